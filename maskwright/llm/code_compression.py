"""Compression of vectors to one code a part, with codebooks by Lloyd's rounds that are kept up by differences.

Each component becomes floor(256 x); a vector is cut into PARTS equal parts, each with a codebook of ENTRIES entries, which starts as that part
of the first kept vectors. The assignment of every part is written with its row. A round compares every part with the new codebooks,
writes the new assignments beside those of the round before, and shuffles only what changed: for each part that moved, its components
with a minus for the old entry and with a plus for the new one, summed in the task that saw them. The running sums and counts, one row an entry,
take these differences and give the next codebooks.

Bounds: codebooks and sums are PARTS * ENTRIES rows of a part's width whatever the input, so they go through the driver. A task holds one batch of rows
and one set of sums. The errors by label are joined by a broadcast only if their counted number is at most BROADCAST_LABELS; beyond, by a shuffled join.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component go; the first vectors are those of the smallest vec_ids, null vec_ids last, rows
of one vec_id by their components; with fewer rows than ENTRIES a codebook has as many entries as there are rows; repeated rows count each; null labels are one
label; a table without rows or without kept rows gives no rows; only the named columns are read. Vectors of other lengths than the first one's, lengths that don't
divide by PARTS, and components of 2^17 or more in size (squared distances would leave 64 bits) are errors that say so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 17
BROADCAST_LABELS = 100_000
_BATCH = 2048


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(batch: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as integers, one row each."""
    lengths = np.diff(np.asarray(batch.offsets))
    if (lengths != width).any():
        raise ValueError(f"all vectors must have the same length: {width} and {int(lengths[lengths != width][0])} were found")
    values = np.asarray(batch.flatten(), np.float64).reshape(-1, width)
    if (np.abs(values) >= LARGEST).any():
        raise ValueError(f"a component of {LARGEST} or more in size: squared distances would not fit 64 bits")
    return np.floor(values * SCALE).astype(np.int64)


def nearest(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """parts: rows x PARTS x width. The index of each part's nearest entry (the lower of equals) and the squared distance."""
    codes = np.empty(parts.shape[:2], np.uint8)
    errors = np.empty(parts.shape[:2], np.int64)
    for m in range(parts.shape[1]):
        d = parts[:, m, None, :] - codebooks[None, m]
        d = np.einsum("nkw,nkw->nk", d, d)
        codes[:, m] = d.argmin(1)
        errors[:, m] = d[np.arange(d.shape[0]), codes[:, m]]
    return codes, errors


def _slices(batches, width: int, parts: int):
    for b in batches:
        for at in range(0, b.num_rows, _BATCH):
            s = b.slice(at, _BATCH)
            yield s, quantised(s.column("vector"), width).reshape(s.num_rows, parts, width // parts)


def _read_codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _write_codes(codes: np.ndarray) -> pa.Array:
    raw, n = np.ascontiguousarray(codes).tobytes(), codes.shape[1]
    return pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary())


def _assign(codebooks: np.ndarray, width: int, first: bool):
    """The rows with their new codes, the codes of the round before (null in the first) and the error."""

    def run(batches):
        for s, parts in _slices(batches, width, codebooks.shape[0]):
            codes, errors = nearest(parts, codebooks)
            before = pa.nulls(s.num_rows, pa.binary()) if first else s.column("code")
            yield pa.record_batch([s.column("vec_id"), s.column("label"), s.column("vector"), before, _write_codes(codes), pa.array(errors.sum(1))], ["vec_id", "label", "vector", "before", "code", "error"])

    return run


def _changes(width: int, n_parts: int, entries: int):
    """For each entry that gained or lost a part in this task: part, entry, n and the sums of components, gains less losses."""

    def run(batches):
        w = width // n_parts
        sums, counts, touched = np.zeros((n_parts * entries, w), np.int64), np.zeros(n_parts * entries, np.int64), np.zeros(n_parts * entries, bool)
        base = np.arange(n_parts) * entries
        for s, parts in _slices(batches, width, n_parts):
            code = _read_codes(s.column("code"), n_parts)
            fresh = s.column("before").null_count > 0
            before = None if fresh else _read_codes(s.column("before"), n_parts)
            moved = np.ones(code.shape, bool) if fresh else code != before
            for sign, which in ((1, code), *(() if fresh else ((-1, before),))):
                at = (which + base)[moved]
                np.add.at(sums, at, sign * parts[moved])
                np.add.at(counts, at, sign)
                touched[at] = True
        at = np.flatnonzero(touched)
        if at.size:
            yield pa.record_batch([pa.array((at // entries).astype(np.int32)), pa.array((at % entries).astype(np.int32)), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _differences(state: DataFrame, width: int, n_parts: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """What a round adds to the running sums and counts of each entry."""
    w = width // n_parts
    rows = state.select("vector", "before", "code").where("before is null or before <> code").mapInArrow(_changes(width, n_parts, entries), "part int, entry int, n long, sums array<long>")
    rows = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(w)]).alias("sums"))
    sums, counts = np.zeros((n_parts, entries, w), np.int64), np.zeros((n_parts, entries), np.int64)
    for part, entry, n, s in rows.collect():  # at most PARTS * ENTRIES rows
        sums[part, entry], counts[part, entry] = s, n
    return sums, counts


def _table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


_STATE = "vec_id {}, label {}, vector array<double>, before binary, code binary, error long"


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """A written table (vec_id, label, code: one byte a part, error) of the kept rows, and the codebooks (parts x entries x width).

    In each round the driver sees the sums of at most parts * entries entries, never rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    vec = F.col(f"`{vector}`")
    kinds = {n: vectors.select(F.col(f"`{c}`").alias(n)).schema[n].dataType for n, c in (("vec_id", vec_id), ("label", label))}
    rows = vectors.where(usable(vec)).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), vec.cast("array<double>").alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, code binary, error long"), np.zeros((parts, 0, 0), np.int64)
    width = len(first[0][0])
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    start = quantised(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    codebooks = start.reshape(-1, parts, width // parts).transpose(1, 0, 2)
    schema = _STATE.format(*(kinds[n].simpleString() for n in ("vec_id", "label")))
    sums, counts = np.zeros_like(codebooks), np.zeros(codebooks.shape[:2], np.int64)
    state, path, old = rows, None, None
    for r in range(rounds + 1):
        columns = state.columns if r == 0 else ["vec_id", "label", "vector", "code"]
        state = state.select(*columns).mapInArrow(_assign(codebooks, width, r == 0), schema)
        if r == rounds:
            out, _ = _table(state.select("vec_id", "label", "code", "error"), "codes")
        else:
            state, path = _table(state, f"assignments-{r}")
            more, n = _differences(state, width, parts, codebooks.shape[1])
            sums, counts = sums + more, counts + n
            used = counts > 0
            codebooks = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], codebooks)
        if old:
            discard(spark, old)
        old = path
    if old:
        discard(spark, old)
    return out, codebooks


def codebooks_text(codebooks: np.ndarray) -> str:
    return ",".join(map(str, codebooks.ravel().tolist()))


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over the rows of the same label (nulls are one label)."""
    sums, _ = _table(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    n = sums.count()
    sums = F.broadcast(sums) if n <= BROADCAST_LABELS else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return label_errors(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """The assignment of round n and, from it, the codebook of the next round."""
    return f"""
, d{n} AS (SELECT p.k, p.m, p.q, c.e, list_sum([(p.q[i] - c.v[i]) * (p.q[i] - c.v[i]) FOR i IN range(1, len(p.q) + 1)])::BIGINT AS d FROM p JOIN c{n} c ON p.m = c.m)
, a{n} AS MATERIALIZED (SELECT k, m, any_value(q) AS q, min(struct_pack(d := d, e := e)) AS x FROM d{n} GROUP BY k, m)
"""


def _book(n: int) -> str:
    return f"""
, s{n} AS (SELECT m, e, i, floor_sum AS v FROM (SELECT m, x.e AS e, i, sum(q[i]) AS s, count(*) AS c, (s - ((s % c) + c) % c) // c AS floor_sum FROM (SELECT m, x, q, unnest(range(1, len(q) + 1)) AS i FROM a{n}) GROUP BY m, x.e, i))
, c{n + 1} AS MATERIALIZED (SELECT c.m, c.e, coalesce(s.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT m, e, list(v::BIGINT ORDER BY i) AS v FROM s{n} GROUP BY m, e) s ON c.m = s.m AND c.e = s.e)
"""


#: the same definition with all distances of every round worked out anew
OP13_SQL = (
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
, p AS MATERIALIZED (SELECT k, m, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding[m * (len(embedding) // 16) + 1 : (m + 1) * (len(embedding) // 16)]] AS q FROM v, (SELECT unnest(range(16)) AS m))
, c0 AS MATERIALIZED (SELECT m, k - 1 AS e, q AS v FROM p WHERE k <= 64)
"""
    + _round(0) + _book(0) + _round(1) + _book(1) + _round(2)
    + """
, r AS (SELECT k, string_agg(printf('%02x', x.e), '' ORDER BY m) AS code, sum(x.d)::BIGINT AS error FROM a2 GROUP BY k)
, h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY m, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (k), h
"""
)

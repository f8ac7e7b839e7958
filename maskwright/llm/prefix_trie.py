"""The trie of conversations that begin alike: one node for each distinct sequence of first turns.

Conversations are rebuilt first: conversation c takes the first h turns of conversation c - c % SHARED, and its own turns from h + 1 on, h = crc32(c in decimal) % MOST.

1. Turns stand for their contents by a 64-bit hash. That no hash stands for two contents is checked on the contents themselves (role and text); where one
   does, its contents are told apart by a second number.
2. The turns are sorted into ranges of conversations. Numpy scans give each turn its place and the polynomial fingerprint of its conversation so far; what a conversation has in
   earlier ranges is added from one row a range. The fingerprints of rebuilt conversations follow from these by shifting them.
3. Rows of one depth and fingerprint are candidates of one node. Each row's turn and parent are compared with those of the group's representative, its smallest conversation.
   Conversations that differ get, from the first such turn on, fingerprints of their own, until every group agrees. As parents were compared, sequences agree turn by turn.
4. Rollup. Every node is counted for its representative, so the nodes of one representative are the end of its path. A node's subtree is what its members' representatives
   own, less what the node's own representative owns above the node: sums of members and one running sum along paths, with no pass for each depth.
5. Members that end at a node are sorted into ranges and hashed as a stream; the first and last nodes of ranges, whose members may stand in several, are sent on in packed pieces and hashed in order.

Memory: no task holds a conversation, a node's members or a depth. A digest over all the members that end at one node is serial by its nature: the pieces of a hot node (about two bytes
a member) pass through one task as a stream.

Edge cases: rows with a null conv_id belong to no conversation and are left out; a null turn comes first; turns of one number stand in the order of role, the first HEAD characters of the text, and a hash
of both; repeated rows are turns each; null role and text are empty; of repeated turns none is dropped; a conversation without turns after rebuilding is a member of the root alone; other columns are ignored;
an empty table has no nodes. Negative conv_ids divide toward zero.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import materialise, mix64

SHARED = 100
MOST = 6
HEAD = 32
BITS = 64
PIECE = 65_536

_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_ROWS = 1 << 14


# ------------------------------------------------------------ numpy

def _power(exponents: np.ndarray) -> np.ndarray:
    """_B to each of the exponents, by squares."""
    out, square, e = np.ones(exponents.size, np.uint64), np.uint64(_B), exponents.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        while e.any():
            np.multiply(out, square, out=out, where=(e & 1).astype(bool))
            square = square * square
            e >>= 1
    return out


def turn_codes(content: np.ndarray, number: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(content.view(np.uint64) + mix64(number.astype(np.uint64) + np.uint64(1)))


def prefix_fingerprints(codes: np.ndarray, first: np.ndarray, place: int, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of turns in order; first marks where a conversation begins, and place and value are those of the turn before."""
    n = codes.size
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(first, at, -1))
    with np.errstate(over="ignore"):
        up, down = _power(at), np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)])
        prefix = np.r_[np.uint64(0), np.cumsum(codes * down)]
        out = (prefix[1:] - prefix[np.maximum(head, 0)]) * up
        early = head < 0  # of the conversation that is going on
        out[early] += _power(at[early] + 1) * np.uint64(value)
    return np.where(early, place + at + 1, at - head + 1), out


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(n)) for n in names]


def _scan(batches):
    """Places and fingerprints within a range."""
    conv, place, value = None, 0, 0
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            b = whole.slice(at, _ROWS)
            c, t, r = _numbers(b, "conv_id", "content", "number")
            first = np.r_[c[:1] != conv if conv is not None else np.ones(1, bool), c[1:] != c[:-1]]
            places, values = prefix_fingerprints(turn_codes(t, r), first, place, value)
            conv, place, value = int(c[-1]), int(places[-1]), int(values[-1])
            yield pa.record_batch([b.column("conv_id"), b.column("part"), pa.array(places.astype(np.int64)), pa.array(values.view(np.int64)), *map(b.column, ("content", "number", "chars"))], ["conv_id", "part", "place", "value", "content", "number", "chars"])


def _carried(ends: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """part: (conversation, place, value) of the turn before each range that begins inside a conversation. ends: part, first conversation, (last conversation, place, value)."""
    out, conv, place, value = {}, None, 0, 0
    for part, first, (last, at, v) in sorted(ends):
        if first == conv:
            out[part] = conv, place, value
        if last == conv:
            value = (value * pow(_B, at, 1 << 64) + v) % (1 << 64)
            place += at
        else:
            conv, place, value = last, at, v % (1 << 64)
    return out


def _whole(carried: dict[int, tuple[int, int, int]]):
    """The rows of _scan with places and fingerprints from the beginnings of conversations."""

    def run(batches):
        for b in batches:
            c, part, place, value = _numbers(b, "conv_id", "part", "place", "value")
            place, value = place.copy(), value.view(np.uint64).copy()
            for p in np.unique(part).tolist():
                if p in carried:
                    conv, at, v = carried[p]
                    mine = (part == p) & (c == conv)
                    with np.errstate(over="ignore"):
                        value[mine] += _power(place[mine]) * np.uint64(v)
                    place[mine] += at
            yield pa.record_batch([b.column("conv_id"), pa.array(place), pa.array(value.view(np.int64)), *map(b.column, ("content", "number", "chars"))], ["conv_id", "place", "value", "content", "number", "chars"])

    return run


def _keys(bits: int):
    """Keys of rebuilt prefixes and of their parents: (joined - own) * _B ** beyond + value."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        for b in batches:
            joined, own, beyond, value, t, r = _numbers(b, "joined", "own", "beyond", "value", "content", "number")
            with np.errstate(over="ignore"):
                f = (joined.view(np.uint64) - own.view(np.uint64)) * _power(beyond) + value.view(np.uint64)
                up = (f - turn_codes(t, r)) * np.uint64(_INVERSE)
            up = np.where(np.asarray(b.column("depth")) == 1, np.uint64(0), up)  # the root
            yield pa.record_batch([*map(b.column, ("conv_id", "depth")), pa.array((f & mask).view(np.int64)), pa.array((up & mask).view(np.int64)), *map(b.column, ("content", "number", "chars", "last"))], ["conv_id", "depth", "key", "up", "content", "number", "chars", "last"])

    return run


# ------------------------------------------------------------ turns and rebuilt conversations

def _clashes(contents: DataFrame) -> DataFrame:
    """content, role, text and number (from 1) of all but the first of the contents that share a hash."""
    several = contents.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content")
    return contents.join(several, "content").withColumn("number", F.row_number().over(Window.partitionBy("content").orderBy("role", "text")) - 1).where("number > 0")


def turns(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """conv_id, place (from 1), value (fingerprint of the turns so far), content, number and chars of every turn."""
    hashed = F.xxhash64("role", "text").bitwiseAND(F.lit(-1 if bits == 64 else (1 << bits) - 1))
    d = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).withColumn("content", hashed)
    clashes = materialise(_clashes(d.select("content", "role", "text").distinct()), "trie-clashes")
    if clashes.isEmpty():
        d = d.withColumn("number", F.lit(0))
    else:
        d = d.join(clashes, ["content", "role", "text"], "left").withColumn("number", F.coalesce("number", F.lit(0)))
    light = d.select("conv_id", "turn", "role", F.left("text", F.lit(HEAD)).alias("head"), "content", F.col("number").cast("int").alias("number"), F.length("text").cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "head", "content", "number"))]
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), "content", "number", "chars")
    local = materialise(ranged.mapInArrow(_scan, "conv_id long, part int, place long, value long, content long, number int, chars long"), "trie-turns")
    ends = local.groupBy("part").agg(F.min("conv_id"), F.max(F.struct("conv_id", "place", "value"))).collect()  # a row for each range
    return local.mapInArrow(_whole(_carried([(p, f, tuple(e)) for p, f, e in ends])), "conv_id long, place long, value long, content long, number int, chars long")


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST


def rebuilt(all_turns: DataFrame, bits: int = BITS) -> DataFrame:
    """A written table of the turns of rebuilt conversations and of the root (depth 0): conv_id, depth, key, up, content, number, chars, last."""
    t = all_turns.withColumn("h", shared_turns(F.col("conv_id")))
    convs = t.groupBy("conv_id", "h").agg(F.max("place").alias("n"), F.max(F.when(F.col("place") == F.col("h"), F.col("value"))).alias("own"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED)
    turn = F.struct("place", "value", "content", "number", "chars")
    heads = t.where((F.col("conv_id") % SHARED == 0) & (F.col("place") < MOST)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("heads"))  # MOST - 1 turns at most
    convs = convs.join(heads, "base", "left").withColumn("heads", F.when(F.col("heads").isNull() | (F.col("h") == 0), F.array().cast(heads.schema["heads"].dataType)).otherwise(F.slice("heads", F.lit(1), F.col("h").cast("int"))))
    taken = F.size("heads").cast("long")
    convs = convs.select("conv_id", "h", taken.alias("taken"), F.coalesce(F.try_element_at("heads", F.lit(-1))["value"], F.lit(0)).alias("joined"), F.coalesce("own", F.lit(0)).alias("own"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), "heads")
    convs = materialise(convs, "trie-conversations")
    own = all_turns.join(convs.drop("heads"), "conv_id").where(F.col("place") > F.col("h"))
    beyond = F.col("place") - F.col("h")
    own = own.select("conv_id", (F.col("taken") + beyond).alias("depth"), "joined", "own", beyond.alias("beyond"), "value", "content", "number", "chars", "length")
    zero = F.lit(0).cast("long")
    first = convs.select("conv_id", "length", F.inline("heads")).select("conv_id", F.col("place").alias("depth"), zero.alias("joined"), zero.alias("own"), zero.alias("beyond"), "value", "content", "number", "chars", "length")
    rows = own.unionByName(first).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    schema = "conv_id long, depth long, key long, up long, content long, number int, chars long, last boolean"
    root = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "key", "up", "content")], F.lit(0).alias("number"), zero.alias("chars"), (F.col("length") == 0).alias("last"))
    return materialise(rows.mapInArrow(_keys(bits), schema).unionByName(root), "trie-rows")


# ------------------------------------------------------------ nodes

_COMPARED = ("content", "number", "up")


def _candidates(rows: DataFrame) -> DataFrame:
    both = [f(c).alias(f"{n}_{c}") for c in _COMPARED for n, f in (("least", F.min), ("most", F.max))]
    agrees = F.lit(True)
    for c in _COMPARED:
        agrees = agrees & (F.col(f"least_{c}") == F.col(f"most_{c}"))
    g = rows.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *both)
    return g.select("depth", "key", "conv_id", "n_convs", "chars", F.col("least_up").alias("up"), agrees.alias("agrees"))


def _split(rows: DataFrame, mixed: DataFrame, again: int) -> DataFrame:
    """New keys, from the first turn on at which a conversation differs from the representative of its group."""
    like = [F.col(c).alias(f"its_{c}") for c in _COMPARED]
    reps = rows.join(mixed.select("depth", "key", "conv_id"), ["depth", "key", "conv_id"]).select("depth", "key", *like)
    differs = F.lit(False)
    for c in _COMPARED:
        differs = differs | (F.col(c) != F.col(f"its_{c}"))
    found = rows.join(reps, ["depth", "key"]).where(differs).select("conv_id", F.struct("depth", F.xxhash64(F.lit(again), "depth", "key", *_COMPARED).alias("mark")).alias("at"))
    found = materialise(found.groupBy("conv_id").agg(F.min("at").alias("at")), "trie-splits")
    new = lambda c, here: F.when(here, F.xxhash64(c, "at.mark")).otherwise(F.col(c))
    from_ = F.coalesce(F.col("depth") >= F.col("at.depth"), F.lit(False))
    below = F.coalesce(F.col("depth") > F.col("at.depth"), F.lit(False))
    return materialise(rows.join(found, "conv_id", "left").withColumns({"key": new("key", from_), "up": new("up", below)}).drop("at"), "trie-rows")


def nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the rows with keys that stand for one sequence each, and the nodes (depth, key, conv_id, n_convs, chars, up)."""
    again = 0
    while True:
        found = materialise(_candidates(rows), "trie-nodes")
        mixed = found.where("not agrees")
        if mixed.isEmpty():
            return rows, found.drop("agrees")
        again += 1
        rows = _split(rows, mixed, again)


def _digest_ranges(batches):
    """(depth, key, ends_sha256) of the nodes inside a range; of its first and last node (depth, key, part, n, packed members)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out, node, state, pieces, held, first = [], None, None, [], [], True

    def packed():
        nonlocal held
        if held:
            text = b",".join(str(i).encode() for i in held)
            state.update((b"," if pieces else b"") + text)
            pieces.append(zlib.compress(text, 1))
            held = []

    def close(last: bool):
        nonlocal pieces, first
        if node is None:
            return
        packed()
        if first or last:
            out.extend((*node, None, part, n, p) for n, p in enumerate(pieces))
        else:
            out.append((*node, state.hexdigest(), None, None, None))
        pieces, first = [], False

    def flush():
        rows, out[:] = list(out), []
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["depth", "key", "ends_sha256", "part", "n", "members"]).to_batches()

    for b in batches:
        for d, k, c in zip(*(b.column(n).to_pylist() for n in ("depth", "key", "conv_id")), strict=True):
            if (d, k) != node:
                close(False)
                node, state = (d, k), hashlib.sha256()
            held.append(c)
            if len(held) >= PIECE:
                packed()
        if len(out) >= _ROWS:
            yield from flush()
    close(True)
    if out:
        yield from flush()


def _digest_pieces(batches):
    node, state, out = None, None, []
    for b in batches:
        for d, k, m in zip(*(b.column(n).to_pylist() for n in ("depth", "key", "members")), strict=True):
            if (d, k) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, k), hashlib.sha256()
            else:
                state.update(b",")
            state.update(zlib.decompress(m))
    if node is not None:
        out.append((*node, state.hexdigest()))
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "key", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """depth, key and ends_sha256 of the nodes at which a conversation ends."""
    by = ["depth", "key", "conv_id"]
    e = rows.where("last").select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    e = materialise(e.mapInArrow(_digest_ranges, "depth long, key long, ends_sha256 string, part int, n int, members binary"), "trie-ends")
    pieces = e.where("members is not null").select("depth", "key", "part", "n", "members").repartition("depth", "key").sortWithinPartitions("depth", "key", "part", "n")
    pieces = pieces.mapInArrow(_digest_pieces, "depth long, key long, ends_sha256 string")
    return e.where("members is null").select("depth", "key", "ends_sha256").unionByName(pieces)


def rolled_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with what their subtrees hold."""
    at = ["depth", "key"]
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    full = found.join(children, at, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    full = materialise(full, "trie-children")
    owned = full.groupBy("conv_id").agg(F.sum("saved").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).where("owned > 0 or leaf > 0")
    below = rows.select("conv_id", *at).join(owned, "conv_id").groupBy(*at).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))
    along = running(full, ["conv_id"], ["depth"], None, {"so_far": "saved"})
    parents = found.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("conv_id").alias("above"))
    root = found.where("depth = 0").select("conv_id").first()
    top = F.lit(root[0] if root else None).cast("long")  # the root has all depth-1 nodes as children: no join for them
    out = along.join(below, at, "left").join(ends(rows), at, "left").join(parents, ["depth", "up"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, top).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("owned") - F.col("so_far") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each node; bits is the width of the hashes of contents and prefixes (less only to force collisions)."""
    return rolled_up(*nodes(rebuilt(turns(conversations, bits), bits)))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = """
WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL)
, crc(c, s, i, x) AS (SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM o
  UNION ALL SELECT c, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE x END AS y FROM crc WHERE i < 8 * length(s)))
, h AS MATERIALIZED (SELECT c, xor(x, 4294967295::BIGINT) % 6 AS h FROM crc WHERE i = 8 * length(s))
, t AS (SELECT c, p AS k, role, text FROM h JOIN o ON o.conv_id = c - c % 100 AND p <= h UNION ALL SELECT c, 10 + p, role, text FROM h JOIN o ON o.conv_id = c AND p > h)
, l AS MATERIALIZED (SELECT c, list({'r': role, 't': text} ORDER BY k) FILTER (WHERE k IS NOT NULL) AS whole FROM h LEFT JOIN t USING (c) GROUP BY c)
, w AS MATERIALIZED (SELECT c, coalesce(whole, []) AS whole, unnest(range(0, coalesce(len(whole), 0) + 1)) AS d FROM l)
, m AS MATERIALIZED (SELECT c, d, len(whole) AS n, whole[1 : d] AS path FROM w)
, v AS MATERIALIZED (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(path[d].t) END AS saved FROM m GROUP BY path, d)
, k AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL)
, f AS MATERIALIZED (SELECT v.*, coalesce(k.n, 0) AS n_children, unnest(range(0, v.d + 1)) AS above FROM v LEFT JOIN k ON v.d = k.d AND v.path = k.path)
, s AS (SELECT path[1 : above] AS path, above AS d, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM f GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s ON v.d = s.d AND v.path = s.path LEFT JOIN k ON v.d = k.d AND v.path = k.path LEFT JOIN v u ON v.d > 0 AND u.d = v.d - 1 AND u.path = v.path[1 : v.d - 1]
"""

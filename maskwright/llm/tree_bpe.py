"""Byte-level BPE encoding by tree concatenation, and decoding from ids.

Short texts are encoded in place, from cached pieces. A text longer than `leaf` characters becomes leaves of that length,
cut anywhere, which tasks encode independently; the leaves of a text are then joined pairwise, as a tree.
At a join the last pre-tokens of the left side (a contraction may need three characters) are scanned again together with a growing window of the right
side, until a boundary of the scan is a boundary of the right side too: from there both agree, for the
pattern never looks back. If the pre-tokens that were cut form one long pre-token, their ids are joined in the same way
a level below: the last ids of the left and the first of the right are encoded again as one window, which grows until
its first and last ids are those that stood there. Then every adjacent pair of ids is one that the merges leave as it is,
and a sequence with this property is the encoding.

Edge cases: a null text is empty and has no ids; repeated doc_ids are separate rows; long texts with special-token
strings are encoded whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_or_empty
from .encoders import ALPHABET, ByteEncoder, encoder, ids_bytes, load, tokenizer_path

LEAF = 32_768
SPECIAL = "<|endoftext|>"
LOOK = 3  # the pattern looks at so many characters from where it stands, besides what it takes


class TreeEncoder:
    """A side is (starts, ids, end): for each pre-token its start in the text and its list of ids, and where the side ends."""

    def __init__(self, path: str):
        self.library = load(path)
        self.model, self.pre = self.library.model, self.library.pre_tokenizer
        self.cache: dict[str, list[int]] = {}

    def _bpe(self, mapped: str) -> list[int]:
        ids = self.cache.get(mapped)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(mapped)]
            if len(mapped) < 64:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[mapped] = ids
        return ids

    def leaf(self, text: str, base: int = 0) -> tuple[list[int], list[list[int]], int]:
        """Encodes text as if it stood alone; base is added to the starts."""
        starts, ids = [], []
        for mapped, (a, _) in self.pre.pre_tokenize_str(text):
            starts.append(base + a)
            ids.append(self.halves(mapped))
        return starts, ids, base + len(text)

    def halves(self, mapped: str, most: int = 2048) -> list[int]:
        """One pre-token (in the library's byte alphabet): long ones are halved, and the halves joined."""
        if len(mapped) <= most:
            return self._bpe(mapped)
        m = len(mapped) // 2
        return self.join_ids(self.halves(mapped[:m], most), self.halves(mapped[m:], most))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two parts of one pre-token, from the encodings of the parts."""
        if not left or not right:
            return left + right
        token = self.model.id_to_token if hasattr(self.model, "id_to_token") else self.library.id_to_token
        k = 4
        while True:
            i, j = min(k, len(left)), min(k, len(right))
            window = [t.id for t in self.model.tokenize("".join(map(token, left[-i:] + right[:j])))]
            if (i == len(left) or window[0] == left[-i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:-i] + window + right[j:]
            k *= 2

    def join(self, text: str, left, right):
        """Joins two adjacent sides of text."""
        (ls, li, _), (rs, ri, end) = left, right
        if not ls or not rs:
            return ls + rs, li + ri, end
        cut, span = rs[0], 64
        k = max(0, bisect_right(ls, cut - LOOK) - 1)  # the last boundary that no match before it found by looking past the cut
        s = ls[k]
        while True:
            to = min(end, cut + span)
            scan = [(m, s + a, s + b) for m, (a, b) in self.pre.pre_tokenize_str(text[s:to])]
            if to < end:
                scan.pop()  # more text may change the last pre-token
            meet = None
            for n, (_, _, b) in enumerate(scan):
                at = bisect_left(rs, b)
                if b > cut and at < len(rs) and rs[at] == b:
                    meet = n, at
                    break
            if meet is None and to == end:
                meet = len(scan) - 1, len(rs)
            if meet is not None:
                break
            span *= 4
        n, at = meet
        starts, ids = ls[:k], li[:k]
        for mapped, a, b in scan[: n + 1]:
            starts.append(a)
            # one pre-token made of exactly one pre-token of each side: its ids come from theirs
            whole = a == ls[-1] and b == (rs[1] if len(rs) > 1 else end)
            ids.append(self.join_ids(li[-1], ri[0]) if whole else self.halves(mapped))
        return starts + rs[at:], ids + ri[at:], end

    def tree(self, text: str, sides: list):
        """Joins the sides of consecutive leaves pairwise until one is left."""
        while len(sides) > 1:
            sides = [self.join(text, *sides[i : i + 2]) if i + 1 < len(sides) else sides[i] for i in range(0, len(sides), 2)]
        return sides[0] if sides else ([], [], 0)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Whole texts, special tokens as the library has them."""
        if SPECIAL in text:
            return self.library.encode(text, add_special_tokens=False).ids
        sides = [self.leaf(text[a : a + leaf], a) for a in range(0, len(text), leaf)]
        return [x for ids in self.tree(text, sides)[1] for x in ids]


_TREES: dict[str, TreeEncoder] = {}
_BYTES: dict[str, list[bytes]] = {}


def tree_encoder(path: str) -> TreeEncoder:
    if path not in _TREES:
        _TREES[path] = TreeEncoder(path)
    return _TREES[path]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: ids of the byte alphabet undone, special tokens as they are written."""
    if path not in _BYTES:
        library = load(path)
        alphabet = {c: b for b, c in ALPHABET.items()}
        special = library.get_added_tokens_decoder()
        _BYTES[path] = [special[i].content.encode() if i in special else bytes(alphabet[c] for c in library.id_to_token(i)) for i in range(library.get_vocab_size())]
    return _BYTES[path]


def decode(ids, path: str) -> str:
    return b"".join(map(token_bytes(path).__getitem__, ids)).decode("utf-8", "replace")


_COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(doc, ids: bytes, path: str) -> tuple:
    text = decode(np.frombuffer(ids, "<u4").tolist(), path)
    return doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _batch(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]


def _short(path: str):
    def run(batches):
        for b in chunks(batches):
            ids = encoder(ByteEncoder, path).encode(b.column("text"))
            yield pa.record_batch(_batch([_digest(d, x, path) for d, x in zip(b.column("doc_id").to_pylist(), ids, strict=True)]), _COLUMNS)

    return run


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _numbers(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _leaves(path: str, leaf: int):
    def run(batches):
        tree = tree_encoder(path)
        for b in chunks(batches, "part"):
            out = []
            for row, doc, no, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "no", "part")), strict=True):
                starts, ids, _ = tree.leaf(text, no * leaf)
                cols = (np.diff(starts, prepend=no * leaf), [len(x) for x in ids], [y for x in ids for y in x])
                out.append((row, doc, no, *map(_squeeze, (text.encode(), *(np.asarray(c, "<u4").view("u1").reshape(-1, 4).T.tobytes() for c in cols)))))
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["row", "doc_id", "no", "part", "starts", "sizes", "ids"])

    return run


def _joined(path: str, leaf: int):
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        parts = [zstandard.ZstdDecompressor().decompress(r["part"]).decode() for r in rows]
        sides = []
        for r, part in zip(rows, parts, strict=True):
            ids, ends = _numbers(r["ids"]).tolist(), np.cumsum(_numbers(r["sizes"])).tolist()
            starts = (np.cumsum(_numbers(r["starts"])) + r["no"] * leaf).tolist()
            sides.append((starts, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], r["no"] * leaf + len(part)))
        ids = [y for x in tree_encoder(path).tree("".join(parts), sides)[1] for y in x]
        return pa.table(_batch([_digest(rows[0]["doc_id"], ids_bytes(ids), path)]), _COLUMNS)

    return run


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    long = (F.length("text") > leaf) & ~F.contains("text", F.lit(SPECIAL))
    short = rows.where(~long).mapInArrow(_short(path), _SCHEMA)
    # a text is known by its row's own number, as doc_ids may repeat
    many = rows.where(long).withColumn("row", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id()))
    parts = many.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), ((F.length("text") - 1) / leaf).cast("long"))).alias("no"))
    parts = parts.select("row", "doc_id", "no", F.substring("text", (F.col("no") * leaf + 1).cast("int"), F.lit(leaf)).alias("part"))
    leaves = parts.repartition("row", "no").mapInArrow(_leaves(path, leaf), "row string, doc_id long, no long, part binary, starts binary, sizes binary, ids binary")
    return short.unionByName(leaves.groupBy("row").applyInArrow(_joined(path, leaf), _SCHEMA))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))

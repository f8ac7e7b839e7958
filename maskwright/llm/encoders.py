"""Library tokenizers behind a cache of short text pieces, for whole columns of text.

A piece is cached only where the cut can't change the library's result: for the byte-level tokenizer
before a space that is followed by something other than white space (its pattern starts a new token
there whatever stands before), for the word tokenizer at spaces and newlines (it drops them). Texts
with other white space next to such a cut, or with special-token strings, are encoded whole by the library.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tidy

CACHE_PIECES = 400_000
_LOADED: dict[tuple, object] = {}
#: caches of a worker process by the work they serve; only one kind of work keeps its caches at a time
_CACHES: dict[str, object] = {}


def cached(work: str, make):
    """make(), kept until another kind of work begins in this process."""
    if work not in _CACHES:
        _CACHES.clear()
        gc.collect()
        tidy()
        _CACHES[work] = make()
    return _CACHES[work]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load(path: str):
    """The library's tokenizer of a file, once for each process, without its truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if ("raw", path) not in _LOADED:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED["raw", path] = t
    return _LOADED["raw", path]


def ids_bytes(ids) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces(dict):
    """piece -> ids, filled on first use. Two generations: when the young one is full it becomes the old one, and pieces seen again move over."""

    def __init__(self, learn, size: int = CACHE_PIECES):
        self.learn, self.size, self.old = learn, size, {}

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.old[piece] if piece in self.old else self.learn(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


#: the byte alphabet of byte-level tokenizers: printable bytes stand for themselves
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def mapped(text: str) -> str:
    return text.encode().decode("latin-1").translate(ALPHABET)


# fixed values: letters whose lower case and composed form are one letter each; all of ASCII's marks but the apostrophe
_LETTERS = "A-Za-zÀ-ÖØ-Þß-öø-ÿ"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def strings(column: pa.Array) -> list[str]:
    """The same as to_pylist(), in a third of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Flat:
    """Rows of ids laid end to end."""

    def __init__(self, rows: list[bytes]):
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.frombuffer(b"".join(rows), "<u4")

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows at the given places, end to end, and where each ends."""
        n = self.sizes[at]
        stops = np.cumsum(n)
        total = int(stops[-1]) if n.size else 0
        return self.ids[np.repeat(self.starts[at] - (stops - n), n) + np.arange(total)], stops

    def joined(self, columns: list[np.ndarray]) -> _Flat:
        """Rows made of the rows at the places of the columns, one behind the other."""
        out = _Flat([])
        out.ids, stops = self.take(np.stack(columns, 1).ravel())
        ends = stops[len(columns) - 1 :: len(columns)]
        out.sizes = np.diff(ends, prepend=0)
        out.starts = ends - out.sizes
        return out


class PieceEncoder:
    """encode(texts) -> for each text its ids as little-endian 32-bit integers.

    Arrow splits a block of texts into pieces and numbers them. A distinct piece is a word and the marks behind it, both
    looked up in caches, or something else, which the library encodes; the ids of all places are gathered at once.
    """

    block = 4 << 20  # bytes

    def __init__(self, path: str, size: int = CACHE_PIECES):
        self.library, self.size = load(path), size
        self.words: dict[str, bytes] = {}
        self.marks = Pieces(self.token, 10_000).__getitem__
        self.others = Pieces(self.other, 100_000).__getitem__

    def whole(self, text: str) -> bytes:
        return ids_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def token(self, text: str) -> bytes:
        """The ids of what is known to be one pre-token."""
        return ids_bytes([t.id for t in self.library.model.tokenize(mapped(text))])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.block, "right")))
            out += self._block(texts.slice(at, to - at))
        return out

    def _block(self, texts: pa.Array) -> list[bytes]:
        lists = self.split(texts)
        cuts = np.asarray(lists.offsets, np.int64)
        pieces = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        cuts = cuts - cuts[0]
        rows, unsafe = self.rows(pieces.dictionary)
        at = np.asarray(pieces.indices, np.int64)
        raw, ends = self.laid(texts, pieces, rows, at, cuts)
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        again = self.special(texts)
        if unsafe.any():
            bad = np.flatnonzero(unsafe[at])
            again |= set((np.searchsorted(cuts, bad, "right") - 1)[self.counts(bad, cuts)].tolist())
        for i in again:
            out[i] = self.whole(texts[i].as_py())
        return out

    def laid(self, texts: pa.Array, pieces: pa.DictionaryArray, rows: _Flat, at: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
        ids, stops = rows.take(at)
        return ids.tobytes(), 4 * np.r_[0, stops][cuts]

    def counts(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Whether an unsafe piece at a place spoils its text."""
        return np.ones(places.size, bool)

    def rows(self, distinct: pa.Array) -> tuple[_Flat, np.ndarray]:
        """The ids of distinct pieces, and which of them have an unsafe cut beside them."""
        line, body = self.body(distinct)
        word = pc.utf8_rtrim(body, characters=_MARKS)
        simple = np.asarray(pc.match_substring_regex(word, self.pattern).cast(pa.int8()), bool) & ~np.asarray(pc.match_substring(distinct, "<|").cast(pa.int8()), bool)
        places = np.flatnonzero(simple)
        codes = self.spelled(word.take(pa.array(places)), line[places]).dictionary_encode()
        words = strings(codes.dictionary)
        if len(self.words) > self.size:
            self.words = {}
        if new := [w for w in words if w not in self.words]:
            self.learn(new)
        ids = [b"", *self.lines(), *map(self.words.__getitem__, words)]
        base = len(ids) - len(words)
        first, second, third = line * 1, np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        second[places] = base + np.asarray(codes.indices, np.int64)
        n = np.asarray(pc.utf8_length(body), np.int64) - np.asarray(pc.utf8_length(word), np.int64)
        marked = np.flatnonzero(simple & (n > 0))
        if marked.size:
            tails = pa.array([t[-k:] for t, k in zip(strings(body.take(pa.array(marked))), n[marked].tolist(), strict=True)], pa.string()).dictionary_encode()
            third[marked] = len(ids) + np.asarray(tails.indices, np.int64)
            ids += map(self.marks, tails.dictionary.to_pylist())
        unsafe = np.zeros(len(distinct), bool)
        for i, p in zip((others := np.flatnonzero(~simple)).tolist(), strings(distinct.take(pa.array(others))), strict=True):
            first[i] = 0
            own = self.others(p)
            if own is None:
                unsafe[i] = True
            else:
                second[i] = len(ids)
                ids.append(own)
        return _Flat(ids).joined([first, second, third]), unsafe

    def lines(self) -> list[bytes]:
        """Ids that may stand before a word."""
        return []

    def body(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Whether a piece begins with a newline, and what follows it."""
        return np.zeros(len(distinct), np.int64), distinct

    def spelled(self, words: pa.Array, line: np.ndarray) -> pa.Array:
        """The words as they are looked up."""
        raise NotImplementedError

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def other(self, piece: str) -> bytes | None:
        """The ids of a piece; None if a cut beside it isn't safe."""
        raise NotImplementedError

    def split(self, texts: pa.Array) -> pa.ListArray:
        raise NotImplementedError

    def special(self, texts: pa.Array) -> set[int]:
        """The texts that only the library may cut."""
        return set()


class ByteEncoder(PieceEncoder):
    """Pieces begin behind a space, or with a newline that stands where the space would."""

    pattern = f"^([{_LETTERS}]+|[0-9]+)$"

    def __init__(self, path: str, size: int = CACHE_PIECES):
        super().__init__(path, size)
        from tokenizers import Tokenizer

        self.first = Pieces(self.whole, 50_000).__getitem__
        self.bare = Tokenizer(self.library.model)
        space = ALPHABET[32]
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.opens = np.array([n[:1] == space for n in names])
        #: no token has a space behind a letter, digit or mark, so no merge reaches over the beginning of a word
        self.groups = 64 if not any(re.search(f"[!-~]{space}", n) for n in names) else 1

    def learn(self, words: list[str]) -> None:
        spaced = [w for w in words if w[0] == " "]
        for k in range(0, len(spaced), self.groups):
            group = spaced[k : k + self.groups]
            ids = np.array(self.bare.encode(mapped("".join(group)), add_special_tokens=False).ids, "<u4")
            cuts = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * ids.size]
            raw = ids.tobytes()
            self.words.update((w, raw[a:b]) for w, a, b in zip(group, cuts[:-1], cuts[1:], strict=True))
        self.words.update((w, self.token(w)) for w in words if w[0] != " ")

    def other(self, piece: str) -> bytes | None:
        if piece[:1] == "\n":
            return None if piece == "\n" or piece[1].isspace() else self.whole(piece)
        return None if not piece or piece[0].isspace() else self.whole(" " + piece)

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")

    def lines(self) -> list[bytes]:
        return [self.marks("\n")]

    def body(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array]:
        return np.asarray(pc.starts_with(distinct, "\n").cast(pa.int64()), np.int64), pc.utf8_ltrim(distinct, characters="\n")

    def spelled(self, words: pa.Array, line: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(pc.if_else(pa.array(line > 0), "", " "), words, "")

    def laid(self, texts: pa.Array, pieces: pa.DictionaryArray, rows: _Flat, at: np.ndarray, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The first piece of a text has no space before it."""
        heads = _Flat(list(map(self.first, pieces.take(pa.array(cuts[:-1])).to_pylist())))
        both = _Flat([])
        both.sizes, both.starts = np.r_[rows.sizes, heads.sizes], np.r_[rows.starts, rows.ids.size + heads.starts]
        both.ids = np.concatenate([rows.ids, heads.ids])
        at = at.copy()
        at[cuts[:-1]] = rows.sizes.size + np.arange(len(texts))
        return super().laid(texts, pieces, both, at, cuts)

    def counts(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return ~np.isin(places, cuts[:-1])

    def special(self, texts: pa.Array) -> set[int]:
        return set(np.flatnonzero(np.asarray(pc.match_substring(texts, "<|").cast(pa.int8()))).tolist())


class WordEncoder(PieceEncoder):
    """Pieces stand between spaces and newlines, which have no ids."""

    pattern = f"^[{_LETTERS}]+$"

    def learn(self, words: list[str]) -> None:
        self.words.update((w, self.token(w)) for w in words)

    def other(self, piece: str) -> bytes:
        return self.whole(piece)

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def spelled(self, words: pa.Array, line: np.ndarray) -> pa.Array:
        return pc.utf8_lower(words)


def encoder(kind: type[PieceEncoder], path: str) -> PieceEncoder:
    return cached(f"{kind.__name__} {path}", lambda: kind(path))

"""Operator 5: byte-level BPE encoding and decoding by merges over length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

#: Matrix widths; a piece goes to the narrowest that holds its bytes. Longer pieces are merged by a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Cells of one matrix, which bounds memory whatever the batch holds.
CELLS = 1 << 18
#: Code points of text that are encoded together.
SLICE = 2 << 20

NONE = np.int64(1) << 40
_PAD = -1
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Token ranks with a hash table from pairs of adjacent tokens to the token that their bytes make.

    ranks: the text of a rank file, a base64 token and its rank per line; every single byte must have a rank.
    """

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        self.any_plane, self.first_plane = regex.compile(pattern), first_plane(pattern)
        by_id = sorted((r, t) for t, r in self.ranks.items())
        top = by_id[-1][0] + 1
        self.lengths = np.zeros(top, np.int64)
        for r, t in by_id:
            self.lengths[r] = len(t)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left = get(token[:i])
                if left is not None and (right := get(token[i:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._table(np.array(keys, np.uint64), np.array(values, np.int64))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: every pending key tries its next slot until all have one."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slot_key = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_rank = np.full(1 << self.bits, NONE)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot_rank[at[todo]] == NONE
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that left and right make, NONE where there is none (or either is padding)."""
        out = np.full(left.shape, NONE)
        real = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = left.ravel()[real].astype(np.uint64) << np.uint64(32) | right.ravel()[real].astype(np.uint64)
        at, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            slot = self.slot_key[at]
            hit = slot == keys
            flat[real[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (self.slot_rank[at] != NONE)
            if not on.any():
                break
            real, keys, at = real[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_matrix(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a padded byte matrix, left-aligned, and how many each has.

        Each round merges the leftmost pair of least rank in every row that has one, and closes the gap; rows without
        such a pair leave, and columns that no row uses any more are cut off.
        """
        wide = raw.shape[1]
        ids = np.where(np.arange(wide) < size[:, None], self.of_byte[raw], _PAD)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out, out_size, rows = np.full(raw.shape, _PAD), size.copy(), np.arange(len(raw))
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            on = best != NONE
            if not on.all():
                out[rows[~on], :wide] = ids[~on]
                out_size[rows[~on]] = size[~on]
                rows, size, at, best = rows[on], size[on], at[on], best[on]
                if not len(rows):
                    break
                wide = int(size.max())
                ids, ranks = ids[on][:, :wide], ranks[on][:, : wide - 1]
            every = np.arange(len(rows))
            gap = np.arange(1, wide) > at[:, None]
            ids = np.concatenate((np.where(gap, ids[:, 1:], ids[:, :-1]), np.full((len(rows), 1), _PAD)), 1)[:, : wide - 1 or 1]
            gap[:, :-1] = gap[:, 1:]
            shifted = np.concatenate((ranks[:, 1:], np.full((len(rows), 1), NONE)), 1)
            ranks = np.where(np.arange(wide - 1) > at[:, None] - 0.5, shifted, ranks)
            size = size - 1
            before = np.maximum(at - 1, 0)
            wide -= 1
            ids[every, at] = best
            after = np.minimum(at + 1, wide - 1)
            right = np.where(at + 1 < wide, ids[every, after], _PAD)
            ranks[every, at] = self.pair_ranks(best, right)
            left = self.pair_ranks(np.where(at > 0, ids[every, before], _PAD), best)
            ranks[every[at > 0], before[at > 0]] = left[at > 0]
            ranks = ranks[:, : max(1, wide - 1)]
            if wide == 1:
                ranks = np.full((len(rows), 1), NONE)
        return out, out_size

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = first.tolist() + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(ranks) if r < NONE]
        heapq.heapify(heap)
        get, names = self.ranks.get, self.token
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue
            j = after[i]
            ids[i], after[i] = rank, after[j]
            ranks[j], ids[j] = -1, -1
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    m = after[k]
                    ranks[k] = int(NONE) if m >= n else get(names(ids[k]) + names(ids[m]), int(NONE))
                    if ranks[k] < NONE:
                        heapq.heappush(heap, (ranks[k], k))
        return np.array([x for x in ids if x >= 0], np.int64)

    def token(self, rank: int) -> bytes:
        return self.bytes[self.starts[rank] : self.starts[rank] + self.lengths[rank]].tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, and where those of each piece start and how many they are."""
        n = len(pieces)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, n)
        length = np.fromiter(map(len, pieces), np.int64, n)
        start, size = np.zeros(n, np.int64), np.ones(n, np.int64)
        one = np.flatnonzero(whole >= 0)
        start[one] = np.arange(len(one))
        flats, total = [whole[one]], len(one)
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(length) - length
        low = 0
        for width in WIDTHS:
            where = np.flatnonzero((whole < 0) & (length > low) & (length <= width))
            low = width
            for k in range(0, len(where), CELLS // width):
                part = where[k : k + CELLS // width]
                cells = np.arange(width) < length[part][:, None]
                raw = np.zeros(cells.shape, np.uint8)
                raw[cells] = ragged(joined, begin[part], length[part])
                ids, sizes = self._merge_matrix(raw, length[part])
                flats.append(ids[np.arange(width) < sizes[:, None]])
                start[part], size[part] = total + np.cumsum(sizes) - sizes, sizes
                total += len(flats[-1])
        for i in np.flatnonzero((whole < 0) & (length > WIDTHS[-1])):
            flats.append(self._merge_long(pieces[i]))
            start[i], size[i] = total, len(flats[-1])
            total += size[i]
        return np.concatenate(flats), start, size

    def pieces(self, text: str) -> list[str]:
        low = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.first_plane if low else self.any_plane).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: pieces of all texts are told apart, each distinct one is merged once."""
        number: dict[str, int] = defaultdict(count().__next__)
        where = [np.array(list(map(number.__getitem__, self.pieces(t))), np.int64) for t in texts]
        flat, start, size = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in number])
        return [ragged(flat, start[w], size[w]) for w in where]

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def first_plane(pattern: str) -> re.Pattern:
    """pattern for the standard library's matcher, twice as fast on texts without code points above U+FFFF: \\p{L}, \\p{N}
    and \\s become the code points that the regex module gives them."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = regex.findall(f"{name}+", every)
        inside = "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in runs)
        out, bracket = "", False
        for part in re.split(r"(\\S|\\.(?:\{\w\})?|\[|\])", pattern):
            bracket = part == "[" or bracket and part != "]"
            if part == name:
                part = inside if bracket else f"[{inside}]"
            elif name == r"\s" and part == r"\S":
                part = f"[^{inside}]"
            out += part
        pattern = out
    return re.compile(pattern)


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start:start + size], one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    """One Vocabulary for each rank file in a worker."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(ranks, pattern)
    return _loaded[key]


def slices(sizes: list[int], most: int = SLICE) -> Iterator[slice]:
    """Runs of rows whose sizes add up to most, or single larger rows."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, decoded: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; ids (array of int) and decoded
    (binary, the bytes that the ids stand for) if asked for.

    Each match of pattern is encoded by itself: a match that is a token is that token, in any other the leftmost adjacent
    pair of least rank is merged until no pair makes a token. No special tokens. There is no shuffle; the rank file
    (under 1 MB) goes to the workers with the function. A worker holds one slice of SLICE code points, or one longer text.

    Null and empty texts give no tokens and the hash of nothing. Null ids, repeated rows and empty tables pass through;
    further columns of docs are not read.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>" * with_ids + ", decoded binary" * decoded

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(ranks, pattern)
        for frame in frames:
            doc_ids, texts = frame["doc_id"].astype("Int64"), frame["text"].tolist()
            for part in slices([len(t) for t in texts]):
                ids = vocab.encode(texts[part])
                back = [vocab.decode(x) for x in ids]
                out = {
                    "doc_id": doc_ids.iloc[part].array,
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                }
                if with_ids:
                    out["ids"] = [x.astype(np.int32) for x in ids]
                if decoded:
                    out["decoded"] = back
                yield pd.DataFrame(out)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, fields)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, decoded binary) from rows with an array of ids; null ids decode to nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(ranks, pattern)
        for frame in frames:
            back = [vocab.decode(np.asarray(x if x is not None else [], np.int64)) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "decoded": back})

    ship(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, decoded binary")


def public_ranks(path: str | None = None) -> tuple[bytes, str]:
    """The rank file and the pattern of the public byte-level vocabulary; the driver reads them."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), *public_ranks(), with_ids=False)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict = {}

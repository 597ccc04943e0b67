"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

A chunk of texts is split by the public pattern with vectorised class runs, its
distinct pieces are sorted into matrices of one padded width each, and in every
round each row merges its leftmost pair of minimum rank.  Pair ranks come from a
hashed table; rows that have no pair left are written out and the matrix is
compacted.  Pieces longer than LONGEST_ROW bytes are merged with a heap, which
takes the same merges in n log n steps.

Null and empty texts give no tokens.  Ties of rank merge the leftmost pair first.
Input rows are kept one to one, with repeated ids; columns other than the id and
the text are not read, so clashing names do no harm.
"""

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.textbuf import mix, pieces_of_batch, ragged, span_hashes, text_buffer

#: Widths of the matrices: a piece goes to the narrowest that holds it.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
LONGEST_ROW = WIDTHS[-1]
_NONE = np.int32(2**31 - 1)
_U = np.uint64
_APOSTROPHE = ord("'")


class PairTable:
    """Open addressing from a pair of ids to the rank of their join; a power-of-two table, at most a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(4 * len(rank)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[at], self.ranks[at] = key[put], rank[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = slot[todo] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(_U)) >> _U(20)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Vocabulary:
    """Ranks of byte strings, read from a rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = [], [], []
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(joined, np.int32))
        used = np.flatnonzero(self.lengths)
        hashes = span_hashes(self.flat, self.offsets[used], self.offsets[used] + self.lengths[used])
        order = np.argsort(hashes)
        self.whole_hash, self.whole_rank = hashes[order], used[order].astype(np.int32)
        self.classes = code_classes(regex, pattern)

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each piece that is a token as it stands, or _NONE."""
        at = np.minimum(np.searchsorted(self.whole_hash, hashes), len(self.whole_hash) - 1)
        return np.where(self.whole_hash[at] == hashes, self.whole_rank[at], _NONE)


def code_classes(regex, pattern: str) -> np.ndarray:
    """For every code point 0: white space, 1: letter, 2: number, 3: other; the splitter knows this one pattern."""
    from public_tokenizers import PATTERN

    if pattern != PATTERN:
        raise ValueError("the splitter is written for the public pattern only")
    classes = np.full(0x110000, 3, np.uint8)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text, points = "".join(map(chr, points)), np.array(points)
    for value, kind in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
        for m in regex.finditer(kind, text):
            classes[points[m.start():m.end()]] = value
    return classes


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    """Once in each worker process."""
    import public_tokenizers as P

    return Vocabulary(path if os.path.exists(path) else P.path(path), pattern or P.PATTERN)


def split_points(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern's matches begin, over texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    ascii_only = not (data & 0x80).any()
    if ascii_only:
        code = data
        place = None
        fence = np.zeros(len(code) + 1, bool)
        fence[offsets] = True
    else:
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        fence = np.zeros(len(code) + 1, bool)
        fence[np.searchsorted(place, offsets)] = True
    kind = classes[code]
    n = len(code)
    new = fence[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begins = new.copy()
    space = code == 32
    # the last blank before a word: a token of its own, or the head of the word's token if it is a space
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~fence[1:-1]
    begins |= last_blank
    led = np.zeros(n, bool)
    led[1:] = last_blank[:-1] & space[:-1]
    begins &= ~led
    # contractions: a lone apostrophe that begins a match, with the letters behind it
    for at in np.flatnonzero((code == _APOSTROPHE) & begins):
        if at + 1 >= n or fence[at + 1] or kind[at + 1] != 1:
            continue
        one, two = chr(code[at + 1]), ""
        if at + 2 < n and not fence[at + 2]:
            two = one + chr(code[at + 2])
        size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
        if size:
            begins[at + 1] = False
            if at + size < n:
                begins[at + size] = True
    found = np.flatnonzero(begins)
    return found if place is None else place[found]


def merge_rows(ids: np.ndarray, length: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges every row of a padded matrix to its end; returns the matrix and the rows' final lengths."""
    n, width = ids.shape
    out, out_length = ids.copy(), length.copy()
    row, column = np.arange(n), np.arange(width)
    rank = np.full((n, width), _NONE, np.int32)
    if width > 1:
        valid = column[None, 1:] < length[:, None]
        rank[:, :-1][valid] = pairs.find(ids[:, :-1][valid], ids[:, 1:][valid])
    ids, length = ids.copy(), length.copy()
    while len(row):
        best = rank.min(axis=1)
        open_ = best != _NONE
        if not open_.all():
            done = ~open_
            out[row[done]], out_length[row[done]] = ids[done], length[done]
            row, ids, rank, length, best = row[open_], ids[open_], rank[open_], length[open_], best[open_]
            if not len(row):
                break
        at = rank.argmin(axis=1)
        here = np.arange(len(row))
        shift = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
        ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
        length -= 1
        ids[here, at] = best
        rank[here, np.maximum(length - 1, 0)] = _NONE
        after = np.flatnonzero(at + 1 < length)
        rank[after, at[after]] = pairs.find(best[after], ids[after, at[after] + 1])
        before = np.flatnonzero(at > 0)
        rank[before, at[before] - 1] = pairs.find(ids[before, at[before] - 1], best[before])
    return out, out_length


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One long piece: the same merges, lowest rank and then leftmost first, from a heap over a linked list."""
    n = len(ids)
    ids, before, after = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    memo: dict = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in memo:
            memo[a, b] = int(pairs.find(np.array([a]), np.array([b]))[0])
        return memo[a, b]

    heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(r, ids[after[i]])) != _NONE:
                heapq.heappush(heap, (x, i))
        if before[i] >= 0 and (x := rank(ids[before[i]], r)) != _NONE:
            heapq.heappush(heap, (x, before[i]))
    return np.array([i for i in ids if i >= 0], np.int32)


def encode_texts(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, n + 1 offsets of the texts in them)."""
    start = split_points(data, offsets, vocab.classes)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    end = np.append(start[1:], len(data))
    hashes = span_hashes(data, start, end)
    distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    whole = vocab.whole(distinct)
    count = np.ones(len(distinct), np.int64)
    size = end[first] - start[first]
    split = whole == _NONE
    begin, ids, used = np.zeros(len(distinct), np.int64), [whole], len(whole)
    begin[:] = np.arange(len(distinct))
    low = 0
    for width in WIDTHS:
        pick = np.flatnonzero(split & (size > low) & (size <= width))
        low = width
        if not len(pick):
            continue
        column = np.arange(width)
        inside = column[None, :] < size[pick][:, None]
        at = np.where(inside, start[first[pick]][:, None] + column[None, :], 0)
        rows = np.where(inside, vocab.single[data[at]], 0).astype(np.int32)
        rows, lengths = merge_rows(rows, size[pick].copy(), vocab.pairs)
        begin[pick], count[pick] = used + np.arange(len(pick)) * width, lengths
        ids.append(rows.ravel())
        used += rows.size
    for i in np.flatnonzero(split & (size > low)):
        merged = merge_long(vocab.single[data[start[first[i]]:end[first[i]]]], vocab.pairs)
        begin[i], count[i] = used, len(merged)
        ids.append(merged)
        used += len(merged)
    of = of.ravel()
    flat = ragged(np.concatenate(ids), begin[of], count[of])
    tokens_before = np.append(0, np.cumsum(count[of]))
    return flat, tokens_before[np.searchsorted(start, offsets)]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, n + 1 offsets)."""
    lengths = vocab.lengths[ids]
    return ragged(vocab.flat, vocab.offsets[ids], lengths), np.append(0, np.cumsum(lengths))[offsets]


def _slim(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in pieces_of_batch(batch, "text"):
                ids, offsets = encode_texts(*text_buffer(part.column(1)), vocab)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return _slim(df, id_column, text_column).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, decoded binary) for every row of ids; a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = [np.asarray(x.as_py() or [], np.int64) for x in part.column(1)]
                offsets = np.append(0, np.cumsum([len(x) for x in lists]))
                data, at = decode_ids(np.concatenate(lists), offsets, vocab)
                texts = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["id", "decoded"])

    kind = df.schema[id_column].dataType.simpleString()
    slim = df.select(F.col(id_column).alias("id"), F.coalesce(ids_column, F.array().cast("array<int>")).alias("ids"))
    return slim.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes its ids again, in one pass: (id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    Without with_ids the ids stay in the worker, so nothing of the size of the corpus leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for part in pieces_of_batch(batch, "text"):
                ids, offsets = encode_texts(*text_buffer(part.column(1)), vocab)
                data, at = decode_ids(ids, offsets, vocab)
                packed = memoryview(ids.astype("<u4").view(np.uint8))
                text = memoryview(np.ascontiguousarray(data))
                columns = {
                    "id": part.column(0), "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(packed[4 * a:4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _slim(df, id_column, text_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)

"""Best-fit packing of tokenised documents into sequences, by the linear grouping scheme.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into pieces of full length;
the last piece may be shorter. Packing then works on the histogram of piece lengths, which has at most `capacity` rows
whatever the corpus holds:

1. large lengths (over capacity / 8) are sorted and dealt into groups of equal cardinality, each rounded up to its largest;
2. the few sizes are packed by configurations (multisets of groups that fit a sequence) from a linear programme, solved
   by column generation and rounded down;
3. actual documents take the places of their group, which frees what rounding had added;
4. everything left, large leftovers and all small documents, goes best-fit, longest first, into the free space.

All four steps handle runs: ranges of sequences with the same content so far, so the work depends on the number of
distinct lengths, not on the number of documents. The outcome is a table of placements by length and rank, of a few
thousand rows (at most some ten for each distinct length). Documents find theirs by their rank among those of equal length.

Nulls: a null text is empty, so its document is the end id alone; a null id is carried along. Ties of length are ranked
by id, and repeated rows are packed each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, slices, split_words

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """Pieces of one length, by rank from `rank`: `each` in every one of `bins` sequences from `bin`, at `offset`."""

    length: int
    rank: int
    bins: int
    each: int
    bin: int
    offset: int


# -- steps 1 and 2: few sizes, configurations -----------------------------------------------------------------------


def group_sizes(hist: Mapping[int, int], groups: int) -> list[list[list[int]]]:
    """Equal-cardinality groups of [length, count], longest first."""
    todo = [[length, hist[length]] for length in sorted(hist, reverse=True)]
    total = sum(n for _, n in todo)
    out, at = [], 0
    for g in range(groups):
        want, own = (g + 1) * total // groups - g * total // groups, []
        while want:
            take = min(want, todo[at][1])
            own.append([todo[at][0], take])
            todo[at][1] -= take
            want -= take
            at += not todo[at][1]
        if own:
            out.append(own)
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of at most `most` sizes that fits."""
    value, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        best, pick = value.copy(), np.full(capacity + 1, -1)
        for g, size in enumerate(sizes):
            cand = value[: capacity + 1 - size] + values[g]
            better = cand > best[size:] + 1e-12
            best[size:][better] = cand[better]
            pick[size:][better] = g
        if np.array_equal(best, value):
            break
        value = best
        picks.append(pick)
    config, room = np.zeros(len(sizes), int), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            config[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(config @ values), config


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear programme uses each, by column generation from one size per sequence."""
    size, need = np.array(sizes), np.array(counts, float)
    most = capacity // min(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, config = best_configuration(size, duals, capacity, most)
        if value <= 1 + 1e-7:
            break
        use, enter = np.linalg.solve(basis, need), np.linalg.solve(basis, config.astype(float))
        ratio = np.where(enter > 1e-9, np.maximum(use, 0) / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = config
    use = np.linalg.solve(basis, need)
    return [(basis[:, j].round().astype(int), float(use[j])) for j in range(len(sizes)) if use[j] > 1e-9]


# -- steps 3 and 4: actual lengths ------------------------------------------------------------------------------------


class _Space:
    """Sequences by free room, as runs (first sequence, number)."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.ranks: dict[int, int] = {}
        self.placed: list[Run] = []

    def free(self, room: int, first: int, number: int) -> None:
        if number and room:
            if room not in self.runs:
                bisect.insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, number))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return run

    def open(self, number: int) -> int:
        self.bins += number
        return self.bins - number

    def put(self, length: int, bins: int, each: int, first: int, room: int) -> None:
        if bins and each:
            rank = self.ranks.get(length, 0)
            self.placed.append(Run(length, rank, bins, each, first, self.capacity - room))
            self.ranks[length] = rank + bins * each

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, number = self.take(room)
            else:
                room = self.capacity
                number = -(-count // (room // length))
                first = self.open(number)
            each = room // length
            whole = min(number, count // each)
            self.put(length, whole, each, first, room)
            self.free(room - each * length, first, whole)
            count -= whole * each
            first, number = first + whole, number - whole
            if number and 0 < count < each:
                self.put(length, 1, count, first, room)
                self.free(room - count * length, first, 1)
                first, number, count = first + 1, number - 1, 0
            self.free(room, first, number)


def pack_histogram(hist: Mapping[int, int], capacity: int, *, groups: int = 48, large: float = 1 / 8) -> tuple[list[Run], int]:
    """Placements for all pieces of the histogram, and the number of sequences."""
    space = _Space(capacity)
    left = dict(hist)
    if full := left.pop(capacity, 0):
        space.put(capacity, full, 1, space.open(full), capacity)
    big = {length: n for length, n in left.items() if length > capacity * large}
    if big:
        own = group_sizes(big, min(groups, sum(big.values())))
        sizes, counts = [g[0][0] for g in own], [sum(n for _, n in g) for g in own]
        merged: dict[int, list[list[int]]] = {}
        for size, g in zip(sizes, own, strict=True):  # groups of one size are one size
            merged.setdefault(size, []).extend(g)
        sizes = sorted(merged, reverse=True)
        counts = [sum(n for _, n in merged[s]) for s in sizes]
        for config, use in configurations(sizes, counts, capacity):
            number = int(use + 1e-9)
            for g in np.flatnonzero(config):
                number = min(number, sum(n for _, n in merged[sizes[g]]) // int(config[g]))
            if not number:
                continue
            runs = [(space.open(number), number, capacity)]
            for g in np.repeat(np.arange(len(sizes)), config):
                runs = _substitute(space, runs, merged[sizes[g]])
            for first, n, room in runs:
                space.free(room, first, n)
        for length in big:
            left.pop(length)
        for g in merged.values():
            for length, n in g:
                left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        space.best_fit(length, left[length])
    return space.placed, space.bins


def _substitute(space: _Space, runs: list[tuple[int, int, int]], docs: list[list[int]]) -> list[tuple[int, int, int]]:
    """One document of the group for each sequence of the runs: the longest into the fullest."""
    out = []
    for first, number, room in sorted(runs, key=lambda r: -r[2]):
        while number:
            length, there = docs[0]
            n = min(number, there)
            space.put(length, n, 1, first, room)
            out.append((first, n, room - length))
            first, number = first + n, number - n
            docs[0][1] -= n
            if not docs[0][1]:
                docs.pop(0)
    return out


# -- tokens -----------------------------------------------------------------------------------------------------------


@functools.lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words:
    """Ids of single words. Up to `bound` words met before are kept, as arrays, by a 64-bit hash of the word."""

    BETWEEN = "\x01"  # is a token of its own between blanks

    def __init__(self, path: str, bound: int = 1_500_000):
        self.tokenizer, self.bound = _tokenizer(path), bound
        (self.between,) = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number by word."""
        parts, sizes = [], []
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            if any(self.BETWEEN in w for w in some):
                each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in some]
                parts.append(np.array([i for ids in each for i in ids], self.flat.dtype))
                sizes.append(np.array([len(ids) for ids in each], np.int32))
                continue
            ids = np.array(self.tokenizer.encode(f" {self.BETWEEN} ".join(some), add_special_tokens=False).ids, self.flat.dtype)
            marks = np.flatnonzero(ids == self.between)
            sizes.append(np.diff(np.concatenate(([-1], marks, [len(ids)]))).astype(np.int32) - 1)
            parts.append(np.delete(ids, marks))
        return np.concatenate([self.flat[:0], *parts]), np.concatenate([self.size[:0], *sizes])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it each word's ids begin and how many they are."""
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(words), bool)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        begin[known], size[known] = self.begin[place[known]], self.size[place[known]]
        new = np.flatnonzero(~known)
        flat, size[new] = self._encode([words[i] for i in new.tolist()])
        begin[new] = np.cumsum(size[new]) - size[new] + len(self.flat)
        both = np.concatenate((self.flat, flat))
        if len(new) and len(self.keys) < self.bound:
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged)
            self.keys, self.begin, self.size, self.flat = merged[order], np.concatenate((self.begin, begin[new]))[order], np.concatenate((self.size, size[new]))[order], both
        return both, begin, size


@functools.lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_ids(texts: pa.Array, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each text followed by id 0, and where each text's ids begin.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are its words' ids; each
    distinct word of the batch is encoded once.
    """
    parts, offsets = split_words(texts)
    coded = pc.dictionary_encode(parts)
    flat, begin, size = words.ids(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = size[codes]
    upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    ids = flat[np.repeat(begin[codes] - upto[:-1], n) + np.arange(upto[-1])].astype(np.uint32)
    ends = upto[offsets[1:]]
    return np.insert(ids, ends, 0), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece. One pass, no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            for at, n in slices(batch.column(1), 8 << 20):
                ids, begin = token_ids(batch.column(1).slice(at, n), words)
                total = np.diff(begin)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(total[row] - start, capacity)
                first = begin[row] + start
                crc = np.fromiter((zlib.crc32(ids[a : a + b]) for a, b in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                out = [batch.column(0).slice(at, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(ids)])).astype(np.int32)), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, PIECE_SCHEMA + ", ids array<int>" * with_ids)


def place(pieces: DataFrame, *, capacity: int = 2048, groups: int = 48, rows_per_block: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces.

    Ranks among pieces of equal length are counted in blocks (by a hash of id and piece), then shifted by the counts of
    the blocks before: no length, however common, is numbered in one task.
    """
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = pack_histogram(hist, capacity, groups=groups)
    runs.sort()
    blocks = max(1, -(-sum(hist.values()) // rows_per_block))
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece")))
    ranked = ranked.join(counts, ["length", "block"]).withColumn("rank", (F.col("base") + F.col("rank") - 1).cast("long")).drop("base", "block")
    table = np.array(runs, np.int64).reshape(-1, len(Run._fields))
    columns = [c for c in ranked.columns if c != "rank"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1] if batch.num_rows else table[:0]
            at = rank - run[:, 1]
            out = [batch.column(c) for c in columns] + [pa.array(run[:, 4] + at // np.maximum(run[:, 3], 1)), pa.array(run[:, 5] + at % np.maximum(run[:, 3], 1) * length)]
            yield pa.RecordBatch.from_arrays(out, [*columns, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(assign, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, key: str = "doc_id", text: str = "text", groups: int = 48) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. Tokens are counted once and cut."""
    return place(cut(tokenize_pieces(docs, tokenizer, capacity=capacity, key=key, text=text)), capacity=capacity, groups=groups)


def sequences(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each of at most `capacity` ids."""
    placed = place(cut(tokenize_pieces(docs, tokenizer, with_ids=True, **options)), capacity=options.get("capacity", 2048))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))

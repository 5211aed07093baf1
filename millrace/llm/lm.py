"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word after its predecessor, of a word by itself, and the uniform one:

    P(v | u) = l2[b] * c(u v) / c(u) + l1[b] * c(v) / N + l0[b] / (V + 1),    b = floor(log2(c(u))), -1 for c(u) = 0

Weights are shared by contexts of similar frequency and learnt by expectation-maximisation on held-out counts: a part of
the training documents is deleted, counts of the others predict it. The final estimates count all training documents.

Counts live where they are needed, not in a table for everyone, which would grow with the corpus:

1. Documents are gathered into blocks of about `block_tokens` tokens: codes of the words and hashes of the distinct ones.
2. Each block asks for its distinct n-grams, once each, with its own counts, sorted by hash. Requests are dealt by ranges
   of the hash; a range adds up all blocks' counts and answers each block in the order of its request, so answers are
   bare numbers. A word that is everywhere is one entry for each block; ranges are sized by the number of requests.
3. Answers join their blocks. Held-out tokens are counted by bucket and rounded log-probabilities, a grid of bounded
   size, on which EM runs on the driver.
4. Answers join their blocks again, to score them. (Blocks with their answers are not kept: that would take more disk.)

Hashes of n-grams have 64 bits; equal hashes are taken for equal n-grams.

Nulls: a null text is empty, that is, one end token; a null id counts as the empty id. Repeated rows are documents each.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import U64, cut, mix, slices, split_words, word_codes

END = U64(0x5851F42D4C957F2D)  # the end token's hash
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
TRAIN, DELETED, TEST = 0, 1, 2
BUCKETS = 40
STEP, LEVELS = 4, 128  # probabilities are rounded to quarter octaves for EM; LEVELS - 1 stands for 0


def part_of(doc_id: int | None) -> int:
    """Documents whose crc32 leaves 1 modulo 5 are never learnt from; those that leave 4 are the deleted part."""
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5
    return TEST if rest == 1 else DELETED if rest == 4 else TRAIN


# -- arrays in a binary column ------------------------------------------------------------------------------------


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays, their bytes by plane, compressed."""
    out = []
    packer = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = packer.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""
        out.append(b"".join((a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(planes).to_bytes(8, "little"), planes)))
    return b"".join(out)


def load(blob: bytes) -> list[np.ndarray]:
    out, at, unpacker = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        kind, n, size = np.dtype(blob[at : at + 4].decode().strip()), int.from_bytes(blob[at + 4 : at + 12], "little"), int.from_bytes(blob[at + 12 : at + 20], "little")
        at += 20
        raw = unpacker.decompress(blob[at : at + size]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += size
    return out


class Block(NamedTuple):
    doc_ids: np.ndarray
    known: np.ndarray  # whether the id is not null
    part: np.ndarray
    size: np.ndarray  # tokens by document
    codes: np.ndarray  # of all tokens, into `words`
    words: np.ndarray  # sorted hashes

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: hash of the pair with its predecessor, code of the predecessor, part of the document."""
        end = int(np.searchsorted(self.words, END)) if len(self.words) else 0
        before = np.empty(len(self.codes), self.codes.dtype)
        before[1:] = self.codes[:-1]
        before[np.cumsum(self.size) - self.size] = end  # a text starts after an end
        w = self.words
        return mix(w[before] * U64(0x9E3779B97F4A7C15) + w[self.codes]), before, np.repeat(self.part, self.size)


def _encode(docs: DataFrame, block_tokens: int, chunk_bytes: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[Block] = []
        tokens = 0
        for batch in batches:
            for at, n in slices(batch.column(1), chunk_bytes):
                held.append(block_of(batch.column(0).slice(at, n), batch.column(1).slice(at, n)))
                tokens += len(held[-1].codes)
                if tokens >= block_tokens:
                    yield row(number, joined(held))
                    held, tokens, number = [], 0, number + 1
        if held:
            yield row(number, joined(held))

    def row(number: int, b: Block) -> pa.RecordBatch:
        by_part = np.bincount(b.part, weights=b.size, minlength=3).astype(np.int64)
        return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "kept": pa.array([by_part[TRAIN]], pa.int64()), "deleted": pa.array([by_part[DELETED]], pa.int64()), "requests": pa.array([len(b.words) + len(b.codes)], pa.int64()), "payload": pa.array([dump(*b)], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "block long, kept long, deleted long, requests long, payload binary")


def block_of(ids: pa.Array, texts: pa.Array) -> Block:
    words, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    codes, _, hashes = word_codes(words)
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    part = np.fromiter((part_of(i if k else None) for i, k in zip(numbers.tolist(), known, strict=True)), np.uint8, len(numbers))
    all_hashes = np.concatenate((hashes, [END]))
    order = np.argsort(all_hashes)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    codes = np.insert(codes, offsets[1:], len(hashes))
    return Block(numbers, known.astype(np.uint8), part, (np.diff(offsets) + 1).astype(np.int64), place[codes], all_hashes[order])


def joined(blocks: list[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    words = np.unique(np.concatenate([b.words for b in blocks]))
    codes = np.concatenate([np.searchsorted(words, b.words).astype(np.int32)[b.codes] for b in blocks])
    return Block(*(np.concatenate([getattr(b, f) for b in blocks]) for f in ("doc_ids", "known", "part", "size")), codes, words)


# -- requests and answers -----------------------------------------------------------------------------------------


def _counted(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order; how often each occurs in kept and in deleted training documents."""
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place[part == TRAIN], minlength=len(unique)), np.bincount(place[part == DELETED], minlength=len(unique))


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [U64(0), *(U64(i << (64 - bits)) for i in range(1, 1 << bits))]
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(*load(payload.as_py()))
                pair, _, part = b.grams()
                single = [b.words, np.bincount(b.codes[part == TRAIN], minlength=len(b.words)), np.bincount(b.codes[part == DELETED], minlength=len(b.words))]
                pairs = _counted(pair, part)
                bounds = [[*np.searchsorted(x[0], np.array(edges)), len(x[0])] for x in (single, pairs)]
                full = [i for i in range(1 << bits) if any(own[i] < own[i + 1] for own in bounds)]
                asked = [dump(*(narrow(a[bounds[o][i] : bounds[o][i + 1]], a is x[0]) for o, x in enumerate((single, pairs)) for a in x)) for i in full]
                yield pa.RecordBatch.from_pydict({"range": pa.array(full, pa.int32()), "block": pa.array([number] * len(full), pa.int64()), "asked": pa.array(asked, pa.binary())})

    return blocks.select("block", "payload").mapInArrow(ask, "range int, block long, asked binary")


def narrow(a: np.ndarray, as_is: bool = False) -> np.ndarray:
    if as_is:
        return a
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _answers(requests: DataFrame) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        asked = [load(x) for x in table.column("asked").to_pylist()]
        answers: list[list[np.ndarray]] = [[] for _ in asked]
        distinct = 0
        for order in range(2):
            sizes = [len(a[3 * order]) for a in asked]
            unique, place = np.unique(np.concatenate([a[3 * order] for a in asked]), return_inverse=True)
            totals = [np.bincount(place, weights=np.concatenate([a[3 * order + 1 + i] for a in asked]), minlength=len(unique)).astype(np.int64) for i in range(2)]
            if not order:
                distinct = int(((totals[0] + totals[1]) > 0).sum())
            for i, part in enumerate(np.split(place, np.cumsum(sizes)[:-1])):
                answers[i] += [narrow(totals[0][part]), narrow(totals[1][part])]
        return pa.table({
            "block": table.column("block"), "range": table.column("range"),
            "distinct": pa.array([distinct] + [0] * (len(asked) - 1), pa.int64()), "answer": pa.array([dump(*a) for a in answers], pa.binary()),
        })

    return requests.groupBy("range").applyInArrow(add, "block long, range int, distinct long, answer binary")


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """payload, answers (by range) of each block."""
    answers = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "answer"))).alias("answers"))
    return blocks.select("block", "payload").join(answers, "block").select("payload", F.col("answers.answer").alias("answers"))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Block, list[np.ndarray]]]:
    """Blocks with the counts of their words in kept and in deleted documents, then those of their pairs."""
    for payload, answers in zip(batch.column(0), batch.column(1), strict=True):
        parts = [load(a.as_py()) for a in answers.values]
        yield Block(*load(payload.as_py())), [np.concatenate([p[k] for p in parts]) for k in range(4)]


def _grid(answered: DataFrame, kept: int) -> DataFrame:
    """Deleted tokens by EM cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, counts in _read(batch):
                pair, before, part = b.grams()
                unique = np.unique(pair)
                gone = np.flatnonzero(part == DELETED)
                cells = cell(counts[2][np.searchsorted(unique, pair[gone])], counts[0][before[gone]], counts[0][b.codes[gone]], kept)
                found, times = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(found.astype(np.int64)), "n": pa.array(times.astype(np.int64))})

    return answered.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


# -- the model -----------------------------------------------------------------------------------------------------


def bucket(context: np.ndarray) -> np.ndarray:
    """-1 for an unseen context, else the whole part of log2 of its count."""
    return np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1).astype(float))[1] - 1, BUCKETS - 2), -1)


def _level(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.minimum(np.round(-STEP * np.log2(np.maximum(p, 1e-300))), LEVELS - 2), LEVELS - 1).astype(np.int64)


def cell(pair: np.ndarray, context: np.ndarray, single: np.ndarray, total: int) -> np.ndarray:
    p2, p1 = pair / np.maximum(context, 1), single / max(total, 1)
    return ((bucket(context) + 1) * LEVELS + _level(p2)) * LEVELS + _level(p1)


def learn_weights(cells: np.ndarray, times: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """weights[bucket + 1] = (pair, single, uniform), by EM on held-out tokens; a bucket without any keeps the start."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    value = lambda level: np.where(level == LEVELS - 1, 0.0, 2.0 ** (-level / STEP))
    own = cells // (LEVELS * LEVELS)
    p = np.stack([value(cells // LEVELS % LEVELS), value(cells % LEVELS), np.full(len(cells), uniform)], 1)
    for _ in range(rounds):
        share = weights[own] * p
        share *= (times / share.sum(1))[:, None]
        sums = np.zeros_like(weights)
        np.add.at(sums, own, share)
        seen = sums.sum(1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
        weights = np.maximum(weights, [0.0, 0.0, 1e-6])  # no text is impossible
        weights /= weights.sum(1, keepdims=True)
    return weights


class Model(NamedTuple):
    weights: np.ndarray
    total: int
    distinct: int


def score_block(b: Block, single: np.ndarray, pairs: np.ndarray, model: Model) -> list[np.ndarray]:
    """Known tokens, base score and score of each document."""
    pair, before, _ = b.grams()
    place = np.unique(pair, return_inverse=True)[1]
    starts = np.cumsum(b.size) - b.size
    own, context = single[b.codes].astype(float), single[before].astype(float)
    base = np.log10((own + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
    w = model.weights[bucket(context) + 1]
    p = w[:, 0] * pairs[place] / np.maximum(context, 1) + w[:, 1] * own / max(model.total, 1) + w[:, 2] / (model.distinct + 1)
    return [np.add.reduceat((own > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]


def train(docs: DataFrame, *, block_tokens: int = 2_000_000, requests_per_range: int = 1_500_000, chunk_bytes: int = 8 << 20) -> tuple[DataFrame, Model]:
    """Blocks of docs (doc_id, text) with the counts that their texts need; and the model."""
    blocks = cut(_encode(docs, block_tokens, chunk_bytes))
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept", "deleted", "requests")]).first()  # one row
    bits = max(3, (int(sums["requests"]) // requests_per_range).bit_length())
    answers = cut(_answers(_requests(blocks, bits)))
    distinct = int(answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("n")).first()["n"])  # one row
    answered = _answered(blocks, answers)
    grid = cut(_grid(answered, int(sums["kept"]))).collect()  # at most BUCKETS * LEVELS ** 2 rows
    weights = learn_weights(np.array([r["cell"] for r in grid], np.int64), np.array([r["n"] for r in grid], float), 1 / (distinct + 1))
    return answered, Model(weights, int(sums["kept"]) + int(sums["deleted"]), distinct)


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    answered, model = train(docs, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, counts in _read(batch):
                known, base, own = score_block(b, counts[0].astype(np.int64) + counts[1], counts[2].astype(np.int64) + counts[3], model)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.doc_ids, pa.int64(), mask=b.known == 0), pa.array(b.part == TEST), pa.array(b.size), pa.array(known), pa.array(np.full(len(known), model.total)), pa.array(base), pa.array(own)],
                    [c.split()[0] for c in SCORES.split(", ")],
                )

    return answered.mapInArrow(apply, SCORES)

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import packing
from millrace.llm.queries import tokenizer_path

from .cases import frame, odd_documents

WORDS = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(6))
def test_histogram_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([32, 256, 2048])
    lengths = [min(capacity, max(1, int(rng.paretovariate(1) * rng.choice([3, 20, capacity // 4])))) for _ in range(rng.choice([0, 1, 7, 500, 5000]))]
    hist = Counter(lengths)
    runs, bins = packing.pack_histogram(hist, capacity)
    ranks, content = {}, {}
    for r in runs:
        for i in range(r.bins * r.each):
            ranks.setdefault(r.length, []).append(r.rank + i)
            content.setdefault(r.bin + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in hist.items()}
    assert sorted(content) == list(range(bins))
    for parts in content.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    if lengths:
        least = max(-(-sum(lengths) // capacity), sum(x > capacity / 2 for x in lengths))
        assert bins <= least * 1.12 + 2


def test_configuration_is_the_most_valuable():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes, values = rng.integers(9, 40, 4), rng.random(4)
        got, config = packing.best_configuration(sizes, values, 64, 64 // int(sizes.min()))
        best = max((a * values[0] + b * values[1] + c * values[2] + d * values[3] for a in range(8) for b in range(8) for c in range(8) for d in range(8) if a * sizes[0] + b * sizes[1] + c * sizes[2] + d * sizes[3] <= 64))
        assert config @ sizes <= 64 and abs(got - best) < 1e-9


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(WORDS), []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc, piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    return out


def check(placed, rows, capacity):
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed]
    assert sorted(got, key=repr) == sorted(brute_pieces(rows, capacity), key=repr)
    bins = {}
    for r in placed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_odd_documents(spark):
    rows = odd_documents()
    placed = packing.pack(frame(spark, rows), WORDS, capacity=256).collect()
    bins = check(placed, rows, 256)
    assert bins <= -(-sum(r["length"] for r in placed) // 256) * 1.15 + 1


def test_blocks_of_ranks(spark):
    rows = odd_documents()
    pieces = packing.tokenize_pieces(frame(spark, rows), WORDS, capacity=256)
    check(packing.place(pieces, capacity=256, rows_per_block=20).collect(), rows, 256)


def test_sequences_hold_the_ids(spark):
    rows = odd_documents()[:40]
    found = packing.sequences(frame(spark, rows), WORDS, capacity=128).collect()
    assert max(len(r["ids"]) for r in found) <= 128
    assert sum(len(r["ids"]) for r in found) == sum(p[3] for p in brute_pieces(rows, 128))


def test_empty_and_clashing_columns(spark):
    assert packing.pack(frame(spark, []), WORDS).count() == 0
    wide = spark.createDataFrame([(1, "a b c", 5, 6, 7)], "doc_id long, text string, length int, rank int, sequence_id int")
    assert packing.pack(wide, WORDS).select("doc_id", "length").collect() == [(1, 4)]

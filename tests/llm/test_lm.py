import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm

from .cases import HAVE_DATA, SF, frame, odd_documents


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows, model):
    train = [tokens(t) for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    single, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    total, distinct = sum(single.values()), len(single)
    assert (model.total, model.distinct) == (total, distinct)
    out = []
    for d, text in rows:
        t = tokens(text)
        base = sum(math.log10((single[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        own = 0.0
        for u, v in zip([None, *t], t):
            w = model.weights[(int(math.log2(single[u])) if single[u] else -1) + 1]
            own += math.log10(w[0] * (pairs[u, v] / single[u] if single[u] else 0) + w[1] * single[v] / total + w[2] / (distinct + 1))
        out.append((d, zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1, len(t), sum(single[w] > 0 for w in t), total, base, own))
    return out


@pytest.mark.parametrize("block", [2_000_000, 500])
def test_against_brute_force(spark, block):
    rows = odd_documents()
    docs = frame(spark, rows)
    _, model = lm.train(docs, block_tokens=block, chunk_bytes=2000)
    assert np.allclose(model.weights.sum(1), 1) and (model.weights[0, 0] == 0)
    got = sorted(map(tuple, lm.score(docs, block_tokens=block, chunk_bytes=2000).collect()), key=repr)
    want = sorted(brute(rows, model), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_arrays_survive():
    arrays = [np.arange(1000, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int32), np.array([1, 2], np.uint8), np.array([-5, 7], np.int64)]
    for a, b in zip(arrays, lm.load(lm.dump(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(3)
    pair, single = rng.integers(0, 30, 20000), rng.integers(8, 60, 20000)
    cells = (6 * lm.LEVELS + pair) * lm.LEVELS + single
    truth = np.array([0.6, 0.3, 0.1])
    p = np.stack([2.0 ** (-pair / lm.STEP), 2.0 ** (-single / lm.STEP), np.full(20000, 1e-4)], 1)
    weights = lm.learn_weights(cells, (truth * p).sum(1), 1e-4)

    def likelihood(w):
        return ((truth * p).sum(1) * np.log((w * p).sum(1))).sum()

    for _ in range(50):
        assert likelihood(weights[6]) >= likelihood(rng.dirichlet([6, 3, 1])) - 1e-6


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_held_out_texts_are_likelier_than_under_the_base(spark):
    found = lm.score(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert found["s"] > found["b"]


def test_empty(spark):
    assert lm.score(frame(spark, [])).count() == 0

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality

from .cases import HAVE_DATA, SF, frame, odd_documents, prose


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts(spark):
    texts = [t for _, t in odd_documents()] + ["a b c d e a b c d e", "x\nx\n \n \nx y\nx", "#a *b* |c| d&d <e>", "a b c d e f a b c d e", "aa " * 6]
    for array in (pa.array(texts, pa.string()), pa.array(["no", *texts], pa.string()).slice(1)):
        got = quality.statistics(array)
        for i, text in enumerate(texts):
            assert {k: int(got[k][i]) for k in quality.STATS} == brute(text), text


def test_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    n = 300_000
    on_good = np.array([[0.02, 0.9, 0.08], [0.05, 0.0, 0.95], [0.1, 0.8, 0.1], [0.02, 0.0, 0.98], [0.1, 0.7, 0.2]])
    on_bad = np.array([[0.6, 0.3, 0.1], [0.7, 0.0, 0.3], [0.6, 0.2, 0.2], [0.5, 0.0, 0.5], [0.8, 0.1, 0.1]])
    good, draw = rng.random(n) < 0.8, rng.random((5, n))
    upto = np.where(good, on_good.cumsum(1).T[:, :, None], on_bad.cumsum(1).T[:, :, None])
    vote = (draw > upto[0]).astype(int) + (draw > upto[1])
    patterns, counts = np.unique((vote * 3 ** np.arange(5)[:, None]).sum(0), return_counts=True)
    start = np.tile([[0.05, 0.5, 0.45], [0.4, 0.1, 0.5]], (5, 1, 1))
    model = quality.expectation_maximisation(patterns, counts.astype(float), start)
    assert abs(model.good - 0.8) < 0.02 and np.allclose(model.rates, [on_good, on_bad], atol=0.02)


def test_verdicts(spark):
    import random

    rng = random.Random(1)
    clean = [(i, ". ".join(prose(rng, 12, 2000).capitalize() for _ in range(rng.choice([2, 5, 40]))) + ".") for i in range(200)]
    junk = [(1000 + i, " ".join(f"{w}***" for w in prose(rng, 60).split())) for i in range(15)] + [(1100 + i, " ".join(f"{w.upper()}!!" for w in prose(rng, 60).split())) for i in range(15)]
    docs = frame(spark, [*clean, *junk, (5000, None), (5001, "")])
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.fit(docs)).collect()}
    assert all(kept[d] for d, _ in clean)
    assert not any(kept[d] for d, _ in junk) and not kept[5000] and not kept[5001]


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_against_labels(spark):
    base = f"{SF}/../sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    found = quality.judge(docs.select("doc_id", "text"), quality.fit(docs)).where("not base_failed")
    labels = spark.read.parquet(f"{base}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = found.join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["label"] == 1], [r["kept"] for r in rows if r["label"] == 0]
    print("kept of good and bad", np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5


def test_odd_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, True), (None, None, 4, False)], "doc_id long, text string, n_words int, kept boolean")
    model = quality.fit(docs)
    assert {(r["doc_id"], r["n_words"], r["kept"]) for r in quality.judge(docs, model).collect()} == {(1, 2, False), (None, 0, False)}
    assert quality.judge(docs, model, only_kept=True).columns == docs.columns
    empty = frame(spark, [])
    assert quality.judge(empty, quality.fit(empty)).count() == 0

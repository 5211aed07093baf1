import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import omh

from .cases import HAVE_DATA, SF, frame, odd_documents, prose


def distance(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in b], int) if b else row[:-1])
        out = [i + 1]
        for v in new:
            out.append(min(int(v), out[-1] + 1))
        row = np.array(out)
    return int(row[-1])


@pytest.mark.parametrize("seed", range(150))
def test_edit_distance(seed):
    rng = random.Random(seed)
    a = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(60))]
    b = list(a)
    for _ in range(rng.randrange(12)):
        kind = rng.randrange(3)
        at = rng.randrange(len(b) + 1)
        if kind == 0:
            b.insert(at, rng.randrange(50))
        elif b and kind == 1:
            b.pop(at % len(b))
        elif b:
            b[at % len(b)] = rng.randrange(50)
    true = distance(a, b)
    for most in (0, 1, 3, true, true + 4, 80):
        assert omh.edit_distance(a, b, most) == (true if true <= most else most + 1)


def brute_classes(rows, threshold=0.8, k=5):
    """Components of equal texts and of pairs that share a k-mer and are similar."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    by_gram = defaultdict(set)
    texts = sorted({t for _, t in rows if t is not None})
    words = [t.encode().split() for t in texts]
    for i, w in enumerate(words):
        for j in range(max(1, len(w) - k + 1) if w else 0):
            by_gram[tuple(w[j : j + k])].add(i)
    for pair in {(i, j) for own in by_gram.values() for i in own for j in own if i < j}:
        a, b = (words[i] for i in pair)
        if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and find(pair[0]) != find(pair[1]) and 1 - distance(a, b) / max(len(a), len(b)) >= threshold:
            up[find(pair[0])] = find(pair[1])
    out = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        out[("null", n) if text is None else find(texts.index(text))].append(doc)
    return sorted((sorted(map(str, v)) for v in out.values()))


def classes_of(df):
    out = defaultdict(list)
    for n, r in enumerate(df.collect()):
        out[r["class_node"] if r["class_node"] is not None else ("null", n)].append(r["doc_id"])
    return sorted((sorted(map(str, v)) for v in out.values()))


def test_odd_documents(spark):
    rows = [r for r in odd_documents() if r[0] != 400]
    got = omh.classes(frame(spark, rows))
    assert classes_of(got) == brute_classes(rows)
    sizes = {(r["doc_id"], r["class_id"], r["class_size"]) for r in got.where("doc_id = 12").collect()}
    assert sizes == {(12, 1, 73)}


def test_chain_and_groups_in_one_bucket(spark):
    """Neighbours of a chain are similar, its ends are not; no link of the chain may be lost."""
    rng = random.Random(2)
    words = prose(rng, 100, 2000).split()
    rows = []
    for i in range(40):
        words = list(words)
        for _ in range(3):
            words[rng.randrange(100)] = f"w{rng.random()}"
        rows.append((i, " ".join(words)))
    assert classes_of(omh.classes(frame(spark, rows))) == brute_classes(rows)


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_test_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert classes_of(omh.classes(docs)) == brute_classes(rows)


def test_keep_one(spark):
    rows = odd_documents()
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as node", "2 as class_id")
    kept = omh.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sum(t == rows[0][1] for _, t in ids) == 1 and (1, rows[0][1]) in ids
    assert sum(t is None for _, t in ids) == 2 and len(ids) == len(classes_of(omh.classes(docs)))


def test_empty(spark):
    assert omh.classes(frame(spark, [])).count() == 0 and omh.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 201), (202, 201)]
    got = {r["node"]: r["root"] for r in omh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = [set(range(31)), {100, 101}, {200, 201, 202}]
    assert set(got) == set().union(*parts) and all(len({got[i] for i in part}) == 1 and got[min(part)] in part for part in parts)


def test_components_end_on_the_driver(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1200)]
    df, rounds = spark.createDataFrame(edges, "a long, b long"), []
    once = omh.cut
    monkeypatch.setattr(omh, "cut", lambda *args, **options: rounds.append(1) or once(*args, **options))
    found = []
    for few in (0, 50, 1 << 17):  # never, after some rounds, at once
        monkeypatch.setattr(omh, "FEW", few)
        rounds.clear()
        parts = defaultdict(set)
        for r in omh.components(df).collect():
            parts[r["root"]].add(r["node"])
        assert all(root in part for root, part in parts.items())
        found.append(sorted(map(sorted, parts.values())))
    assert found[0] == found[1] == found[2] and len(rounds) == 2


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("similar, most_lost", [(0.8, 15), (0.85, 2), (0.9, 0)])
def test_recall_of_scattered_changes(spark, similar, most_lost):
    """Of 150 pairs with words changed here and there; 32 sketches of 3 lost about 80, 45 and 10 % of them."""
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = [f"v{rng.randrange(20_000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed(rng, words, round(300 * (1 - similar)))))]
    got = classes_of(omh.classes(frame(spark, rows)))
    assert all(len(c) <= 2 for c in got) and len(got) - 150 <= most_lost


def in_large_buckets():
    """Pairs of near copies, each pair apart from the others, that share one passage with all: few or no small buckets."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows = []
    for i in range(30):
        words = prose(rng, 40, 2000).split()
        rows += [(2 * i, f"{passage} {' '.join(words)}"), (2 * i + 1, f"{passage} {' '.join(changed(rng, words, 18))}")]
    return rows


def test_large_buckets_lose_no_pair(spark):
    """With hot=0 every bucket is large; the sketches are few, so that many pairs agree on one only."""
    rows = in_large_buckets()
    whole = classes_of(omh.classes(frame(spark, rows), sketches=8, hot=10**9))
    assert len(whole) < 60
    for hot in (0, 5):
        assert classes_of(omh.classes(frame(spark, rows), sketches=8, hot=hot)) == whole
    assert classes_of(omh.classes(frame(spark, rows), hot=0)) == brute_classes(rows)


def test_few_pairs_of_large_buckets_are_aligned_in_vain(spark, monkeypatch):
    """40 texts, any two of which share words and buckets and are not similar: 780 pairs.

    With counts of 512 classes of words 600 of them came to alignment, with 1024 it is 361.
    """
    rng = random.Random(6)
    base = [f"v{rng.randrange(2000)}" for _ in range(700)]
    texts = []
    for _ in range(40):
        words = list(base)
        for i in rng.sample(range(700), 92):
            words[i] = f"v{rng.randrange(2000)}"
        texts.append(" ".join(words))
    counts, pairs = [], omh._pairs_between_classes

    def counted(*args):
        found = pairs(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(omh, "_pairs_between_classes", counted)
    got = classes_of(omh.classes(frame(spark, list(enumerate(texts))), hot=2))
    words = [text.split() for text in texts]
    assert all(omh.edit_distance(a, b, 140) > 140 for i, a in enumerate(words) for b in words[:i]) and got == sorted([str(i)] for i in range(40))
    assert counts[0] < 450


def test_odd_documents_with_large_buckets(spark):
    rows = [r for r in odd_documents() if r[0] != 400]
    assert classes_of(omh.classes(frame(spark, rows), hot=2)) == brute_classes(rows)


@pytest.mark.parametrize("seed", range(40))
def test_prefixes_of_similar_texts_meet(seed):
    rng = random.Random(seed)
    a = [rng.randrange(rng.choice([3, 30, 300])) for _ in range(rng.randrange(1, 60))]
    b = list(a)
    while True:
        at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
        c = b[:at] + [rng.randrange(1000)] * (kind != 1) + b[at + (kind > 0) :]
        if not c or 1 - distance(a, c) / max(len(a), len(c)) < 0.8:
            break
        b = c
    codes = np.array(a + b).astype(np.uint64)
    words, row = omh.prefixes(omh.mix(codes), np.array([0, len(a), len(a) + len(b)]), 0.8, np.random.default_rng(seed).integers(0, 4, 64))
    assert set(words[row == 0]) & set(words[row == 1])


def test_short_near_copies(spark):
    """Texts of up to 15 words with so many edits as the threshold allows, down to where no k-mer is left in common."""
    rng = random.Random(8)
    rows, want = [], []
    for i, (n, kind) in enumerate([(n, kind) for n in range(4, 15) for kind in ("add", "put") if kind == "add" or n > 4]):
        words = [f"t{i}w{j}" for j in range(n)]
        other = [*words, "more"] if kind == "add" else changed(rng, words, n // 5)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want.append([str(2 * i), str(2 * i + 1)])
    rows += [(900, "all of it differs"), (901, "all of this is not alike"), (902, "one"), (903, "two")]
    want += [[str(d)] for d in range(900, 904)]
    for hot in (0, 100):
        assert classes_of(omh.classes(frame(spark, rows), hot=hot)) == sorted(sorted(w) for w in want)

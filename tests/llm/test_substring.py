import hashlib
import random
from collections import Counter

import pytest

from millrace.llm import substring

from .cases import HAVE_DATA, SF, frame, odd_documents, prose


def brute(rows, window=20):
    """(doc, words, removed, digest). Rows must not repeat an id with different texts, nor ids without texts matter."""
    seen, out = {}, []
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    kept = {}
    for doc, text in order:
        words, gone = text.encode().split(), set()
        for s in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[s : s + window]), (doc, s)) != (doc, s):
                gone |= set(range(s, s + window))
        kept[doc, text] = (len(words), len(gone), [w for i, w in enumerate(words) if i not in gone])
    for doc, text in rows:
        n, gone, words = kept.get((doc, text), (0, 0, []))
        out.append((doc, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def more_rows():
    rng = random.Random(4)
    rows = [r for r in odd_documents() if r[0] not in (7,)]
    a = prose(rng, 60, 2000)
    rows += [(600, f"{a} {a}"), (601, " ".join(a.split()[3:24])), (602, " ".join(a.split()[3:22])), (603, "y " * 21), (604, "y " * 20), (605, "y " * 19), (606, " ".join(["p", "q"] * 40))]
    half = a.split()
    rows += [(610 + i, " ".join(half[i : i + 25]) + " " + prose(rng, 10, 2000)) for i in range(20)]  # overlapping excerpts
    return rows


def test_against_brute_force(spark):
    rows = more_rows()
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as tie", "2 as spans", "3 as start")
    assert got(substring.remove(docs, digest=True)) == brute(rows)


def test_hot_anchors(spark):
    """With shards of two snippets nearly all goes through windows instead of automata; the result is the same."""
    rows = more_rows()
    assert got(substring.remove(frame(spark, rows), shard=2, digest=True)) == brute(rows)


def test_one_task_or_many(spark):
    rows = more_rows()
    assert got(substring.remove(frame(spark, rows).repartition(23, "doc_id"), digest=True)) == brute(rows)


def test_text_and_columns(spark):
    rows = more_rows()
    docs = frame(spark, rows).selectExpr("'x' as tie", "text", "doc_id", "named_struct('a', doc_id) as spans")
    out = substring.remove(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    texts = out.collect()
    assert len(texts) == len(rows) and all(r["spans"]["a"] == r["doc_id"] for r in texts)
    digests = Counter((r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in texts)
    want = Counter()
    for (doc, _, _, digest), n in brute(rows).items():
        want[doc, digest] += n
    assert digests == want
    assert sum(r["text"] is None for r in texts) == sum(t is None for _, t in rows)


def test_repeated_rows_are_one_document(spark):
    text = prose(random.Random(1), 30)
    rows = [(1, text), (1, text)]
    assert got(substring.remove(frame(spark, rows), digest=True)) == Counter([(1, 30, 0, hashlib.sha256(text.encode()).hexdigest())] * 2)


def test_empty(spark):
    assert substring.remove(frame(spark, [])).count() == 0 and substring.remove(frame(spark, []), digest=True).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_test_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(substring.remove(docs, digest=True)) == want and any(w[2] for w in want)


@pytest.mark.parametrize("seed", range(40))
def test_automaton(seed):
    """Matching statistics agree with looking at all windows."""
    rng = random.Random(seed)
    window, letters = rng.choice([2, 3, 5]), "abcd"[: rng.choice([1, 2, 4])]
    snippets, at = [], 0
    for doc in range(rng.randrange(1, 6)):
        words = [rng.choice(letters) for _ in range(rng.randrange(1, 25))]
        snippets.append((doc, at, words))
        at += rng.randrange(3)
    first, want = {}, set()
    for doc, start, words in snippets:
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), (doc, start + s))
    for i, (doc, start, words) in enumerate(snippets):
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (doc, start + s):
                want |= {(i, start + s + j) for j in range(window)}
    assert {(i, w) for i, a, b in substring.repeated_spans(snippets, window) for w in range(a, b)} == want

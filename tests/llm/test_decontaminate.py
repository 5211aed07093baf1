import random
import re

import pytest

from millrace.llm import decontaminate

from .cases import HAVE_DATA, SF, frame, odd_documents, prose

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    wins = [(item, tuple(w[s : s + window])) for item, text in items for w in [words_of(text)] if w for s in range(max(1, len(w) - window + 1))]
    by_first = {}
    for item, win in set(wins):
        by_first.setdefault(win[0], []).append((item, win))
    out = []
    for doc, text in rows:
        words = words_of(text)
        hit, found = set(), set()
        for i, w in enumerate(words):
            for item, win in by_first.get(w, ()):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(words), len(hit), len(names), names, bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["items"]), r["contaminated"]) for r in df.collect()), key=repr)


def items_and_documents():
    rng = random.Random(9)
    long, short = prose(rng, 40), prose(rng, 4)
    items = [(1, long), (2, short), (2, short), (10, long.upper()), (3, "solitary"), (4, ""), (5, None), (6, "!!! ..."), (None, prose(rng, 12)), (7, "a a a a a a a a a a a a")]
    passage = " ".join(long.split()[5:20])
    rows = odd_documents() + [
        (500, f"{prose(rng, 30)} {passage.title()} {prose(rng, 30)}"), (501, passage.replace(" ", "--")), (502, " ".join(long.split()[:9])), (503, short), (503, short),
        (504, f"x{short}"), (505, "Solitary, solitary solitary"), (506, items[8][1]), (507, "a " * 25), (508, f"{long} {long}"), (509, " ".join(long.split()[-10:])),
    ]
    return rows, items


def test_against_brute_force(spark):
    rows, items = items_and_documents()
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as item_id", "2 as n_hit", "3 as words", "4 as win")
    found = decontaminate.decontaminate(docs, frame(spark, items, "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as words"))
    assert got(found) == brute(rows, items)


@pytest.mark.parametrize("window", [1, 3])
def test_other_windows(spark, window):
    rows, items = items_and_documents()
    rows = [r for r in rows if r[0] != 400]
    assert got(decontaminate.decontaminate(frame(spark, rows), frame(spark, items, "item_id long, text string"), window=window)) == brute(rows, items, window)


def test_blocks_of_items_change_nothing(spark):
    rows, items = items_and_documents()
    found = decontaminate.decontaminate(frame(spark, rows), frame(spark, items, "item_id long, text string"), block_bytes=150)
    assert got(found) == brute(rows, items)


def test_empty(spark):
    rows, items = items_and_documents()
    none = frame(spark, [], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    assert got(decontaminate.decontaminate(frame(spark, rows), none)) == brute(rows, [])


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_test_data(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.decontaminate(docs, items)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(found) == want and any(w[-1] for w in want)


def test_stays_native(spark):
    rows, items = items_and_documents()
    plan = decontaminate.decontaminate(frame(spark, rows), frame(spark, items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import sharding, url_reputation

from .cases import HAVE_DATA, SF, frame, odd_documents


def place(key, weights):
    def draw(s):
        return (int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    return max(range(len(weights)), key=lambda s: (weights[s] / -math.log(draw(s)), -s))


def check_shards(found, rows, weights):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "key" and r["shard"] == place(r["doc_id"], weights)
        grown = place(r["doc_id"], [*weights, 1.0])
        assert r["grown_shard"] == grown and grown in (r["shard"], len(weights))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("per_block", [200_000, 7])
def test_shards(spark, per_block):
    rows = odd_documents()
    docs = frame(spark, rows).selectExpr("*", "1 as shard", "2 as block", "3 as n", "4 as rank")
    check_shards(sharding.shard(docs, rows_per_block=per_block).collect(), rows, [1.0] * 8)


def test_weights(spark):
    rows = [(i, "t") for i in range(8000)]
    weights = [1.0, 2.0, 5.0]
    found = sharding.shard(frame(spark, rows), weights).collect()
    check_shards(found, rows, weights)
    counts = Counter(r["shard"] for r in found)
    assert all(abs(counts[s] / 8000 - w / 8) < 0.03 for s, w in enumerate(weights))
    check_shards(sharding.shard(frame(spark, rows[:50]), [1.0]).collect(), rows[:50], [1.0])


def test_no_documents(spark):
    assert sharding.shard(frame(spark, [])).count() == 0


# -- urls -------------------------------------------------------------------------------------------------------------

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http:///p", "HTTP://Example.NET/en/x?y#z", "http://example.net/e", "http://a.b.example.net/en/", "http://badexample.net/en/", "http://net/", "http://net",
    "http://EXAMPLE.com/de/", "http://example.com/de", "http://x.org/fr/a", "http://org/fr/", "http://x.org?fr/", "http://x.org#/fr/", "ftp://x.org/fr/://y.net/", "a://b\nc.org/fr/\nd?e", "http://İX.ORG/fr/", "http://.net/", "x://y://z.net/",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[6]), (None, URLS[6])], "page_id long, url string").selectExpr("*", "1 as host", "2 as domain", "3 as mean", "4 as rule")
    found = url_reputation.judge(pages, spark.createDataFrame([], "host string, bad int")).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        if r["page_id"]:
            assert (r["host"], r["path"]) == split_url(URLS[r["page_id"]])
        assert r["rule"] == rule_of(r["host"], r["path"]) and r["verdict"] == RULES.get(r["rule"], "allow")


def test_reputation(spark):
    """Shrinkage: many bad pages block a host, one does not; an unknown host under a bad domain takes the domain's rate."""
    outcomes = [("bad.evil.example", 1)] * 200 + [("worse.evil.example", 1)] * 150 + [("once.fine.example", 1)] + [("www.fine.example", 0)] * 300 + [("www.good.test", 0)] * 300 + [("www.fine.example", None)] * 50
    hosts = ["bad.evil.example", "new.evil.example", "once.fine.example", "www.fine.example", "new.test", "nowhere.invalid"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    found = {r["host"]: r for r in url_reputation.judge(pages, spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert {h: r["verdict"] for h, r in found.items()} == dict.fromkeys(hosts, "allow") | {"bad.evil.example": "block", "new.evil.example": "block"}
    assert found["once.fine.example"]["bad_rate"] < 0.9 and found["www.fine.example"]["bad_rate"] < found["once.fine.example"]["bad_rate"]
    assert all(r["bad_bound"] <= r["bad_rate"] for r in found.values())


def test_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.x/"), (2, "http://a.x/"), (3, None), (None, "http://b.x/")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, 0), (None, 0, 0), (9, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    found = Counter((r["host"], r["bad"]) for r in url_reputation.outcomes_from_labels(pages, labels).collect())
    assert found == Counter({("a.x", 1): 2, ("a.x", 0): 1, ("", 0): 1, ("a.x", None): 1})
    empty = url_reputation.judge(pages.limit(0), url_reputation.outcomes_from_labels(pages, labels))
    assert empty.count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_test_data_stays_native(spark):
    pages, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "labels"))
    judged = url_reputation.judge(pages, url_reputation.outcomes_from_labels(pages, labels))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    found = judged.collect()
    assert len(found) == len(urls)
    assert all((r["host"], r["path"]) == split_url(urls[r["page_id"]]) and r["rule"] == rule_of(r["host"], r["path"]) for r in found)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", judged._jdf.queryExecution().executedPlan().toString())

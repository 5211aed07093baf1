import hashlib
import os
import random
import re
from collections import Counter

import pytest
import zstandard

from millrace.llm import warc

from .cases import HAVE_DATA, SF, prose

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(7)
    page = f"<html>{prose(rng, 80)}</html>"
    rows = [(9, "http://a.example/", page), (3, "http://b.example/", page), (3, "http://b.example/", page), (5, None, page), (None, "http://c.example/", page)]
    rows += [(10, "http://d.example/a b\r\nX: y", None), (11, "", ""), (12, "u", "short"), (13, "u", "short"), (14, "u", "x" * 99), (15, "u", "x" * 99), (16, "u", "x" * 100), (17, "u", "x" * 100)]
    rows += [(18, "u", "é" * 50), (19, "u", "é" * 50), (20, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (21, "u", prose(rng, 60_000)), (22, "ü", "\u0000 ﬁ 😀" * 30)]
    rows += [(100 + i, f"http://e.example/{i}", f"<p>{prose(rng, 50)}</p>") for i in range(60)]
    rows += [(200 + i, "u", page) for i in range(50)]
    return rows


def want(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    out = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        lead = first.get(body)
        again = lead is not None and page != lead
        out[page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", lead if again else None] += 1
    return out


def got(df):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect())


@pytest.mark.parametrize("archive_bytes", [16 << 20, 2000])
def test_round_trip(spark, archive_bytes):
    rows = pages()
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as id", "3 as own", "4 as record_type")
    manifest = warc.write(table, warc.fresh_directory(spark), archive_bytes=archive_bytes)
    assert got(warc.read(manifest)) == want(rows)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)


def test_files(spark):
    """Any reader of the format finds the dictionary in the leading frame and each record in a frame of its own."""
    manifest = warc.write(spark.createDataFrame(pages(), PAGES).coalesce(1), warc.fresh_directory(spark)).collect()
    targets = []
    for m in manifest:
        raw = open(m["path"].removeprefix("file://"), "rb").read()
        assert len(raw) == m["bytes"] == os.path.getsize(m["path"].removeprefix("file://"))
        assert raw[:4] == bytes.fromhex("5d2a4d18")
        records = list(warc.read_archive(raw))
        assert len(records) == m["records"]
        at, record = records[len(records) // 2]
        upto = [*(a for a, _ in records), len(raw)][len(records) // 2 + 1]
        body = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + int.from_bytes(raw[4:8], "little")])
        assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)).decompress(raw[at:upto]) == record
        targets += [warc.parse_record(r)[0].get("WARC-Target-URI") for _, r in records]
    assert "http://d.example/a%20b%0D%0AX:%20y" in targets and None in targets


def test_damage_is_noticed(spark):
    directory = warc.fresh_directory(spark)
    manifest = warc.write(spark.createDataFrame(pages(), PAGES).coalesce(1), directory)
    path = manifest.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(raw[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_archive(raw[8:]))


@pytest.mark.parametrize("records", [[b"x"], [b"same" * 30] * 50, [os.urandom(3000) for _ in range(200)], [b""]])
def test_any_records(records):
    assert [r for _, r in warc.read_archive(warc.build_archive(records))] == records


def test_empty(spark):
    manifest = warc.write(spark.createDataFrame([], PAGES), warc.fresh_directory(spark))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_test_data(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in table.collect()]
    assert got(warc.read(warc.write(table, warc.fresh_directory(spark)))) == want(rows)


def test_headers_cannot_be_forged():
    raw = warc.build_record(1, "http://x/\r\nWARC-Type: revisit", b"p", "response", None)
    headers, _, payload = warc.parse_record(raw)
    assert headers["WARC-Type"] == "response" and payload == b"p" and not re.search(r"\r\nWARC-Type: revisit", raw.decode())

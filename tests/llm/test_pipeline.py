import pytest

import corpus_pipeline
from millrace.llm import decontaminate

from .cases import HAVE_DATA, SF
from .test_omh import brute_classes
from .test_packing import check


def test_stages_are_listed_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "substring dedup", "decontamination", "packing"]


@pytest.mark.skipif(not HAVE_DATA, reason="no test data")
def test_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs)
        assert i == 4 or docs.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in kept[:4]]
    assert len(texts[0]) > 100
    classes = brute_classes(sorted(texts[0].items()))
    assert set(texts[1]) == {min(map(int, c)) for c in classes}
    seen: set = set()
    for doc, text in sorted(texts[1].items()):  # windows in the order of documents
        words, gone = text.split(), set()
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone |= set(range(s, s + 20))
            seen.add(key)
        assert texts[2][doc] == (" ".join(w for i, w in enumerate(words) if i not in gone) if gone else text)
    hit = decontaminate.decontaminate(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
    assert set(texts[3]) == set(texts[2]) - {r["doc_id"] for r in hit.collect()}
    check(kept[4].collect(), sorted(texts[3].items()), 2048)


def test_decontamination_keeps_clean_rows_of_an_id(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} ends"), (None, "a clean text without an id"), (None, None), (5, item), (5, "another clean text"), (6, "clean")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    kept = corpus_pipeline.benchmark_decontamination(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)

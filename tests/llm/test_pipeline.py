"""The pipeline's stages on small tables with nulls, empty and repeated rows, and on empty ones."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def good(r, n):
    return " ".join("".join(r.choice("th er on an in re ti es".split()) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."


def junk(r, n):
    return " | ".join("ab###" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    item = good(r, 30)
    rows = [(i, good(r, r.randint(30, 80)), "en", f"s{i % 3}", 0) for i in range(80)]
    rows += [(100 + i, junk(r, r.randint(20, 60)), "en", "s0", 0) for i in range(40)]
    rows += [(200, rows[5][1], "en", "s1", 0), (201, rows[5][1] + " more", "en", "s1", 0), (202, rows[6][1] + " " + item, "en", None, 0)]
    rows += [(203, None, None, None, None), (204, "", "en", "", 0), (205, "12 34", None, "s2", 5), (None, good(r, 40), None, "s2", None), (7, rows[7][1], "en", "s1", 0)]
    rows += [(206, good(r, 20_000), "en", "s2", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80)) for i in [*range(80), *range(100, 140)]], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("q1", item), (None, None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_stages(spark, tables):
    d, rows, item = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.lit("mine") for c in ("stats", "score", "key", "rate", "_tg")})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[: len(SCHEMA.split(","))] == [x.split()[0] for x in SCHEMA.split(", ")] and docs.where("stats = 'mine'").count() == docs.count()
        kept[name] = docs.collect()
    ids = {name: [r.doc_id for r in got] for name, got in kept.items()}
    assert not [i for i in ids["quality"] if i is not None and 100 <= i < 140] and set(range(80)) <= set(ids["quality"])
    assert not {203, 204, 205} & set(ids["language"]) and set(range(80)) | {None, 206} <= set(ids["language"])
    assert not {200, 201} & set(ids["near_duplicates"]) and sorted(i for i in ids["near_duplicates"] if i == 7) == [7] and None in ids["near_duplicates"]
    clean = {r.doc_id: r.text for r in kept["decontamination"]}
    assert item not in clean[202] and clean[0] == rows[0][1] and set(range(80)) <= set(clean)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert set(mixed.columns) == {*docs.columns, "copy"} and 0 < mixed.count() < 1000


def test_run_and_empty_tables(spark, tables, tmp_path):
    d, rows, _ = tables
    out = corpus_pipeline.run(spark, d)
    assert out.columns[:5] == [x.split()[0] for x in SCHEMA.split(", ")] and out.count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()

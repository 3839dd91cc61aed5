"""Every stage of the pipeline over odd rows: nulls, empty and long texts, ties, repeats, clashing names and an empty table."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents

from heddle.llm import bpe, mixing, pipeline_stages

ODD = [(1, None, None, None), (2, "", "aa", "s"), (3, " \n\t ", "aa", "s"), (None, "no id here", "aa", "s"), (None, None, None, None), (4, "x", "aa", None), (4, "x", "aa", None), (4, "another text of four", "aa", "s"), (5, "été ñandú 日本 🙂 " * 400, "bb", "t"), (6, "a" * 300_000, "aa", "t"), (7, "password=hunter2222", None, "s")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("stages"))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ne", "to", "ri"]) for _ in range(rng.randint(1, 3)))
    rows = [(100 + i, " ".join([word() for _ in range(50)] + ["grumbler"] * (i % 4 == 0)), "aa", f"s{i % 3}") for i in range(80)]
    documents(spark, ODD + rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(80)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize(("name", "stage"), pipeline_stages.STAGES)
def test_stage_on_odd_rows(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    got = out.collect()
    ids = [r["doc_id"] for r in got]
    if name == "bpe":
        assert out.columns == ["doc_id", "mix_position", "ids"] and len(got) == docs.count() and len({r["mix_position"] for r in got}) == len(got)
        own = bpe.encoder(bpe.VOCABULARY)
        assert sorted(own.decode(r["ids"]).decode() for r in got) == sorted(r["text"] or "" for r in docs.collect())
    else:
        assert tuple(out.columns) == pipeline_stages.COLUMNS
    if name == "toxicity":  # only the abusive documents go
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in docs.collect() if "grumbler" not in (r["text"] or ""))
    if name == "simhash":  # of the texts without words the first stays, with null ids all
        assert ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(4) == 3 and {5, 6, 7} <= set(ids)
    if name in ("secrets", "mix"):
        assert len(got) == docs.count()
    if name == "secrets":
        assert {r["text"] for r in got if r["doc_id"] == 7} == {"[assign]"} and {r["text"] for r in got if r["doc_id"] == 1} == {None}
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_places_follow_the_order_that_the_mix_wrote(spark, tmp_path):
    rows = [(i, f"text {i}", "aa", f"s{i % 3}" if i % 7 else None) for i in range(500)]
    read = lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    docs = read(documents(spark, rows).select(*pipeline_stages.COLUMNS).repartition(5), "docs")
    places = lambda df: {r["doc_id"]: r["mix_position"] for r in pipeline_stages.encode_bpe(spark, df, "").collect()}
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mix_rows(docs).collect()}
    mixed = pipeline_stages.mix_sources(spark, docs, "")
    assert places(read(mixed, "mixed")) == want and places(mixed) == want
    assert sorted(places(docs).values()) == sorted(want.values()) and places(docs) != want  # without the stage: another order
    turned = mixed.select("*").withColumn("_p", F.monotonically_increasing_id()).orderBy(F.desc("_p")).drop("_p")
    got = places(read(turned, "turned"))
    assert sorted(got, key=got.get) == sorted(want, key=want.get, reverse=True)
    some = places(docs.filter("doc_id < 100"))  # no whole files
    assert len(some) == len(set(some.values())) == 100


def test_a_task_that_encodes_has_one_python_worker(spark, tmp_path):
    rows = [(i, f"text {i}", "aa", f"source {i % 300}") for i in range(1_000)]  # 300 short blocks
    docs = documents(spark, rows).select(*pipeline_stages.COLUMNS)
    pipeline_stages.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    encoded = pipeline_stages.encode_bpe(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|EvalPython|InPandas|PythonUDTF", plan)) == 1  # each is a worker of its own, kept with the encoder it loaded
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mix_rows(docs).collect()}
    assert {r["doc_id"]: r["mix_position"] for r in encoded.collect()} == want
    assert pipeline_stages.encode_bpe(spark, docs.limit(0), "").count() == 0

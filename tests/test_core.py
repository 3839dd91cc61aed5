"""The library's own operators on small literals, and every query against its SQL in DuckDB."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from heddle.functions import answers, keys
from heddle.functions import text as T
from heddle.operators import adapters, dedup, generators, graph, intervals, quality, sampling, sequences, stats, temporal, vector
from heddle.plans import registry
from heddle.streaming import runtime, tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    sql = registry.ORACLE_SQL.get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_file_digests_are_those_of_the_files(spark):
    import hashlib
    from pathlib import Path

    want = [(len(x), hashlib.sha256(x).hexdigest()) for x in [Path(f"{DATA}/region.parquet").read_bytes()]]
    assert [(r["bytes"], r["sha256"]) for r in __spark_entry__.queries()["s8_file_digest"](spark, DATA).collect()] == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_split_and_draws(spark):
    ids = [f"id{i}" for i in range(2000)]
    df = spark.createDataFrame([(i,) for i in ids], "k string")
    rows = df.select("k", keys.hash_unit(F.lit("split"), "k").alias("u"), keys.split_of("k", {"train": 0.9, "validation": 0.05, "test": 0.05}).alias("s")).collect()
    for r in rows:
        u = int(hashlib.sha256(f"split|{r['k']}".encode()).hexdigest()[:16], 16) / 18446744073709551615.0
        assert r["u"] == u and r["s"] == ("train" if u < 0.9 else "validation" if u < 0.9 + 0.05 else "test")
    with pytest.raises(ValueError):
        keys.split_of("k", {"a": 0.9, "b": 0.2})


def test_work_key_ignores_order(spark):
    df = spark.createDataFrame([({"b": "2", "a": "é"},), ({"a": "é", "b": "2"},)], "m map<string,string>")
    assert {r[0] for r in df.select(keys.work_key(F.lit("s"), "m")).collect()} == {'s:{"a":"é","b":"2"}'}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.clean_multiline(F.lit(" a  b \n\n  \nc"))) == "a b\nc"
    assert one(T.short(F.lit("abc, def ghi"), 6)) == "abc…" and one(T.short(F.lit("abc"), 6)) == "abc"
    assert one(T.choice_prompt(F.lit("q"), F.array(F.lit("x"), F.lit("y")))) == "q\nA. x\nB. y"
    assert one(T.number_tokens(F.lit("+1,200 and -3.5 or 7"))) == ["1200", "-3.5", "7"]
    assert tuple(one(T.calendar_date(F.lit("31st February, 1999")))) == (1999, 2, 31)
    assert one(T.calendar_date(F.lit("February 32 1999"))) is None and tuple(one(T.partial_date(F.lit("4 May")))) == (5, 4)
    assert one(T.contains_token(F.lit("see x.y today"), F.lit("x.y"))) and not one(T.contains_token(F.lit("see xay"), F.lit("x.y")))
    holds = lambda t, m: one(T.contains_token(F.lit(t), F.lit(m)))
    assert holds("it cost 1,200 then", "1200") and not holds("it cost 12000", "1200") and holds("a+5", "5") and not holds("was 5.5", "5") and not holds("x", "")
    assert not holds("étéx", "x") and holds("été x!", "x") and holds("a \\E b", "\\E") and not holds("naïve", "na")
    assert one(T.qa_normalize(F.lit("The  “Big” Apple, 1,000!"))) == "big apple 1000"
    assert one(T.surface_signature(F.lit("Task-0012 has 3.5 kg, a1 and  x-12 -4"))) == "<id> has <n> kg, a1 and x-<n> <n>"


@pytest.mark.parametrize(
    ("said", "reference", "same"),
    [
        ("Paris", "paris", True), ("the Paris", "Paris", True), ("Yes, it is", "yes", True), ("yesterday", "yes", False), ("USA", "United States", True), ("seven", "7", True),
        ("May 4, 1999", "4 May 1999", True), ("4 May", "May 4 1999", True), ("about 1,200", "1200", True), ("in 1999 and 2001", "1999", True), ("2001", "1999", False),
        ("it was Albert Einstein then", "Albert Einstein", True), ("Einstein", "Albert Einstein", False), ("", "x", False), ("12 apples", "13", False),
        ("american", "united states", True), ("Scottish", "UK", True), ("holland", "netherlands", False), ("Bombay, India", "Mumbai", True), ("the North West", "northwest", True), ("yes—it is", "yes", True), ("1999–2001", "1999 to 2001", True),
        ("12 of 15", "12", True), ("about 12 or so", "12", True), ("kilometres: 12", "13 km", False), ("French", "Germany", False), ("in AD 1066", "1066", True), ("-3", "3", False),
    ],
)
def test_answers(spark, said, reference, same):
    assert answers.with_answer_match(spark.range(1), F.lit(said), F.lit(reference), "x").first()["x"] is same


def test_places_in_order_and_shards(spark):
    from heddle.operators import ranking, sampling

    rows = [(i, "hot" if i % 3 else None if i % 2 else "b", (i * 7919) % 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = ranking.place_in_order(df, ["v", "k"], ["g"], "at", "all").collect()
    for g in ("hot", "b", None):
        want = sorted((v, k) for k, h, v in rows if h == g)
        assert sorted((r["at"], r["v"], r["k"]) for r in got if r["g"] == g) == [(i, v, k) for i, (v, k) in enumerate(want)]
        assert {r["all"] for r in got if r["g"] == g} == {len(want)}
    assert sorted(r["_place"] for r in ranking.place_in_order(df, ["v", "k"]).collect()) == list(range(500))
    assert ranking.place_in_order(df.limit(0), ["v"], ["g"]).count() == 0
    few = sampling.round_robin_shards(df.filter("k < 3"), 8, ["k"]).collect()
    assert sorted(r["shard"] for r in few) == list(range(8))


def test_assignment_of_more_rows_than_columns(spark):
    from itertools import permutations

    from heddle.operators import vector

    cost = {(a, b): (a * 37 + b * 61) % 29 for a in range(6) for b in range(4)}
    for flip in (False, True):
        rows = [(1, *((b, a) if flip else (a, b)), float(c)) for (a, b), c in cost.items()]
        got = vector.assign(spark.createDataFrame(rows, "g long, r long, c long, cost double"), "g", "r", "c", "cost").collect()
        total = sum(cost[(x["c"], x["r"]) if flip else (x["r"], x["c"])] for x in got)
        assert len(got) == 4 and total == min(sum(cost[a, b] for b, a in enumerate(p)) for p in permutations(range(6), 4))


def test_exact_arithmetic_and_boxes():
    assert answers.exact("(1 + 2) * 3 / 4") == Fraction(9, 4) and answers.exact("-2.5*2") == -5
    assert answers.exact("__import__('os')") is None and answers.exact("1/0") is None and answers.exact("2**9") is None
    assert answers.last_boxed_value("a \\boxed{1} b \\fbox{x{2}y}") == "x{2}y" and answers.last_boxed_value("\\boxed 2$") == "2"
    assert answers.last_boxed_value("\\boxed{}") is None and answers.last_boxed_value("none") is None and answers.last_boxed_value("\\boxed{1") is None
    assert answers.canonical_json_value('{"b": 1, "a": {"d": 2, "c": "é"}}') == '{"a":{"c":"é","d":2},"b":1}' and answers.canonical_json_value("{") is None
    assert answers.evidence_markers_of('{"a": "no", "b": "yes", "c": [1, true]}') == ["yes", "1", "[1,true]", '{"a":"no","b":"yes","c":[1,true]}']


def test_adapters(spark):
    mmlu = adapters.adapt(spark.createDataFrame([("q", ["x", "y"], 1), ("q", ["x"], 5)], "question string, choices array<string>, answer int"), "mmlu").collect()
    assert mmlu[0]["reference_answer"] == "y" and mmlu[0]["valid"] and not mmlu[1]["valid"]
    arc = adapters.adapt(spark.createDataFrame([("q", (["A", "B"], ["x", "y"]), "B"), ("q", (["A"], ["x"]), "Z")], "question string, choices struct<label:array<string>,text:array<string>>, answerKey string"), "arc").collect()
    assert arc[0]["reference_answer"] == "y" and not arc[1]["valid"]
    nq = adapters.adapt(spark.createDataFrame([("q", [" ", "b", "b", "a"]), ("q", [" "])], "question string, answer array<string>"), "nq_open").collect()
    assert nq[0]["aliases"] == ["b", "a"] and not nq[1]["valid"]
    wiki = adapters.adapt(spark.createDataFrame([("q", "a", "[[\"t\", \"s\"]]"), ("q", "a", "{bad")], "question string, answer string, context string"), "2wikimultihopqa").collect()
    assert wiki[0]["valid"] and not wiki[1]["valid"]
    rows = spark.createDataFrame([(0.0, (["toxicity"], [0.9])), (0.0, (["quality"], [0.7])), (float("nan"), ([], [])), (0.0, None)], "rank double, labels struct<name:array<string>,value:array<double>>")
    assert [r[0] for r in rows.select(adapters.oasst_ok()).collect()] == [False, True, False, True]


def test_sequential_quota_reopens_what_was_beyond_the_quota(spark):
    rows = [("a", "k1", 1), ("a", "k2", 2), ("b", "k1", 1), ("b", "k2", 2), ("b", "k2", 3)]
    out = dedup.sequential_quota(spark.createDataFrame(rows, "s string, k string, o int"), "s", ["a", "b"], "k", ["o"], {"a": 1, "b": 5})
    assert sorted(map(tuple, out.collect())) == [("a", "k1", 1), ("b", "k2", 2)]


def test_shards_cover_and_wrap(spark):
    for n, world in ((1, 6), (7, 3), (12, 4)):
        df = spark.range(n).withColumn("b", F.lit("x"))
        rows = sampling.round_robin_shards(df, world, ["id"], ["b"]).collect()
        assert len(rows) == -(-n // world) * world and {r["id"] for r in rows} == set(range(n))
        assert {r["shard"] for r in rows} == set(range(world))


def test_as_of_latest_and_freshness(spark):
    v = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("a", 3, 31), ("b", 5, 50)], "k string, t int, v int")
    p = spark.createDataFrame([("a", 0, 1), ("a", 3, 2), ("a", 9, 3), ("b", 4, 4)], "k string, t int, id int")
    assert {r["id"]: r["asof_v"] for r in temporal.as_of(p, v, ["k"], "t", ["v"], "v").collect()} == {1: None, 2: 31, 3: 31, 4: None}
    assert {r["id"] for r in temporal.delivered_versions(p, v, ["k"], "t", "v").collect()} == {2}
    assert {r["k"]: r["v"] for r in temporal.latest_per_key(v, ["k"], ["t", "v"], ["v"]).collect()} == {"a": 31, "b": 50}
    e = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q"), ("z", None, "r"), ("w", 1, "s")], "k string, version int, value string")
    o = spark.createDataFrame([("x", 1, "p"), ("y", 1, "q"), ("z", 9, "r")], "k string, version int, value string")
    assert {r["k"]: r["status"] for r in temporal.freshness(e, o, "k").collect()} == {"x": "fresh", "y": "stale", "z": "fresh", "w": "missing"}


def test_intervals(spark):
    t = spark.createDataFrame([("a", "s", 1, 1), ("a", "s", 2, 2), ("a", "f", 5, 3), ("a", "f", 6, 4), ("b", "f", 1, 5)], "k string, kind string, t int, seq int")
    assert [tuple(r) for r in intervals.pair_intervals(t, ["k"], "kind", "s", "f", "t", "seq").collect()] == [("a", 2, 5)]
    rng = random.Random(1)
    rows = [(rng.choice("ab"), s, s + rng.randint(1, 9)) for s in (rng.randint(0, 80) for _ in range(60))]
    df = spark.createDataFrame(rows, "k string, start int, finish int")
    merged = {tuple(r) for r in intervals.merge_intervals(df, ["k"]).collect()}
    for k in "ab":
        points = {x for kk, s, f in rows if kk == k for x in range(s, f)}
        assert {x for kk, s, f in merged if kk == k for x in range(s, f)} == points
    other = spark.createDataFrame([(k, s + 3, f + 4) for k, s, f in rows[:20]], "k string, start int, finish int")
    plain = sorted(map(tuple, intervals.overlaps(df, other, ["k"]).collect()))
    assert sorted(map(tuple, intervals.binned_overlaps(df, other, ["k"], 7).collect())) == plain


def test_sequences(spark):
    s = spark.createDataFrame([("a", x) for x in (0, 1, 2, 5, 6, 9)], "k string, s int")
    assert sorted((r[1], r[2]) for r in sequences.transitions(s, ["k"], "s").collect()) == [(-1, 0), (0, 1), (1, 2), (5, 6)]
    assert sorted((r["first_step"], r["length"]) for r in sequences.runs(s, ["k"], "s").collect()) == [(0, 3), (5, 2), (9, 1)]
    assert sorted((r["first_step"], r["last_step"]) for r in sequences.rollout_windows(s, ["k"], "s", 2).collect()) == [(0, 1), (2, 2), (5, 6), (9, 9)]
    items = [("e0", 0, 2, []), ("e1", 0, 1, ["e0"]), ("e2", 9, 1, [])]
    df = spark.createDataFrame([(items,)], "items array<struct<id:string,activation:bigint,delay:bigint,depends_on:array<string>>>")
    got = df.select(F.explode(sequences.sequential_schedule("items")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("e0", 0, 2), ("e1", 2, 3), ("e2", 9, 10)]
    blocks = spark.range(10).select(sequences.proportional_block(F.col("id"), F.lit(10), 3).alias("b")).collect()
    assert [r["b"] for r in blocks] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_statistics(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 2, 5, 9, 11)], "k string, v int")
    for q in (0.0, 0.1, 0.3, 0.5, 0.9, 1.0):
        v = sorted((1, 2, 2, 5, 9, 11))
        assert stats.index_quantile(df, ["k"], "v", q, "round").first()["quantile"] == v[round(5 * q)]
        assert stats.index_quantile(df, ["k"], "v", q, "floor").first()["quantile"] == v[int(5 * q)]
    w = spark.createDataFrame([("t1", 1.0, 4), ("t1", 1.0, 2), ("t2", 3.0, 1)], "t string, w double, n int")
    rows = stats.balance_weights(w, "t", "w", "n").collect()
    assert abs(sum(r["loss_weight"] * r["n"] for r in rows) / 7 - 1) < 1e-12
    m = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "z", 1)], "k string, v string, o int")
    assert {r["k"]: r["v"] for r in stats.majority(m, ["k"], "v", "o").collect()} == {"a": "y", "b": "z"}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (2, 5), (5, 6)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.reachable(e, start).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2), (5, 2), (6, 3)}
    assert {r["node"] for r in graph.reachable(e, start, spark.createDataFrame([(5,)], "node long")).collect()} == {1, 2, 3, 4}
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "k string, p string")
    got = {(r["k"], r["hops"], r["ancestor"]) for r in graph.chain(p, "k", "p", 7).collect()}
    assert got == {("a", 1, "b"), ("a", 2, "c"), ("b", 1, "c"), ("x", 1, "y"), ("y", 1, "x")}
    d = spark.createDataFrame([([[], [0], [0, 1], []],)], "parents array<array<int>>")
    assert d.select(graph.depth_of("parents").alias("x")).first()["x"] == [1, 2, 3, 1]


def test_assignment_is_least():
    import itertools

    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.random((n, m))
        got = vector.hungarian(cost)
        assert len(set(got)) == n
        assert np.isclose(cost[range(n), got].sum(), min(cost[range(n), list(p)].sum() for p in itertools.permutations(range(m), n)))
    with pytest.raises(ValueError):
        vector.hungarian(np.ones((3, 2)))


def test_rules(spark):
    df = spark.createDataFrame([("a", 5, '{"k": {"delay": 1}}'), ("b", None, '{"z": 2}'), ("b", 3, "{}")], "id string, v int, j string")
    assert {(r["rule"], r["key"]) for r in quality.range_violations(df, "id", {"small": F.col("v") < 5}).collect()} == {("small", "a"), ("small", "b")}
    assert [r["key"] for r in quality.duplicate_keys(df, ["id"]).collect()] == ["b"]
    assert [r["key"] for r in quality.unknown_keys(df, "id", "j", ["k"]).collect()] == ["b"]
    assert [r["detail"] for r in quality.forbidden_keys(df, "id", "j", ["delay"]).collect()] == ["delay"]
    frames = spark.createDataFrame([("t", 0, "x", False), ("t", 1, "y", False), ("t", 2, "y", True), ("t", 3, "y", False)], "t string, pos int, c string, r boolean")
    assert {(r["rule"], r["key"]) for r in quality.vanished(frames, ["t"], "pos", "c", "r").collect()} == {("vanished", "t|x"), ("reactivated", "t|y")}
    with pytest.raises(ValueError, match="unique: b"):
        quality.assert_none(quality.duplicate_keys(df, ["id"]))


def test_generators_are_deterministic_and_right(spark):
    a, b = (generators.generate(spark, 800, s) for s in (1, 1))
    assert a.collect() == b.collect() and generators.verify(a).count() == 0
    assert generators.generate(spark, 800, 2).select("prompt").subtract(a.select("prompt")).count() > 400
    spoiled = a.withColumn("answer", F.when(F.col("task_no") == 3, F.col("answer") + 1).otherwise(F.col("answer")))
    assert generators.verify(spoiled).count() == 1


def test_runtime_rules():
    run = lambda *rows: [(r[2], r[3]) for r in runtime.advance(runtime.new_state(), 1, rows)]
    need = lambda seq, n, src="s", arg="1": (seq, "need", n, src, arg, None)
    seen = lambda seq, v, arg="1": (seq, "observe", None, "s", arg, v)
    assert run(need(1, "a"), need(2, "b")) == [("binding_active", "b1"), ("external_refresh_started", "b1"), ("binding_active", "b2"), ("job_deduplicated", "b2")]
    assert run(need(1, "a"), need(2, "b"), seen(3, "v"))[4:] == [("external_refresh_finished", None), ("binding_observation_updated", "b1"), ("binding_observation_updated", "b2")]
    assert run(need(1, "a"), seen(2, "v"), need(3, "c"))[-1] == ("cache_hit", "b2")
    assert ("observation_invalidated", "b1") in run(need(1, "a"), seen(2, "v"), need(3, "a", arg="2"))
    assert run(need(1, "a"), need(2, "a", src="t"))[2:4] == [("binding_retired", "b1"), ("binding_active", "b2")]
    assert run(need(1, "a"), (2, "retire", None, None, None, None))[-1] == ("external_refresh_cancelled", "b1")
    assert run(need(1, "a"), seen(2, "v"), seen(3, "v")).count(("binding_observation_updated", "b1")) == 1


def test_stream_equals_batch(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    batch = runtime.replay(runtime.from_events(e))
    s = tables.read_stream(spark, f"{DATA}/events.parquet", e.schema)
    out = tables.run_to_table(runtime.stream(runtime.from_events(s)), "test", each=lambda b, _: b).drop("batch")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(batch)


def test_upsert(spark):
    a = spark.createDataFrame([("k1", "x"), ("k2", "y")], "k string, p string")
    b = spark.createDataFrame([("k2", "y"), ("k3", "z"), ("k1", "other")], "k string, p string")
    assert {tuple(r) for r in tables.upsert(a, b, "k", "p").collect()} == {("k1", "x", "conflict"), ("k2", "y", "unchanged"), ("k3", "z", "inserted")}

"""Queries over scans and sinks, streams, generators, review and compilation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import answers
from heddle.functions import text as X
from heddle.operators import adapters, generators, quality, review
from heddle.plans.registry import query
from heddle.sources import scans, sinks
from heddle.sources.shared import read_table, shared_dir
from heddle.streaming import runtime, tables


def folder(spark, tag):
    return f"{shared_dir(spark)}/heddle/{tag}-{uuid.uuid4().hex}"


@query("s1_k1_jsonl_round_trip", "SELECT conv_id, turn, role, sha256(text) digest FROM conversations")
def s1(spark, d):
    c = read_table(spark, d, "conversations")
    path = folder(spark, "jsonl")
    sinks.jsonl(c, path)
    return scans.jsonl(spark, path, c.schema).select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


@query("s2_parse_with_defaults", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT k, 0.55::DOUBLE threshold FROM events")
def s2(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.from_json("props", "k long, threshold double").alias("j")).select("event_id", "j.*")
    return scans.with_defaults(e, {"threshold": 0.55})


@query("s3_k8_rejects", "SELECT 'good' side, count(*) n FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 10 = 3")
def s3(spark, d):
    """Lines that aren't objects of the schema go aside, the others stay."""
    path = folder(spark, "lines")
    line = F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.concat(F.lit('{"id": '), "event_id", F.lit("}")))
    read_table(spark, d, "events").select(line.alias("value")).write.text(path)
    good, bad = scans.json_objects(spark, path, T.StructType([T.StructField("id", T.LongType())]))
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("side"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("side"), "n"))


@query("s4_parquet_row_key", "SELECT count(*) n, count(*) distinct_keys FROM documents")
def s4(spark, d):
    x = scans.parquet_with_row_key(spark, f"{d}/documents.parquet").select("row_key")
    return x.agg(F.count("*").alias("n"), F.count_distinct("row_key").alias("distinct_keys"))


@query("s5_typed_scan", "SELECT doc_id, lang FROM documents WHERE n_chars > 3000")
def s5(spark, d):
    return spark.read.schema("doc_id long, lang string, n_chars long").parquet(f"{d}/documents.parquet").filter("n_chars > 3000").select("doc_id", "lang")


@query("s6_s7_json_map_scan", "SELECT n_nationkey::VARCHAR AS \"key\", n_name AS \"value\" FROM nation")
def s6(spark, d):
    """One JSON map in a file, exploded to rows."""
    path = folder(spark, "map")
    n = read_table(spark, d, "nation")
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value")).write.text(path)
    return scans.keyed_documents(spark, path, "string")


@query("s8_file_digest")
def s8(spark, d):
    return scans.file_digests(spark, f"{d}/region.parquet").select("bytes", "sha256")


@query("s9_json_manifest_dir", "SELECT r_regionkey, r_name FROM region")
def s9(spark, d):
    path = folder(spark, "manifests")
    read_table(spark, d, "region").repartition(3).write.json(path)
    docs = scans.json_documents(spark, path).filter("parsed is not null or text <> ''")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("l")).filter("l <> ''")
    return lines.select(F.from_json("l", "r_regionkey int, r_name string").alias("j")).select("j.*")


@query("s12_pool_scan", "SELECT count(*) n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def s12(spark, d):
    need = ["doc_id", "text", "lang", "source"]
    bad = quality.range_violations(read_table(spark, d, "documents"), "doc_id", {c: F.col(c).isNotNull() for c in need})
    all_ = read_table(spark, d, "documents").agg(F.count("*").alias("n"))
    return all_.join(F.broadcast(bad.agg(F.count_distinct("key").alias("b")))).select((F.col("n") - F.col("b")).alias("n"))


@query("s13_filtered_scan", "SELECT 'found' side, count(*) n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'absent', count(*) FROM customer WHERE c_nationkey = 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s13(spark, d):
    ids = read_table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    found, absent = scans.selected(read_table(spark, d, "orders"), ids, "o_custkey")
    one = lambda x, name: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return one(found, "found").unionByName(one(absent, "absent"))


@query("s15_s19_u2_data_source", "SELECT n_nationkey, n_name, 'v7:' || n_nationkey AS \"version\" FROM nation")
def s19(spark, d):
    """A mapping with versions as a Python data source: the nations, a fixed dimension, as its entries."""
    spark.dataSource.register(scans.VersionedMapping)
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    entries = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "n_name"))))).first()[0]
    m = spark.read.format("heddle_mapping").option("entries", entries).option("version", "v7").load()
    return m.select(F.col("key").cast("long").alias("n_nationkey"), F.col("value").alias("n_name"), "version")


@query("s16_clock_source", "SELECT event_type, count(*) n FROM events GROUP BY 1")
def s16(spark, d):
    """Every event stamped with the clock of the read: one time for all rows, not before any of them."""
    e = read_table(spark, d, "events").withColumn("now", F.current_timestamp())
    one = F.size(F.collect_set("now")) == 1
    return e.filter("now >= ts").groupBy("event_type").agg(F.when(one, F.count("*")).alias("n"))


@query("k4_sorted_keyed", "SELECT count(*) n, 0 unsorted FROM lineitem")
def k4(spark, d):
    path = folder(spark, "sorted")
    sinks.sorted_keyed(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), path, ["l_orderkey", "l_linenumber"])
    return sinks.unsorted(spark, path, "l_orderkey")


@query("k5_manifest_sink", "SELECT count(*) n, max(n_chars) most FROM documents")
def k5(spark, d):
    path = folder(spark, "manifest")
    sinks.manifest(read_table(spark, d, "documents").agg(F.count("*").alias("n"), F.max("n_chars").alias("most")), path)
    return spark.read.schema("n long, most long").json(path)


@query("k7_partitioned_sink", "SELECT lang, count(*) n FROM documents GROUP BY 1")
def k7(spark, d):
    path = folder(spark, "blocks")
    sinks.partitioned(read_table(spark, d, "documents").select("doc_id", "lang"), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("k8_reject_sink", "SELECT 'good' side, count(*) n FROM orders WHERE o_totalprice >= 1000 UNION ALL SELECT 'bad', count(*) FROM orders WHERE o_totalprice < 1000")
def k8(spark, d):
    a, b = folder(spark, "good"), folder(spark, "bad")
    o = read_table(spark, d, "orders")
    sinks.with_rejects(o, a, b, F.when(F.col("o_totalprice") < 1000, "price too low"))
    bad = spark.read.schema("o_orderkey long").json(b)
    return spark.read.parquet(a).agg(F.count("*").alias("n")).select(F.lit("good").alias("side"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("side"), "n"))


# --- answers, JSON and adapters -----------------------------------------------------------------------------------


@query("str13_answer_match", "SELECT event_id, event_id % 3 <> 2 ok FROM events")
def str13(spark, d):
    """Numbers written three ways against the plain number: with words that don't matter, bare, and off by one."""
    e = read_table(spark, d, "events")
    n = F.col("event_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("about "), n)).when(n % 3 == 1, n.cast("string")).otherwise((n + 1).cast("string"))
    return answers.with_answer_match(e, said, n.cast("string"), "ok").select("event_id", "ok")


@query("str10_qa_normalize", """WITH a AS (SELECT conv_id, turn, lower(translate(text, '‘’“”–—', '''''""--')) y FROM conversations), b AS (SELECT *, regexp_replace(regexp_replace(y, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g') z FROM a),
 c AS (SELECT *, replace(regexp_replace(regexp_replace(z, '\\.([0-9])', '§\\1', 'g'), '[^a-z0-9à-öø-ÿ§+-]+', ' ', 'g'), '§', '.') w FROM b)
 SELECT conv_id, turn, sha256(array_to_string(list_filter(regexp_split_to_array(trim(w), ' +'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')) n FROM c""")
def str10(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.qa_normalize("text"), 256).alias("n"))


@query("str17_token_containment", "SELECT n_nationkey, regexp_matches('NATION_1 and NATION_12', '(^|[^A-Za-z0-9_])' || n_name || '($|[^A-Za-z0-9_])') hit FROM nation")
def str17(spark, d):
    return read_table(spark, d, "nation").select("n_nationkey", X.contains_token(F.lit("NATION_1 and NATION_12"), "n_name").alias("hit"))


@query("str17_benchmark_containment", "SELECT b.item_id, count(*) n FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda x: x <> '')) >= 6 GROUP BY 1")
def str17b(spark, d):
    """Documents that hold a whole benchmark passage (of six words or more): its second to fifth words, which stand whole wherever it does, are the key of the candidates; the whole passage is looked for in those."""
    b = read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")).withColumn("w", F.filter(F.split("passage", "\\s+"), lambda x: x != "")).filter(F.size("w") >= 6)
    b = b.select("item_id", "passage", F.array_join(F.slice("w", 2, 4), " ").alias("k"))
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    words = F.split("text", "\\s+")
    shifted = [words, *(F.slice(words, i, F.greatest(F.size(words) - i + 1, F.lit(0))) for i in (2, 3, 4))]
    grams = F.transform(F.arrays_zip(*(x.alias(f"w{i}") for i, x in enumerate(shifted))), lambda x: F.concat_ws(" ", x["w0"], x["w1"], x["w2"], x["w3"]))
    hits = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("k")).join(b.select("k", "item_id", "passage"), "k")
    return hits.join(docs, "doc_id").filter(F.contains("text", F.col("passage"))).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n"))


@query("str18_evidence_markers", """SELECT event_id, json_extract_string(props, '$.k') || '|{"k":' || json_extract_string(props, '$.k') || '}' markers FROM events""")
def str18(spark, d):
    return read_table(spark, d, "events").select("event_id", F.array_join(answers.evidence_markers("props"), "|").alias("markers"))


@query("str23_arithmetic", "SELECT o_orderkey, (o_orderkey * 3 + o_custkey)::VARCHAR AS \"value\" FROM orders")
def str23(spark, d):
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey", answers.arithmetic(F.format_string("%d * 3 + (%d)", "o_orderkey", "o_custkey")).alias("value"))


@query("str24_linear_verifier", "SELECT n_nationkey, n_nationkey % 2 = 0 ok FROM nation")
def str24(spark, d):
    n = F.col("n_nationkey")
    eqs = F.format_string("2*x + y = %d; x - y = %d", 2 * n + 1 + n % 2, n - 1)
    return read_table(spark, d, "nation").select("n_nationkey", answers.solves_linear(eqs, F.format_string("x=%d;y=1", n)).alias("ok"))


@query("p2_str9_last_boxed", "SELECT o_orderkey, '{' || o_custkey || '}' boxed FROM orders WHERE o_orderkey % 5 <> 0")
def p2(spark, d):
    t = F.when(F.col("o_orderkey") % 5 == 0, "no answer").otherwise(F.concat(F.lit("first \\boxed{1}, then \\boxed{{"), "o_custkey", F.lit("}} done")))
    rows = adapters.adapt(read_table(spark, d, "orders").select("o_orderkey", F.lit("q").alias("problem"), t.alias("solution")), "hendrycks_math")
    return rows.filter("valid").select("o_orderkey", F.col("reference_answer").alias("boxed"))


@query("f2_row_reject", "SELECT count(*) FILTER (o_orderkey % 5 = 0) rejected, count(*) FILTER (o_orderkey % 5 <> 0) kept FROM orders")
def f2(spark, d):
    a = F.when(F.col("o_orderkey") % 5 == 0, "#### ").otherwise(F.concat(F.lit("so #### "), "o_custkey"))
    rows = adapters.adapt(read_table(spark, d, "orders").select(F.lit("q").alias("question"), a.alias("answer")), "gsm8k")
    return rows.agg(F.count_if(~F.col("valid")).alias("rejected"), F.count_if("valid").alias("kept"))


@query("p6_zip_documents", "SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1")
def p6(spark, d):
    by = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("title"), F.collect_list(F.array(F.col("l_shipdate").cast("string"))).alias("sentences"))
    rows = adapters.adapt(by.select("l_orderkey", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.struct("title", "sentences").alias("context")), "hotpotqa")
    return rows.filter("valid").select("l_orderkey", F.size("documents").cast("long").alias("n"))


@query("p8_supporting_titles", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2")
def p8(spark, d):
    para = F.struct(F.col("l_partkey").cast("string").alias("title"), (F.col("l_returnflag") == "R").alias("is_supporting"))
    by = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(para).alias("paragraphs"))
    rows = adapters.adapt(by.select("l_orderkey", "paragraphs", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(True).alias("answerable")), "musique")
    return rows.filter("valid").select("l_orderkey")


@query("js3_js7_canonical_json", "SELECT event_id, '{\"a\":[1,2],\"k\":' || json_extract_string(props, '$.k') || '}' j FROM events")
def js3(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", answers.canonical_json_text(F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, 2]}'))).alias("j"))


@query("r11_lifecycle", """SELECT event_id, CASE WHEN cur IS NULL THEN 'ACTIVE' WHEN cur = 'RETIRED' THEN 'RETIRED' WHEN cur = 'WAITING' AND w THEN 'WAITING' WHEN cur = 'WAITING' AND (a OR prop = 'WAITING') THEN 'ACTIVE' WHEN cur = 'WAITING' THEN prop WHEN cur = 'STABLE' AND r THEN 'ACTIVE' WHEN cur = 'STABLE' AND prop = 'ACTIVE' THEN 'STABLE' WHEN cur = 'STABLE' AND prop = 'WAITING' THEN CASE WHEN w THEN 'WAITING' ELSE 'STABLE' END WHEN cur = 'STABLE' THEN prop WHEN prop = 'WAITING' AND NOT w THEN 'ACTIVE' ELSE prop END resolved
 FROM (SELECT event_id, ['ACTIVE','WAITING','STABLE','RETIRED',NULL][1 + event_id % 5] cur, ['ACTIVE','WAITING','STABLE','RETIRED'][1 + (event_id // 5) % 4] prop, (event_id // 20) % 2 = 1 w, (event_id // 40) % 2 = 1 a, (event_id // 80) % 2 = 1 r FROM events)""")
def r11(spark, d):
    """The whole transition table: every state, proposal and signal."""
    i = F.col("event_id")
    states = ["ACTIVE", "WAITING", "STABLE", "RETIRED"]
    cur = F.element_at(F.array(*map(F.lit, [*states, None])), (i % 5 + 1).cast("int"))
    prop = F.element_at(F.array(*map(F.lit, states)), (F.floor(i / 5) % 4 + 1).cast("int"))
    bit = lambda n: F.floor(i / n) % 2 == 1
    return read_table(spark, d, "events").select("event_id", answers.lifecycle(cur, prop, bit(20), bit(40), bit(80)).alias("resolved"))


# --- streams ---------------------------------------------------------------------------------------------------------


def event_stream(spark, d):
    return tables.read_stream(spark, f"{d}/events.parquet", read_table(spark, d, "events").schema)


@query("r1_r5_runtime_replay")
def r1(spark, d):
    """Trace of the runtime for each case: reconcile, invalidate, share reads, cache, project."""
    return runtime.replay(runtime.from_events(read_table(spark, d, "events"))).groupBy("event").agg(F.count("*").alias("n"))


@query("r1_r5_runtime_stream")
def r1_stream(spark, d):
    """The same trace from a stream with keyed state."""
    out = tables.run_to_table(runtime.stream(runtime.from_events(event_stream(spark, d))), "runtime", each=lambda b, _: b)
    return out.groupBy("event").agg(F.count("*").alias("n"))


@query("r8_stream_first_wins", "SELECT event_type, count(DISTINCT user_id) n FROM events GROUP BY 1")
def r8(spark, d):
    """A cache by key: the first observation of each key in a stream."""
    s = event_stream(spark, d).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")
    return tables.run_to_table(s, "cache").groupBy("event_type").agg(F.count("*").alias("n"))


@query("r10_stream_latest", "SELECT user_id, max(event_id) last_id, count(*) n FROM events GROUP BY 1")
def r10(spark, d):
    """A changelog in update mode; the latest batch of a key wins."""
    s = event_stream(spark, d).groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.count("*").alias("n"))
    return tables.latest(tables.run_to_table(s, "facts", "update"), ["user_id"])


@query("s17_replay_source", "SELECT user_id, count(*) n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def s17(spark, d):
    s = event_stream(spark, d).filter("event_type = 'purchase'").select("user_id", "event_id")
    return tables.run_to_table(s, "replay").groupBy("user_id").agg(F.count("*").alias("n"))


@query("r19_resumable_waves", "SELECT status, count(*) n FROM (SELECT CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'unchanged' WHEN k % 3 = 0 THEN 'inserted' ELSE 'kept' END status FROM (SELECT o_orderkey k FROM orders) WHERE k % 2 = 0 OR k % 3 = 0) GROUP BY 1")
def r19(spark, d):
    """Two waves of answers merged by key: what came before stays, the same answer again changes nothing."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    return tables.upsert(o.filter("k % 2 = 0"), o.filter("k % 3 = 0"), "k", "p").groupBy("status").agg(F.count("*").alias("n"))


# --- corpus: tasks, review, compilation --------------------------------------------------------------------------------


def corpus(c):
    """Conversations as tasks: user turns are evidence, the last turn the answer; every seventh plan is spoiled."""
    w = W.partitionBy("conv_id").orderBy("turn")
    last = F.max("turn").over(W.partitionBy("conv_id"))
    c = c.withColumns({"task_id": F.format_string("t%06d", "conv_id"), "last": last, "pos": (F.row_number().over(w) - 1).cast("int")})
    answer = F.concat(F.lit("answer "), F.col("conv_id").cast("string"))
    head = c.filter("turn = 0")
    tasks = head.select("task_id", F.lit("What is the number").alias("prompt"), answer.alias("reference_answer"), F.lit("qa").alias("task_kind"))
    events = c.select("task_id", "pos", F.lit("search").alias("source"), F.col("role").alias("argument"), F.concat(F.lit("value"), F.col("conv_id"), F.lit("x"), F.col("pos")).alias("value"))
    evidence = review.evidence_chain(events)
    bad = F.col("conv_id") % 7 == 0
    plans = head.select("task_id", F.when(bad, "wrong").otherwise(answer).alias("final_answer"))
    after = c.select("task_id", F.concat(F.lit("after:e"), "pos").alias("phase"), (F.col("pos") + 1).alias("frame_pos"), F.when(F.col("turn") == F.col("last"), F.when(bad, "wrong").otherwise(answer)).otherwise(F.concat(F.lit("note "), "pos")).alias("display"))
    frames = head.select("task_id", F.lit("initial").alias("phase"), F.lit(0).alias("frame_pos"), F.lit("start").alias("display")).unionByName(after)
    cells = frames.select("task_id", "phase", F.lit("c1").alias("cell_id"), F.lit("goal").alias("text"), F.lit("conclusion").alias("role"), F.lit(1.0).alias("weight"), F.lit("ACTIVE").alias("lifecycle"))
    needs = evidence.filter("requires_need").select("task_id", F.concat(F.lit("n"), "pos").alias("need_id"), "evidence_id", "source", "argument", F.lit("always").alias("freshness"), F.lit("initial").alias("phase"))
    return tasks, evidence, plans, frames, cells, needs


@query("x1_review", "SELECT accepted, count(*) n FROM (SELECT conv_id % 7 <> 0 accepted FROM conversations GROUP BY conv_id) GROUP BY 1")
def x1(spark, d):
    return review.review(*corpus(read_table(spark, d, "conversations"))).groupBy("accepted").agg(F.count("*").alias("n"))


@query("x2_compile", "SELECT count(DISTINCT conv_id) * 2 examples FROM conversations WHERE conv_id % 7 <> 0")
def x2(spark, d):
    tasks, evidence, plans, frames, cells, needs = corpus(read_table(spark, d, "conversations"))
    ok = review.review(tasks, evidence, plans, frames, cells, needs)
    steps = review.compile_plans(ok, evidence, frames, 5, 2)
    return steps.agg(F.count_distinct("example_id").alias("examples"))


@query("x3_causal_job", "SELECT count(DISTINCT conv_id) tasks, count(DISTINCT (conv_id, role)) unlocked_at_start FROM conversations")
def x3(spark, d):
    tasks, evidence, *_ = corpus(read_table(spark, d, "conversations"))
    s = review.causal_stages(evidence)
    return s.agg(F.count_distinct("task_id").alias("tasks"), F.sum(F.when(F.col("stage") == 0, F.size("contracts")).otherwise(0)).alias("unlocked_at_start"))


@query("p15_visible_projection", "SELECT conv_id FROM conversations WHERE turn = 0")
def p15(spark, d):
    t = review.visible_tasks(corpus(read_table(spark, d, "conversations"))[0])
    assert "reference_answer" not in t.columns
    return t.select(F.substring("task_id", 2, 10).cast("long").alias("conv_id"))


@query("w9_future_leak", "SELECT count(*) n FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING conv_id % 5 = 0 AND count(*) > 1)")
def w9(spark, d):
    """A planted leak: every fifth task's first frame tells the value that its second event brings."""
    tasks, evidence, _, frames, cells, _ = corpus(read_table(spark, d, "conversations"))
    n = F.substring("task_id", 2, 10).cast("long")
    cells = cells.withColumn("text", F.when((n % 5 == 0) & (F.col("phase") == "initial"), F.concat(F.lit("it is value"), n, F.lit("x1"))).otherwise(F.col("text")))
    return review.leaks(frames, cells, evidence, tasks).select("task_id").distinct().agg(F.count("*").alias("n"))


@query("x8_mixture", "SELECT component, count(*) n, round(sum(w), 6) weight FROM (SELECT 'documents' component, 0.5::DOUBLE w FROM documents UNION ALL SELECT 'benchmark', 2.0::DOUBLE FROM benchmark) GROUP BY 1")
def x8(spark, d):
    """Components united in order, ids unique over all of them, a weight set on each row."""
    spec = [("documents", "doc_id", 0.5), ("benchmark", "item_id", 2.0)]
    parts = [read_table(spark, d, t).select(F.lit(t).alias("component"), F.concat_ws(":", F.lit(t), k).alias("example_id"), F.lit(w).alias("w")) for t, k, w in spec]
    u = parts[0].unionByName(parts[1])
    quality.assert_none(quality.duplicate_keys(u, ["example_id"]))
    return u.groupBy("component").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


@query("f17_f27_drift", "SELECT 'n_docs' field WHERE false")
def f17(spark, d):
    """A manifest against its pin: the differing fields, none here."""
    docs = read_table(spark, d, "documents")
    now = docs.agg(F.count("*").alias("n_docs"), F.count_distinct("lang").alias("langs"))
    then = docs.agg(F.count("doc_id").alias("n_docs"), F.count_distinct("lang").alias("langs"))
    as_rows = lambda x, v: x.unpivot([], ["n_docs", "langs"], "field", v)
    both = as_rows(now, "a").join(as_rows(then, "b"), "field")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("field")

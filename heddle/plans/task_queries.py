"""Queries over builds, resumable batches, slots, programs and renderings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import extract, keys
from heddle.functions import text as T
from heddle.operators import adapters, quality, review, slots
from heddle.plans.build_queries import corpus
from heddle.plans.registry import query
from heddle.sources import sinks
from heddle.sources.shared import read_table, shared_dir


def table(spark, d, name):
    return read_table(spark, d, name)


@query("w14_slot_allocation", "SELECT count(*) n, 0 clashes FROM (SELECT DISTINCT user_id, event_id // 1000, event_type FROM events)")
def w14(spark, d):
    """Cells keep their slot while they live; two cells never share one in a frame."""
    e = table(spark, d, "events").select("user_id", F.expr("cast(event_id div 1000 as int)").alias("frame_pos"), F.col("event_type").alias("cell_id"), (F.col("event_type") == "error").alias("retired")).distinct()
    s = slots.allocate_slots(e, "user_id", 8)
    clash = s.groupBy("user_id", "frame_pos", "slot").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).cast("int").alias("clashes"))
    return s.agg(F.count("*").alias("n")).join(F.broadcast(clash))


@query("f30_u4_program_screen", "SELECT o_orderkey, [NULL, 'import', 'name eval', 'syntax'][1 + o_orderkey % 4] reason FROM orders")
def f30(spark, d):
    code = F.element_at(F.array(*map(F.lit, ("import math\nx = math.pi", "import os", "eval('1')", "def f(:"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return slots.screen_programs(table(spark, d, "orders").select("o_orderkey", code.alias("code")), "o_orderkey", "code")


@query("j24_unordered_bijection", "SELECT l_orderkey, true same FROM lineitem GROUP BY 1")
def j24(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("a"))
    return by.select("l_orderkey", slots.same_multiset("a", F.reverse("a")).alias("same"))


@query("k2_k3_k6_sorted_pool", "SELECT count(*) n, min('t' || lpad(conv_id::VARCHAR, 6, '0')) \"first\" FROM (SELECT DISTINCT conv_id FROM conversations)")
def k6(spark, d):
    path = f"{shared_dir(spark)}/heddle/pool-{uuid.uuid4().hex}"
    tasks = corpus(read_table(spark, d, "conversations"))[0].orderBy("task_id")
    sinks.jsonl(tasks, path)
    return spark.read.schema(tasks.schema).json(path).agg(F.count("*").alias("n"), F.min("task_id").alias("first"))


@query("k10_two_reports", "SELECT 'case' kind, count(*) n FROM events WHERE event_type = 'error' UNION ALL SELECT 'summary', 1")
def k10(spark, d):
    """Rows of cases to one folder, their summary to another."""
    root = f"{shared_dir(spark)}/heddle/report-{uuid.uuid4().hex}"
    cases = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id")
    cases.write.json(f"{root}/cases")
    sinks.manifest(cases.agg(F.count("*").alias("errors")), f"{root}/summary")
    one = lambda p, k, c: spark.read.schema(f"{c} long").json(f"{root}/{p}").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("cases", "case", "event_id").unionByName(one("summary", "summary", "errors"))


@query("k9_r25_resumable_batch", "SELECT pending, count(*) n FROM (SELECT o_orderkey % 5 = 0 pending FROM orders) GROUP BY 1")
def r25(spark, d):
    """A batch that is resumed: requests without an answer are pending."""
    o = table(spark, d, "orders").select(keys.request_id("o_orderkey").alias("request_id"), "o_orderkey")
    done = o.filter("o_orderkey % 5 <> 0").select("request_id", F.lit(True).alias("done"))
    return o.join(done, "request_id", "left").groupBy(F.col("done").isNull().alias("pending")).agg(F.count("*").alias("n"))


@query("p5_program_prompt", "SELECT o_orderkey, 'Write f.' || chr(10) || 'assert f(' || o_custkey || ')' prompt FROM orders")
def p5(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("Write f.").alias("text"), F.lit("def f(x): return x").alias("code"), F.array(F.concat(F.lit("assert f("), "o_custkey", F.lit(")"))).alias("test_list"))
    return adapters.adapt(rows, "mbpp").filter("valid").select("o_orderkey", "prompt")


@query("p7_json_columns", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def p7(spark, d):
    ctx = F.when(F.col("o_orderkey") % 4 == 0, "[broken").otherwise('[["title", "a sentence"]]')
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("q").alias("question"), F.lit("a").alias("answer"), ctx.alias("context"))
    return adapters.adapt(rows, "2wikimultihopqa").filter("valid").select("o_orderkey")


@query("p17_w8_evidence_chain", "SELECT count(*) n, count(*) FILTER (r = 1) requires_need FROM (SELECT row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) r FROM conversations)")
def p17(spark, d):
    e = corpus(read_table(spark, d, "conversations"))[1]
    return e.agg(F.count("*").alias("n"), F.count_if("requires_need").alias("requires_need"))


@query("p18_request_render", "SELECT conv_id, sha256('Task t' || lpad(conv_id::VARCHAR, 6, '0') || chr(10) || 'Question: What is the number') request FROM (SELECT DISTINCT conv_id FROM conversations)")
def p18(spark, d):
    t = review.visible_tasks(corpus(read_table(spark, d, "conversations"))[0])
    return t.select(F.substring("task_id", 2, 10).cast("long").alias("conv_id"), F.sha2(F.format_string("Task %s\nQuestion: %s", "task_id", "prompt"), 256).alias("request"))


@query("p30_grounded_response", "SELECT conv_id, string_agg(role || '.', ' ' ORDER BY turn) response FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r FROM conversations) WHERE r <= 3 GROUP BY 1")
def p30(spark, d):
    """Up to three notes of a case, in order."""
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "role"))), 1, 3).alias("n"))
    return by.select("conv_id", T.short(F.array_join(F.transform("n", lambda x: F.concat(x["role"], F.lit("."))), " "), 480).alias("response"))


@query("p36_evidence_line", "SELECT item_id, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 59), '[ ,;:-]+$', '') || '…' END AS \"line\" FROM (SELECT item_id, 'item ' || item_id || ': ' || text t FROM benchmark)")
def p36(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.short(F.concat(F.lit("item "), "item_id", F.lit(": "), "text"), 60).alias("line"))


@query("p37_u5_descriptors", "SELECT event_type AS \"name\", k argument, count(*) n, count(*) = any_value(total) required FROM (SELECT event_type, unnest(json_keys(props)) k, count(*) OVER (PARTITION BY event_type) total FROM events) GROUP BY 1, 2")
def p37(spark, d):
    """Tool descriptors from what calls were made with: an argument that all calls of a tool have is required."""
    calls = table(spark, d, "events").select(F.col("event_type").alias("name"), F.map_keys(F.from_json("props", "map<string,string>")).alias("keys"))
    total = calls.groupBy("name").agg(F.count("*").alias("total"))
    used = calls.select("name", F.explode("keys").alias("argument")).groupBy("name", "argument").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(total), "name").select("name", "argument", "n", (F.col("n") == F.col("total")).alias("required"))


@query("f29_unique_jobs", "SELECT count(*) n FROM (SELECT conv_id FROM conversations WHERE turn = 0 GROUP BY 1 HAVING count(*) > 1)")
def f29(spark, d):
    return quality.duplicate_keys(corpus(read_table(spark, d, "conversations"))[0], ["task_id"]).agg(F.count("*").alias("n"))


@query("f18_x18_reactivation", "SELECT user_id, count(*) n FROM (SELECT user_id, event_type, event_id, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM events) WHERE r = 1 AND event_type = 'view' GROUP BY 1")
def f18x(spark, d):
    """Work that goes on after a correction: views after the first error of a case."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    e = table(spark, d, "events").withColumn("r", F.max((F.col("event_type") == "error").cast("int")).over(w))
    return e.filter("r = 1 and event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))


@query("str44_subject_guards", "SELECT p_partkey, contains(lower('Which red widget is largest?'), lower(p_name)) named FROM part")
def str44(spark, d):
    return table(spark, d, "part").select("p_partkey", F.contains(F.lower(F.lit("Which red widget is largest?")), F.lower("p_name")).alias("named"))


@query("str29_str32_more_facts", "SELECT c_custkey, 'teacher' occupation, 'Oxford' education, 'Nobel Prize' award FROM customer")
def str29(spark, d):
    t = F.concat(F.lit("Xan "), F.col("c_custkey").cast("string"), F.lit(" was a teacher. She studied at Oxford, and won the Nobel Prize."))
    return table(spark, d, "customer").select("c_custkey", *(extract.fact(k, t).alias(k) for k in ("occupation", "education", "award")))


@query("x5_prepare", "SELECT \"mode\", count(*) n FROM (SELECT CASE WHEN count(*) > 4 THEN 'tool_required' WHEN ('0x' || substr(sha256('42|unnecessary|' || conv_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE < 0.3 THEN 'tools_available_unnecessary' ELSE 'no_tool' END AS \"mode\" FROM conversations GROUP BY conv_id) GROUP BY 1")
def x5(spark, d):
    """Tasks of a split, made tool tasks, unnecessary-tool tasks by a hash draw, or plain ones."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    mode = F.when(F.col("n") > 4, "tool_required").when(keys.bernoulli(0.3, F.lit("42"), F.lit("unnecessary"), "conv_id"), "tools_available_unnecessary").otherwise("no_tool")
    return t.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query("x6_x12_x17_component", "SELECT count(*) tasks, count(*) FILTER (conv_id % 7 <> 0) accepted, sum(CASE WHEN conv_id % 7 <> 0 THEN n ELSE 0 END)::BIGINT evidence FROM (SELECT conv_id, count(*) n FROM conversations GROUP BY 1)")
def x6(spark, d):
    """A component's build: review, then the accepted tasks and their evidence counted."""
    tasks, evidence, plans, frames, cells, needs = corpus(read_table(spark, d, "conversations"))
    ok = review.review(tasks, evidence, plans, frames, cells, needs).select("task_id", "accepted")
    n = evidence.groupBy("task_id").agg(F.count("*").alias("n"))
    return ok.join(n, "task_id").agg(F.count("*").alias("tasks"), F.count_if("accepted").alias("accepted"), F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("evidence"))


@query("r2_r3_generations", "SELECT user_id, count(*) - count(DISTINCT event_type) updates FROM events GROUP BY 1")
def r2(spark, d):
    """How often a need came again: its binding's generation."""
    g = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    e = table(spark, d, "events").withColumn("g", F.when(g > 0, 1).otherwise(0))
    return e.groupBy("user_id").agg(F.sum("g").alias("updates"))


@query("r18_replay_score", "SELECT round(sum((d.event_id IS NOT NULL)::INT) / count(*), 6) coverage FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_type <> 'error') d USING (event_id)")
def r18(spark, d):
    """Observations that a replay delivered, of those that were expected."""
    e = table(spark, d, "events")
    got = e.filter("event_type <> 'error'").select("event_id", F.lit(1).alias("g"))
    return e.join(got, "event_id", "left").agg(F.round(F.sum(F.coalesce("g", F.lit(0))) / F.count("*"), 6).alias("coverage"))


@query("s18_source_registry", "SELECT 'purchase' source, min(event_id) FILTER (event_type = 'purchase' AND event_id > 5000) next_id FROM events UNION ALL SELECT 'view', min(event_id) FILTER (event_type = 'view' AND event_id > 5000) FROM events")
def s18(spark, d):
    """Named sources and the next step of each."""
    e = table(spark, d, "events").filter("event_type in ('purchase', 'view')")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.min(F.when(F.col("event_id") > 5000, F.col("event_id"))).alias("next_id"))

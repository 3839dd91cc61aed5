"""Queries over extraction, rewriting, ranking, storage pressure and decoding."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import extract, keys
from heddle.functions import text as T
from heddle.operators import generators, quality, sampling
from heddle.plans.registry import query
from heddle.sources.shared import read_table


def table(spark, d, name):
    return read_table(spark, d, name)


@query("str20_str39_math_match", "SELECT o_orderkey, o_orderkey % 3 <> 2 same FROM orders")
def str20(spark, d):
    """Fractions in two spellings, lists in another order, and different values."""
    n = F.col("o_orderkey")
    a = F.when(n % 3 == 0, F.format_string("\\dfrac{%d}{%d}", n, n + 1)).when(n % 3 == 1, F.format_string("%d, (1,2), %d", n, n + 2)).otherwise(n.cast("string"))
    b = F.when(n % 3 == 0, F.format_string("$\\frac{%d}{%d}$", n, n + 1)).when(n % 3 == 1, F.format_string("%d, %d, (1, 2)", n + 2, n)).otherwise((n + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", extract.math_match(a, b).alias("same"))


@query("str25_str26_asks", "SELECT o_orderkey, ['birth_date', 'death_cause', 'director', 'other'][1 + o_orderkey % 4] kind FROM orders")
def str25(spark, d):
    q = F.element_at(F.array(*map(F.lit, ("When was Ada born?", "What was the cause of death of Bo?", "Who directed the film?", "Say hello."))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", extract.asked(q).alias("kind"))


@query("str27_str30_facts", "SELECT c_custkey, (1900 + c_custkey % 100)::VARCHAR born, 'Customer' || ' Father' father, 'pneumonia' cause FROM customer")
def str27(spark, d):
    t = F.format_string("Xan (born %d) was the son of Customer Father. He died from pneumonia in Rome.", 1900 + F.col("c_custkey") % 100)
    return table(spark, d, "customer").select("c_custkey", extract.fact("birth_date", t).alias("born"), extract.fact("parents", t).alias("father"), extract.fact("death_cause", t).alias("cause"))


@query("str28_nationality", "SELECT c_custkey, ['France', 'United States', NULL][1 + c_custkey % 3] country FROM customer")
def str28(spark, d):
    t = F.element_at(F.array(*map(F.lit, ("She was a noted French painter of Italian scenes.", "He is an American.", "Nothing here."))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", extract.nationality(t).alias("country"))


@query("str31_evidence_summary", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ada: birth date = 10 May 1815' ELSE 'Ada: no birth date stated' END AS \"line\" FROM customer")
def str31(spark, d):
    t = F.when(F.col("c_custkey") % 2 == 0, "Ada was born on 10 May 1815 in London.").otherwise("Ada wrote letters.")
    return table(spark, d, "customer").select("c_custkey", extract.evidence_summary(F.lit("When was Ada born?"), F.lit("Ada"), t).alias("line"))


@query("str33_search_summary", "SELECT o_custkey, array_to_string(list_slice(list(p ORDER BY f), 1, 5), '; ') titles FROM (SELECT o_custkey, o_orderpriority p, min(o_orderkey) f FROM orders GROUP BY ALL) GROUP BY 1")
def str33(spark, d):
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("t"))
    return by.select("o_custkey", extract.candidate_titles("t").alias("titles"))


@query("str34_p33_anchors", "SELECT o_orderkey, 'number:' || o_custkey || ',text:' || o_orderstatus anchors, 'a-' || substr(sha256(o_orderkey || '|' || o_custkey), 1, 12) first_id FROM orders")
def str34(spark, d):
    a = extract.anchors(F.array(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderstatus"), F.col("o_orderkey").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", a.alias("a"))
    return rows.select("o_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["kind"], x["value"])), ",").alias("anchors"), F.col("a")[0]["anchor_id"].alias("first_id"))


@query("str35_p20_surface_rewrite", "SELECT doc_id, CASE (('0x' || substr(sha256('9|' || doc_id), 1, 8))::BIGINT % 3) WHEN 0 THEN 'Read' WHEN 1 THEN 'Look at' ELSE 'Consider' END || ' document ' || doc_id prompt FROM documents")
def str35(spark, d):
    """One of several surfaces by hash."""
    return table(spark, d, "documents").select("doc_id", F.concat(keys.pick(["Read", "Look at", "Consider"], F.lit("9"), "doc_id"), F.lit(" document "), F.col("doc_id").cast("string")).alias("prompt"))


@query("str36_prefix_strip", "SELECT p_partkey, regexp_replace(p_name, '^(red|blue|small|large|hot|cold) ', '') core FROM part")
def str36(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", "^(red|blue|small|large|hot|cold) ", "").alias("core"))


@query("str41_frame_text", "SELECT conv_id, sha256(string_agg(role || ' ' || lower(trim(text)), ' ' ORDER BY turn)) t FROM conversations GROUP BY 1")
def str41(spark, d):
    one = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(" ", x["role"], F.lower(F.trim(x["text"]))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(one, " "), 256).alias("t"))


@query("str42_anchor_key", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'part' || p_partkey WHEN p_partkey % 3 = 1 THEN 'number:' || p_size || ':kg' ELSE 'brand:' || p_brand END AS \"key\" FROM part")
def str42(spark, d):
    n = F.col("p_partkey")
    k = extract.anchor_key(F.when(n % 3 == 0, F.concat(F.lit("part"), n)), F.when(n % 3 == 1, F.col("p_size")), F.lit("kg"), F.lit("brand"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", k.alias("key"))


@query("str43_alias_normalize", "SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || ' X '), '[ \\t\\n\\r\\f]+', ' ', 'g')) alias FROM part")
def str43(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(T.clean(F.concat(F.lit("  "), "p_name", F.lit(" X ")))).alias("alias"))


@query("str45_sentence_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT n FROM documents")
def str45(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n"))


@query("js4_reference_walk", "SELECT event_id, '$.k' path FROM events")
def js4(spark, d):
    """References in nested JSON: every leaf of an object as (path, value), one level of a map at a time."""
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.select("event_id", F.concat(F.lit("$."), "k").alias("path"))


@query("js6_evidence_text", "SELECT event_id, coalesce(json_extract_string(props, '$.text'), json_extract_string(props, '$.k')) t FROM events")
def js6(spark, d):
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.title", "string"), F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.k", "string")).alias("t"))


@query("p13_p16_conditional_structs", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || chr(10) || 'Tests:' || chr(10) || o_custkey ELSE o_orderpriority END prompt FROM orders")
def p13(spark, d):
    code = F.concat_ws("\n", "o_orderpriority", F.lit("Tests:"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", code).otherwise(F.col("o_orderpriority")).alias("prompt"))


@query("p14_plan_from_template", "SELECT conv_id, phase FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['initial', 'pre', 'after:e0', 'final']) phase)")
def p14(spark, d):
    frames = F.array(*(F.struct(F.lit(p).alias("phase"), F.lit(i).alias("pos")) for i, p in enumerate(("initial", "pre", "after:e0", "final"))))
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(frames).alias("f")).select("conv_id", "f.phase")


@query("p19_remap", "SELECT event_id, '{\"knob\":\"' || json_extract_string(props, '$.k') || '\"}' renamed FROM events")
def p19(spark, d):
    """Keys of a map renamed by a table; names that aren't in it stay."""
    names = F.create_map(F.lit("k"), F.lit("knob"))
    m = F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, _: F.coalesce(F.try_element_at(names, k), k))
    return table(spark, d, "events").select("event_id", keys.canonical_json(m).alias("renamed"))


@query("p21_role_prefix", "SELECT conv_id, turn, CASE WHEN length('Note: ' || text) <= 200 THEN 'Note: ' || text WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 199) || '…' END AS \"line\" FROM (SELECT conv_id, turn, regexp_replace(text, '[ ,;:-]+$', '') text FROM conversations WHERE length(text) <= 199)")
def p21(spark, d):
    """A prefix where it fits, else the text, else its beginning."""
    c = table(spark, d, "conversations").filter(F.length("text") <= 199).withColumn("text", F.regexp_replace("text", "[ ,;:-]+$", ""))
    full = F.concat(F.lit("Note: "), "text")
    return c.select("conv_id", "turn", F.when(F.length(full) <= 200, full).otherwise(T.short("text", 200)).alias("line"))


@query("p22_augment", "SELECT doc_id || '::aug' task_id, '{\"lang\":\"' || lang || '\",\"style\":\"plain\"}' metadata FROM documents")
def p22(spark, d):
    m = F.map_concat(F.create_map(F.lit("lang"), F.col("lang")), F.create_map(F.lit("style"), F.lit("plain")))
    return table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("::aug")).alias("task_id"), keys.canonical_json(m).alias("metadata"))


@query("p24_weight_injection", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 2.0 ELSE 0.5 END::DOUBLE weight FROM orders")
def p24(spark, d):
    """A weight is set where there is none; one that is there must be the same (else the row would be a violation)."""
    had = F.when(F.col("o_orderkey") % 10 == 0, F.lit(2.0))
    o = table(spark, d, "orders").withColumns({"had": had, "spec": F.when(F.col("o_orderkey") % 10 == 0, 2.0).otherwise(0.5)})
    quality.assert_none(quality.range_violations(o.filter("had is not null"), "o_orderkey", {"weight": F.col("had") == F.col("spec")}))
    return o.select("o_orderkey", F.coalesce("had", "spec").alias("weight"))


@query("p26_dataset_tag", "SELECT tag, count(*) n FROM (SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END, ''), CASE WHEN doc_id % 3 = 1 THEN lang END, 'unlabeled') tag FROM documents) GROUP BY 1")
def p26(spark, d):
    n = F.col("doc_id")
    tag = F.coalesce(F.nullif(F.when(n % 3 == 0, F.col("source")).otherwise(""), F.lit("")), F.when(n % 3 == 1, F.col("lang")), F.lit("unlabeled"))
    return table(spark, d, "documents").groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))


@query("p31_value_free_contract", "SELECT event_id, event_type || ':' || user_id contract FROM events")
def p31(spark, d):
    return table(spark, d, "events").drop("value").select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("contract"))


@query("p32_record_rendering", "SELECT l_orderkey, string_agg('R' || n || ': ' || l_partkey || '|' || l_suppkey, chr(10) ORDER BY n) ledger FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) n FROM lineitem) GROUP BY 1")
def p32(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    return by.select("l_orderkey", F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("R"), i + 1, F.lit(": "), x["l_partkey"], F.lit("|"), x["l_suppkey"])), "\n").alias("ledger"))


@query("p34_phase_cells", "SELECT l_orderkey, p phase, count(*) cells FROM (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber p FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <= b.l_linenumber) GROUP BY ALL")
def p34(spark, d):
    """Cells of each phase: percepts of all that has arrived by then (a prefix, so no self join). Lines are counted before they are sorted."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("phase")).agg(F.count("*").alias("n"))
    w = W.partitionBy("l_orderkey").orderBy("phase").rowsBetween(W.unboundedPreceding, 0)
    return n.select("l_orderkey", "phase", (F.col("n") * F.sum("n").over(w)).alias("cells"))


@query("p35_decision_text", "SELECT doc_id, CASE (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 2) WHEN 0 THEN 'No tool is needed.' ELSE 'Answer directly.' END AS \"text\" FROM documents")
def p35(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.pick(["No tool is needed.", "Answer directly."], "doc_id").alias("text"))


@query("f7_f8_restraint_candidates", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') = 0 AND max(l_linenumber) >= 3")
def f7(spark, d):
    """Candidates without evidence (an anti join) and of some depth."""
    li = table(spark, d, "lineitem")
    deep = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m")).filter("m >= 3")
    return deep.join(li.filter("l_returnflag = 'R'"), "l_orderkey", "left_anti").select("l_orderkey")


@query("f21_tct_quality", "SELECT conv_id, turn FROM conversations WHERE NOT (length(text) <= 192 AND NOT contains(text, substr(text, 1, 96) || substr(text, 1, 1)))")
def f21(spark, d):
    """Hard rules as violations: a cell's length, and no verbatim copy of 96 characters."""
    copy = F.contains("text", F.concat(F.substring("text", 1, 96), F.substring("text", 1, 1)))
    ok = {"quality": (F.length("text") <= 192) & ~copy}
    c = table(spark, d, "conversations").withColumn("k", F.concat_ws("|", "conv_id", "turn"))
    v = quality.range_violations(c, "k", ok)
    return v.select(F.split("key", "\\|")[0].cast("long").alias("conv_id"), F.split("key", "\\|")[1].cast("long").alias("turn"))


@query("f23_correction_audit", "SELECT user_id FROM (SELECT user_id, avg(value) FILTER (event_id < 3000) a, avg(value) FILTER (event_id BETWEEN 3000 AND 6000) b, avg(value) FILTER (event_id > 6000) c FROM events GROUP BY 1) WHERE b - a > 0.2 AND b - c > 0.2")
def f23(spark, d):
    """Noise that rises and then falls over three phases, pivoted to columns."""
    p = F.when(F.col("event_id") < 3000, "a").when(F.col("event_id") <= 6000, "b").otherwise("c")
    x = table(spark, d, "events").withColumn("p", p).groupBy("user_id").pivot("p", ["a", "b", "c"]).agg(F.avg("value"))
    return x.filter("b - a > 0.2 and b - c > 0.2").select("user_id")


@query("f24_required_tokens", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'widget') OR contains(lower(p_name), 'ring'))")
def f24(spark, d):
    n = F.lower("p_name")
    return table(spark, d, "part").filter(~(F.contains(n, F.lit("widget")) | F.contains(n, F.lit("ring")))).select("p_partkey")


@query("f26_transition_integrity", "SELECT a.user_id, a.step FROM (SELECT DISTINCT user_id, event_id // 500 step, event_type FROM events) a LEFT JOIN (SELECT DISTINCT user_id, event_id // 500 step, event_type FROM events) b ON a.user_id = b.user_id AND b.step = a.step + 1 AND a.event_type = b.event_type WHERE a.event_type = 'view' AND b.user_id IS NULL AND a.step < 19")
def f26(spark, d):
    """Cells of step s that are gone at s + 1."""
    x = table(spark, d, "events").select("user_id", F.expr("event_id div 500").alias("step"), "event_type").distinct()
    nxt = x.select("user_id", (F.col("step") - 1).alias("step"), "event_type")
    return x.filter("event_type = 'view' and step < 19").join(nxt, ["user_id", "step", "event_type"], "left_anti").select("user_id", "step")


@query("t5_arg_max_source", "SELECT user_id, arg_max(event_type, (n, -f)) source FROM (SELECT user_id, event_type, count(*) n, min(event_id) f FROM events GROUP BY ALL) GROUP BY 1")
def t5(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return s.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("f"))).alias("source"))


@query("t6_top_allocations", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) r FROM events WHERE value >= 5) WHERE r <= 4")
def t6(spark, d):
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("value").desc(), F.col("event_id").desc()))
    return table(spark, d, "events").filter("value >= 5").withColumn("r", r).filter("r <= 4").select("user_id", "event_id")


@query("t7_confidence_reveal", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) r, count(*) OVER (PARTITION BY user_id) n FROM events WHERE event_type = 'click') WHERE r <= ceil(n * 0.25)")
def t7(spark, d):
    w = W.partitionBy("user_id")
    e = table(spark, d, "events").filter("event_type = 'click'").withColumns({"r": F.row_number().over(w.orderBy(F.col("value").desc(), "event_id")), "n": F.count("*").over(w)})
    return e.filter(F.col("r") <= F.ceil(F.col("n") * 0.25)).select("user_id", "event_id")


@query("t8_r15_reclamation", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r, count(*) OVER (PARTITION BY user_id) n FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)) WHERE r <= greatest(0, ceil(n - 64 * 0.75))")
def t8(spark, d):
    """Oldest retired first, until the watermark, without what strong links pin."""
    pinned = table(spark, d, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("user_id"))
    w = W.partitionBy("user_id")
    e = table(spark, d, "events").join(pinned, "user_id", "left_anti").withColumns({"r": F.row_number().over(w.orderBy("event_id")), "n": F.count("*").over(w)})
    return e.filter(F.col("r") <= F.greatest(F.lit(0), F.ceil(F.col("n") - 64 * 0.75))).select("event_id")


@query("t13_result_ordering", "SELECT doc_id, source FROM documents ORDER BY source, doc_id")
def t13(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id")


@query("g2_longest_parent_depth", "SELECT l_orderkey, max(l_linenumber)::BIGINT depth FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY 1")
def g2(spark, d):
    """A chain: each line's parent is the one before, so the depth is the number of lines."""
    from heddle.operators import graph

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    by = li.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    parents = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i > 0, F.array(i - 1)).otherwise(F.array().cast("array<int>")))
    return by.withColumn("parents", parents).select("l_orderkey", F.array_max(graph.depth_of("parents")).cast("long").alias("depth"))


@query("g11_decomposition", "SELECT o_orderkey, 'Who leads ' || o_custkey || '?' query, 1::BIGINT n_deps FROM orders")
def g11(spark, d):
    """Placeholders `#N` become dependencies and are replaced by the earlier answers; a `#N` beyond the nodes stays as it is."""
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_custkey").cast("string")).alias("answers"), F.lit("Who leads #1?").alias("q"))
    marks = F.filter(F.transform(F.regexp_extract_all("q", F.lit("#([0-9]+)"), F.lit(1)), lambda x: x.cast("int")), lambda n: n <= F.size("answers"))
    rows = o.withColumn("deps", marks)
    return rows.select("o_orderkey", F.aggregate("deps", F.col("q"), lambda acc, n: F.replace(acc, F.concat(F.lit("#"), n.cast("string")), F.element_at("answers", n))).alias("query"), F.size("deps").cast("long").alias("n_deps"))


@query("g13_lineage", "SELECT 'split' kind, o_orderkey child, o_custkey parent FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'merge', o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def g13(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_orderkey % 2 = 0").select(F.lit("split").alias("kind"), F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"))
    return a.unionByName(o.filter("o_orderkey % 2 = 1").select(F.lit("merge").alias("kind"), F.col("o_custkey").alias("child"), F.col("o_orderkey").alias("parent")))


@query("r12_terminal_barrier", "SELECT user_id, bool_and(event_type <> 'error') AND count(DISTINCT event_type) >= 3 done FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) r FROM events) WHERE r = 1 GROUP BY 1")
def r12(spark, d):
    """Every binding's last state must be resolved."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("m"))
    return last.groupBy("user_id").agg((F.bool_and(F.col("event_type") != "error") & (F.count("*") >= 3)).alias("done"))


@query("r13_quiescence", "SELECT event_id, epoch_us(nxt) - epoch_us(ts) wait_us FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) nxt FROM events) WHERE nxt IS NOT NULL")
def r13(spark, d):
    """How long a case waits for its next event."""
    e = table(spark, d, "events").withColumn("nxt", F.lead("ts").over(W.partitionBy("user_id").orderBy("event_id"))).filter("nxt is not null")
    return e.select("event_id", F.expr("timestampdiff(MICROSECOND, ts, nxt)").alias("wait_us"))


@query("r16_r22_field_metrics", "SELECT user_id, count(DISTINCT event_type) occupied, count(DISTINCT event_type) FILTER (event_type <> 'error') live, 8 - count(DISTINCT event_type) \"empty\" FROM events GROUP BY 1")
def r22(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(e).alias("occupied"), F.count_distinct(F.when(e != "error", e)).alias("live"), (8 - F.count_distinct(e)).alias("empty"))


@query("r23_archive", "SELECT user_id, min(event_id) tombstone FROM events WHERE event_type = 'error' GROUP BY 1")
def r23(spark, d):
    """One tombstone a cell."""
    return table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("tombstone"))


@query("v1_need_decoding", "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 source FROM embeddings WHERE 1 / (1 + exp(-list_max(embedding)::DOUBLE)) >= 0.55")
def v1(spark, d):
    top = F.array_max("embedding")
    e = table(spark, d, "embeddings").filter(1 / (1 + F.exp(-top.cast("double"))) >= 0.55)
    return e.select("vec_id", (F.array_position("embedding", top) - 1).alias("source"))


@query("v2_grounding_decoding", "SELECT label, pos, count(*) n FROM (SELECT label, unnest(embedding) x, unnest(range(len(embedding)))::INTEGER pos FROM embeddings) WHERE x >= 0.3 GROUP BY ALL")
def v2(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).filter(F.col("x") >= F.lit(0.3).cast("float"))
    return x.groupBy("label", "pos").agg(F.count("*").alias("n"))


@query("v3_revision_decoding", "SELECT vec_id FROM embeddings WHERE embedding[1] > embedding[2] AND embedding[1] > embedding[3]")
def v3(spark, d):
    a = lambda i: F.col("embedding")[i]
    return table(spark, d, "embeddings").filter((a(0) > a(1)) & (a(0) > a(2))).select("vec_id")


@query("v5_display_corruption", "SELECT conv_id, turn, substr(sha256('3|' || conv_id || '|' || turn), 1, 2) < '40' OR turn = 0 masked FROM conversations")
def v5(spark, d):
    """Bernoulli masks by hash, at least one a conversation."""
    h = F.substring(sampling.hash_order("3", "conv_id", "turn"), 1, 2) < "40"
    return table(spark, d, "conversations").select("conv_id", "turn", (h | (F.col("turn") == 0)).alias("masked"))


@query("v7_retrieval_cost", "SELECT q.vec_id, round(min(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) cost FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1")
def v7(spark, d):
    from heddle.operators import vector

    e = table(spark, d, "embeddings")
    return vector.nearest_in_group(e.filter("vec_id % 100 = 0"), e, "label", "vec_id", "embedding", -1.0).select("vec_id", F.round(1 - F.col("similarity"), 9).alias("cost"))


@query("s10_s11_specs", "SELECT component, round(weight / sum(weight) OVER (), 9) share FROM (SELECT source component, sum(n_chars)::DOUBLE weight FROM documents GROUP BY 1 UNION ALL SELECT 'pages', sum(length(html)) FROM pages)")
def s10(spark, d):
    """A specification from the sources' sizes, with its rules: names unique, weights finite and positive."""
    documents = table(spark, d, "documents").groupBy(F.col("source").alias("component")).agg(F.sum("n_chars").cast("double").alias("weight"))
    spec = documents.unionByName(table(spark, d, "pages").agg(F.lit("pages").alias("component"), F.sum(F.length("html")).cast("double").alias("weight")))
    quality.assert_none(quality.duplicate_keys(spec, ["component"]))
    quality.assert_none(quality.range_violations(spec, "component", {"weight": (F.col("weight") > 0) & (F.col("weight") < float("inf"))}))
    return spec.join(F.broadcast(spec.agg(F.sum("weight").alias("all")))).select("component", F.round(F.col("weight") / F.col("all"), 9).alias("share"))


@query("s28_identity_generators", "SELECT family || '-' || c_custkey task_id, CASE WHEN c_custkey % 4 = 3 THEN 'zh' ELSE 'en' END lang, CASE family WHEN 'name' THEN 'Who is ' || c_name || '?' WHEN 'maker' THEN 'Where does ' || c_name || ' come from?' ELSE 'What can ' || c_name || ' not do?' END prompt FROM customer, (SELECT unnest(['name', 'maker', 'limits']) family)")
def s28(spark, d):
    """Questions of three families about every customer's identity."""
    ask = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(p).alias("p")) for f, p in (("name", "Who is %s?"), ("maker", "Where does %s come from?"), ("limits", "What can %s not do?"))))
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.explode(ask).alias("x"))
    return rows.select(F.concat_ws("-", "x.family", F.col("c_custkey").cast("string")).alias("task_id"), F.when(F.col("c_custkey") % 4 == 3, "zh").otherwise("en").alias("lang"), F.replace("x.p", F.lit("%s"), F.col("c_name")).alias("prompt"))


@query("x7_retry_variants", "SELECT c_custkey, min(r) AS \"used\" FROM (SELECT c_custkey, r FROM customer, range(1, 32) t(r) WHERE (c_custkey * 7 + r) % 5 = 0) GROUP BY 1")
def x7(spark, d):
    """Rejected rows against 31 deterministic variants; the first that passes is taken. No loop."""
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("r"))
    return c.filter((F.col("c_custkey") * 7 + F.col("r")) % 5 == 0).groupBy("c_custkey").agg(F.min(F.col("r").cast("long")).alias("used"))


@query("x14_x15_restraint_build", "SELECT p_brand, count(*) n FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('4|' || p_partkey), p_partkey) r FROM part WHERE p_size > 10) WHERE r <= 7 GROUP BY 1")
def x14(spark, d):
    p = sampling.stratified(table(spark, d, "part").filter("p_size > 10"), ["p_brand"], 7, "4", "p_partkey")
    return p.groupBy("p_brand").agg(F.count("*").alias("n"))

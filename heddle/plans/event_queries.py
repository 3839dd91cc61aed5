"""Queries over ordered events: latest, as-of, freshness, intervals, sequences, trace metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.operators import intervals, sequences, stats, temporal
from heddle.plans.registry import query
from heddle.sources.shared import read_table


def events(spark, d):
    return read_table(spark, d, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


@query("j8_latest_per_key", "SELECT user_id, event_type, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) event_id, round(arg_max(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')), 6) AS \"value\" FROM (SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts) FROM events) GROUP BY ALL")
def j8(spark, d):
    return temporal.latest_per_key(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]).withColumn("value", F.round("value", 6))


@query("j9_as_of", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id vid, event_type FROM events WHERE event_type = 'view')
 SELECT p.event_id, arg_max(v.vid, (v.ts, v.vid)) asof_vid FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY 1""")
def j9(spark, d):
    e = events(spark, d)
    p = e.filter("event_type = 'purchase'").select("user_id", "us", "event_id")
    v = e.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("vid"))
    return temporal.as_of(p, v, ["user_id"], "us", ["vid"], "vid").select("event_id", "asof_vid")


@query("j10_incremental_as_of", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id vid FROM events WHERE event_type = 'view'),
 a AS (SELECT p.event_id, p.user_id, p.ts, arg_max(v.vid, (v.ts, v.vid)) vid FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY ALL), b AS (SELECT *, lag(vid) OVER (PARTITION BY user_id ORDER BY ts) prev FROM a) SELECT event_id, vid FROM b WHERE vid IS NOT NULL AND vid IS DISTINCT FROM prev""")
def j10(spark, d):
    """Each poll delivers the newest due version once; versions between polls are skipped."""
    e = events(spark, d)
    polls = e.filter("event_type = 'purchase'").select("user_id", "us", "event_id")
    v = e.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("vid"))
    return temporal.delivered_versions(polls, v, ["user_id"], "us", "vid").select("event_id", F.col("asof_vid").alias("vid"))


@query("j11_next_event", "SELECT user_id, min(event_id) FILTER (event_id > 5000) next_id FROM events GROUP BY 1")
def j11(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.min(F.when(F.col("event_id") > 5000, F.col("event_id"))).alias("next_id"))


@query("j12_freshness", """WITH e AS (SELECT user_id k, max(event_id) version, count(*) AS \"value\" FROM events WHERE event_type <> 'error' GROUP BY 1), o AS (SELECT user_id k, max(event_id) version, count(*) AS \"value\" FROM events WHERE event_type <> 'error' AND event_id < 9900 AND user_id % 7 <> 0 GROUP BY 1)
 SELECT e.k, CASE WHEN o.k IS NULL THEN 'missing' WHEN e.version IS DISTINCT FROM o.version THEN 'stale' WHEN e.value IS DISTINCT FROM o.value THEN 'stale' ELSE 'fresh' END status FROM e LEFT JOIN o USING (k)""")
def j12(spark, d):
    e = events(spark, d).filter("event_type <> 'error'")
    agg = lambda x: x.groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("version"), F.count("*").alias("value"))
    return temporal.freshness(agg(e), agg(e.filter("event_id < 9900 and user_id % 7 <> 0")), "k").select("k", "status")


@query("j20_work_dedup", "SELECT event_type, count(*) requests, count(*) FILTER (rn > 1) deduplicated FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type, user_id, props ORDER BY event_id) rn FROM events) GROUP BY 1")
def j20(spark, d):
    e = events(spark, d).withColumn("work", F.concat_ws(":", "event_type", "user_id", "props"))
    return temporal.share_work(e, "work", ["event_id"]).groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if("deduplicated").alias("deduplicated"))


@query("j21_drain_fan_out", "SELECT c.event_id job, count(*) bindings FROM (SELECT event_id, user_id FROM events WHERE event_type = 'purchase') c JOIN (SELECT o_custkey FROM orders) b ON c.user_id = b.o_custkey GROUP BY 1")
def j21(spark, d):
    """A completed job's observation goes to every active binding with its key."""
    c = events(spark, d).filter("event_type = 'purchase'")
    b = read_table(spark, d, "orders").select("o_custkey")
    return c.join(b, c["user_id"] == b["o_custkey"]).groupBy(F.col("event_id").alias("job")).agg(F.count("*").alias("bindings"))


@query("j27_orphans", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000)")
def j27(spark, d):
    active = read_table(spark, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 100000").select(F.col("o_custkey").alias("user_id"))
    return events(spark, d).join(active, "user_id", "left_anti").select("event_id")


_IV = "(SELECT user_id, event_type, epoch_us(ts) s, epoch_us(ts) + (value * 1000000)::BIGINT * 60 f FROM events WHERE value > 0)"


def spans(spark, d):
    e = events(spark, d).filter("value > 0")
    return e.select("user_id", "event_type", F.col("us").alias("start"), (F.col("us") + F.round(F.col("value") * 1000000).cast("long") * 60).alias("finish"))


@query("w4_pair_intervals", """WITH x AS (SELECT user_id, event_type k, epoch_us(ts) t, lag(event_type) OVER w pk, lag(epoch_us(ts)) OVER w pt FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, pt start, t finish FROM x WHERE k = 'purchase' AND pk = 'view'""")
def w4(spark, d):
    return intervals.pair_intervals(events(spark, d), ["user_id"], "event_type", "view", "purchase", "us", "event_id")


@query("w5_merge_intervals", f"""WITH a AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM {_IV}), b AS (SELECT *, sum((r IS NULL OR s > r)::INT) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) i FROM a) SELECT user_id, min(s) start, max(f) finish FROM b GROUP BY user_id, i""")
def w5(spark, d):
    return intervals.merge_intervals(spans(spark, d), ["user_id"])


@query("j19_interval_overlap", f"""SELECT a.user_id, count(*) pairs, sum(least(a.f, b.f) - greatest(a.s, b.s))::BIGINT overlap FROM {_IV} a JOIN {_IV} b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.s < b.f AND b.s < a.f GROUP BY 1""")
def j19(spark, d):
    x = spans(spark, d)
    both = intervals.overlaps(x.filter("event_type = 'click'"), x.filter("event_type = 'purchase'"), ["user_id"])
    return both.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("overlap"))


@query("j19_binned_overlap", f"""SELECT count(*) pairs, sum(least(a.f, b.f) - greatest(a.s, b.s))::BIGINT overlap FROM {_IV} a JOIN {_IV} b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.s < b.f AND b.s < a.f""")
def j19_binned(spark, d):
    x = spans(spark, d)
    both = intervals.binned_overlaps(x.filter("event_type = 'click'"), x.filter("event_type = 'purchase'"), ["user_id"], 3_600_000_000)
    return both.agg(F.count("*").alias("pairs"), F.sum("overlap").alias("overlap"))


@query("a22_tool_wait_overlap", f"""WITH io AS (SELECT * FROM {_IV} WHERE event_type = 'purchase'), a AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM io), b AS (SELECT *, sum((r IS NULL OR s > r)::INT) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) i FROM a), m AS (SELECT user_id, min(s) s, max(f) f FROM b GROUP BY user_id, i)
 SELECT x.user_id, count(DISTINCT x.s) steps, sum(least(x.f, m.f) - greatest(x.s, m.s))::BIGINT overlap FROM {_IV} x JOIN m ON x.user_id = m.user_id AND x.event_type = 'click' AND x.s < m.f AND m.s < x.f GROUP BY 1""")
def a22(spark, d):
    """Model intervals that touch merged I/O, and the time they share."""
    x = spans(spark, d)
    io = intervals.merge_intervals(x.filter("event_type = 'purchase'"), ["user_id"])
    both = intervals.overlaps(x.filter("event_type = 'click'"), io, ["user_id"])
    return both.groupBy("user_id").agg(F.count_distinct("a_start").alias("steps"), F.sum("overlap").alias("overlap"))


@query("w1_transitions", "SELECT conv_id, turn::BIGINT source_step, (turn + 1)::BIGINT target_step FROM conversations WHERE (conv_id, turn + 1) IN (SELECT conv_id, turn FROM conversations) UNION SELECT conv_id, -1, 0 FROM conversations WHERE turn = 0")
def w1(spark, d):
    return sequences.transitions(read_table(spark, d, "conversations"), ["conv_id"], "turn")


_GAPPY = "(SELECT DISTINCT user_id, event_id // 97 step FROM events)"


def gappy(spark, d):
    return read_table(spark, d, "events").select("user_id", F.expr("event_id div 97").alias("step")).distinct()


@query("w2_runs", f"SELECT user_id, min(step)::BIGINT first_step, max(step)::BIGINT last_step, count(*) length FROM (SELECT *, step - row_number() OVER (PARTITION BY user_id ORDER BY step) i FROM {_GAPPY}) GROUP BY user_id, i")
def w2(spark, d):
    return sequences.runs(gappy(spark, d), ["user_id"], "step")


@query("w3_rollout_windows", f"SELECT user_id, min(step)::BIGINT first_step, max(step)::BIGINT last_step, count(*) length FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, i ORDER BY step) - 1) // 4 c FROM (SELECT *, step - row_number() OVER (PARTITION BY user_id ORDER BY step) i FROM {_GAPPY})) GROUP BY user_id, i, c")
def w3(spark, d):
    return sequences.rollout_windows(gappy(spark, d), ["user_id"], "step", 4)


@query("a2_a3_transition_counts", f"WITH s AS (SELECT DISTINCT * FROM {_GAPPY}) SELECT a.user_id, count(b.step) adjacent, count(b.step) + max((a.step = 0)::INT) training FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND b.step = a.step + 1 GROUP BY 1")
def a2(spark, d):
    s = gappy(spark, d).groupBy("user_id").agg(F.collect_set("step").alias("s"))
    return s.select("user_id", sequences.adjacent_count(F.col("s")).cast("long").alias("adjacent"), sequences.training_count(F.col("s")).cast("long").alias("training"))


@query("w6_first_occurrence", "SELECT user_id, event_type, min(event_id) first_id FROM events GROUP BY ALL")
def w6(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min_by("event_id", "event_id").alias("first_id"))


@query("w7_history_frame", """SELECT conv_id, turn, array_to_string(list_filter(list(role || ':' || length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda x: NOT ends_with(x, ':0')), ' ') history FROM conversations""")
def w7(spark, d):
    c = read_table(spark, d, "conversations")
    h = sequences.history(c, ["conv_id"], "turn", F.concat_ws(":", "role", F.length("text")), 6, lambda x: ~x.endswith(":0"))
    return c.withColumn("h", h).select("conv_id", "turn", F.when(F.col("turn") > 0, F.array_join("h", " ")).alias("history")).withColumn("history", F.coalesce("history", F.lit(None)))


@query("w8_previous_of_same_key", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) depends_on, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AND user_id IN (SELECT o_custkey FROM orders) requires_need FROM events")
def w8(spark, d):
    """An event depends on the one before of its key; only the first with a binding needs one."""
    e = events(spark, d).withColumn("depends_on", sequences.previous_same_key(None, ["user_id", "event_type"], "event_id", "event_id"))
    bound = read_table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.lit(True).alias("_b")).distinct()
    return e.join(bound, "user_id", "left").select("event_id", "depends_on", (F.col("depends_on").isNull() & F.coalesce("_b", F.lit(False))).alias("requires_need"))


@query("w10_carry_forward", """WITH st AS (SELECT DISTINCT user_id, unnest(range(0, 10000, 500)) step FROM events), v AS (SELECT user_id, event_id step, event_type FROM events) SELECT st.user_id, st.step::BIGINT step, arg_max(v.event_type, v.step) asof_event_type FROM st LEFT JOIN v ON v.user_id = st.user_id AND v.step <= st.step GROUP BY ALL""")
def w10(spark, d):
    e = events(spark, d)
    steps = e.select("user_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9999).cast("long"), F.lit(500).cast("long")))).withColumn("tag", F.lit(1))
    arrivals = e.select("user_id", F.col("event_id").alias("step"), "event_type", F.col("event_id").alias("ord"))
    return temporal.carry_forward(steps, arrivals, ["user_id"], "step", "event_type", "ord").select("user_id", "step", "asof_event_type")


@query("w11_sequential_schedule", """WITH RECURSIVE o AS (SELECT o_custkey c, o_orderkey k, o_orderstatus s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i FROM orders),
 r(c, i, k, launch, arrive, f, o, p) AS (SELECT DISTINCT c, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o UNION ALL
 SELECT c, i, k, l, a, CASE WHEN s = 'F' THEN a ELSE f END, CASE WHEN s = 'O' THEN a ELSE o END, CASE WHEN s = 'P' THEN a ELSE p END FROM (SELECT *, greatest(l + k % 3 + 1, before + 1)::BIGINT a FROM (SELECT o.c, o.i, o.k, o.s, r.f, r.o, r.p, r.arrive before, greatest(o.k % 7, CASE o.s WHEN 'F' THEN r.f WHEN 'O' THEN r.o ELSE r.p END)::BIGINT l FROM r JOIN o ON o.c = r.c AND o.i = r.i + 1)))
 SELECT c o_custkey, k::VARCHAR id, launch, arrive FROM r WHERE i > 0""")
def w11(spark, d):
    """Launch and arrival of a customer's orders when each depends on the one before of the same status (fold over an ordered array)."""
    o = read_table(spark, d, "orders")
    prev = F.lag(F.col("o_orderkey").cast("string")).over(W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey"))
    o = o.withColumn("dep", prev)
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.pmod("o_orderkey", F.lit(7)).alias("activation"), (F.pmod("o_orderkey", F.lit(3)) + 1).alias("delay"), F.array_compact(F.array("dep")).alias("depends_on"))
    by = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))), lambda y: y["x"]).alias("items"))
    return by.select("o_custkey", F.explode(sequences.sequential_schedule("items")).alias("s")).select("o_custkey", "s.id", "s.launch", "s.arrive")


@query("w12_revision_label", "SELECT event_id, CASE WHEN value - p > 1e-6 THEN 'REOPEN' WHEN value - p < -1e-6 THEN 'STABILIZE' WHEN p IS NOT NULL THEN 'KEEP' END AS label FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) p FROM events)")
def w12(spark, d):
    p = F.lag("value").over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    return events(spark, d).select("event_id", sequences.revision_label(p, F.col("value")).alias("label"))


@query("w13_prefix_fold", "SELECT event_id, sum(event_id % 5) OVER w::BIGINT prefix, sum((event_type = 'click')::INT) OVER w % 2 = 1 parity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)".replace("OVER w::BIGINT", "OVER w").replace("sum(event_id % 5) OVER w", "(sum(event_id % 5) OVER w)::BIGINT"))
def w13(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events(spark, d).select("event_id", F.sum(F.col("event_id") % 5).over(w).alias("prefix"), (F.sum((F.col("event_type") == "click").cast("int")).over(w) % 2 == 1).alias("parity"))


@query("w15_equilibrium_label", "SELECT event_id, event_id = max(event_id) OVER (PARTITION BY user_id) OR event_type = 'error' equilibrium FROM events")
def w15(spark, d):
    last = F.max("event_id").over(W.partitionBy("user_id"))
    return events(spark, d).select("event_id", ((F.col("event_id") == last) | (F.col("event_type") == "error")).alias("equilibrium"))


@query("w17_activation_phase", "SELECT l_orderkey, l_linenumber, CASE WHEN p IS NULL THEN 'pre' ELSE 'after:' || p END phase FROM (SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM lineitem)")
def w17(spark, d):
    """Work becomes active after the latest thing it depends on."""
    p = F.max("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(W.unboundedPreceding, -1))
    li = read_table(spark, d, "lineitem").withColumn("p", p)
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("p").isNull(), "pre").otherwise(F.concat(F.lit("after:"), "p")).alias("phase"))


@query("w18_proportional_blocks", "SELECT blk, count(*) n FROM (SELECT o_custkey, ((i + 1) * 4 - 1) // n blk FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 i, count(*) OVER (PARTITION BY o_custkey) n FROM orders)) GROUP BY 1")
def w18(spark, d):
    w = W.partitionBy("o_custkey")
    o = read_table(spark, d, "orders").select((F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return o.groupBy(sequences.proportional_block(F.col("i"), F.col("n"), 4).alias("blk")).agg(F.count("*").alias("n"))


@query("w19_step_snapshot", "SELECT event_id, user_id FROM events WHERE event_id = 4242")
def w19(spark, d):
    return events(spark, d).filter("event_id = 4242").select("event_id", "user_id")


@query("a17_trace_counts", "SELECT event_type, count(*) n FROM events GROUP BY 1")
def a17(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a18_first_delay", """SELECT round(coalesce(avg(b - a), 0), 6) AS \"mean\", count(*) n FROM (SELECT user_id, min(event_id) FILTER (event_type = 'view') a, min(event_id) FILTER (event_type = 'purchase') b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def a18(spark, d):
    x = stats.first_delay(events(spark, d), ["user_id"], "event_type", "view", F.col("event_type") == "purchase", "event_id", "event_id")
    return x.agg(F.round(F.coalesce(F.avg("delay"), F.lit(0.0)), 6).alias("mean"), F.count("*").alias("n"))


@query("a19_first_delay_executable", """SELECT round(coalesce(avg(b - a), 0), 6) AS \"mean\", count(*) n FROM (SELECT user_id, min(event_id) FILTER (event_type = 'view') a, min(event_id) FILTER (event_type = 'purchase' AND value > 10) b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def a19(spark, d):
    x = stats.first_delay(events(spark, d), ["user_id"], "event_type", "view", (F.col("event_type") == "purchase") & (F.col("value") > 10), "event_id", "event_id")
    return x.agg(F.round(F.coalesce(F.avg("delay"), F.lit(0.0)), 6).alias("mean"), F.count("*").alias("n"))


@query("a20_binding_to_observation", """SELECT round(coalesce(avg(b - a), 0), 6) AS \"mean\", count(*) n FROM (SELECT user_id, min(event_id) FILTER (event_type = 'click') a, min(event_id) FILTER (event_type IN ('view', 'purchase')) b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def a20(spark, d):
    x = stats.first_delay(events(spark, d), ["user_id"], "event_type", "click", F.col("event_type").isin("view", "purchase"), "event_id", "event_id")
    return x.agg(F.round(F.coalesce(F.avg("delay"), F.lit(0.0)), 6).alias("mean"), F.count("*").alias("n"))


@query("a21_projection_after_observation", """WITH f AS (SELECT user_id, min(event_id) a FROM events WHERE event_type = 'view' GROUP BY 1), g AS (SELECT e.user_id, a, min(event_id) b FROM events e JOIN f USING (user_id) WHERE event_type = 'click' AND event_id > a GROUP BY ALL) SELECT round(avg(b - a), 6) AS \"mean\", count(*) n FROM g""")
def a21(spark, d):
    x = stats.delay_after(events(spark, d), ["user_id"], F.col("event_type") == "view", F.col("event_type") == "click", "event_id", "event_id")
    return x.agg(F.round(F.avg("delay"), 6).alias("mean"), F.count("*").alias("n"))


@query("a23_evaluation_summary", """WITH t AS (SELECT user_id, count(*) expected, count(*) FILTER (event_type <> 'error') observed, count(*) FILTER (event_type = 'view') stale, min(event_id) delay FROM events GROUP BY 1) SELECT count(*) cases, round(CASE WHEN sum(expected) = 0 THEN 1.0 ELSE sum(observed) / sum(expected) END, 6) coverage, round(CASE WHEN sum(observed) = 0 THEN 0.0 ELSE sum(stale) / sum(observed) END, 6) staleness, round(avg(delay), 6) mean_delay FROM t""")
def a23(spark, d):
    """Coverage and staleness are ratios of sums, delays are means of cases."""
    e = F.col("event_type")
    t = events(spark, d).groupBy("user_id").agg(F.count("*").alias("expected"), F.count_if(e != "error").alias("observed"), F.count_if(e == "view").alias("stale"), F.min("event_id").alias("delay"))
    return t.agg(F.count("*").alias("cases"), F.round(stats.rate(F.sum("observed"), F.sum("expected"), 1.0), 6).alias("coverage"), F.round(stats.rate(F.sum("stale"), F.sum("observed"), 0.0), 6).alias("staleness"), F.round(F.avg("delay"), 6).alias("mean_delay"))


@query("r4_refresh_due", """SELECT event_id, CASE WHEN p IS NULL THEN true WHEN pol = 'always' THEN true WHEN pol = 'max_age' THEN us - p >= 600000000 ELSE false END due FROM (SELECT event_id, epoch_us(ts) us, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) p, CASE event_type WHEN 'view' THEN 'once' WHEN 'click' THEN 'always' ELSE 'max_age' END pol FROM events)""")
def r4(spark, d):
    p = F.lag("us").over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    policy = F.when(F.col("event_type") == "view", "once").when(F.col("event_type") == "click", "always").otherwise("max_age")
    e = events(spark, d).withColumn("p", p)
    return e.select("event_id", temporal.refresh_due(policy, F.col("p").isNotNull(), F.col("us") - F.col("p"), F.lit(600_000_000)).alias("due"))


@query("r6_version_probe", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events) WHERE event_type IS DISTINCT FROM p")
def r6(spark, d):
    return temporal.changed_only(events(spark, d), ["user_id"], ["event_id"], "event_type").select("event_id")


@query("r7_one_observation_a_step", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) offset_step FROM events")
def r7(spark, d):
    return events(spark, d).select("event_id", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long").alias("offset_step"))


@query("r9_projection_re_emit", "SELECT user_id, step, count(*) percepts, min(i) first_index FROM (SELECT e.user_id, s.step, row_number() OVER (PARTITION BY e.user_id ORDER BY s.step, e.event_id) i FROM events e JOIN (SELECT unnest(range(0, 10000, 2500)) step) s ON e.event_id <= s.step WHERE e.event_type = 'purchase') GROUP BY ALL")
def r9(spark, d):
    """Each step projects again what is available by then; the index counts on."""
    e = events(spark, d).filter("event_type = 'purchase'")
    steps = F.array(*(F.lit(i).cast("long") for i in range(0, 10000, 2500)))
    rows = e.select("user_id", "event_id", F.explode(F.filter(steps, lambda s: s >= F.col("event_id"))).alias("step"))
    i = F.row_number().over(W.partitionBy("user_id").orderBy("step", "event_id"))
    return rows.withColumn("i", i).groupBy("user_id", "step").agg(F.count("*").alias("percepts"), F.min(F.col("i").cast("long")).alias("first_index"))


@query("r10_fact_store", "SELECT 'binding:' || user_id fact, arg_max(event_type, event_id) AS \"value\", count(*) revision FROM events GROUP BY user_id")
def r10(spark, d):
    """A changelog's latest value and revision of each fact."""
    return events(spark, d).groupBy(F.concat(F.lit("binding:"), "user_id").alias("fact")).agg(F.max_by("event_type", "event_id").alias("value"), F.count("*").alias("revision"))


@query("r14_superseded", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def r14(spark, d):
    """Only the newest version of a key survives; older ones that weren't delivered are skipped."""
    return temporal.latest_per_key(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"]).select("event_id")


@query("r17_lifecycle_changes", "SELECT event_type \"to\", p \"from\", count(*) n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events) WHERE p <> event_type GROUP BY ALL")
def r17(spark, d):
    p = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    return events(spark, d).select(F.col("event_type").alias("to"), p.alias("from")).filter("`from` <> `to`").groupBy("to", "from").agg(F.count("*").alias("n"))


@query("r21_binding_sets", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type <> 'error')), ',') available, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type = 'error')), ',') waiting FROM events GROUP BY 1")
def r21(spark, d):
    s = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("event_type")))), ",")
    out = events(spark, d).groupBy("user_id").agg(s(F.col("event_type") != "error").alias("available"), s(F.col("event_type") == "error").alias("waiting"))
    return out.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("available", "waiting")})


@query("r24_step_clock", "SELECT event_id, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) clock FROM events")
def r24(spark, d):
    """A logical clock that never runs back."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events(spark, d).select("event_id", F.max("us").over(w).alias("clock"))

"""Queries over keys, texts, projections and filters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import keys as K
from heddle.functions import text as T
from heddle.operators import dedup, sampling
from heddle.plans.registry import query
from heddle.sources.shared import read_table

SID = "sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))))"
UNIT = "(('0x' || substr(sha256({x}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE)"
LANGS = ["de", "en", "es", "fr"]
QUOTA = 200


def unit_sql(x: str) -> str:
    return UNIT.format(x=x)


_FOLD = "".join(
    f""", c_{g} AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score, doc_id) rn FROM base WHERE lang = '{g}'{"".join(f" AND sid NOT IN (SELECT sid FROM a_{h})" for h in LANGS[:i])}),
 a_{g} AS (SELECT doc_id, lang, sid FROM c_{g} WHERE rn = 1 ORDER BY score, doc_id LIMIT {QUOTA})"""
    for i, g in enumerate(LANGS)
)


@query("x4_task_pool", f"""WITH base AS (SELECT doc_id, lang, {SID} sid, sha256('7|' || lang || '|' || doc_id || '|' || {SID}) score FROM documents) {_FOLD},
 pool AS ({" UNION ALL ".join(f"SELECT * FROM a_{g}" for g in LANGS)}),
 labelled AS (SELECT *, {unit_sql("'split|' || sid")} u FROM pool)
 SELECT lang, CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.9 + 0.05 THEN 'validation' ELSE 'test' END split, count(*) n_docs, min('pub-' || lang || '-' || substr(sha256(doc_id || '|' || sid), 1, 16)) first_task FROM labelled GROUP BY ALL""")
def x4_task_pool(spark, d):
    """Semantic dedup across sources in turn, quota sample in hash order, deterministic split, task ids, counts."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang", K.semantic_id("text").alias("sid"))
    docs = docs.withColumn("score", K.stable_hash(K.joined(F.lit("7"), "lang", "doc_id", "sid")))
    pool = dedup.sequential_quota(docs, "lang", LANGS, "sid", ["score", "doc_id"], dict.fromkeys(LANGS, QUOTA))
    split = K.split_of("sid", {"train": 0.9, "validation": 0.05, "test": 0.05})
    return pool.groupBy("lang", split.alias("split")).agg(F.count("*").alias("n_docs"), F.min(K.task_id("lang", "doc_id", "sid")).alias("first_task"))


@query("str1_semantic_id", f"SELECT doc_id, {SID} semantic_id FROM documents")
def str1(spark, d):
    return read_table(spark, d, "documents").select("doc_id", K.semantic_id("text").alias("semantic_id"))


@query("str2_stable_hash", "SELECT item_id, sha256(text) digest FROM benchmark")
def str2(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", K.stable_hash("text").alias("digest"))


@query("str3_split", f"SELECT split, count(*) n FROM (SELECT CASE WHEN u < 0.9 THEN 'train' WHEN u < 0.95 THEN 'validation' ELSE 'test' END split FROM (SELECT {unit_sql("'split|' || o_orderkey")} u FROM orders)) GROUP BY 1")
def str3(spark, d):
    split = K.split_of("o_orderkey", {"train": 0.9, "validation": 0.05, "test": 0.05})
    return read_table(spark, d, "orders").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query("f10_hash_bernoulli", f"SELECT o_orderkey FROM orders WHERE {unit_sql("'42|unnecessary|' || o_orderkey")} < 0.12")
def f10(spark, d):
    return read_table(spark, d, "orders").filter(K.bernoulli(0.12, F.lit("42"), F.lit("unnecessary"), "o_orderkey")).select("o_orderkey")


_CLEAN = "trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query("str4_clean", f"SELECT doc_id, sha256({_CLEAN.format(x='text')}) cleaned, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_CLEAN.format(x='x')}), lambda x: x <> ''), chr(10))) multiline FROM documents")
def str4(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.sha2(T.clean("text"), 256).alias("cleaned"), F.sha2(T.clean_multiline("text"), 256).alias("multiline"))


@query("str5_short", "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 79), '[ ,;:-]+$', '') || '…' END short FROM documents")
def str5(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.short("text", 80).alias("short"))


@query("str6_compact_text", """WITH a AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) c FROM documents), b AS (SELECT *, substr(c, 1, 120) h FROM a),
 k AS (SELECT *, CASE WHEN contains(h, '; ') THEN length(h) - length(string_split(h, '; ')[-1]) - 2 ELSE -1 END k1, CASE WHEN contains(h, ', ') THEN length(h) - length(string_split(h, ', ')[-1]) - 2 ELSE -1 END k2, CASE WHEN contains(h, ' ') THEN length(h) - length(string_split(h, ' ')[-1]) - 1 ELSE -1 END k3 FROM b)
 SELECT doc_id, CASE WHEN length(c) <= 120 THEN c ELSE rtrim(substr(h, 1, CASE WHEN k1 >= 60 THEN k1 WHEN k2 >= 60 THEN k2 WHEN k3 >= 60 THEN k3 ELSE 120 END)) END compact FROM k""")
def str6(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.compact_text("text", 120).alias("compact"))


@query("str7_short_dots", "SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE rtrim(substr(text, 1, 137), ' ') || '...' END short FROM documents")
def str7(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.short_dots("text").alias("short"))


# a letter and the sign or digit behind it are one piece, so that what is left of a number follows no letter
_SIG = "trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(regexp_replace(lower({x}), '\\b[a-z][a-z0-9-]*-[0-9]{{4,}}\\b', '<id>', 'g'), '[a-z][-+0-9]|[-+]?[0-9]+(?:\\.[0-9]+)?|(?s:.)'), lambda t: CASE WHEN regexp_full_match(t, '[-+]?[0-9]+(\\.[0-9]+)?') THEN '<n>' ELSE t END), ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query("str8_surface_signature", f"SELECT {_SIG.format(x='url')} signature, count(*) n FROM pages GROUP BY 1")
def str8(spark, d):
    return read_table(spark, d, "pages").groupBy(T.surface_signature("url").alias("signature")).agg(F.count("*").alias("n"))


@query("str11_answer_key", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) k FROM documents")
def str11(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.sha2(T.answer_key("text"), 256).alias("k"))


@query("str12_number_tokens", """SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '([-+]?[0-9]+(?:\\.[0-9]+)?)', 1), lambda x: ltrim(x, '+')), ' ') numbers FROM pages""")
def str12(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.array_join(T.number_tokens("url"), " ").alias("numbers"))


@query("str14_calendar_date", "SELECT o_orderkey, year(o_orderdate)::INTEGER y, month(o_orderdate)::INTEGER m, day(o_orderdate)::INTEGER dd FROM orders")
def str14(spark, d):
    """Dates written out in two styles and read back."""
    o = read_table(spark, d, "orders")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return o.select("o_orderkey", T.calendar_date(written).alias("x")).select("o_orderkey", "x.y", "x.m", F.col("x.d").alias("dd"))


@query("str16_normalized_text", "SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))), '^[.,;:!? ]+', ''), '[.,;:!? ]+$', '')) t FROM conversations")
def str16(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.normalized_text("text"), 256).alias("t"))


@query("str19_insufficiency", "SELECT count(*) FILTER (regexp_matches(lower(text), '(insufficient|not enough) (evidence|information)|cannot be (determined|answered)|can''t be (determined|answered)|does not (say|state|specify)|unknown from the (evidence|documents)')) n, count(*) total FROM conversations")
def str19(spark, d):
    return read_table(spark, d, "conversations").agg(F.count_if(T.insufficient("text")).alias("n"), F.count("*").alias("total"))


@query("str37_safe_filename", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), 1, 96) name FROM pages")
def str37(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.safe_filename("url").alias("name"))


@query("str38_request_id", "SELECT conv_id, turn, 'tw-' || substr(sha256(conv_id || '|' || turn), 1, 24) request_id FROM conversations")
def str38(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", K.request_id("conv_id", "turn").alias("request_id"))


@query("js1_work_key", """SELECT event_id, event_type || ':{"k":"' || json_extract_string(props, '$.k') || '","user":"' || user_id || '"}' x FROM events""")
def js1(spark, d):
    """One key for equal arguments in whatever order they come."""
    e = read_table(spark, d, "events")
    return e.select("event_id", K.work_key("event_type", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))).alias("x"))


@query("js5_json_field", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT k FROM events")
def js5(spark, d):
    return read_table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s14_static_lookup", "SELECT s_suppkey, n_name, 'static:' || n_nationkey AS version FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s14(spark, d):
    """A keyed lookup in a small dimension (25 rows by its schema) with the version of the entry."""
    n = read_table(spark, d, "nation")
    return read_table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", F.concat(F.lit("static:"), "n_nationkey").alias("version"))


@query("p1_text_after_marker", "SELECT page_id, trim(string_split(url, '/')[-1]) tail FROM pages")
def p1(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.trim(F.element_at(F.split("url", "/"), -1)).alias("tail"))


@query("p3_choice_prompt", """SELECT r_regionkey, r_name || chr(10) || string_agg(chr((65 + i)::INTEGER) || '. ' || n_name, chr(10) ORDER BY i) prompt, max(CASE WHEN i = 1 THEN n_name END) answer FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 i FROM nation) n JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def p3(spark, d):
    """Lettered choices and the indexed answer."""
    n = read_table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("choices"))
    r = read_table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select("r_regionkey", T.choice_prompt("r_name", "choices").alias("prompt"), F.element_at("choices", 2).alias("answer"))


@query("p4_label_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END label FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def p4(spark, d):
    """Text of a label by its position; a label that isn't listed is rejected."""
    labels, texts = F.array(*map(F.lit, "FOP")), F.array(*map(F.lit, ("finished", "open", "pending")))
    at = F.array_position(labels, F.col("o_orderstatus")).cast("int")
    return read_table(spark, d, "orders").withColumn("at", at).filter("at > 0").select("o_orderkey", F.element_at(texts, F.col("at")).alias("label"))


@query("p12_task_id", f"SELECT doc_id, 'pub-' || source || '-' || substr(sha256(doc_id || '|' || {SID}), 1, 16) task_id FROM documents")
def p12(spark, d):
    return read_table(spark, d, "documents").select("doc_id", K.task_id("source", "doc_id", K.semantic_id("text")).alias("task_id"))


@query("p11_provenance", "SELECT doc_id, 'documents' || '/' || source || '/' || lang || '/' || doc_id provenance FROM documents")
def p11(spark, d):
    s = F.struct(F.lit("documents").alias("dataset"), F.col("source"), F.col("lang"), F.col("doc_id").cast("string").alias("row_key"))
    return read_table(spark, d, "documents").select("doc_id", s.alias("p")).select("doc_id", F.concat_ws("/", "p.dataset", "p.source", "p.lang", "p.row_key").alias("provenance"))


@query("p23_variants", "SELECT conv_id, conv_id || '::schedule-' || lpad(v::VARCHAR, 2, '0') example_id FROM (SELECT DISTINCT conv_id FROM conversations), range(2) r(v)")
def p23(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id").distinct()
    return c.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("conv_id", F.format_string("%d::schedule-%02d", "conv_id", "v").alias("example_id"))


@query("p25_mode_classifier", "SELECT mode, count(*) n FROM (SELECT CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'tool_required' WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'tools_available_unnecessary' ELSE 'no_tool' END AS \"mode\" FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def p25(spark, d):
    by = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("b"), F.count_if(F.col("l_linestatus") == "O").alias("s"))
    mode = F.when(F.col("b") > 0, "tool_required").when(F.col("s") > 0, "tools_available_unnecessary").otherwise("no_tool")
    return by.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query("p27_depth_bucket", "SELECT CASE WHEN n <= 8 THEN '1-8' WHEN n <= 16 THEN '9-16' WHEN n <= 32 THEN '17-32' WHEN n <= 64 THEN '33-64' ELSE '65+' END bucket, count(*) n_users FROM (SELECT user_id, count(*) n FROM events GROUP BY 1) GROUP BY 1")
def p27(spark, d):
    by = read_table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    b = F.when(F.col("n") <= 8, "1-8").when(F.col("n") <= 16, "9-16").when(F.col("n") <= 32, "17-32").when(F.col("n") <= 64, "33-64").otherwise("65+")
    return by.groupBy(b.alias("bucket")).agg(F.count("*").alias("n_users"))


@query("p28_conversation_prompt", """SELECT conv_id, sha256(CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) END) prompt FROM conversations GROUP BY conv_id""")
def p28(spark, d):
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select("conv_id", F.sha2(T.conversation_prompt("turns"), 256).alias("prompt"))


@query("p29_key_values", "SELECT o_orderkey, concat_ws(' | ', 'status=' || o_orderstatus, 'priority=' || o_orderpriority, 'customer=' || o_custkey) line FROM orders")
def p29(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", T.key_values(status="o_orderstatus", priority="o_orderpriority", customer="o_custkey").alias("line"))


@query("f3_row_filter", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1 AND toxic = 0")
def f3(spark, d):
    ok = read_table(spark, d, "labels").filter("quality = 1 and toxic = 0")
    return read_table(spark, d, "documents").filter("lang = 'en'").join(ok, "doc_id").select("doc_id")


@query("f4_label_thresholds", """SELECT user_id FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) p, count(*) FILTER (event_type = 'error') / count(*) e FROM events GROUP BY 1) WHERE coalesce(p, 1.0) >= 0.1 AND coalesce(e, 0.0) <= 0.3""")
def f4(spark, d):
    """Thresholds on a map of named scores, with defaults for the names that are absent."""
    e = read_table(spark, d, "events").groupBy("user_id", "event_type").count()
    by = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("count").cast("double").alias("n")))).alias("m"), F.sum("count").alias("t"))
    score = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)) / F.col("t")
    return by.filter((score("purchase") >= 0.1) & (score("error") <= 0.3)).select("user_id")


@query("f5_length_window", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 20 AND 4000")
def f5(spark, d):
    return read_table(spark, d, "documents").filter(F.length("text").between(20, 4000)).select("doc_id")


@query("f6_turn_after_user", "SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) p FROM conversations) WHERE role = 'assistant' AND p = 'user'")
def f6(spark, d):
    p = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return read_table(spark, d, "conversations").withColumn("p", p).filter("role = 'assistant' and p = 'user'").select("conv_id", "turn")


@query("f1_split_filter", f"SELECT doc_id FROM documents WHERE {unit_sql("'split|' || doc_id")} < 0.9")
def f1(spark, d):
    return read_table(spark, d, "documents").filter(K.split_of("doc_id", {"train": 0.9, "rest": 0.1}) == "train").select("doc_id")


@query("t1_quota_sample", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) r FROM (SELECT *, row_number() OVER (PARTITION BY source, sid ORDER BY score, doc_id) rn FROM (SELECT source, doc_id, sid, sha256('3|' || source || '|' || doc_id || '|' || sid) score FROM (SELECT *, {SID} sid FROM documents))) WHERE rn = 1) WHERE r <= 20")
def t1(spark, d):
    docs = read_table(spark, d, "documents").select("source", "doc_id", K.semantic_id("text").alias("sid"))
    docs = docs.withColumn("score", K.stable_hash(K.joined(F.lit("3"), "source", "doc_id", "sid")))
    one = dedup.first_by(docs, ["source", "sid"], ["score", "doc_id"])
    r = F.row_number().over(W.partitionBy("source").orderBy("score", "doc_id"))
    return one.withColumn("r", r).filter("r <= 20").select("source", "doc_id")


@query("t2_quota_with_drops", """WITH a AS (SELECT source, doc_id, sha256(text) k, n_chars < 200 bad, sha256('5|' || doc_id) o FROM documents), b AS (SELECT *, NOT bad AND row_number() OVER (PARTITION BY source, k ORDER BY bad::INTEGER, o) = 1 ok FROM a),
 c AS (SELECT *, sum(ok::BIGINT) OVER w r, sum((NOT ok)::BIGINT) OVER w dropped FROM b WINDOW w AS (PARTITION BY source ORDER BY o ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, r::BIGINT rank, dropped::BIGINT dropped_before FROM c WHERE ok AND r <= 15""")
def t2(spark, d):
    docs = read_table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("k"), (F.col("n_chars") < 200).alias("bad"), sampling.hash_order("5", "doc_id").alias("o"))
    return sampling.quota_with_drops(docs, "source", "k", ["o"], 15, F.col("bad")).select("source", "doc_id", "rank", "dropped_before")


@query("t3_stratified", "SELECT p_brand, p_partkey, r stratum_rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('9|' || p_partkey), p_partkey) r FROM part) WHERE r <= 5")
def t3(spark, d):
    return sampling.stratified(read_table(spark, d, "part"), ["p_brand"], 5, "9", "p_partkey").select("p_brand", "p_partkey", F.col("stratum_rank").cast("long").alias("stratum_rank"))


@query("t4_hash_top_n", "SELECT o_orderkey FROM orders ORDER BY sha256('11|' || o_orderkey), o_orderkey LIMIT 100")
def t4(spark, d):
    return sampling.top_by_hash(read_table(spark, d, "orders"), 100, "11", "o_orderkey").select("o_orderkey")


@query("t9_head", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def t9(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("t10_round_robin_shard", "SELECT shard, count(*) n, min(k) least FROM (SELECT (row_number() OVER (ORDER BY h) - 1) % 6 shard, h k FROM (SELECT sha256('1|' || o_orderkey) h FROM orders)) GROUP BY 1")
def t10(spark, d):
    o = read_table(spark, d, "orders").select(sampling.hash_order("1", "o_orderkey").alias("k"))
    s = sampling.round_robin_shards(o, 6, ["k"])
    return s.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("k").alias("least"))


@query("t11_bucketed_shard", """WITH a AS (SELECT o_orderstatus b, o_orderkey k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('2|' || o_orderkey)) - 1 i, count(*) OVER (PARTITION BY o_orderstatus) n FROM orders), c AS (SELECT *, unnest(range(0, ((ceil(n / 4)::BIGINT * 4 - 1 - i) // n) + 1)) * n + i p FROM a) SELECT b, (p % 4)::INTEGER shard, count(*) n, sum(k)::BIGINT keys FROM c GROUP BY ALL""")
def t11(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("b"), F.col("o_orderkey").alias("k"))
    return sampling.round_robin_shards(o, 4, [sampling.hash_order("2", "k")], ["b"]).groupBy("b", "shard").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("t12_micro_batches", "SELECT b, batch, count(*) n, min(k) first_key FROM (SELECT o_orderstatus b, o_orderkey k, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 64 batch FROM orders) GROUP BY ALL")
def t12(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("b"), F.col("o_orderkey").alias("k"))
    return sampling.micro_batches(o, ["b"], ["k"], 64).groupBy("b", "batch").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("d1_union_ordered", "SELECT component_ord, count(*) n FROM (SELECT 0 component_ord FROM documents UNION ALL SELECT 1 FROM benchmark) GROUP BY 1")
def d1(spark, d):
    a = read_table(spark, d, "documents").select(F.lit(0).alias("component_ord"), "text")
    return a.unionByName(read_table(spark, d, "benchmark").select(F.lit(1).alias("component_ord"), "text")).groupBy("component_ord").agg(F.count("*").alias("n"))


@query("d2_semantic_dedup", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, sid ORDER BY sha256('7|' || doc_id), doc_id) rn FROM (SELECT *, {SID} sid FROM documents)) WHERE rn = 1")
def d2(spark, d):
    docs = read_table(spark, d, "documents").select("source", "doc_id", K.semantic_id("text").alias("sid"))
    return dedup.first_by(docs, ["source", "sid"], [sampling.hash_order("7", "doc_id"), "doc_id"]).select("source", "doc_id")


@query("d3_w16_fingerprint", f"SELECT doc_id, CASE WHEN f <> doc_id THEN f END duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY {SID} ORDER BY doc_id) f FROM documents)")
def d3(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", K.semantic_id("text").alias("fp"))
    return dedup.mark_duplicates(docs, "fp", ["doc_id"], "doc_id").select("doc_id", "duplicate_of")


@query("d4_holdout_overlap", f"SELECT {SID} sid FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {SID} FROM documents WHERE doc_id % 2 = 1")
def d4(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", K.semantic_id("text").alias("sid"))
    return dedup.disjoint_violations(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "sid")


@query("d5_pair_dedup", "SELECT count(*) n FROM (SELECT DISTINCT lower(p_name), lower(p_type) FROM part)")
def d5(spark, d):
    return read_table(spark, d, "part").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).dropDuplicates(["a", "b"]).agg(F.count("*").alias("n"))


@query("d6_first_prompt", f"SELECT sid, arg_min(doc_id, doc_id) doc_id FROM (SELECT doc_id, {SID} sid FROM documents) GROUP BY 1")
def d6(spark, d):
    return read_table(spark, d, "documents").groupBy(K.semantic_id("text").alias("sid")).agg(F.min_by("doc_id", "doc_id").alias("doc_id"))


@query("d7_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def d7(spark, d):
    return read_table(spark, d, "customer").select("c_custkey").subtract(read_table(spark, d, "events").select("user_id"))


@query("d8_set_equality", """SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) = list_sort(list(DISTINCT l_partkey)) same FROM lineitem GROUP BY 1""")
def d8(spark, d):
    a = lambda c: F.array_sort(F.collect_set(c))
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg((a("l_suppkey") == a("l_partkey")).alias("same"))


@query("d9_catalog_union", "SELECT p_name anchor, arg_min(p_brand, p_partkey) brand, count(DISTINCT p_brand) > 1 conflict FROM part GROUP BY 1")
def d9(spark, d):
    return read_table(spark, d, "part").groupBy(F.col("p_name").alias("anchor")).agg(F.min_by("p_brand", "p_partkey").alias("brand"), (F.count_distinct("p_brand") > 1).alias("conflict"))


@query("d10_object_universe", "SELECT 'nation' kind, n_name AS id FROM nation UNION SELECT 'region', r_name FROM region UNION SELECT 'segment', c_mktsegment FROM customer UNION SELECT 'brand', p_brand FROM part")
def d10(spark, d):
    parts = [read_table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, t, c in (("nation", "nation", "n_name"), ("region", "region", "r_name"), ("segment", "customer", "c_mktsegment"), ("brand", "part", "p_brand"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("kind", "id")


@query("d11_key_intersection", "SELECT c_custkey k FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def d11(spark, d):
    a = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return a.intersect(read_table(spark, d, "orders").select("o_custkey")).intersect(read_table(spark, d, "events").select("user_id"))

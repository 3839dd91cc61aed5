"""Queries over generated cases, one for each row of a given table: each builds, verifies from what a solver sees, and counts.

Draws are parts of SHA-256, so the SQL recomputes prompts and answers from the tables' keys by formulas of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import cases, dedup, generators
from heddle.plans.registry import query
from heddle.sources.shared import read_table


def numbered(spark, d, name, key):
    return read_table(spark, d, name).select(F.col(key).alias("task_no"))


def drawn(seed: int, name: str, low: int, high: int, key: str = "k") -> str:
    return f"(('0x' || substr(sha256('{seed}|{name}|' || {key}), 1, 12))::BIGINT % {high - low + 1} + {low})"


def _formulas(seed: int, names: list[str]) -> str:
    """SQL columns of every family's draws, named family_draw."""
    return ", ".join(f"{drawn(seed, f'{n}.{x}', *r)} {n}_{x}" for n in names for x, r in generators.FAMILIES[n][0].items())


_FAMILIES = list(generators.FAMILIES)
_ALGEBRA = ["linear_equation", "difference_of_squares", "derivative_at", "system_sum", "polynomial_value", "arithmetic_series"]
# answers by family, in SQL
_ANSWERS = {
    "order_total": "order_total_a * order_total_b + order_total_c", "remainder": "remainder_a % remainder_b", "clip": "CASE WHEN clip_a > 9999 THEN 9999 WHEN clip_a < -9999 THEN -9999 ELSE clip_a END",
    "least_of_three": "list_min([least_of_three_a, least_of_three_b, least_of_three_c])", "middle_of_three": "list_sort([middle_of_three_a, middle_of_three_b, middle_of_three_c])[2]", "bit_xor": "xor(bit_xor_a, bit_xor_b)",
    "minutes": "(minutes_a + minutes_b) % 1440", "seats": "(seats_a + seats_b - 1) // seats_b", "growth": "list_reduce([growth_a] || range(growth_b), lambda x, y: x * 11 // 10)", "count_multiples": "count_multiples_a // count_multiples_b",
    "linear_equation": "linear_equation_x", "difference_of_squares": "difference_of_squares_a * difference_of_squares_a - difference_of_squares_b * difference_of_squares_b", "derivative_at": "derivative_at_a * derivative_at_x + derivative_at_a * derivative_at_x + derivative_at_b",
    "system_sum": "system_sum_x", "polynomial_value": "polynomial_value_x * (polynomial_value_a * polynomial_value_x * polynomial_value_x + polynomial_value_b) + polynomial_value_c",
    "arithmetic_series": "list_sum(list_transform(range(arithmetic_series_n), lambda i: arithmetic_series_a + i * arithmetic_series_b))",
}


def _generated(table: str, key: str, seed: int, names: list[str], more: str = "") -> str:
    branch = " ".join(f"WHEN {i} THEN ({_ANSWERS[n]})::BIGINT" for i, n in enumerate(names))
    return f"(SELECT k, {names!r}[1 + k % {len(names)}] family, CASE k % {len(names)} {branch} END answer{more} FROM (SELECT {key} k, {_formulas(seed, names)} FROM {table}))"


@query("s20_s27_generators", f"SELECT k o_orderkey, family, answer, CASE family WHEN 'remainder' THEN prompt ELSE NULL END prompt FROM {_generated('orders', 'o_orderkey', 7, _FAMILIES, more=chr(44) + ' ' + chr(39) + 'What is the remainder of ' + chr(39) + ' || remainder_a || ' + chr(39) + ' divided by ' + chr(39) + ' || remainder_b || ' + chr(39) + '?' + chr(39) + ' prompt')}")
def s20(spark, d):
    """A task of some family for every order; none whose answer isn't what its spec gives."""
    t = generators.generate(spark, numbered(spark, d, "orders", "o_orderkey"), 7)
    return t.join(generators.verify(t).select("task_id"), "task_id", "left_anti").select(F.col("task_no").alias("o_orderkey"), "family", "answer", F.when(F.col("family") == "remainder", F.col("prompt")).alias("prompt"))


@query("x9_x11_computational_build", f"SELECT 1 + k % 3 stages, family, count(*) n, sum(answer)::BIGINT answers FROM {_generated('customer', 'c_custkey', 11, _FAMILIES)} GROUP BY 1, 2")
def x9(spark, d):
    """Generated tasks of all customers with their stage histogram."""
    t = generators.generate(spark, numbered(spark, d, "customer", "c_custkey"), 11).withColumn("stages", 1 + F.col("task_no") % 3)
    return t.groupBy("stages", "family").agg(F.count("*").alias("n"), F.sum("answer").alias("answers"))


@query("x10_x16_family_builds", f"SELECT family, count(*) n_tasks, sum(answer)::BIGINT answers FROM {_generated('part', 'p_partkey', 3, _ALGEBRA)} GROUP BY 1")
def x10(spark, d):
    """A build from chosen families only, a task a part, verified."""
    t = generators.generate(spark, numbered(spark, d, "part", "p_partkey"), 3, _ALGEBRA)
    return t.join(generators.verify(t), "task_id", "left_anti").groupBy("family").agg(F.count("*").alias("n_tasks"), F.sum("answer").alias("answers"))


def counted(tasks, wrong, name):
    w = wrong.agg(F.count("*").alias("wrong"))
    return tasks.agg(F.count("*").alias("tasks"), F.sum("answer").alias("answers")).join(F.broadcast(w)).select(F.lit(name).alias("family"), "tasks", "answers", "wrong")


@query(
    "s24_s25_record_cases",
    f"""SELECT family, count(*) tasks, sum(answer)::BIGINT answers, 0::BIGINT wrong FROM (SELECT 'serial_chain' family, {drawn(1, 'value', 1, 9999)} answer FROM (SELECT c_custkey k FROM customer) UNION ALL SELECT 'alias_join', {drawn(2, 'value', 1, 9999)} FROM (SELECT c_custkey k FROM customer)
 UNION ALL SELECT 'parallel_join', {drawn(3, 'price', 2, 99)} * {drawn(3, 'stock', 1, 50)} FROM (SELECT c_custkey k FROM customer) UNION ALL SELECT 'stale_override', CASE WHEN k % 2 = 0 THEN {drawn(4, 'new', 100, 199)} ELSE {drawn(4, 'old', 1, 99)} END FROM (SELECT c_custkey k FROM customer)
 UNION ALL SELECT 'fork_join', ({drawn(5, 'v0', 1, 500)} + {drawn(5, 'v1', 1, 500)} + {drawn(5, 'v2', 1, 500)}) * {drawn(5, 'scale', 2, 9)} FROM (SELECT c_custkey k FROM customer)) GROUP BY 1""",
)
def s24(spark, d):
    n = numbered(spark, d, "customer", "c_custkey")
    t, r = cases.serial_chain(spark, n, 1)
    out = counted(t, cases.verify_chain(t, r), "serial_chain")
    t, r = cases.alias_join(spark, n, 2)
    out = out.unionByName(counted(t, cases.verify_chain(t, r, 4), "alias_join"))
    t, r = cases.parallel_join(spark, n, 3)
    out = out.unionByName(counted(t, cases.verify_values(t, r, cases.product), "parallel_join"))
    t, r = cases.stale_override(spark, n, 4)
    out = out.unionByName(counted(t, cases.verify_values(t, r, cases.authoritative), "stale_override"))
    t, r = cases.fork_join(spark, n, 5)
    scaled = t.join(r.groupBy("task_no").agg(F.sum("value").alias("s")).hint("merge"), "task_no").filter(F.col("s") * F.col("scale") != F.col("answer"))
    return out.unionByName(counted(t, scaled, "fork_join"))


@query("s26_logic_cases", "SELECT ['spatial_displacement', 'parity_chain', 'modular_policy', 'boolean_gates', 'ordering', 'candidate_elimination', 'longest_run', 'causal_intervention'][1 + c_custkey % 8] family, [8, 16, 32, 64, 128][1 + (c_custkey // 8) % 5]::INTEGER capacity, count(*) tasks FROM customer GROUP BY 1, 2")
def s26(spark, d):
    n = numbered(spark, d, "customer", "c_custkey")
    return cases.logic_cases(spark, n, 1).filter("answer is not null").groupBy("family", "capacity").agg(F.count("*").alias("tasks"))


@query("d4_logic_holdout", "SELECT count(*) tasks, 0::BIGINT shared FROM customer")
def d4(spark, d):
    """Probe specifications that training has as well: none may."""
    n = numbered(spark, d, "customer", "c_custkey")
    a, b = cases.logic_cases(spark, n, 1), cases.logic_cases(spark, n, 1, probe=True)
    key = lambda x: x.select(F.sha2(F.concat_ws(",", "family", F.array_join(F.transform("spec", lambda v: v.cast("string")), ",")), 256).alias("k"))
    return a.agg(F.count("*").alias("tasks")).join(F.broadcast(dedup.disjoint_violations(key(a), key(b), "k").agg(F.count("*").alias("shared"))))


@query("s23_corrections", f"SELECT count(*) * 3 frames, sum(3 * ({drawn(1, 'a', 10, 99)} + {drawn(1, 'b', 10, 99)}) + 2)::BIGINT hypotheses, 0::BIGINT broken FROM (SELECT c_custkey k FROM customer)")
def s23(spark, d):
    """Two wrong hypotheses, one too high, and the right one for every customer's number."""
    c = cases.corrections(spark, numbered(spark, d, "customer", "c_custkey"), 1)
    return c.agg(F.count("*").alias("frames"), F.sum("hypothesis").alias("hypotheses")).join(F.broadcast(cases.audit_corrections(c).agg(F.count("*").alias("broken"))))


@query("s27_multilingual", f"SELECT ['en', 'de', 'fr', 'es', 'zh'][1 + k % 5] ask_lang, ['en', 'de', 'fr', 'es', 'zh'][1 + {drawn(1, 'tell', 0, 4)}] tell_lang, count(*) n FROM (SELECT c_custkey k FROM customer) GROUP BY 1, 2")
def s27(spark, d):
    m = cases.multilingual(spark, numbered(spark, d, "customer", "c_custkey"), 1)
    told = F.contains("second", F.col("answer")) & ~F.contains("prompt", F.col("answer")) & ~F.contains("first", F.col("answer"))
    return m.filter(told).groupBy("ask_lang", "tell_lang").agg(F.count("*").alias("n"))

"""Generated cases, slots, program screening and extraction on small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heddle.functions import extract
from heddle.operators import cases, slots


def test_cases_hold_and_verifiers_notice(spark):
    t, r = cases.serial_chain(spark, 50, 1, 6)
    assert cases.verify_chain(t, r, 6).count() == 0
    spoiled = r.withColumn("value", F.when(F.col("task_no") == 7, F.col("value") + 1).otherwise(F.col("value")))
    assert [x["task_no"] for x in cases.verify_chain(t, spoiled, 6).collect()] == [7]
    t, r = cases.stale_override(spark, 50, 2)
    assert cases.verify_values(t, r, cases.authoritative).count() == 0
    assert cases.verify_values(t, r.filter("source = 'cache'"), cases.authoritative).count() == 25
    t, r = cases.parallel_join(spark, 50, 3)
    assert cases.verify_values(t, r, cases.product).count() == 0


def fold(family, s):
    if family == "spatial_displacement":
        return sum(x if x % 2 == 0 else -x for x in s)
    if family == "parity_chain":
        return sum(s) % 2
    if family == "modular_policy":
        acc = 1
        for x in s:
            acc = (acc * 3 + x) % 97
        return acc
    if family == "boolean_gates":
        acc = 1
        for x in s:
            acc = acc * (x % 2) if x % 3 == 0 else max(acc, x % 2) if x % 3 == 1 else 1 - acc
        return acc
    if family == "ordering":
        return sorted(s)[-(-len(s) // 2) - 1]
    if family == "candidate_elimination":
        return sum(x > 2 and x % 3 != 1 for x in s)
    if family == "longest_run":
        best = n = 0
        last = None
        for x in s:
            n = n + 1 if x % 2 == last else 1
            last, best = x % 2, max(best, n)
        return best
    return sum((5 if i == 2 else x) > 4 for i, x in enumerate(s))


def test_logic_answers_equal_python(spark):
    rows = cases.logic_cases(spark, 160, 3).collect()
    assert {r["family"] for r in rows} == set(cases.FOLDS) and {len(r["spec"]) for r in rows} == set(cases.CAPACITIES)
    assert all(r["answer"] == fold(r["family"], r["spec"]) for r in rows)


def test_no_specification_is_on_both_sides(spark):
    """So many short specifications that draws from two seeds meet; whatever the seeds, training and probes never do."""
    n = spark.range(0, 40 * 40_000, 40).select(F.col("id").alias("task_no"))  # one family, eight cells
    train, probe = (cases.logic_cases(spark, n, s, probe=p).select(F.array_join(F.transform("spec", lambda v: v.cast("string")), ",").alias("k")) for s, p in ((1, False), (2, True)))
    assert train.intersect(probe).count() == 0
    last = train.select(F.substring_index("k", ",", -1).alias("x")).groupBy("x").count().collect()
    assert len(last) == 10 and min(r["count"] for r in last) > 3500
    same = cases.logic_cases(spark, n, 3, probe=True).select("task_no", "spec").intersect(cases.logic_cases(spark, n, 3).select("task_no", "spec"))
    assert same.count() == 0


def test_corrections_and_languages(spark):
    c = cases.corrections(spark, 20, 1)
    assert cases.audit_corrections(c).count() == 0
    spoiled = c.withColumn("noise", F.when((F.col("task_no") == 3) & (F.col("phase") == "final"), 0.6).otherwise(F.col("noise")))
    assert cases.audit_corrections(spoiled).count() == 1
    m = cases.multilingual(spark, 50, 1).collect()
    assert all(r["answer"] in r["second"] and r["answer"] not in r["prompt"] for r in m)


def test_slots_are_kept_and_reused(spark):
    rows = [("t", 0, "a", False), ("t", 0, "b", False), ("t", 1, "a", True), ("t", 1, "b", False), ("t", 2, "b", False), ("t", 2, "c", False)]
    df = spark.createDataFrame(rows, "t string, frame_pos int, cell_id string, retired boolean")
    got = {(r["frame_pos"], r["cell_id"]): r["slot"] for r in slots.allocate_slots(df, "t", 2).collect()}
    assert got[0, "a"] == got[1, "a"] == got[2, "c"] and got[0, "b"] == got[2, "b"] != got[0, "a"]
    with pytest.raises(Exception, match="more than 1 live"):
        slots.allocate_slots(df, "t", 1).collect()


def test_programs_are_screened():
    assert slots.unsafe_reason("import math\nprint(math.pi)") is None
    for code, why in (("import os", "import"), ("from subprocess import run", "import"), ("x = eval('1')", "name eval"), ("().__class__", "attribute __class__"), ("def f(:", "syntax"), (None, "no code")):
        assert slots.unsafe_reason(code) == why


@pytest.mark.parametrize(
    ("kind", "text", "value"),
    [
        ("birth_date", "Ada Poe (born 10 May 1815) was a writer.", "10 May 1815"), ("death_place", "He died in 1852 in Turin, Italy.", "Turin, Italy"), ("death_cause", "She died from heart failure in Rome.", "heart failure"),
        ("director", "It is a film directed by Jean de Boer.", "Jean de Boer"), ("spouse", "He married Ann Lee in 1900.", "Ann Lee"), ("founded", "The club was founded in 1887.", "1887"), ("burial", "She is buried in Highgate Cemetery.", "Highgate Cemetery"),
        ("award", "Nothing here.", None),
    ],
)
def test_facts(spark, kind, text, value):
    assert spark.range(1).select(extract.fact(kind, F.lit(text)).alias("x")).first()["x"] == value


def test_math_surfaces(spark):
    one = lambda a, b: spark.range(1).select(extract.math_match(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert one("$\\dfrac{1}{2}$", "\\frac{1}{2}") and one("3, (1, 2)", "(1,2), 3") and one("1,234", "1234") and one("\\text{ yes }", "yes")
    assert not one("1, 2", "1, 3") and not one("\\frac{1}{2}", "\\frac{2}{1}")
    assert not one("X", "x") and one("2 and 3", "3, 2") and one("3\\text{ or }4", "4, 3") and not one("band", "b,")


def test_records_are_never_broadcast(spark):
    """900,000 keys are a file of 4 MB but records of gigabytes: no join of a verifier may collect them."""
    small = spark.range(20).select(F.col("id").alias("task_no"))
    t, r = cases.serial_chain(spark, small, 1)
    p, v = cases.parallel_join(spark, small, 3)
    for plan in (cases.verify_chain(t, r), cases.verify_values(p, v, cases.product)):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 0

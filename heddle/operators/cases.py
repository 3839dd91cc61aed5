"""Synthetic cases with evidence: record tables to look up and join, logic specifications to fold, corrections, languages.

As in generators.py every row is a function of its number and the seed, and n may be a table with `task_no`. Each kind comes with a verifier that recomputes
the answer from what a solver would see (the records, the specification), not from the draws.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.generators import draw, numbered

RECORDS = "task_no long, source string, key string, next_key string, value long"


def _records(df: DataFrame, *rows: tuple[str, Column, Column | None, Column | None]) -> DataFrame:
    null_key, null_value = F.lit(None).cast("string"), F.lit(None).cast("long")
    parts = F.array(*(F.struct(F.lit(s).alias("source"), k.alias("key"), (n if n is not None else null_key).alias("next_key"), (v if v is not None else null_value).cast("long").alias("value")) for s, k, n, v in rows))
    return df.select("task_no", F.explode(parts).alias("r")).select("task_no", "r.*")


def serial_chain(spark: SparkSession, n: int | DataFrame, seed: int, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tasks, records): each record names the next; the last holds the value."""
    one, base = draw(seed), numbered(spark, n)
    key = lambda i: F.concat_ws("-", F.lit("k"), "task_no", one(f"key{i}", 100, 999).cast("string"), F.lit(str(i)))
    value = one("value", 1, 9999)
    rows = [("directory", key(i), key(i + 1) if i + 1 < depth else None, None if i + 1 < depth else value) for i in range(depth)]
    return base.select("task_no", key(0).alias("start"), value.alias("answer")), _records(base, *rows)


def verify_chain(tasks: DataFrame, records: DataFrame, depth: int = 5) -> DataFrame:
    """Tasks whose answer isn't what the hops lead to: one join a hop, never a broadcast (a small file of keys makes a large table of records)."""
    at, records = tasks.withColumn("at", F.col("start")), records.hint("merge")
    for _ in range(depth - 1):
        hop = records.select("task_no", F.col("key").alias("at"), F.col("next_key").alias("_next"))
        at = at.hint("merge").join(hop, ["task_no", "at"]).withColumn("at", F.col("_next")).drop("_next")
    end = at.join(records.select("task_no", F.col("key").alias("at"), "value"), ["task_no", "at"])
    return tasks.join(end.filter(F.col("value").eqNullSafe(F.col("answer"))).hint("merge"), "task_no", "left_anti")


def parallel_join(spark: SparkSession, n: int | DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two sources, one key; the answer is price times stock."""
    one, base = draw(seed), numbered(spark, n)
    key = F.concat(F.lit("item"), "task_no")
    price, stock = one("price", 2, 99), one("stock", 1, 50)
    return base.select("task_no", key.alias("start"), (price * stock).alias("answer")), _records(base, ("prices", key, None, price), ("stocks", key, None, stock))


def stale_override(spark: SparkSession, n: int | DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A cached value and, for every other task, an authoritative one that overrides it."""
    one, base = draw(seed), numbered(spark, n)
    key = F.concat(F.lit("rate"), "task_no")
    old, new = one("old", 1, 99), one("new", 100, 199)
    has = F.col("task_no") % 2 == 0
    rows = _records(base, ("cache", key, None, old), ("authority", key, None, F.when(has, new)))
    return base.select("task_no", key.alias("start"), F.when(has, new).otherwise(old).alias("answer")), rows.filter("value is not null")


def alias_join(spark: SparkSession, n: int | DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """An alias leads to an entity, the entity to its policy, the policy to a rate."""
    return serial_chain(spark, n, seed, 4)


def fork_join(spark: SparkSession, n: int | DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Three branches whose values are summed and scaled."""
    one, base = draw(seed), numbered(spark, n)
    v = [one(f"v{i}", 1, 500) for i in range(3)]
    scale = one("scale", 2, 9)
    rows = [(f"branch{i}", F.concat(F.lit("b"), "task_no"), None, v[i]) for i in range(3)]
    return base.select("task_no", F.concat(F.lit("b"), "task_no").alias("start"), scale.alias("scale"), ((v[0] + v[1] + v[2]) * scale).alias("answer")), _records(base, *rows)


def verify_values(tasks: DataFrame, records: DataFrame, how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tasks whose answer isn't what `how` makes of their records (one row a task: task_no, got)."""
    return tasks.join(how(records).hint("merge"), "task_no", "left").filter(~F.col("answer").eqNullSafe(F.col("got")))


def product(records: DataFrame) -> DataFrame:
    by = records.groupBy("task_no").agg(F.max(F.when(F.col("source") == "prices", F.col("value"))).alias("p"), F.max(F.when(F.col("source") == "stocks", F.col("value"))).alias("s"))
    return by.select("task_no", (F.col("p") * F.col("s")).alias("got"))


def authoritative(records: DataFrame) -> DataFrame:
    best = F.max_by("value", F.when(F.col("source") == "authority", 1).otherwise(0))
    return records.groupBy("task_no").agg(best.alias("got"))


CAPACITIES = (8, 16, 32, 64, 128)
#: Answers folded from a specification: an array of integers of [0, 9].
FOLDS: dict[str, Callable[[Column], Column]] = {
    "spatial_displacement": lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x % 2 == 0, x).otherwise(-x)),
    "parity_chain": lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: (acc + x) % 2),
    "modular_policy": lambda s: F.aggregate(s, F.lit(1).cast("long"), lambda acc, x: (acc * 3 + x) % 97),
    "boolean_gates": lambda s: F.aggregate(s, F.lit(1).cast("long"), lambda acc, x: F.when(x % 3 == 0, acc * (x % 2)).when(x % 3 == 1, F.greatest(acc, x % 2)).otherwise(1 - acc)),
    "ordering": lambda s: F.element_at(F.array_sort(s), F.ceil(F.size(s) / 2).cast("int")),
    "candidate_elimination": lambda s: F.size(F.filter(s, lambda x: (x > 2) & (x % 3 != 1))).cast("long"),
    "longest_run": lambda s: F.aggregate(s, F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("best")), lambda acc, x: F.struct((x % 2).alias("last"), F.when(x % 2 == acc["last"], acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.greatest(acc["best"], F.when(x % 2 == acc["last"], acc["n"] + 1).otherwise(F.lit(1).cast("long"))).alias("best")), lambda acc: acc["best"]),
    "causal_intervention": lambda s: F.aggregate(F.transform(s, lambda x, i: F.when(i == 2, F.lit(5).cast("long")).otherwise(x)), F.lit(0).cast("long"), lambda acc, x: F.when(x > 4, acc + 1).otherwise(acc)),
}


def logic_cases(spark: SparkSession, n: int | DataFrame, seed: int, probe: bool = False) -> DataFrame:
    """(task_no, family, capacity, spec, answer): families and capacities in turn. Holdout is by specification, whatever the seeds: a hash of
    all cells but the last says whether a training case ends in an even or an odd one, and a probe case ends in the other."""
    names = list(FOLDS)
    base = numbered(spark, n)
    base = base.withColumns({"family": F.element_at(F.array(*map(F.lit, names)), (F.col("task_no") % len(names) + 1).cast("int")), "capacity": F.element_at(F.array(*map(F.lit, CAPACITIES)), (F.floor(F.col("task_no") / len(names)) % len(CAPACITIES) + 1).cast("int"))})
    cell = lambda i: F.pmod(F.xxhash64(F.lit(seed * 2 + int(probe)), F.col("task_no"), i), F.lit(10)).cast("long")
    base = base.withColumn("_head", F.transform(F.sequence(F.lit(1), F.col("capacity") - 1), cell))
    last, side = cell(F.col("capacity")), F.pmod(F.xxhash64(F.array_join(F.transform("_head", lambda x: x.cast("string")), ",")) + int(probe), F.lit(2))
    base = base.withColumn("spec", F.concat("_head", F.array(F.floor(last / 2) * 2 + side))).drop("_head")
    answer = F.lit(None).cast("long")
    for name, fold in FOLDS.items():
        answer = F.when(F.col("family") == name, fold(F.col("spec"))).otherwise(answer)
    return base.withColumn("answer", answer)


def corrections(spark: SparkSession, n: int | DataFrame, seed: int) -> DataFrame:
    """(task_no, phase, hypothesis, noise, answer): a wrong hypothesis, the evidence against it, the right one; noise rises and then falls."""
    one = draw(seed)
    a, b = one("a", 10, 99), one("b", 10, 99)
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(p).alias("phase"), h.alias("hypothesis"), F.lit(x).alias("noise")) for i, (p, h, x) in enumerate((("initial", a + b + 1, 0.2), ("after:e0", a + b + 1, 0.7), ("final", a + b, 0.1)))))
    base = numbered(spark, n)
    return base.select("task_no", (a + b).alias("answer"), F.explode(rows).alias("r")).select("task_no", "r.*", "answer")


def audit_corrections(cases: DataFrame) -> DataFrame:
    """Cases that break a rule: noise must rise by more than 0.2 and then fall by as much, the last hypothesis be right, the first wrong."""
    p = cases.groupBy("task_no", "answer").pivot("phase", ["initial", "after:e0", "final"]).agg(F.first("hypothesis").alias("h"), F.first("noise").alias("x"))
    ok = (F.col("`after:e0_x`") - F.col("initial_x") > 0.2) & (F.col("`after:e0_x`") - F.col("final_x") > 0.2) & (F.col("final_h") == F.col("answer")) & (F.col("initial_h") != F.col("answer"))
    return p.filter(~ok)


#: Question and evidence patterns of two-hop tasks in each language.
LANGUAGES = {
    "en": ("Where does the colleague of %s work?", "%s works with %s.", "%s works in %s."),
    "de": ("Wo arbeitet die Kollegin von %s?", "%s arbeitet mit %s.", "%s arbeitet in %s."),
    "fr": ("Où travaille la collègue de %s ?", "%s travaille avec %s.", "%s travaille à %s."),
    "es": ("¿Dónde trabaja la colega de %s?", "%s trabaja con %s.", "%s trabaja en %s."),
    "zh": ("%s的同事在哪里工作？", "%s和%s一起工作。", "%s在%s工作。"),
}


def multilingual(spark: SparkSession, n: int | DataFrame, seed: int) -> DataFrame:
    """(task_no, ask_lang, tell_lang, prompt, first, second, answer): the question in one language, both facts in another."""
    one, langs = draw(seed), list(LANGUAGES)
    base = numbered(spark, n)
    ask, tell = (F.element_at(F.array(*map(F.lit, langs)), (x + 1).cast("int")) for x in (F.col("task_no") % len(langs), one("tell", 0, len(langs) - 1)))
    base = base.withColumns({"ask_lang": ask, "tell_lang": tell, "a": F.concat(F.lit("Ana"), "task_no"), "b": F.concat(F.lit("Bo"), one("b", 0, 999).cast("string")), "answer": F.concat(F.lit("City"), one("c", 0, 999).cast("string"))})

    def by(lang: str, i: int, *args: str) -> Column:
        out = F.lit(None).cast("string")
        for name, patterns in LANGUAGES.items():
            out = F.when(F.col(lang) == name, F.format_string(patterns[i], *args)).otherwise(out)
        return out

    return base.select("task_no", "ask_lang", "tell_lang", by("ask_lang", 0, "a").alias("prompt"), by("tell_lang", 1, "a", "b").alias("first"), by("tell_lang", 2, "b", "answer").alias("second"), "answer")

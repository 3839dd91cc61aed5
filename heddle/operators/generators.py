"""Synthetic task families from numbered rows and hash draws: a row depends on its number and the seed alone.

Every family is a pair of expressions over a row's draws: the prompt, and the answer computed from the same draws. The
draws stay in `spec`, so that an answer can be recomputed by a verifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Draw = Callable[[str, int, int], Column]


def draw(seed: int) -> Draw:
    """An integer of [low, high] for each row and name: 48 bits of SHA-256 of seed, name and number, joined by bars."""

    def one(name: str, low: int, high: int) -> Column:
        bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("task_no").cast("string")), 256), 1, 12), 16, 10).cast("long")
        return bits % (high - low + 1) + low

    return one


def numbered(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """(task_no): n rows, or those of a table that has such a column."""
    return n.select(F.col("task_no").cast("long").alias("task_no")) if isinstance(n, DataFrame) else spark.range(n).withColumnRenamed("id", "task_no")


def _fmt(pattern: str, *names: str) -> Callable[[dict], Column]:
    return lambda s: F.format_string(pattern, *(s[n] for n in names))


# name: (draws, prompt, answer)
FAMILIES: dict[str, tuple[dict[str, tuple[int, int]], Callable, Callable]] = {
    "order_total": ({"a": (2, 40), "b": (3, 60), "c": (1, 20)}, _fmt("%d boxes at %d each and a fee of %d: what is the total?", "a", "b", "c"), lambda s: s["a"] * s["b"] + s["c"]),
    "remainder": ({"a": (100, 9999), "b": (3, 97)}, _fmt("What is the remainder of %d divided by %d?", "a", "b"), lambda s: s["a"] % s["b"]),
    "clip": ({"a": (-20000, 20000)}, _fmt("Clip %d to the range from -9999 to 9999.", "a"), lambda s: F.least(F.greatest(s["a"], F.lit(-9999)), F.lit(9999))),
    "least_of_three": ({"a": (0, 999), "b": (0, 999), "c": (0, 999)}, _fmt("Which is the least of %d, %d and %d?", "a", "b", "c"), lambda s: F.least(s["a"], s["b"], s["c"])),
    "middle_of_three": ({"a": (0, 999), "b": (0, 999), "c": (0, 999)}, _fmt("What is the median of %d, %d and %d?", "a", "b", "c"), lambda s: s["a"] + s["b"] + s["c"] - F.least(s["a"], s["b"], s["c"]) - F.greatest(s["a"], s["b"], s["c"])),
    "bit_xor": ({"a": (1, 1023), "b": (1, 1023)}, _fmt("What is %d xor %d?", "a", "b"), lambda s: s["a"].bitwiseXOR(s["b"])),
    "minutes": ({"a": (0, 1439), "b": (1, 600)}, _fmt("It is minute %d of the day. Which minute is it %d minutes later?", "a", "b"), lambda s: (s["a"] + s["b"]) % 1440),
    "seats": ({"a": (5, 500), "b": (2, 50)}, _fmt("How many tables of %2$d seats do %1$d guests need?", "a", "b"), lambda s: F.ceil(s["a"] / s["b"])),
    "growth": ({"a": (100, 5000), "b": (1, 4)}, _fmt("%d grows by a tenth each year, rounded down each time. What is it after %d years?", "a", "b"), lambda s: F.aggregate(F.sequence(F.lit(1).cast("long"), s["b"]), s["a"], lambda acc, _: F.floor(acc * 11 / 10))),
    "count_multiples": ({"a": (20, 2000), "b": (2, 19)}, _fmt("How many multiples of %2$d are there from 1 to %1$d?", "a", "b"), lambda s: F.floor(s["a"] / s["b"])),
    "linear_equation": ({"a": (2, 19), "x": (-30, 30), "b": (-40, 40)}, lambda s: F.format_string("Solve %d*x + %d = %d for x.", s["a"], s["b"], s["a"] * s["x"] + s["b"]), lambda s: s["x"]),
    "difference_of_squares": ({"a": (2, 60), "b": (1, 59)}, _fmt("Compute %d^2 - %d^2.", "a", "b"), lambda s: (s["a"] - s["b"]) * (s["a"] + s["b"])),
    "derivative_at": ({"a": (-9, 9), "b": (-9, 9), "x": (-5, 5)}, _fmt("What is the derivative of %d*x^2 + %d*x at x = %d?", "a", "b", "x"), lambda s: 2 * s["a"] * s["x"] + s["b"]),
    "system_sum": ({"x": (-20, 20), "y": (-20, 20)}, lambda s: F.format_string("x + y = %d and x - y = %d. What is x?", s["x"] + s["y"], s["x"] - s["y"]), lambda s: s["x"]),
    "polynomial_value": ({"a": (-5, 5), "b": (-5, 5), "c": (-5, 5), "x": (-6, 6)}, _fmt("Evaluate %d*x^3 + %d*x + %d at x = %d.", "a", "b", "c", "x"), lambda s: s["a"] * s["x"] * s["x"] * s["x"] + s["b"] * s["x"] + s["c"]),
    "arithmetic_series": ({"a": (-10, 10), "b": (1, 9), "n": (3, 40)}, _fmt("Sum the first %3$d terms of the series that starts at %1$d and rises by %2$d.", "a", "b", "n"), lambda s: s["n"] * (2 * s["a"] + (s["n"] - 1) * s["b"]) / 2),
}


def generate(spark: SparkSession, n: int | DataFrame, seed: int = 0, families: list[str] | None = None) -> DataFrame:
    """(task_id, task_no, family, prompt, answer, spec): n tasks, or one for each row of a table with `task_no`; the families in turn."""
    names = families or list(FAMILIES)
    one = draw(seed)
    base = numbered(spark, n).withColumn("family", F.element_at(F.array(*map(F.lit, names)), (F.col("task_no") % len(names) + 1).cast("int")))
    prompt, answer, spec = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("map<string,bigint>")
    for name in names:
        ranges, ask, solve = FAMILIES[name]
        s = {k: one(f"{name}.{k}", low, high) for k, (low, high) in ranges.items()}
        mine = F.col("family") == name
        prompt = F.when(mine, ask(s)).otherwise(prompt)
        answer = F.when(mine, solve(s).cast("long")).otherwise(answer)
        spec = F.when(mine, F.create_map(*(x for k, v in s.items() for x in (F.lit(k), v)))).otherwise(spec)
    out = base.withColumns({"prompt": prompt, "answer": answer, "spec": spec})
    return out.select(F.format_string(f"gen-{seed}-%08d", "task_no").alias("task_id"), "task_no", "family", "prompt", "answer", "spec")


def verify(tasks: DataFrame) -> DataFrame:
    """Rows whose answer isn't what their spec gives."""
    right = F.lit(None).cast("long")
    for name, (ranges, _, solve) in FAMILIES.items():
        s = {k: F.try_element_at("spec", F.lit(k)) for k in ranges}
        right = F.when(F.col("family") == name, solve(s).cast("long")).otherwise(right)
    return tasks.withColumn("right", right).filter(~F.col("answer").eqNullSafe(F.col("right")))

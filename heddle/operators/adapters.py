"""Row adapters of public datasets: each maps a source's columns to (prompt, reference_answer) and rejects rows that lack one.

An adapter is a function of a DataFrame; rows it can't use come out with `valid` false, are counted and dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions.answers import last_boxed


def gsm8k(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": F.col("question"), "reference_answer": F.trim(F.element_at(F.split("answer", "####"), -1))})


def math(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": F.col("problem"), "reference_answer": last_boxed("solution")})


def mmlu(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": T.choice_prompt("question", "choices"), "reference_answer": F.try_element_at("choices", (F.col("answer") + 1).cast("int"))})


def arc(df: DataFrame) -> DataFrame:
    at = F.array_position("choices.label", F.col("answerKey")).cast("int")
    return df.withColumns({"prompt": T.choice_prompt("question", "choices.text"), "reference_answer": F.when(at > 0, F.try_element_at("choices.text", at))})


def mbpp(df: DataFrame) -> DataFrame:
    prompt = F.concat_ws("\n", "text", F.array_join("test_list", "\n"))
    return df.withColumns({"prompt": prompt, "reference_answer": F.col("code")})


def hotpot(df: DataFrame) -> DataFrame:
    equal = F.size("context.title") == F.size("context.sentences")
    docs = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    return df.withColumns({"prompt": F.col("question"), "reference_answer": F.when(equal, F.col("answer")), "documents": docs})


def two_wiki(df: DataFrame) -> DataFrame:
    """Context is JSON text: [[title, [sentences]], ...]; bad JSON rejects the row."""
    parsed = F.from_json("context", "array<array<string>>", {"mode": "PERMISSIVE"})
    return df.withColumns({"prompt": F.col("question"), "reference_answer": F.when(F.try_parse_json("context").isNotNull(), F.col("answer")), "documents": parsed})


def musique(df: DataFrame) -> DataFrame:
    support = F.filter("paragraphs", lambda p: p["is_supporting"])
    titles = F.array_distinct(F.transform(support, lambda p: p["title"]))
    return df.withColumns({"prompt": F.col("question"), "reference_answer": F.when(F.col("answerable") & (F.size(titles) >= 2), F.col("answer")), "titles": titles})


def nq_open(df: DataFrame) -> DataFrame:
    names = F.array_distinct(F.filter("answer", lambda a: F.trim(a) != ""))
    return df.withColumns({"prompt": F.col("question"), "reference_answer": F.try_element_at(names, F.lit(1)), "aliases": names})


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"gsm8k": gsm8k, "hendrycks_math": math, "mmlu": mmlu, "arc": arc, "mbpp": mbpp, "hotpotqa": hotpot, "2wikimultihopqa": two_wiki, "musique": musique, "nq_open": nq_open}


def adapt(df: DataFrame, kind: str) -> DataFrame:
    """The adapter's columns and `valid`."""
    out = ADAPTERS[kind](df)
    full = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return out.withColumn("valid", full("prompt") & full("reference_answer"))


def oasst_ok(labels: str = "labels", rank: str = "rank") -> Column:
    """Quality rules of message labels: absent labels take defaults, a rank that isn't zero (or is NaN) fails."""
    m = F.map_from_arrays(f"{labels}.name", f"{labels}.value")
    at = lambda k, default: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(default))
    low = [at(k, 0.0) <= 0.25 for k in ("fails_task", "pii", "not_appropriate")]
    return F.coalesce((at("quality", 1.0) >= 0.65) & (at("helpfulness", 1.0) >= 0.5) & low[0] & low[1] & low[2] & (at("toxicity", 0.0) <= 0.75), F.lit(True)) & F.coalesce((F.col(rank) == 0) & ~F.isnan(rank), F.lit(False))

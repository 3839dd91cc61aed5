"""Operator 11, importance resampling towards a target distribution, in Spark's own functions only.

Features are runs of consecutive words, hashed to a fixed number of buckets. The gain of a bucket says how much more
often the target has it than the corpus; the mean gain of a document's features is its weight, and a draw by weight plus
Gumbel noise (from a hash of the id, so that a run can be repeated) is a sample without replacement.

1. The feature arrays of both tables are exploded and counted by bucket, in tasks first: `buckets` rows leave each task.
2. The gain table has one row a bucket, whatever the input, and is broadcast.
3. A second scan explodes again, joins the gains and sums by row. A row's features are summed in the task that reads it,
   so one row a document is shuffled, and a document may have any length.
4. Scores are sorted by ranges; a row's rank is its place in its range plus the rows of the ranges before.

Defined cases: null and empty texts have no features, weight 0 and no place among the drawn; a null doc_id draws the noise
of the empty id and sorts before all others; rows that repeat an id are rows of their own, equal ones in any order; an
empty target or empty documents leave gains of 0 counts, no error; extra columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import materialize, read_table
from heddle.operators.ranking import place_in_order

BUCKETS = 10_000
SEED = "2024"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words of a text, with an empty string before or after them where the text begins or ends between words."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def _lowered(feature: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` has a fast path, but it may be taken only where all characters are ASCII."""
    return F.when(F.octet_length(feature) == F.char_length(feature), F.lower(feature)).otherwise(F.translate(feature, ascii_uppercase, ascii_lowercase))


def _runs(words: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) >= size, F.transform(places, lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def exploded(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """rows without `text`, a row for each feature: its `bucket`, null for a row that stands for no feature; and `n_words` if runs are longer than a word."""
    keep = [c for c in rows.columns if c != "text"]
    if longest == 1:
        features = _words(F.col("text"))
    else:
        rows = rows.select(*keep, F.filter(_words(F.col("text")), lambda w: w != "").alias("_words"))
        features = F.concat(F.array(F.lit("")), F.col("_words"), *(_runs(F.col("_words"), n) for n in range(2, longest + 1)))
        keep.append(F.size("_words").alias("n_words"))
    found = rows.select(*keep, F.explode(features).alias("_feature"))
    return found.withColumn("bucket", F.when(F.col("_feature") != "", F.crc32(_lowered(F.col("_feature")).cast("binary")) % buckets)).drop("_feature")


def bucket_counts(docs: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """(bucket, `name`) for the buckets that a feature of docs falls in: `buckets` rows at most."""
    return exploded(docs.select("text"), longest, buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 * ln of the target's share over the corpus's), counts one higher."""
    own, aim = (bucket_counts(t, longest, buckets, n) for t, n in ((docs, "s"), (target, "t")))
    counts = materialize(docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(aim, "bucket", "left").na.fill(0), "gains")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    s, t = F.col("s").cast("double") + 1.0, F.col("t").cast("double") + 1.0
    ratio = (t * float(total["s"] + buckets)) / (s * float(total["t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def importance(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row of docs."""
    gains = F.broadcast(gain_table(docs, target, longest, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())
    found = exploded(rows, longest, buckets).join(gains, "bucket", "left")
    words = F.count("bucket") if longest == 1 else F.max("n_words").cast("long")
    summed = found.groupBy("_row", "doc_id").agg(words.alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_gain"))
    weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (_gain - pmod(_gain, n_features)) div n_features END")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    return summed.withColumn("weight", weight).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the rows with `least_words` words or more, the `percent` with the highest scores are ranked from 1."""
    scored = importance(docs, target, longest, buckets, seed).withColumn("_able", F.col("n_words") >= least_words).drop("n_words")
    placed = place_in_order(scored, [-F.col("score"), "doc_id", "n_features"], ["_able"], "_at", "_all")
    drawn = F.col("_able") & (F.col("_at") < F.floor(percent * F.col("_all") / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_at") + 1).cast("long").alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

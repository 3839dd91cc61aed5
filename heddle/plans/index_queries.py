"""Queries over indexes, walks and closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import index, references
from heddle.plans.registry import query
from heddle.sources.shared import materialize, read_table


@query(
    "js4_nested_references",
    r"""SELECT conv_id, path, target FROM (SELECT conv_id, 'files[' || turn || '].path' path, 'data/' || role || '/' || turn || '.json' target FROM conversations WHERE turn % 2 = 0
 UNION ALL SELECT conv_id, repeat('next.', (conv_id % 5)::INT + 1) || 'parts[' || turn || '][1].manifest', 'manifests/' || conv_id || '-' || turn FROM conversations
 UNION ALL SELECT DISTINCT conv_id, 'path', 'metadata/' || conv_id FROM conversations) ORDER BY ALL""",
)
def js4(spark, d):
    """Nested documents built from conversations, of one to five objects within one another, with fields and targets that are no references."""
    c = read_table(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    path = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data/"), "role", F.lit("/"), turn, F.lit(".json"))).otherwise(F.concat(F.lit("elsewhere/"), turn))
    part = F.array(F.lit(None).cast("struct<manifest:string,note:string>"), F.struct(F.concat(F.lit("manifests/"), F.col("conv_id").cast("string"), F.lit("-"), turn).alias("manifest"), F.lit("data/not a reference").alias("note")))
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", path.alias("path"), part.alias("part")))).alias("t"))
    files = F.transform("t", lambda x: F.struct(x["path"].alias("path"), F.col("conv_id").alias("id")))
    inner = F.to_json(F.struct(F.transform("t", lambda x: x["part"]).alias("parts")), {"ignoreNullFields": "false"})
    nested = inner
    for depth in range(1, 6):
        nested = F.when(F.col("conv_id") % 5 + 1 >= depth, F.concat(F.lit('{"next":'), nested, F.lit("}"))).otherwise(nested)
    whole = F.concat(F.lit('{"path":"metadata/'), F.col("conv_id").cast("string"), F.lit('","files":'), F.to_json(files), F.lit(","), F.substring(nested, 2, 1 << 30))
    return references.references(by.select("conv_id", whole.alias("json")), "conv_id", "json")


_NEAREST = """SELECT vec_id, arg_max(c, (s, -c)) "match", round(max(s), 9) similarity FROM (SELECT q.vec_id, c.vec_id c, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) s FROM embeddings q JOIN embeddings c ON {on} q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0) GROUP BY 1"""


def _indexed(spark, d, group=None):
    e = materialize(read_table(spark, d, "embeddings"), "vectors")
    centroids = index.fit(e, "vec_id", "embedding")
    return index.build(e, "vec_id", "embedding", centroids, group), centroids


@query("j22_indexed_nearest", _NEAREST.format(on=""))
def nearest(spark, d):
    """The nearest of all rows, found exactly through the index, for the ids that 100 divides."""
    built, centroids = _indexed(spark, d)
    found = index.search(built, built.filter("_key % 100 = 0"), centroids, exact=True)
    return found.select(F.col("key").alias("vec_id"), "match", F.round("similarity", 9).alias("similarity"))


@query("j22_indexed_in_group", _NEAREST.format(on="q.label = c.label AND"))
def nearest_in_label(spark, d):
    """The same within the query's label."""
    built, centroids = _indexed(spark, d, "label")
    found = index.search(built, built.filter("_key % 100 = 0"), centroids, exact=True, probes=4)
    return found.select(F.col("key").alias("vec_id"), "match", F.round("similarity", 9).alias("similarity"))


@query("j22_index_recall", "SELECT count(*) indexed, count(*) FILTER (vec_id % 100 = 0) queries, true enough FROM embeddings")
def recall(spark, d):
    """Rows in the index, queries, and whether the probed search, tuned on a sample, finds nine tenths of the true ten nearest."""
    built, centroids = _indexed(spark, d)
    asked = built.filter("_key % 100 = 0")
    near = index.search(built, asked, centroids, k=10, probes=index.tune(built, centroids)).select("key", "match")
    true = index.search(built, asked, centroids, k=10, exact=True).select("key", "match")
    both = near.join(true, ["key", "match"]).agg(F.count("*").alias("hits")).join(true.agg(F.count("*").alias("all")))
    counts = built.agg(F.count("*").alias("indexed"), F.count(F.when(F.col("_key") % 100 == 0, 1)).alias("queries"))
    return counts.join(both).select("indexed", "queries", (F.col("hits") >= 0.9 * F.col("all")).alias("enough"))

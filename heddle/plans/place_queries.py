"""Queries over names from lists and what texts say of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import evidence, places
from heddle.operators import gazetteer
from heddle.plans.registry import query
from heddle.sources.shared import materialize, read_table

_PHRASES = r"list_filter(regexp_split_to_array(text, '[^\w]+'), lambda x: x <> '')"


def _entries(spark, d):
    """Names to look for: the first one, two or three plain words of each benchmark text."""
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+"), F.lit(0))
    return read_table(spark, d, "benchmark").select(F.array_join(F.slice(words, 1, (F.length("text") % 3 + 1).cast("int")), " ").alias("entry")).filter("entry <> ''")


_HITS = r"""WITH e AS (SELECT min(entry) entry, lower(entry) low FROM (SELECT array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1 : length(text) % 3 + 1], ' ') entry FROM benchmark) WHERE entry <> '' GROUP BY 2),
 t AS (SELECT doc_id, regexp_extract_all(text, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+') t FROM documents),
 x AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) i FROM t),
 g AS (SELECT doc_id, i, n, lower(t[i] || CASE WHEN n > 1 THEN ' ' || t[i + 2] ELSE '' END || CASE WHEN n > 2 THEN ' ' || t[i + 4] ELSE '' END) low FROM x, range(1, 4) r(n)
  WHERE regexp_matches(t[i], '^[\pL\pN\pM_]') AND i + 2 * n - 2 <= len(t) AND (n < 2 OR regexp_matches(t[i + 1], '^\s+$')) AND (n < 3 OR regexp_matches(t[i + 3], '^\s+$')))
 SELECT entry, count(*) hits, count(DISTINCT doc_id) docs FROM g JOIN e USING (low) GROUP BY 1"""


@query("str28_gazetteer_hits", _HITS)
def gazetteer_hits(spark, d):
    """All hits of the list in all documents, by a trie of words."""
    found = gazetteer.hits(read_table(spark, d, "documents"), "doc_id", "text", _entries(spark, d), "entry", overlapping=True)
    return found.groupBy("entry").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("str28_gazetteer_join", _HITS)
def gazetteer_join(spark, d):
    """The same where the list is too long to broadcast: by a join on phrases."""
    found = gazetteer.hits(read_table(spark, d, "documents"), "doc_id", "text", _entries(spark, d), "entry", overlapping=True, limit=0)
    return found.groupBy("entry").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


_NAMES = [c for c in places.COUNTRIES if " " not in c][:25]
_LISTED = "['" + "', '".join(_NAMES) + "']"


def _spread(rows):
    """rows dealt over the cluster: rules read them for long, while a table of few bytes is a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def _country(key):
    """A country's name for each nation's key."""
    return F.element_at(F.array(*map(F.lit, _NAMES)), (key % 25 + 1).cast("int"))


@query(
    "str28_country_of_text",
    f"""SELECT c_custkey, [a, 'United States', b, a][1 + c_custkey % 4] country, [NULL, NULL, b, a][1 + c_custkey % 4] origin FROM (SELECT c_custkey, {_LISTED}[1 + c_nationkey] a, {_LISTED}[1 + (c_nationkey + 1) % 25] b FROM customer)""",
)
def country_of_text(spark, d):
    """Texts that name two countries: in a line, by a state, in the second line, as an origin."""
    rows = read_table(spark, d, "customer").withColumns({"a": _country(F.col("c_nationkey")), "b": _country(F.col("c_nationkey") + 1)})
    form = lambda s, *c: F.format_string(s, *(F.col(x) for x in c))
    text = (
        F.when(F.col("c_custkey") % 4 == 0, form("%s worked in %s\nand later, it is said, in %s.", "c_name", "a", "b")).when(F.col("c_custkey") % 4 == 1, form("%s lived in New York and in %s.", "c_name", "a"))
        .when(F.col("c_custkey") % 4 == 2, form("No names here.\n  %s comes from %s,  where %s is well known", "c_name", "b", "a")).otherwise(form("%s was born in %s.", "c_name", "a"))
    )
    found = _spread(rows.select("c_custkey", text.alias("text")))
    return found.select("c_custkey", places.country("text").alias("country"), places.origin_country("text").alias("origin"))


@query(
    "str28_nationality_of_text",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'German' WHEN 1 THEN 'Canadian-American' WHEN 2 THEN NULL WHEN 3 THEN 'Dutch' WHEN 4 THEN 'Irish' ELSE NULL END nationality, CASE WHEN c_custkey % 6 = 5 THEN 'Norway' END filmed FROM customer""",
)
def nationality_of_text(spark, d):
    """Subjects, hyphens, ancestors, works, and two nationalities that could be anybody's, around every customer's name."""
    forms = [
        "%s was a renowned German painter of French ancestry.", "%s is a Canadian-American singer in the Mexican film industry.", "%s met a Spanish poet and a Greek one.", "The English title (a translation) is lost.\n%s, the daughter of a Polish general, was a Dutch spy.",
        "%s is an Irish band consisting of Swedish and Danish players.", "%s, a film, was shot in the north of Norway.",
    ]
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = F.when(F.col("c_custkey") % 6 == i, F.format_string(f, F.col("c_name"))).otherwise(text)
    rows = materialize(_spread(read_table(spark, d, "customer").select("c_custkey", text.alias("text"))), "told")
    return rows.select("c_custkey", places.nationality("text").alias("nationality"), places.media_country("text").alias("filmed"))


@query(
    "str27_facts_of_texts",
    f"""SELECT c_custkey, CASE WHEN k IN (0, 3) THEN d END born, CASE k WHEN 0 THEN n_name WHEN 3 THEN 'Upper ' || n_name END birth_place, CASE WHEN k = 1 THEN d WHEN k = 3 THEN '7 June 1990' END died, CASE k WHEN 1 THEN 'Old ' || n_name END death_place, CASE WHEN k = 1 THEN 'river fever' END death_cause,
 CASE k WHEN 0 THEN 'Nils Moe' WHEN 2 THEN 'Rolf Lind' END father, CASE k WHEN 0 THEN 'Kari Moe' WHEN 2 THEN 'Eva Lind' END mother, CASE WHEN k = 4 THEN 'Ada Moe' END spouse, CASE WHEN k = 4 THEN 'Golden Loom' END award, CASE WHEN k = 2 THEN 'Lund University' END education
 FROM (SELECT c_custkey, c_custkey % 5 k, (1 + c_custkey % 28) || ' May ' || (1900 + c_custkey % 90) d, {_LISTED}[1 + c_nationkey] n_name FROM customer)""",
)
def facts_of_texts(spark, d):
    """What five kinds of texts state of every customer: dates, places, causes, parents in either order, spouses, prizes, schools, and what they don't."""
    rows = read_table(spark, d, "customer").withColumn("n_name", _country(F.col("c_nationkey")))
    day = F.concat((F.col("c_custkey") % 28 + 1).cast("string"), F.lit(" May "), (F.col("c_custkey") % 90 + 1900).cast("string"))
    where = F.col("n_name")
    forms = [
        F.concat(F.lit("The weaver was born on "), day, F.lit(" in "), where, F.lit(" to Nils Moe and Kari Moe.")), F.concat(F.lit("His wife died of grief.\nHe died on "), day, F.lit(" of river fever in Old "), where, F.lit(" while the town slept.")),
        F.lit("The daughter of Swedish actress Eva Lind and director Rolf Lind, she graduated from Lund University in 1920."), F.concat(F.lit("A weaver (Upper "), where, F.lit(", "), day, F.lit(" – 7 June 1990) of rugs.")), F.lit("She was awarded the Golden Loom in 1950.\nHis wife was the singer Ada Moe, a star."),
    ]
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = F.when(F.col("c_custkey") % 5 == i, f).otherwise(text)
    told = materialize(_spread(rows.select("c_custkey", text.alias("text"))), "told")
    kinds = {"born": "birth_date", "birth_place": "birth_place", "died": "death_date", "death_place": "death_place", "death_cause": "death_cause", "father": "father", "mother": "mother", "spouse": "spouse", "award": "award", "education": "education"}
    return told.select("c_custkey", evidence.facts(kinds, "text").alias("f")).select("c_custkey", "f.*")

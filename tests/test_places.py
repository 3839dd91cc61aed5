"""Names from lists and what texts say of places, on own literals and against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from heddle.functions import places
from heddle.operators import gazetteer


def brute_hits(text, entries, overlapping):
    """Every run of whole words that spells an entry; then the leftmost and longest, one after the other."""
    first = {}
    for e in sorted(entries):
        if words := re.findall(r"\w+", e.casefold()):
            first.setdefault(" ".join(words), e)
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    found = []
    for i in range(len(words)):
        for j in range(i, min(i + 4, len(words))):
            if all(text[words[k][1] : words[k + 1][0]].isspace() for k in range(i, j)):
                spelled = " ".join(text[s:e].casefold() for s, e in words[i : j + 1])
                if spelled in first:
                    found.append((words[i][0], words[j][1], first[spelled]))
    if overlapping:
        return found
    kept, at = [], -1
    for s, e, name in sorted(found, key=lambda h: (h[0], -h[1])):
        if s >= at:
            kept.append((s, e, name))
            at = e
    return kept


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("limit", [gazetteer.LIMIT, 0])
def test_hits(spark, overlapping, limit):
    rng = random.Random(2)
    names = ["New York", "York", "new york city", "Élan vital", "x", "X", "a-b", "", None, "of the", "the of the", "Straße"]
    word = lambda: rng.choice(["new", "New", "york", "YORK", "city", "élan", "ÉLAN", "vital", "x", "a", "b", "of", "the", "straße", "_y"])
    texts = ["".join(word() + rng.choice([" ", " ", "  ", "-", ", ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["", None, "x" * 100_000, "new york " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "York")], "id long, text string")
    entries = spark.createDataFrame([(n,) for n in names], "name string")
    got = gazetteer.hits(df, "id", "text", entries, "name", overlapping, limit)
    assert got.columns == ["id", "start", "end", "entry"]
    known = [n for n in names if n]
    want = [(i, *h) for i, t in [*enumerate(texts), (0, texts[0]), (None, "York")] if t is not None for h in brute_hits(t, known, overlapping)]
    order = lambda r: (r[0] is None, *(x or 0 for x in r[:3]), r[3])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert gazetteer.hits(df.limit(0), "id", "text", entries, "name", overlapping, limit).count() == 0
    assert gazetteer.hits(df, "id", "text", entries.limit(0), "name", overlapping, limit).count() == 0


def test_only_phrases_that_may_be_entries_reach_the_join(spark):
    text = "one two three new york city four five york new " * 2_000
    rows = spark.createDataFrame([(1, text, 0), (2, "Of none", 1), (3, "", 2)], "_key int, _text string, _row long")
    listed = spark.createDataFrame([("new york city",), ("york",), ("the",)], "phrase string")
    got = gazetteer._phrases(rows, listed).groupBy("phrase").count().collect()
    assert {r["phrase"]: r["count"] for r in got} == {"new": 4_000, "new york": 2_000, "new york city": 2_000, "york": 4_000}  # of some 60,000


def test_walks_and_hits_hold_little():
    text = "x y " * 200_000
    trie = gazetteer.Trie(["x", "y x z"])
    tracemalloc.start()
    assert sum(1 for _ in trie.find(text)) == 200_000 and tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    batch = pa.RecordBatch.from_pydict({"_key": [7, 8], "_text": [text, "x"]})
    sizes = [(b.num_rows, set(b.column("_key").to_pylist())) for b in gazetteer._cut(((b, i, *h) for b, i, t in gazetteer._texts([batch]) for h in trie.find(t)), ["_key"])]
    assert sum(n for n, _ in sizes) == 200_001 and max(n for n, _ in sizes) == gazetteer.HITS and sizes[-1][1] == {7, 8}


COUNTRY = [
    ("He moved from Spain to Italy.", "Spain"), ("Work in South Korea and Korea", "South Korea"), ("Nothing here.\nIt was made in bosnia and herzegovina.", "Bosnia and Herzegovina"), ("Born in West Virginia, raised in France.", "United States"), ("Paid in US$ in Chile", "Chile"), ("A U.S. senator", "United States"),
    ("Indianapolis is no India", "India"), ("Guineas and Chad", None), ("one\ntwo\nthree\nfour\nin Japan", None), ("", None), (None, None),
]
ORIGIN = [("She is a Norway native of Oslo", "Norway"), ("He worked in Brazil.", None), ("Ann (born 1950 in Lyon, France) worked in Brazil.", "France"), ("A singer from Ghana who plays in Peru", "Ghana"), ("He was in Egypt.\nA native of Kenya", "Kenya")]
NATIONALITY = [
    ("Ann is a Danish chemist.", "Danish"), ("Bo was a former Swiss rower of Thai descent.", "Swiss"), ("Cy is a Canadian-American actor.", "Canadian-American"), ("Di worked in the Indian film industry.", None), ("Ed was an Indian film director.", "Indian"), ("His father was, as said, an Italian baker.", None),
    ("The son of a Greek sailor, he sang.", None), ("French troops took the town.", None), ("A Polish and a Czech writer met.", None), ("A Polish-Czech writer.", "Polish-Czech"), ("Flo, Austrian-born German poet", None), ("Flo is an Austrian-born German poet", "Austrian-German"), ("British Columbia is large.\nGus is a Finnish skier.", "Finnish"),
    ("A group consisting of Irish players", None), ("The professional English theatre", None), (None, None),
]


@pytest.mark.parametrize(("rule", "cases"), [(places.country, COUNTRY), (places.origin_country, ORIGIN), (places.nationality, NATIONALITY), (places.media_country, [("It was filmed in rural Spain and in France.", "Spain"), ("Takes place in\nSpain", None), ("Made in Spain", None), ("Set in Austin, Texas", "United States")])])
def test_places(spark, rule, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r["got"] for r in df.select("i", rule("t").alias("got")).orderBy("i").collect()]
    assert [(c, g) for c, g in zip(cases, got, strict=True) if c[1] != g] == []

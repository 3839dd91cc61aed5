"""References in nested JSON, the vector index, markers in texts: against brute force."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import index, references, review


def walk(value, path=""):
    """Every reference of a document, by recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if k in references.REFERENCE_KEYS and isinstance(v, str) and v.startswith(references.PREFIXES):
                yield at, v
            yield from walk(v, at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def nested(rng, depth):
    kind = rng.randrange(4) if depth else 3
    if kind == 0:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind < 3:
        return {rng.choice(["path", "manifest", "a", "é x", "input_pool", "paths"]): nested(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice(["data/x.json", "manifests/y", "metadata/", "Data/x", "elsewhere", "{data/", "", 3, None, True, 1.5])


def test_references_at_any_depth(spark):
    rng = random.Random(2)
    docs = [nested(rng, rng.randint(0, 7)) for _ in range(120)] + [{"a": {"b": [{"path": "data/deep"}]}}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(900, None), (901, "not json"), (902, ""), (0, json.dumps(docs[-1]))]
    df = spark.createDataFrame(rows, "id long, body string")
    want = sorted((i, p, t) for i, x in [*enumerate(docs), (0, docs[-1])] for p, t in walk(x))
    assert sorted(map(tuple, references.references(df, "id", "body").collect())) == want and any(p.count(".") > 2 for _, p, _ in want)
    there = spark.createDataFrame([("data/x.json",), ("data/deep",)], "path string")
    missing = references.missing_references(df, "id", "body", there).collect()
    assert sorted(map(tuple, missing)) == [w for w in want if w[2] not in ("data/x.json", "data/deep")]
    assert references.references(df.limit(0), "id", "body").count() == 0


def brute_nearest(rows, queries, k, threshold):
    out = []
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, _, v in rows if v is not None and np.linalg.norm(v) > 0}
    for q, g, _ in queries:
        if q in unit:
            near = sorted(((-round(float(unit[q] @ unit[i]), 9), i) for i, h, _ in rows if i in unit and i != q and (g or "") == (h or "")))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near) if -s >= threshold - 1e-9]
    return sorted(out)


@pytest.mark.parametrize(("k", "probes", "block", "threshold", "lists"), [(1, 1, 4, -1.0, 12), (3, 2, 7, 0.3, 12), (5, 8, 10_000, -1.0, 3), (2, 1, 3, -1.0, 1)])
def test_exact_search(spark, k, probes, block, threshold, lists):
    rng = random.Random(k)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, "a", [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(300, "a", None), (301, "a", [0.0] * 4), (302, "alone", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, g string, v array<float>")
    centroids = index.fit(df, "id", "v", lists)
    built = index.build(df, "id", "v", centroids, "g")
    assert built.count() == sum(v is not None and any(v) for _, _, v in rows)
    found = index.search(built, built.filter("_key % 4 = 0"), centroids, k, probes, True, threshold, block).collect()
    got = sorted((r["key"], r["rank"], r["match"], round(r["similarity"], 9)) for r in found)
    want = brute_nearest(rows, [r for r in rows if r[0] % 4 == 0], k, threshold)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], pytest.approx(w[3], abs=1e-8)) for w in want]
    alike = {(w[0], w[3]) for w in want}
    assert all((g[0], g[2]) in {(w[0], w[2]) for w in want} or any(abs(g[3] - s) < 1e-8 for q, s in alike if q == g[0]) for g in got)


def test_empty_index(spark):
    df = spark.createDataFrame([], "id long, v array<float>")
    centroids = index.fit(df, "id", "v")
    built = index.build(df, "id", "v", centroids)
    assert index.search(built, built, centroids, exact=True).count() == 0


def test_markers(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "12", "1,200", "x-y", "été", "(a)", "3.5", "+7"])
    texts = [(rng.randint(0, 3), " ".join(word() for _ in range(rng.randint(0, 12)))) for _ in range(60)] + [(0, None), (0, "alphabeta"), (1, "_alpha")]
    markers = [(rng.randint(0, 3), rng.choice(["alpha", "alpha beta", "12", "1200", "x-y", "été", "7", "3.5", "y", "(a)", "(", "", "gamma"])) for _ in range(60)] + [(0, None)]
    a = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(texts)], "k long, i long, t string")
    b = spark.createDataFrame([(k, j, m) for j, (k, m) in enumerate(markers)], "k long, j long, m string")

    def holds(t, m):
        if re.fullmatch(r"[-+]?\d+(\.\d+)?", m.replace(",", "")):
            return m.replace(",", "").lstrip("+") in [n.lstrip("+") for n in re.findall(r"[-+]?\d+(?:\.\d+)?", re.sub(r"(?<=\d),(?=\d)", "", t))]
        return bool(re.search(r"\w", m)) and re.search(rf"(?<!\w){re.escape(m)}(?!\w)", t) is not None

    got = sorted((r["i"], r["j"]) for r in review.marker_hits(a, b, "k", "t", "m").collect())
    assert got == sorted((i, j) for i, (k, t) in enumerate(texts) for j, (q, m) in enumerate(markers) if k == q and t and m and holds(t, m)) and len(got) > 50


def test_marker_hits_number_their_rows_once(spark):
    """Both sides are numbered and then read several times: with numbers that aren't written, other splits of a shuffle lost hits."""
    a = spark.range(600).select((F.col("id") % 60).alias("k"), F.concat(F.lit("it is value"), "id", F.lit(" here")).alias("t")).groupBy("k", "t").agg(F.count("*").alias("n"))
    b = spark.range(600).select((F.col("id") % 60).alias("k"), F.concat(F.lit("value"), "id").alias("m")).groupBy("k", "m").agg(F.count("*").alias("c"))
    hits = review.marker_hits(a, b, "k", "t", "m")
    assert "monotonically" not in hits._jdf.queryExecution().toString() and hits.count() == 600

"""Operators 11 to 13: importance resampling, min-max hashing and collocations, each against brute force on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tests.llm.helpers import documents

from heddle.llm import collocations, minmax, queries, resampling

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id here, no id here"), (None, None), (4, "x"), (4, "x"), (4, "another text of four words here", None), (5, "Another text of four words here"),
    (None, "another text of four words here"), (6, "été ÉTÉ Ñandú 日本 🙂 \x00nul " * 30, "bb"), (7, "a" * 300_000, "bb"), (8, "to be or not to be " * 20_000, "bb"), (9, "x x x x x x"), (10, "x x"),
]


@pytest.mark.parametrize("name", ["op11_resampling", "op12_minhash", "op13_collocations"])
def test_query_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"set max_temp_directory_size = '1GB'; set temp_directory = '{tmp_path}'")
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    got = df.select(*names).collect()
    assert got and sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)


# --- importance resampling -------------------------------------------------------------------------------------------


def brute_draw(rows, target, percent, least_words, longest, buckets, seed):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    cell = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(cell(x) for text in texts for x in features(text)[1]) for texts in ([r[1] for r in rows], target))
    gain = lambda k: math.floor(1000 * math.log(((t[k] + 1.0) * (s.total() + buckets)) / ((s[k] + 1.0) * (t.total() + buckets))))
    out = []
    for i, text, *_ in rows:
        n, found = features(text)
        weight = sum(gain(cell(x)) for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 50, 60, 2)])
def test_resampling(spark, longest, buckets, percent, least):
    rng = random.Random(longest)
    rows = [*ODD, *((100 + i, " ".join(rng.choice(["Alpha", "beta", "gamma2", "dé"]) + rng.choice(" -,.\n") for _ in range(rng.randint(0, 60)))) for i in range(150))]
    target = ["beta beta gamma2", None, "", "Dé dé x"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(documents(spark, rows), aim, percent, least, longest, buckets, "7")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == brute_draw(rows, target, percent, least, longest, buckets, "7")
    none = documents(spark, rows).limit(0)
    assert resampling.resample(none, aim).count() == 0
    assert resampling.resample(documents(spark, rows), aim.limit(0)).filter("rank is not null").count() == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")) >= 20 for r in rows) // 10


# --- min-max hashing -------------------------------------------------------------------------------------------------


def brute_components(rows, size=2, percent=80):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()

    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, x) for d, x in sets if x and d is not None]
    for i, (d, x) in enumerate(known):
        for e, y in known[:i]:
            if 100 * len(x & y) >= percent * len(x | y) and find(d) != find(e):
                parent[max(find(d), find(e))] = min(find(d), find(e))
    out = []
    for d, x in sets:
        c = d if not x else find(d) if d is not None else min((find(e) for e, y in known if y == x), default=None)
        out.append((d, len(x), c, d == c))
    return sorted(out, key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randint(0, 1)] = [f"v{rng.randint(0, 900)}"] * rng.randint(0 if len(words) > 2 else 1, 2)
    return words


@pytest.mark.parametrize("block", [minmax.BLOCK, 3])
def test_minmax_classes(spark, block):
    rng = random.Random(block)
    rows, i = list(ODD), 100
    for n in (4, 5, 6, 9, 14, 30, 30, 80, 300):
        base = [f"w{rng.randint(0, 400)}" for _ in range(n)]
        for _ in range(14):
            rows.append((i, " ".join(edited(rng, base, rng.randint(0, max(1, n // 8))))))
            i += 1
    rows += [(i + k, rows[60][1].upper()) for k in range(20)]  # equal sets
    got = minmax.near_duplicates(documents(spark, rows), block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows)
    assert minmax.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_minmax_signature_is_unbiased_and_lossless_tests_lose_nothing():
    rng = np.random.default_rng(1)
    a, b = minmax.permutations(500)
    for n, common in ((50, 40), (300, 280), (2000, 1000)):
        x = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        s, t = np.sort(x[:n]), np.sort(x[n - common :])
        true = common / (2 * n - common)
        same = np.concatenate([p == q for p, q in zip(minmax.signature(s, a, b), minmax.signature(t, a, b), strict=True)])
        assert abs(same.mean() - true) < 4 * math.sqrt(true * (1 - true) / len(same))
        similarity = true - 1e-6
        for span in (True, False):
            assert minmax.cross_pairs(np.array([n, n]), [minmax.parity(s), minmax.parity(t)], np.array([0, 1]), similarity, span) in ([(1, 0)], [(0, 1)])
    # sets of unlike widths, in either order
    x = rng.integers(0, 2**63, 1100).astype(np.uint64)
    sets = [x[:1000], x[:1024], x[:1025], x[:1100]]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        got = minmax.cross_pairs(np.array([len(sets[k]) for k in order]), [minmax.parity(sets[k]) for k in order], np.arange(4), 0.9, False)
        assert {frozenset((order[i], order[j])) for i, j in got} == {frozenset(p) for p in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))}


def test_one_template_stays_linear(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = [(i, " ".join(base[:k] + [f"u{i}"] + base[k + 1 :])) for i in range(3000) for k in [rng.randrange(60)]]
    got = minmax.near_duplicates(documents(spark, rows)).selectExpr("max(component_id)", "min(n_shingles)").first()
    assert tuple(got) == (0, 59)


# --- collocations ----------------------------------------------------------------------------------------------------


def brute_collocations(rows, longest, least, share, top):
    counts, total = Counter(), Counter()
    for _, text, *lang in rows:
        code = lang[0] if lang and lang[0] is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        if text is not None:
            total[code] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[code] += len(words)
            counts.update((code, tuple(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    often = {k: n for k, n in counts.items() if n >= least}
    found = {}
    for (code, words), a in often.items():
        if len(words) < 2:
            continue
        cuts = [(10**6 * a * a // (counts[code, words[:k]] * counts[code, words[k:]]), k, counts[code, words[:k]], counts[code, words[k:]]) for k in range(1, len(words))]
        inside = lambda w, x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        if not any(c == code and len(x) > len(words) and 100 * n >= share * a and inside(words, x) for (c, x), n in often.items()):
            score, _, left, right = min(cuts)
            found.setdefault(code, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((code, i + 1, p.decode(), -a, left, right, total[code], -score) for code, v in found.items() for i, (score, a, p, left, right) in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (2, 2, 7), (5, 3, 50)])
def test_collocations(spark, longest, least, top):
    rng = random.Random(longest)
    word = lambda: rng.choice(["Go", "to", "the", "New", "York", "été", "a b", "日本", "x" * 50])
    rows = [r for r in ODD if r[0] != 7]
    rows += [(100 + i, "".join(word() + rng.choice([" ", " ", " ", "\t ", ", ", "\n"]) for _ in range(rng.randint(0, 40))), rng.choice(["aa", "aa", None])) for i in range(150)]
    rows += [(300, "of the new york city " * 30, "aa"), (301, "of the new york city " * 30, "aa")]
    docs = documents(spark, rows)
    want = brute_collocations(rows, longest, least, 50, top)
    got = collocations.collocations(docs, longest, least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_segments_and_a_full_sketch_change_nothing(spark):
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", "cd", "Ef", "g" * 30]) + rng.choice([" ", "  \t", "; ", "\n"]) for _ in range(4000)).encode()
    for limit in (1, 7, 64, 1000):
        parts = list(collocations.segments(text, 3, limit))
        assert b"".join(p[:n] for p, n in parts) == text
        split, whole = Counter(), Counter()
        for into, texts in ((split, parts), (whole, [(text, len(text))])):
            for t in texts:
                found = collocations.Phrases([t], [0], 3)
                for size, place, count in found.groups:
                    into.update(dict(zip(found.texts(size, place).to_pylist(), count.tolist(), strict=True)))
        assert +split == whole
    # more phrases than cells: every cell passes, the counts stay exact
    rows = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(2000)), "aa") for i in range(60)]
    few = collocations.phrase_counts(documents(spark, rows), width=256)
    key = lambda r: tuple(r)
    assert sorted(map(key, few.collect())) == sorted(map(key, collocations.phrase_counts(documents(spark, rows)).collect()))

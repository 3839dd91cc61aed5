"""Operators that compare rows: mixing, SimHash, passages, suffixes; and the pipeline. Each against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import by_id, documents

from heddle.llm import anchors, mixing, passages, pipeline_stages, simhash, suffixes, toxicity

# --- mixing ----------------------------------------------------------------------------------------------------------


def brute_schedule(blocks, weights, slots):
    """Slot by slot, with exact fractions: the released block of the earliest deadline."""
    total, taken, out = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), []
    for t in range(slots):
        ready = []
        for s, w in weights.items():
            share = Fraction(w) / total
            release, due = math.floor(taken[s] / share), math.ceil((taken[s] + 1) / share)
            if release <= t:
                ready.append((due, release, s))
        due, release, s = min(ready)
        out.append((s, taken[s], t, release, due))
        taken[s] += 1
        if taken[s] == blocks[s]:
            break
    return out


def test_every_source_stays_within_one_block_of_its_target():
    rng = random.Random(2)
    cases = [{f"s{i}": rng.random() + 0.01 for i in range(rng.randint(1, 12))} for _ in range(20)]
    cases += [{"a": 0.4004, "b": 0.3503, "c": 0.2493}, {f"s{i}": math.sqrt(n) for i, n in enumerate((70, 901, 12345, 3))}, {"big": 1.0, "small": 0.0001}]
    for weights in cases:
        blocks = dict.fromkeys(weights, 700)
        rows = [r for r in mixing.schedule(blocks, weights) if r[2] == 0]
        assert [(s, i, t, release, due) for s, i, _, t, release, due in rows] == brute_schedule(blocks, weights, 10**6)
        total, taken = sum(map(Fraction, weights.values())), Counter()
        for s, i, _, t, release, due in rows:
            assert i == taken[s] and release <= t < due
            taken[s] += 1
            if t < 3000:
                assert all(abs(taken[x] - (t + 1) * Fraction(w) / total) < 1 for x, w in weights.items())


def test_many_sources_and_many_slots_keep_the_target():
    weights = {f"s{i}": 1.0 for i in range(2000)} | {"big": 50.0}
    rows = mixing.schedule({s: 40 if s == "big" else 1 for s in weights}, weights)
    assert sorted(r[3] for r in rows) == list(range(2040))
    first = [r for r in rows if r[2] == 0]
    assert abs(sum(r[0] == "big" for r in first) - len(first) * 50 / 2050) < 1
    weights = {"a": 0.4004, "b": 0.3503, "c": 0.2493}
    taken = Counter(r[0] for r in mixing.schedule(dict.fromkeys(weights, 60_000), weights) if r[3] < 60_000)
    assert all(abs(taken[s] - 60_000 * w) < 1 for s, w in weights.items())


def test_phases_use_every_block_once():
    blocks = {"a": 700, "b": 30, "c": 1, "d": 90}
    rows = mixing.schedule(blocks, {"a": 0.5, "b": 0.3, "c": 0.2})
    assert sorted(r[3] for r in rows) == list(range(sum(blocks.values())))
    assert {s: sorted(r[1] for r in rows if r[0] == s) for s in blocks} == {s: list(range(n)) for s, n in blocks.items()}
    assert min(r[3] for r in rows if r[0] == "d") == 731  # no weight: after all others
    assert mixing.schedule({}, {}) == [] and mixing.block_size(10) == 16 and mixing.block_size(10**10) == 38147


def test_mixing_on_tables(spark):
    rows = [(i, f"t{i}", None, "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(400)] + [(1000, None, None, None), (None, "x", None, "hot"), (7, "t7", None, "s2"), (7, "t7", None, "s2"), (1001, "", None, "s1"), (1002, "long " * 300_000, None, "s1")]
    docs = documents(spark, rows).withColumns({"_source": F.lit("mine"), "_rank": F.lit(3), "_s": F.lit("x"), "mix_slot": F.lit("old")})
    out = mixing.mix_rows(docs, block_rows=4)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == [c for c in docs.columns if c != "mix_slot"] + list(mixing.ADDED)
    assert all(r["_source"] == "mine" and r["_rank"] == 3 and r["_s"] == "x" for r in got)
    assert len({r["mix_position"] for r in got}) == len(rows)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert max(Counter((r["source"], r["mix_block"]) for r in got).values()) == 4
    assert {r["mix_slot"] for r in got} == set(range(len({(r["source"], r["mix_block"]) for r in got})))
    docs = documents(spark, rows)
    ordered = mixing.in_mixed_order(docs, block_rows=4)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)
    assert mixing.mix_rows(documents(spark, [])).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = ["", " \n", "A", "a B", "a b c", "É é B c d e"] + [" ".join(rng.choice("abcdeé") for _ in range(rng.choice([5, 30, 900]))) for _ in range(60)]
    for t in texts:
        assert simhash.simhash(t.encode()) == brute_fingerprint(t)


def test_every_link_meets_in_some_table():
    rng = random.Random(3)
    for blocks in (5, 6):
        masks = simhash.block_masks(blocks)
        for _ in range(3000):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_bucket_links_span_the_components():
    rng = random.Random(4)
    for n in (2, 40, 700):
        seeds = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
        fp = {rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(n)}
        fp = np.array(sorted(fp), np.uint64)
        got = simhash.bucket_links(fp, simhash.pivots())
        assert all(int(fp[a] ^ fp[b]).bit_count() <= 3 for a, b in got)
        assert len(got) <= len(fp) - 1
        pairs = set(got) | {(b, a) for a, b in got}
        want = brute_components(list(fp), lambda x, y: int(x ^ y).bit_count() <= 3)
        joined = brute_components(list(range(len(fp))), lambda x, y: (x, y) in pairs)
        # spanning links alone must give the same classes
        assert len(set(want)) == len(fp) - len(got) and len(set(joined)) == len(set(want))


def test_simhash_on_tables(spark):
    rng = random.Random(5)
    base = [[rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 99)) for _ in range(300)] for _ in range(12)]
    rows = [(10 * i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for j in range(4):
            c = list(b)
            for _ in range(j):
                c[rng.randrange(300)] = "changed"
            rows.append((200 + 10 * i + j, " ".join(c)))
    rows += [(500, None), (501, ""), (499, " \n"), (502, "one two"), (503, "one two"), (None, rows[0][1]), (0, rows[0][1])]
    docs = documents(spark, rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f if f < 1 << 63 else f - (1 << 64), least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=lambda t: tuple((x is not None, x) for x in t))
    assert by_id(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *least.values()}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "a long, b long")
    assert by_id(simhash.components(edges), "node", "root") == [*((i, 0) for i in range(61)), (100, 100), (101, 100), (102, 100)]


# --- repeated windows ------------------------------------------------------------------------------------------------


def repeated_texts(seed, unit, n):
    """Texts with exact and near copies, shared passages, repeats within a text and one passage in a third of all."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(unit) for _ in range(k)]
    hot, shared = words(70), words(45)
    out = []
    for i in range(n):
        t = words(rng.randint(0, 120))
        if i % 3 == 0:
            t[rng.randint(0, len(t)) : 0] = hot
        if i % 7 == 0:
            t += shared + words(3) + shared
        if i % 11 == 0 and out:
            t = list(rng.choice(out))
        if i % 13 == 0 and out:
            t = list(rng.choice(out))
            if t:
                t[rng.randrange(len(t))] = "edit"
        out.append(t)
    return out


def brute_passages(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), {}
    for k in order:
        w = (rows[k][1] or "").split()
        gone, mine = set(), []
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen or x in mine:
                gone |= set(range(i, i + 20))
            mine.append(x)
        seen |= set(mine)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[rows[k][0]] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_passages_equal_brute_force(spark):
    texts = repeated_texts(1, ["the", "of", "ño", "cat", "dog", "sun", "sky", "re", "un", "ki", "lo", "ma"], 140)
    rows = [(i, rngsep(i).join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, " ".join(texts[0])), (903, " ".join(["same"] * 60))]
    want = brute_passages(rows)
    docs = documents(spark, [*rows, rows[5]])
    out = passages.remove_passages(docs)
    assert out.count() == len(rows) + 1
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == want
    assert all(sum(x["last"] - x["first"] for x in r["ranges"]) == r["n_removed"] for r in out.collect())
    for hot in (1, 12):  # windows of hot anchors are grouped one by one
        lone = passages.remove_passages(docs, hot).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in lone} == want
    assert passages.remove_passages(documents(spark, [])).count() == 0


def rngsep(i):
    return [" ", "\n", "  ", "\t"][i % 4]


def brute_repeats(texts, window):
    n = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if n[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    unit = [c * k for c in "abcdé" for k in (7, 9, 13)]
    rows = [(i, "".join(t)) for i, t in enumerate(repeated_texts(2, unit, 120))] + [(900, None), (901, ""), (903, "ab" * 700), (904, "x" * 399), (905, "x" * 398 + "y"), (None, "tail " * 30)]
    docs = documents(spark, rows)
    want = dict(zip([i for i, _ in rows], brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0
    for hot in (1, 12):
        lone = suffixes.remove_repeats(docs, hot).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in lone} == want
    twice = suffixes.remove_repeats(documents(spark, [(1, "q" * 10 + "w" * 500), (1, "q" * 10 + "w" * 500)])).collect()
    assert [r["n_removed"] for r in twice] == [510, 510]
    assert suffixes.remove_repeats(documents(spark, [])).count() == 0


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (500, 48), dtype=np.uint8)
    group = rng.integers(0, 5, 500)
    order = suffixes.multikey_quicksort(rows, group)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    common = suffixes.common_lengths(rows, order, group)
    for k in range(1, 500):
        a, b = keys[k - 1], keys[k]
        want = -1 if a[0] != b[0] else next((i for i in range(48) if a[1][i] != b[1][i]), 48)
        assert common[k] == want


@pytest.mark.parametrize(("window", "gram"), [(20, 8), (400, 64)])
def test_runs_cover_all_windows_across_blocks(monkeypatch, window, gram):
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 3, 5000).astype(np.uint64)
    whole = anchors.window_runs(anchors.mix(unit), window, gram)
    monkeypatch.setattr(anchors, "BLOCK_UNITS", 700)
    cut = anchors.window_runs(anchors.mix(unit), window, gram)
    spread = lambda r: [(h, p) for h, p, a, b in zip(*(x.tolist() for x in r), strict=True) for _ in range(a, b + 1)]
    assert len(spread(whole)) == 5000 - window + 1 and spread(whole) == spread(cut)


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "ne", "to", "ri", "su", "mo"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(160):
        text = " ".join([word() for _ in range(60)] + (["grumbler", word(), "grumbler"] if i % 5 == 0 else []))
        rows.append((i, text + (" password=hunter2222" if i % 7 == 1 else ""), "aa", f"s{i % 4}"))
    rows += [(300 + i, rows[i][1], "aa", "s9") for i in range(1, 20)]
    d = str(tmp_path)
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    for name, stage in pipeline_stages.STAGES[:-1]:
        seen = stage(spark, seen, d)
        assert tuple(seen.columns) == pipeline_stages.COLUMNS, name
    import corpus_pipeline

    out = corpus_pipeline.run(spark, d)
    lexicon = toxicity.train(docs, labels).prepare()
    clean = [r for r in rows if lexicon.score(r[1]) < toxicity.THRESHOLD]
    roots = brute_components([brute_fingerprint(r[1]) for r in clean], lambda a, b: (a ^ b).bit_count() <= 3)
    keep = {min(r[0] for r, x in zip(clean, roots, strict=True) if x == root) for root in set(roots)}
    assert {r["doc_id"] for r in out.collect()} == keep and not any(i % 5 == 0 for i in keep if i < 160)
    from heddle.llm import bpe

    texts = dict((r[0], r[1]) for r in rows)
    own = bpe.encoder(bpe.VOCABULARY)
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mix_rows(documents(spark, [r for r in rows if r[0] in keep])).collect()}
    assert {r["doc_id"]: r["mix_position"] for r in out.collect()} == want
    for r in out.filter("doc_id in (1, 2)").collect():
        assert own.decode(r["ids"]).decode() == texts[r["doc_id"]].replace("password=hunter2222", "[assign]")

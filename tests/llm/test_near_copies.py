"""The near-copy search of the pipeline's SimHash stage: no link is lost, against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
from tests.llm.helpers import by_id, documents
from tests.llm.test_groups import brute_components, brute_fingerprint

from heddle.llm import near_copies


def word(rng):
    return "".join(rng.choice(["ba", "ne", "to", "ri", "su", "mo", "ka"]) for _ in range(rng.randint(2, 4)))


def kept_by_brute_force(rows):
    """Three-word fingerprints at three bits, or five-word shingles at 0.8."""
    own = [(brute_fingerprint(t), near_copies.shingle_set((t or "").encode())) for _, t in rows]
    roots = brute_components(own, lambda x, y: (x[0] ^ y[0]).bit_count() <= 3 or len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1]) > 0)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    return set(least.values())


def kept(spark, rows):
    return {r["doc_id"] for r in near_copies.drop_near_copies(documents(spark, rows)).collect()}


def edited(rng, base):
    """A copy with words replaced, a block appended, cut or inserted: similarities on both sides of 0.8."""
    c, k = list(base), max(1, int(len(base) * rng.uniform(0.02, 0.28)))
    kind = rng.randrange(4)
    if kind == 0:
        for _ in range(max(1, k // 5)):
            c[rng.randrange(len(c))] = word(rng)
    elif kind == 1:
        c += [word(rng) for _ in range(k)]
    elif kind == 2:
        del c[-k:]
    else:
        at = rng.randrange(len(c))
        c[at:at] = [word(rng) for _ in range(k)]
    return c


def test_all_pairs_at_the_similarity_are_found(spark):
    rng = random.Random(11)
    famous = [word(rng) for _ in range(40)]
    rows = []
    for g in range(60):
        base = [word(rng) for _ in range(rng.randint(20, 300))] + (famous if g % 2 else [])
        for j in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(edited(rng, base) if j else base)))
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate([["one"], ["two", "words"], ["one"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "f"]])]
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_one_group_of_all_sorts_of_copies(spark, monkeypatch):
    rng = random.Random(5)
    hot = [word(rng) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, hot))) for i in range(220)]
    want = kept_by_brute_force(rows)
    assert len(want) > 3 and kept(spark, rows) == want
    monkeypatch.setattr(near_copies, "BLOCK", 60)  # hot keys dealt block against block
    assert kept(spark, rows) == want


def test_copies_that_hang_together_by_failed_links(spark):
    rng = random.Random(21)
    rows = []
    for g in range(30):
        b = [word(rng) for _ in range(300)]
        a, c = list(b), list(b)
        at = rng.sample(range(0, 300, 6), 14)
        for x, i, j in [(a, *at[k : k + 2]) for k in (0, 2, 4, 6)] + [(c, *at[k : k + 2]) for k in (8, 10, 12)]:  # the same words: a is no copy of b and c
            x[i], x[j] = x[j], x[i]
        rows += [(3 * g + i, " ".join(t)) for i, t in enumerate((a, b, c))]
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_defined_cases(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(200_000))
    rows = [(1, "a b c d e f g"), (3, "A  b c\nd e f g"), (3, "something else that is alone here"), (None, "a b c d e f g"), (None, None), (20, None), (21, ""), (1, "a b c d e f g"), (30, long), (31, long + " more")]
    docs = documents(spark, rows)
    out = near_copies.drop_near_copies(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or ""))
    assert [i for i, _ in got] == [None, None, 1, 1, 3, 20, 30] and got[4][1].startswith("something")
    assert near_copies.drop_near_copies(documents(spark, [])).count() == 0


def test_parity_bitmaps_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a)) + 1], rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)]))
        w = min(near_copies.width(len(a)), near_copies.width(len(b))) // 8
        x, y = (near_copies.parity(s).to_bytes(near_copies.width(len(s)) // 8, "little") for s in (a, b))
        if max(len(x), len(y)) <= 2 * w:
            differ = int(np.bitwise_count(near_copies._folded(x, w) ^ near_copies._folded(y, w)).sum())
            assert differ <= len(np.setxor1d(a, b))


def test_verification_is_exact(spark):
    docs = documents(spark, [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k x"), (3, "A  b c d\ne f g h i j k l"), (4, None), (5, "")])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    packed = near_copies.packed_texts(docs)
    assert by_id(near_copies.verified(pairs, packed), "a", "b") == [(1, 3)]
    assert by_id(near_copies.verified(pairs, packed, 5, 0.7), "a", "b") == [(1, 2), (1, 3)]

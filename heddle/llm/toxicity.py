"""Operator 10, toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: words and word stems (prefixes of 3 to 8 letters) that stand in many toxic
documents and in few others, by a likelihood-ratio test that allows for the number of candidates. Terms and stems go
into one trie. Each distinct word of a text builds a Levenshtein automaton (bit-parallel, one edit), which is
intersected with the trie, so misspelled terms are caught, and words that begin with a misspelled stem. Terms and stems
of fewer than `LONG` letters are one edit from too many words; in those only letters may be repeated. Every hit looks at
a window of words around it: quotation marks about it and cues near it (words that the labelled rows show near hits in
clean documents, such as words of reporting) move its weight from abuse to quotation. A logistic model over a text's
exact, misspelled and quoted weight and its density gives the score.

Learning: from at most `SAMPLE` labelled rows of each class that are not held out (by hash order, so that the sample
doesn't depend on the table's order); that bound keeps the lexicon and what reaches the driver small at any size of
the corpus. Scoring covers all rows in one pass without a shuffle.

Defined cases: null and empty texts are scored as texts without hits; null labels and rows with a null id are not
learned from, a document that has several labels counts as toxic if one says so; with no toxic or no clean row to
learn from every score is 0; texts of any length are read whole; repeated rows give repeated results; other columns are ignored or passed through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import as_texts, chunks, held_out, materialize, read_table

SAMPLE = 10_000
STEM = range(3, 9)
WINDOW = 8
THRESHOLD = 0.7
#: Letters of a term or stem from which it may be misspelled by any one edit; in shorter ones letters may be repeated.
LONG = 5
#: Documents of the sample that a cue must stand in, and the share of the toxic ones that a term must stand in: a text that was
#: copied with changes a few dozen times would teach its own words otherwise.
SUPPORT, SHARE = 5, 0.02
_RUN = re.compile(r"(\w)\1+")
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = '"“„«‹', '"”“»›'
KNOWN_WORDS = 200_000


class Trie:
    """Terms and stems as nested dicts; the empty string holds a term's number, "*" a stem's (as no word has that letter)."""

    def __init__(self, terms: list[str], stems: list[str] = ()) -> None:
        self.root: dict = {}
        self.stems = list(stems)
        for end, texts in (("", terms), ("*", stems)):
            for i, t in enumerate(texts):
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[end] = i

    def within(self, word: str, edits: int = 1) -> tuple[int, str, int] | None:
        """(edits, kind, number) of the nearest term ("") or stem ("*"), ties by kind and number: the word's Levenshtein automaton run over the trie.

        State d is a bitmap of the word's prefixes that the path so far matches with d edits. A term must match the whole
        word; a stem a prefix of it that begins and ends with the stem's own letters, so that the edit lies inside."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        final, full = 1 << len(word), (1 << len(word) + 1) - 1
        start = [(1 << d + 1) - 1 & full for d in range(edits + 1)]
        best, stack = None, [(self.root, start)]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c in ("", "*"):
                    ends = final
                    if c:
                        stem = self.stems[below]
                        ends = masks.get(stem[-1], 0) << 1 if word[:1] == stem[0] else 0
                    for d in range(edits + 1):
                        if state[d] & ends:
                            if best is None or (d, c, below) < best:
                                best = (d, c, below)
                            break
                    continue
                m, new, prior_old, prior_new = masks.get(c, 0), [], 0, 0
                for s in state:
                    x = (s & m) << 1 | prior_old | prior_old << 1 | prior_new << 1
                    x &= full
                    new.append(x)
                    prior_old, prior_new = s, x
                if new[-1]:
                    stack.append((below, new))
        return best


@dataclass
class Lexicon:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    stems: dict[str, float] = field(default_factory=dict)
    #: Words that mark a hit as quoted if they stand in its window.
    cues: frozenset = frozenset()
    coefficients: tuple[float, ...] = (-math.inf, 0.0, 0.0, 0.0, 0.0)

    def prepare(self) -> Matcher:
        return Matcher(self)


def squeezed(word: str) -> str:
    """The word with runs of one letter as one."""
    return _RUN.sub(r"\1", word)


class Matcher:
    """Looks words up, and scores texts, in a worker."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.exact = dict(zip(lexicon.terms, lexicon.weights, strict=True))
        self.fuzzy = [i for i, t in enumerate(lexicon.terms) if len(t) >= LONG]
        terms, stems = [lexicon.terms[i] for i in self.fuzzy], sorted(s for s in lexicon.stems if len(s) >= LONG)
        self.trie, self.stems = Trie(terms, stems), stems
        self.lengths = {n + d for n in map(len, terms) for d in (-1, 0, 1)}
        # a word within one edit of a term begins with its first half or ends with its second
        self.heads = {t[: len(t) // 2] for t in terms}
        self.tails = {t[len(t) // 2 :] for t in terms}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        # a prefix within an edit of a stem is equal to it once each lacks a letter at most
        self.lacking = {t[:i] + t[i + 1 :] for t in stems for i in range(1, len(t) - 1)} | set(stems)
        self.stem_begins = {t[0] for t in stems}
        self.stem_cuts = sorted({len(t) for t in stems})
        self.stem_sizes = sorted({len(x) for x in lexicon.stems})
        # short ones: letters may be repeated, no other edit
        self.short = {squeezed(t): w for t, w in self.exact.items() if len(t) < LONG}
        self.short_stems = {squeezed(t): w for t, w in lexicon.stems.items() if len(t) < LONG}
        self.short_sizes = sorted({len(x) for x in self.short_stems})
        self.known: dict[str, tuple[float, bool] | None] = {}

    def look_up(self, word: str) -> tuple[float, bool] | None:
        """(weight, is it exact) of a word, or null."""
        if word in self.exact:
            return self.exact[word], True
        for n in self.stem_sizes:
            if len(word) >= n and (w := self.lexicon.stems.get(word[:n])) is not None:
                return w, True
        if self._may_match(word) and (got := self.trie.within(word)):
            return (self.lexicon.stems[self.stems[got[2]]] if got[1] else self.lexicon.weights[self.fuzzy[got[2]]]), False
        if (self.short or self.short_stems) and _RUN.search(word):
            own = squeezed(word)
            for w in (self.short.get(own), *(self.short_stems.get(own[:n]) for n in self.short_sizes)):
                if w is not None:
                    return w, False
        return None

    def _may_match(self, word: str) -> bool:
        if len(word) in self.lengths and (any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)):
            return True
        if word[:1] in self.stem_begins:
            for n in self.stem_cuts:
                for k in (n - 1, n, n + 1):
                    part = word[:k]
                    if part in self.lacking or any(part[:i] + part[i + 1 :] in self.lacking for i in range(1, len(part) - 1)):
                        return True
        return False

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Logarithms of the weight of exact, misspelled and quoted hits, and of the unquoted weight in a hundred words."""
        low, known = text.lower(), self.known
        words = _WORD.findall(low)
        kinds = set(words)
        for w in kinds:
            if w not in known:
                known[w] = self.look_up(w)
        if not any(map(known.get, kinds)):
            self._forget()
            return 0.0, 0.0, 0.0, 0.0
        exact = fuzzy = quoted = 0.0
        spans = [m.span() for m in _WORD.finditer(low)]
        for i, w in enumerate(words):
            if not (hit := known[w]):
                continue
            share = self.quotation(low, words, spans, i, self.lexicon.cues)
            quoted += hit[0] * share
            if hit[1]:
                exact += hit[0] * (1 - share)
            else:
                fuzzy += hit[0] * (1 - share)
        self._forget()
        return math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * (exact + fuzzy) / (len(words) + 20))

    def _forget(self) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()

    @staticmethod
    def quotation(low: str, words: list[str], spans: list[tuple[int, int]], i: int, cues: frozenset) -> float:
        """How far a hit is quoted: 0.6 for quotation marks around it within the window, 0.4 for a cue there."""
        a, b = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
        before, after = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b][1] + 1]
        opened = max(before.rfind(c) for c in _OPEN)
        marked = opened >= 0 and "\n" not in before[opened:] and before[opened:].count('"') % 2 == (before[opened] == '"') and any(c in after for c in _CLOSE)
        return 0.6 * marked + 0.4 * any(w in cues for w in words[a : b + 1])

    def around(self, text: str) -> set[str]:
        """Words within the windows of a text's hits, the hits left out."""
        words, known = _WORD.findall(text.lower()), self.known
        for w in set(words):
            if w not in known:
                known[w] = self.look_up(w)
        hit = [known[w] is not None for w in words]
        self._forget()
        return {words[j] for i, h in enumerate(hit) if h for j in range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1)) if not hit[j]}

    def score(self, text: str) -> float:
        c = self.lexicon.coefficients
        z = c[0] + sum(x * y for x, y in zip(c[1:], self.features(text), strict=True))
        return 0.0 if z < -700 else 1 / (1 + math.exp(-z))


def text_features(text: str) -> set[str]:
    """The words of a text and their stems (with a star)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEM if len(w) > k}


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most `per_class` labelled rows of each class that are not held out; equal texts count once."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")


def _count_features(sample: DataFrame, of: Callable[[str], set[str]], wanted: frozenset | None = None) -> DataFrame:
    """(feature, toxic, n): documents of each class that have a feature, summed in each task first."""
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        wanted = shared.value
        for batch in chunks(batches):
            for c, t in zip(batch.column("toxic").to_pylist(), as_texts(batch.column("text")), strict=True):
                got = of(t)
                counts[c].update(got if wanted is None else got & wanted)
        for c, count in counts.items():
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c] * len(count), pa.int32()), pa.array(list(count.values()), pa.int64())], ["feature", "toxic", "n"])

    return sample.mapInArrow(run, "feature string, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def _likelihood_ratio(a: float, nt: float, c: float, nc: float) -> float:
    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((1 - k / n) / (1 - p)) if n - k > 0 and p < 1 else 0.0)

    p = (a + c) / (nt + nc)
    return 2 * (part(a, nt, p) + part(c, nc, p))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], nt: int, nc: int) -> Lexicon:
    """Features that tell toxic documents, each at its most telling length (by likelihood ratio): no term extends or begins another stem."""
    rows = []
    for f, a in toxic.items():
        c = clean.get(f, 0)
        weight = math.log((a + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
        gain = _likelihood_ratio(a, nt, c, nc)
        if weight > math.log(5) and gain > 2 * math.log(len(toxic) + 1) + 6:
            rows.append((-gain, f.endswith("*"), -len(f), f, weight))
    out, taken = Lexicon(), []
    for _, stem, _, f, weight in sorted(rows):
        own = f.rstrip("*")
        if any((stem_ and own.startswith(t)) or (stem and t.startswith(own)) for t, stem_ in taken):
            continue
        taken.append((own, stem))
        if stem:
            out.stems[own] = weight
        else:
            out.terms.append(own)
            out.weights.append(weight)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for logistic regression with a ridge around `prior` (the intercept is free but for a little)."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    pull = np.array([1e-3] + [ridge] * (x.shape[1] - 1))
    beta = prior.astype(float).copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - pull * (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn_cues(sample: DataFrame, lexicon: Lexicon) -> frozenset:
    """Words that stand near hits of clean documents far more often than near those of toxic ones: words of reporting, where there are such."""
    windows: list[Matcher] = []

    def around(text: str) -> set[str]:
        if not windows:
            windows.append(lexicon.prepare())
        return windows[0].around(text) | {""}  # the empty word counts the documents with a word near a hit

    near: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in _count_features(sample, around).groupBy("feature").pivot("toxic", [0, 1]).sum("n").na.fill(0).filter(F.col("0") >= SUPPORT).collect():
        near[0][r["feature"]], near[1][r["feature"]] = r["0"], r["1"]
    return frozenset(choose_cues(near[1], near[0], near[1].pop("", 0), near[0].pop("", 0)))


def choose_cues(toxic: dict[str, int], clean: dict[str, int], nt: int, nc: int) -> list[str]:
    if not nt or not nc:
        return []
    out = []
    for w, c in clean.items():
        a = toxic.get(w, 0)
        weight = math.log((c + 0.5) / (nc + 1)) - math.log((a + 0.5) / (nt + 1))
        if weight > math.log(5) and _likelihood_ratio(a, nt, c, nc) > 2 * math.log(len(clean) + 1) + 6:
            out.append(w)
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Lexicon:
    """Learn the lexicon and the logistic model. The driver sees terms and five figures a sampled row."""
    sample = materialize(labelled_sample(docs, labels, per_class), "toxicity-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nc = size.get(1, 0), size.get(0, 0)
    if not nt or not nc:
        return Lexicon()
    candidates = frozenset(r["feature"] for r in _count_features(sample.filter("toxic = 1"), text_features).filter(F.col("n") >= max(SUPPORT, SHARE * nt)).select("feature").collect())
    both: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in _count_features(sample, text_features, candidates).collect():
        both[r["toxic"]][r["feature"]] = r["n"]
    lexicon = choose_terms(both[1], both[0], nt, nc)
    lexicon.cues = learn_cues(sample, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.prepare()
        for batch in chunks(batches):
            x = [own.features(t) for t in as_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([r[i] for r in x], pa.float64()) for i in range(4))], ["toxic", *"abcd"])

    got = sample.mapInArrow(run, "toxic int, a double, b double, c double, d double").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in "abcd"], axis=1)
    beta = fit_logistic(x, got.column("toxic").to_numpy().astype(float), np.array([-2.0, 2.0, 1.0, 0.0, 2.0]))
    lexicon.coefficients = tuple(beta.tolist())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value.prepare()
        for batch in chunks(batches):
            s = [own.score(t) for t in as_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value.prepare()
        for batch in chunks(batches):
            yield batch.filter(pa.array([own.score(t) < THRESHOLD for t in as_texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))

"""Operator 6, language ID by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to 4. A text's code length under a language is exact, under frozen
counts (method C): a symbol that context c has seen costs -log2 n(c, s) / (n(c) + d(c)), where d(c) is the number of
different symbols seen; any other escapes with d(c) / (n(c) + d(c)) to the next shorter context, whose probabilities are
renormalised without the symbols that c has seen (exclusion), down to 1/256. The shortest code wins; ties go to the
first language by name.

Learning counts the strings of five bytes of whole texts, all shorter contexts being their sums. What is counted grows
with the corpus, and so does the tree: strings of at least `support` occurrences are kept, which is 1 and the square
root of the megabytes counted. The trees of all languages lie in arrays of sorted keys with one row of code lengths, a
column a language, so that a byte of text is looked up once, not once a language.

Every language is learned. They go by their bytes into groups of `LANGUAGES`, each with a model of its own; a language
that a group's support would leave with less keeps its `FEWEST` most frequent strings. The shortest code of all groups
wins, and the posterior is over all languages.

Scale: each task sums its counts before the shuffle, in bounded memory. What is collected and broadcast at once is a
group's model of at most `MOST` code lengths (strings times languages; the support rises where there would be more) and
half of that for the languages of few strings. Up to `LANGUAGES` languages scoring is one pass without a shuffle; beyond,
texts are written once and read by one pass a group, and a row a text and group, without the text, is shuffled.

Defined cases: null text or text without a letter gives `und` and score 0; rows with a null lang or text, and
held-out rows (also those with a null id), are not learned from; repeated rows count as often as they occur; texts of
any length are read whole; with nothing to learn from every row is `und`; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter as Counts
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import as_bytes, chunks, held_out, materialize, read_table
from heddle.llm.hashed import Counter, Index, support

ORDER = 4
LANGUAGES = 256
MOST = 1 << 24
FEWEST = 128
#: Strings that a task holds for all languages together, before they are summed.
HELD = 1 << 24
#: What stands before a text.
MARGIN = b"    "
_LETTER = re.compile(r"[^\W\d_]")


def strings(texts: list[bytes]) -> np.ndarray:
    """The five bytes that end at every byte of the texts, text after text, as integers."""
    joined = MARGIN.join([b"", *texts])
    s = np.frombuffer(joined, np.uint8).astype(np.int64)
    if len(s) <= ORDER:
        return np.zeros(0, np.int64)
    keys = s[4:] | s[3:-1] << 8 | s[2:-2] << 16 | s[1:-3] << 24 | s[:-4] << 32
    own = np.ones(len(keys), bool)  # what ends in a margin is no string
    ends = np.cumsum([len(x) + ORDER for x in texts[:-1]]).astype(np.int64) - ORDER
    for k in range(ORDER):
        own[ends + k] = False
    return keys[own]


def count_strings(docs: DataFrame, learned: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """(lang, key, n) over whole texts, as `learned` gives them, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows(g: str) -> pa.RecordBatch:
            key, n = counts[g].take()
            return pa.RecordBatch.from_arrays([pa.array([g]).take(pa.array(np.zeros(len(key), np.int32))), pa.array(key), pa.array(n)], ["lang", "key", "n"])

        for batch in chunks(batches):
            by: dict[str, list[bytes]] = {}
            for g, t in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if t := learned(t):
                    by.setdefault(g, []).append(t)
            for g, texts in by.items():
                counts.setdefault(g, Counter()).add(strings(texts))
                if counts[g].full:
                    yield rows(g)
            if sum(c.size for c in counts.values()) > HELD:
                for g in counts:
                    yield rows(g)
                counts.clear()
        for g in counts:
            yield rows(g)

    return docs.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Tree:
    """One language's contexts: for each order the sorted strings with their code lengths, and the sorted contexts with the cost of an escape."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.levels: list[tuple] = []
        for k in range(ORDER + 1):
            own, at = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, minlength=len(own))
            context, of = np.unique(own >> 8, return_inverse=True)
            total, kinds = np.bincount(of, n, minlength=len(context)), np.bincount(of, minlength=len(context))
            lower = self.cost(own & ((1 << 8 * k) - 1), k - 1)
            shorter = np.bincount(of, np.exp2(-lower), minlength=len(context))  # what the next shorter context gives to symbols that this one has seen
            bits = np.log2((total + kinds)[of] / n)
            escape = np.log2((total + kinds) / kinds) + np.log2(np.maximum(1 - shorter, 2.0**-40))
            self.levels.append((own, bits, context, escape))

    def cost(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code length of each string's last byte after the k bytes before it."""
        if k < 0:
            return np.full(len(keys), 8.0)
        own, bits, context, escape = self.levels[k]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        out = bits[at]
        miss = np.flatnonzero(own[at] != keys)
        if len(miss):
            out[miss] = self.escape(keys[miss] >> 8, k) + self.cost(keys[miss] & ((1 << 8 * k) - 1), k - 1)
        return out

    def escape(self, contexts: np.ndarray, k: int) -> np.ndarray:
        """Cost of leaving each context of order k: none where the language has never seen it."""
        _, _, context, escape = self.levels[k]
        at = np.minimum(np.searchsorted(context, contexts), len(context) - 1)
        return np.where(context[at] == contexts, escape[at], 0.0)


class Model:
    """All languages' trees: rows of strings and of contexts, by order, with a column a language."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.names = sorted(trees)
        self.strings: list[tuple[Index, np.ndarray]] = []
        self.contexts: list[tuple[Index, np.ndarray]] = []
        for k in range(ORDER + 1 if trees else 0):
            for out, which, of in ((self.strings, 0, Tree.cost), (self.contexts, 2, Tree.escape)):
                keys = np.unique(np.concatenate([trees[g].levels[k][which] for g in self.names]))
                out.append((Index(keys), np.stack([of(trees[g], keys, k) for g in self.names], axis=1).astype(np.float32)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """(strings, languages): code length of each string's last byte."""
        index, table = self.strings[ORDER]
        at = index.find(keys)
        out = table[np.maximum(at, 0)]
        if len(left := np.flatnonzero(at < 0)):
            out[left] = 0
            for k in range(ORDER, -1, -1):
                index, table = self.contexts[k]
                at = index.find(keys[left] >> 8 & ((1 << 8 * k) - 1))
                out[left] += np.where(at[:, None] >= 0, table[np.maximum(at, 0)], 0)
                if not k:
                    out[left] += 8
                    break
                index, table = self.strings[k - 1]
                at = index.find(keys[left] & ((1 << 8 * k) - 1))
                hit = at >= 0
                out[left[hit]] += table[at[hit]]
                left = left[~hit]
                if not len(left):
                    break
        return out


def train(docs: DataFrame) -> Iterator[Model]:
    """The models of all languages, a group of LANGUAGES after another, so that the driver holds one at a time."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", "text")
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return
    every = materialize(count_strings(known), "language-strings")
    for at in range(0, len(sizes), LANGUAGES):
        group = sizes[at : at + LANGUAGES]
        counts = every.filter(F.col("lang").isin([r["lang"] for r in group])) if len(sizes) > LANGUAGES else every
        histogram = {1 << r["p"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
        least = support(sum(r["n"] for r in group), histogram, MOST // len(group))
        lang, key, n = _columns(counts.filter(F.col("n") >= least))
        kept = Counts(lang.tolist())
        if least > 1 and (few := [r["lang"] for r in group if kept[r["lang"]] < FEWEST]):
            first = counts.filter((F.col("n") < least) & F.col("lang").isin(few)).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("r") <= FEWEST)
            more, more_key, more_n, place = _columns(first)
            use = place <= FEWEST - np.array([kept[g] for g in more.tolist()], np.int64)
            lang, key, n = np.concatenate([lang, more[use]]), np.concatenate([key, more_key[use]]), np.concatenate([n, more_n[use]])
        yield Model({g: Tree(key[lang == g], n[lang == g]) for g in sorted(set(lang.tolist()))})


def _columns(df: DataFrame) -> list[np.ndarray]:
    return [x.to_numpy() for x in df.toArrow().columns]


def predict(docs: DataFrame, models: Iterable[Model]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte): score is the winner's share of the posterior over all languages."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(m) for m in models] or [context.broadcast(Model({}))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    if len(shared) == 1:
        best = _scored(rows, shared[0], ["doc_id", "held_out"]).withColumn("total", F.col("mass"))
    else:
        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "language-rows")
        parts = reduce(DataFrame.unionByName, [_scored(rows, m, ["_row", "doc_id", "held_out"]) for m in shared])
        least = parts.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sort_array(F.collect_list(F.struct("bits", "lang_pred", "bits_per_byte", "mass"))).alias("of"))
        share = F.aggregate("of", F.lit(0.0), lambda acc, x: acc + x["mass"] * F.pow(F.lit(2.0), -F.least(x["bits"] - F.col("of")[0]["bits"], F.lit(1000.0))))
        best = least.select("doc_id", "held_out", F.col("of")[0]["bits"].alias("bits"), F.col("of")[0]["lang_pred"].alias("lang_pred"), F.col("of")[0]["bits_per_byte"].alias("bits_per_byte"), share.alias("total"))
    return best.select("doc_id", "held_out", "lang_pred", F.when(F.col("bits").isNull(), 0.0).otherwise(1 / F.col("total")).alias("score"), "bits_per_byte")


def _scored(rows: DataFrame, shared: Broadcast, carried: list[str]) -> DataFrame:
    """The carried columns with one model's shortest code: (bits, lang_pred, mass, bits_per_byte), mass being the sum of all its languages' likelihoods over the winner's. No bits where there is no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.names, object)
        for batch in chunks(batches, limit=1 << 19):
            texts = as_bytes(batch.column("text"))
            pred, least, mass, rate = np.array(["und"] * len(texts), object), np.full(len(texts), np.nan), np.zeros(len(texts)), np.zeros(len(texts))
            use = [i for i, x in enumerate(texts) if _LETTER.search(x.decode("utf-8", "replace"))] if len(names) else []
            if use:
                bits = code_lengths(own, [texts[i] for i in use])
                pred[use] = names[bits.argmin(axis=1)]
                least[use] = bits.min(axis=1)
                mass[use] = np.exp2(-np.minimum(bits - least[use][:, None], 1000)).sum(axis=1)
                rate[use] = least[use] / np.array([len(texts[i]) for i in use])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(least, from_pandas=True), pa.array(pred, pa.string()), pa.array(mass), pa.array(rate)], [*carried, "bits", "lang_pred", "mass", "bits_per_byte"])

    kinds = dict(rows.dtypes)
    return rows.select(*carried, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", bits double, lang_pred string, mass double, bits_per_byte double")


def code_lengths(model: Model, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
    """(texts, languages): bits of each whole text (none empty), a block of bytes at a time."""
    keys, length = strings(texts), np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length) - length
    out = np.zeros((len(texts), len(model.names)))
    for s in range(0, len(keys), block):
        e = min(len(keys), s + block)
        first, last = np.searchsorted(start, s, "right") - 1, np.searchsorted(start, e, "left")
        bits = model.bits(keys[s:e])
        out[first:last] += np.add.reduceat(bits, np.maximum(start[first:last] - s, 0), axis=0, dtype=np.float64)
    return out


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, train(docs))

"""Causal jobs, plan review and compilation as DataFrame compositions.

Tables: tasks(task_id, prompt, reference_answer, task_kind), evidence(task_id, pos, evidence_id, source, argument, value,
depends_on array<int>, requires_need), plans(task_id, final_answer), frames(task_id, phase, frame_pos, display),
cells(task_id, phase, cell_id, text, role, weight, lifecycle), needs(task_id, need_id, evidence_id, source, argument,
freshness, phase).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from heddle.functions.algebra import chosen_option, math_verdict, ratio_verdict
from heddle.functions.answers import with_answer_match
from heddle.functions.keys import hash_unit, joined, stable_hash
from heddle.functions.text import normalized_text, number_tokens
from heddle.sources.shared import materialize

# Kinds of tasks by how their answers are judged (`qa` is any question), and what says that the evidence doesn't do.
QA_KINDS = ("multi_hop_qa", "multiple_choice_knowledge_reasoning", "science_multiple_choice", "synthetic_mechanism", "qa")
WORD_PROBLEM, COMPETITION = "math_word_problem", "competition_math"
INSUFFICIENT = (
    r"\b(?:visible|support) evidence\b[^.]{0,160}\b(?:does not|cannot|not stated|not establish|gives no)\b|\bdid not\b[^.;]{0,120}\bin the visible (?:account|evidence)\b|\bno minimum age\b"
    r"|\b(?:cannot be resolved|not established|not reliably established|not explicitly stated|does not establish|does not state|does not give)\b"
)


def evidence_chain(events: DataFrame) -> DataFrame:
    """events(task_id, pos, source, argument, value) as evidence: each depends on the one before of its source and argument; only the first needs a need."""
    w = W.partitionBy("task_id", "source", "argument").orderBy("pos")
    before = F.lag("pos").over(w)
    out = events.withColumns({"evidence_id": F.concat(F.lit("e"), "pos"), "_before": before})
    return out.select("task_id", "pos", "evidence_id", "source", "argument", "value", F.array_compact(F.array("_before")).alias("depends_on"), F.col("_before").isNull().alias("requires_need"))


def causal_stages(evidence: DataFrame) -> DataFrame:
    """(task_id, stage, contracts, arrived): what each stage may ask for; no value that hasn't arrived stands in it, and no answer."""
    stage = F.coalesce(F.array_max("depends_on") + 1, F.lit(0))
    contract = F.struct("pos", "evidence_id", "source", "argument")
    return evidence.withColumn("stage", stage).groupBy("task_id", "stage").agg(F.array_sort(F.collect_list(contract)).alias("contracts"), F.min("pos").alias("first_pos"))


def visible_tasks(tasks: DataFrame) -> DataFrame:
    """tasks without what a teacher may not see."""
    return tasks.drop("reference_answer")


def persistent_roots(evidence: DataFrame) -> DataFrame:
    """(task_id, evidence_id, root): the first evidence of the chain of equal source and argument."""
    w = W.partitionBy("task_id", "source", "argument").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return evidence.select("task_id", "evidence_id", F.first("evidence_id").over(w).alias("root"))


def _reason(df: DataFrame, text) -> DataFrame:
    return df.select("task_id", (text if not isinstance(text, str) else F.lit(text)).alias("reason"))


@F.pandas_udf(BooleanType())
def _holds(text: pd.Series, marker: pd.Series) -> pd.Series:
    """Does the text hold the marker with no word character on either side; by plain search, no pattern is compiled."""

    def one(t: str | None, m: str | None) -> bool:
        at = t.find(m) if t and m else -1
        while at >= 0:
            end = at + len(m)
            if not (at and _WORD.match(t[at - 1])) and not (end < len(t) and _WORD.match(t[end])):
                return True
            at = t.find(m, at + 1)
        return False

    return pd.Series([one(t, m) for t, m in zip(text, marker, strict=True)], dtype=bool)


_WORD = re.compile(r"\w")
_NUMBER = "^[-+]?[0-9]+(\\.[0-9]+)?$"


def _marked(df: DataFrame, text: str) -> DataFrame:
    """df with `_tokens`: the text's words, and its numbers as `#n`; what holds a marker has all of the marker's tokens."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    return df.withColumn("_tokens", F.array_distinct(F.concat(words, F.transform(number_tokens(text), lambda n: F.concat(F.lit("#"), n)))))


def _wanted(df: DataFrame, marker: str) -> DataFrame:
    """df with `_number` (the marker as a number, null if it is none) and `_tokens`, the tokens that a text must have."""
    plain = F.replace(F.col(marker), F.lit(","), F.lit(""))
    number = F.when(plain.rlike(_NUMBER), F.ltrim(plain, F.lit("+")))
    words = F.regexp_extract_all(marker, F.lit(r"(?U)\w+"), F.lit(0))
    return df.withColumn("_number", number).withColumn("_tokens", F.when(F.col("_number").isNotNull(), F.array(F.concat(F.lit("#"), "_number"))).otherwise(words))


def marker_hits(texts: DataFrame, markers: DataFrame, by: str, text: str, marker: str) -> DataFrame:
    """Pairs of rows of texts and markers with the same `by` whose text holds the marker: a number as a number, all else at word boundaries.

    Of a marker's tokens the one that the fewest texts have is joined, so a text meets the markers that it might hold and no
    others, however many there are. Markers without a word or number are nowhere. Columns of both sides are kept; the text side's
    names must differ from the marker side's, but for `by`.
    """
    held = materialize(_marked(texts, text).withColumn("_text_id", F.monotonically_increasing_id()), "marker-texts")  # numbers differ where a side is computed again
    index = held.select(by, "_text_id", F.explode("_tokens").alias("_token"))
    often = index.groupBy(by, "_token").agg(F.count("*").alias("_n"))
    asked = materialize(_wanted(markers, marker).withColumn("_marker_id", F.monotonically_increasing_id()), "markers")
    every = asked.select(by, "_marker_id", F.explode("_tokens").alias("_token")).join(often, [by, "_token"], "left")
    rare = every.groupBy(by, "_marker_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("t"))).alias("r")).filter("r.n > 0").select(by, "_marker_id", F.col("r.t").alias("_token"))
    pairs = rare.join(index, [by, "_token"]).select(by, "_marker_id", "_text_id")
    met = pairs.join(asked.drop("_tokens"), [by, "_marker_id"]).join(held.drop("_tokens"), [by, "_text_id"])
    return met.filter(F.col("_number").isNotNull() | _holds(text, F.when(F.col("_number").isNull(), F.col(marker)))).drop("_marker_id", "_text_id", "_number")


def leaks(frames: DataFrame, cells: DataFrame, evidence: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, phase, evidence_id): frames that tell a value before it arrives.

    Evidence p is there from the frame after it on, all of it in a final frame. A value doesn't count that stands in what the
    task shows from the start (the prompt, and `shown` where tasks have it), or in a value that has arrived by then.
    Frames meet values through the rarest word of each (`marker_hits`), and arrived values meet those that leaked only.
    """
    told = cells.groupBy("task_id", "phase").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("cells"))
    text = frames.join(told, ["task_id", "phase"], "left").select("task_id", "phase", "frame_pos", normalized_text(F.concat_ws(" ", "display", "cells")).alias("told"))
    value = evidence.select("task_id", "pos", "evidence_id", normalized_text("value").alias("marker")).filter("length(marker) >= 3")
    future = marker_hits(text, value, "task_id", "told", "marker").filter((F.col("frame_pos") <= F.col("pos")) & (F.col("phase") != "final"))
    base = F.concat_ws(" ", "prompt", "shown") if "shown" in tasks.columns else F.col("prompt")
    asked = tasks.select("task_id", normalized_text(base).alias("asked"))
    future = materialize(future.join(asked, "task_id").filter(~F.contains("asked", F.col("marker"))).select("task_id", "phase", "frame_pos", "pos", "evidence_id", "marker"), "leaks")
    arrived = value.select("task_id", F.col("pos").alias("seen_pos"), F.col("marker").alias("seen")).join(future.select("task_id").distinct(), "task_id", "left_semi")
    excused = marker_hits(arrived, future, "task_id", "seen", "marker").filter("seen_pos < frame_pos").select("task_id", "phase", "evidence_id").distinct()
    return future.join(excused, ["task_id", "phase", "evidence_id"], "left_anti").select("task_id", "phase", "evidence_id").distinct()


def reference_reasons(tasks: DataFrame, plans: DataFrame) -> DataFrame:
    """(task_id, reason) for every answer that has a reference: why it isn't that, by the rules of the task's kind; null if it is, and for other kinds.

    Questions: names and numbers as in `with_answer_match`; where the answer says that the evidence doesn't do, what stands
    before that must be the answer as well. Word problems: that, or the last number. Competition problems: equal in
    meaning (not merely undecided), or that, or the letter of an option that is.
    """
    rows = plans.select("task_id", "final_answer").join(tasks.filter("reference_answer is not null").select("task_id", "prompt", "task_kind", "reference_answer"), "task_id")
    return _with_reason(rows).select("task_id", "reason")  # unfiltered: a filter would be pushed down with all the rules copied into it


def _with_reason(rows: DataFrame) -> DataFrame:
    """rows (final_answer, prompt, task_kind, reference_answer, others) with `reason`, by the rules of `reference_reasons`."""
    columns = rows.columns
    lacks = F.regexp_like("final_answer", F.lit(f"(?i){INSUFFICIENT}"))
    before = F.regexp_replace(F.regexp_extract("final_answer", f"(?is)^(.*?)(?:{INSUFFICIENT})", 1), r"^[ ,.;:-]+|[ ,.;:-]+$", "")
    rows = rows.withColumn("_lacks", lacks).withColumns({"_before": F.when(F.col("_lacks"), before), "_meets": F.when(F.col("_lacks"), F.col("reference_answer"))})
    rows = with_answer_match(with_answer_match(rows, "final_answer", "reference_answer", "_same"), "_before", "_meets", "_supported")
    last = lambda c: F.try_element_at(number_tokens(c), F.lit(-1))
    math = F.col("task_kind") == COMPETITION
    rows = rows.withColumn("_plain", F.when(math, ratio_verdict("final_answer", "reference_answer")))
    asks = lambda x: math & ~F.coalesce("_same", F.lit(False)) & F.col("_plain").isNull() & x.isNotNull()  # noqa: E731  of others no verdict is asked
    verdict = lambda x: F.coalesce(math_verdict(F.when(asks(x), x), F.when(asks(x), F.col("reference_answer"))) == "equal", F.lit(False))
    asked = F.when(F.col("_lacks"), (F.col("_before") != "") & F.coalesce("_supported", F.lit(False)) & F.col("_same")).otherwise(F.col("_same"))
    number = F.col("_same") | F.coalesce(last("final_answer") == last("reference_answer"), F.lit(False))
    meant = F.col("_same") | F.coalesce(F.col("_plain") == "equal", F.lit(False)) | verdict(F.col("final_answer")) | verdict(chosen_option("prompt", "final_answer"))
    text = lambda kind: F.lit(f"final_answer does not match the public {kind}reference answer")
    wrong = F.when(F.col("task_kind").isin(*QA_KINDS) & ~asked, text("")).when((F.col("task_kind") == WORD_PROBLEM) & ~number, text("numerical ")).when(math & ~meant, text("competition-math "))
    return rows.select(*columns, wrong.alias("reason"))


def argument_reasons(needs: DataFrame, evidence: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(task_id, reason) for the needs whose `arguments` (a map) lack one that their source requires, or have another than the evidence.

    descriptors: (source, argument, required). Needs of unknown evidence or of an unknown source are `contract_reasons`' matter.
    """
    given = evidence.select("task_id", "evidence_id", F.col("arguments").alias("_given"))
    rows = needs.join(given, ["task_id", "evidence_id"]).join(descriptors.filter("required").select("source", F.col("argument").alias("_name")).distinct(), "source")
    own, other = F.try_element_at("arguments", F.col("_name")), F.try_element_at("_given", F.col("_name"))
    has = lambda m: F.coalesce(F.array_contains(F.map_keys(m), F.col("_name")), F.lit(False))
    name = F.concat(F.lit(" '"), "_name", F.lit("'"))
    lacks = lambda kind, key: F.concat(F.lit(f"{kind} "), key, F.lit(" is missing required argument"), name)
    reason = F.when(~has("arguments"), lacks("need", "need_id")).when(~has("_given"), lacks("evidence", "evidence_id")).when(~own.eqNullSafe(other), F.concat(F.lit("need "), "need_id", F.lit(" argument"), name, F.lit(" does not match supplied evidence")))
    return rows.select("task_id", reason.alias("reason")).filter("reason is not null")


def contract_reasons(needs: DataFrame, evidence: DataFrame, descriptors: DataFrame, frames: DataFrame, cells: DataFrame) -> DataFrame:
    """(task_id, reason): the first rule that a need breaks: its evidence and source are known, the source is the evidence's, its phase has a frame, its cell is in it."""
    known = evidence.select("task_id", "evidence_id", F.col("source").alias("_source"))
    sources = descriptors.select("source").distinct().withColumn("_named", F.lit(True))
    phases = frames.select("task_id", "phase").distinct().withColumn("_framed", F.lit(True))
    placed = cells.select("task_id", "phase", "cell_id").distinct().withColumn("_placed", F.lit(True))
    rows = needs.join(known, ["task_id", "evidence_id"], "left").join(sources, "source", "left").join(phases, ["task_id", "phase"], "left").join(placed, ["task_id", "phase", "cell_id"], "left")
    quoted = lambda text, c: F.concat(F.lit(text + " '"), F.col(c), F.lit("'"))
    reason = (
        F.when(F.col("_source").isNull(), quoted("teacher need references unknown evidence", "evidence_id")).when(F.col("_named").isNull(), quoted("teacher need references unknown source", "source"))
        .when(F.col("_source") != F.col("source"), "teacher need source must match its evidence source").when(F.col("_framed").isNull(), quoted("teacher need references unknown phase", "phase"))
        .when(F.col("_placed").isNull(), "teacher need target cell must exist in its activation phase")
    )
    return rows.select("task_id", reason.alias("reason")).filter("reason is not null")


def first_accepted(tasks: DataFrame, variants: DataFrame) -> DataFrame:
    """(task_id, variant, final_answer): of each task's variants (task_id, variant, final_answer) the first whose answer is judged right; null if none is.

    All variants are judged at once, by the rules of the task's kind; nothing is tried one after the other.
    """
    rows = _with_reason(variants.join(tasks.select("task_id", "prompt", "task_kind", "reference_answer"), "task_id"))
    best = F.min(F.when(F.col("reference_answer").isNull() | F.col("reason").isNull(), F.struct("variant", "final_answer")))
    return rows.groupBy("task_id").agg(best.alias("b")).select("task_id", "b.variant", "b.final_answer")


def review(tasks: DataFrame, evidence: DataFrame, plans: DataFrame, frames: DataFrame, cells: DataFrame, needs: DataFrame) -> DataFrame:
    """(task_id, accepted, reasons, fingerprint, duplicate_of) for every plan.

    Each rule is a table of (task_id, reason); reasons are distinct and sorted. The first plan of a fingerprint, in
    task order, makes later ones duplicates of it, also where it is itself rejected.
    """
    found = []
    # the reasons' texts are fixed values: those who read reviews compare them
    per = evidence.join(needs.select("task_id", "evidence_id", "need_id", F.col("argument").alias("_arg"), "freshness"), ["task_id", "evidence_id"], "left")
    count = per.groupBy("task_id", "evidence_id", "requires_need").agg(F.count("need_id").alias("n"))
    found.append(_reason(count.filter("requires_need and n <> 1"), F.concat(F.lit("evidence "), "evidence_id", F.lit(" requires exactly one activating need"))))
    found.append(_reason(count.filter("not requires_need and n > 0"), F.concat(F.lit("evidence "), "evidence_id", F.lit(" reuses a persistent binding and must not create a new need"))))
    found.append(_reason(per.filter("need_id is not null and not (argument <=> _arg)"), F.concat(F.lit("need "), "need_id", F.lit(" does not match supplied evidence"))))
    roots = persistent_roots(evidence).filter("root <> evidence_id").select("task_id", F.col("root").alias("evidence_id")).distinct()
    found.append(_reason(roots.join(needs.filter("freshness <> 'always'"), ["task_id", "evidence_id"]), F.concat(F.lit("need "), "need_id", F.lit(" must use freshness always"))))
    found.append(_reason(needs.join(evidence.select("task_id", "evidence_id"), ["task_id", "evidence_id"], "left_anti"), F.concat(F.lit("need "), "need_id", F.lit(" has unknown evidence"))))
    allowed = evidence.select("task_id", F.concat(F.lit("after:"), "evidence_id").alias("phase"))
    found.append(_reason(allowed.join(frames, ["task_id", "phase"], "left_anti"), F.concat(F.lit("missing evidence frame "), "phase")))
    extra = frames.filter("phase not in ('initial', 'pre', 'final') and phase not like 'refine:%'").join(allowed, ["task_id", "phase"], "left_anti")
    found.append(_reason(extra, F.concat(F.lit("unsupported phase "), "phase")))
    refine = frames.filter("phase like 'refine:%'").groupBy("task_id").agg(F.max(F.element_at(F.split("phase", ":"), 2).cast("int")).alias("m"), F.count("*").alias("k"))
    found.append(_reason(refine.filter("m + 1 <> k"), "refinement phases are not contiguous"))
    last = frames.groupBy("task_id").agg(F.max_by("display", "frame_pos").alias("display"), F.max_by("phase", "frame_pos").alias("phase"))
    found.append(_reason(last.join(plans, "task_id").filter("trim(display) <> trim(final_answer)"), "final frame display does not match final_answer"))
    concluded = cells.filter("role = 'conclusion' and weight > 0").select("task_id", "phase").distinct()
    found.append(_reason(last.join(concluded, ["task_id", "phase"], "left_anti"), "final frame has no conclusion-role cell"))
    found.append(reference_reasons(tasks, plans))
    found.append(_reason(leaks(frames, cells, evidence, tasks), F.concat(F.lit("phase '"), "phase", F.lit("' leaks future evidence '"), "evidence_id", F.lit("'"))))
    gone = cells.join(frames.select("task_id", "phase", "frame_pos"), ["task_id", "phase"]).groupBy("task_id", "cell_id").agg(F.min("frame_pos").alias("a"), F.max("frame_pos").alias("b"), F.count_distinct("frame_pos").alias("n"))
    found.append(_reason(gone.filter("b - a + 1 <> n"), F.concat(F.lit("cell "), "cell_id", F.lit(" vanishes without retirement"))))
    reasons = found[0]
    for f in found[1:]:
        reasons = reasons.unionByName(f)
    by_task = reasons.groupBy("task_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    shape = frames.groupBy("task_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("frame_pos", "phase", "display")))).alias("f"))
    print_ = plans.join(tasks.select("task_id", "prompt"), "task_id").join(shape, "task_id", "left").select("task_id", stable_hash(joined("prompt", "final_answer", "f")).alias("fingerprint"))
    first = F.first("task_id").over(W.partitionBy("fingerprint").orderBy("task_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = print_.withColumn("_first", first).join(by_task, "task_id", "left")
    dup = F.when(F.col("_first") != F.col("task_id"), F.col("_first"))
    all_reasons = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array_compact(F.array(F.when(dup.isNotNull(), F.concat(F.lit("duplicate of "), "_first")))))
    return out.select("task_id", (F.size(all_reasons) == 0).alias("accepted"), all_reasons.alias("reasons"), "fingerprint", dup.alias("duplicate_of"))


def schedule(evidence: DataFrame, seed: int, variants: int, longest: int = 4) -> DataFrame:
    """(example_id, task_id, pos, launch, arrive): arrivals of each variant; delays are hash draws.

    Evidence arrives after what it depends on and after the item before it: arrive(p) = max(launch + delay, arrive(p - 1) + 1).
    With launch(p) = arrive of the last dependency, the recurrence is folded over the task's ordered items.
    """
    v = evidence.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    delay = (F.floor(hash_unit(F.lit(seed), "task_id", "variant", "pos") * longest).cast("long") + 1).alias("delay")
    item = F.struct("pos", delay, F.array_max("depends_on").alias("dep"), "evidence_id")
    by = v.groupBy("task_id", "variant").agg(F.array_sort(F.collect_list(item)).alias("items"))
    launch = "coalesce(element_at(filter(acc, y -> y.pos = x.dep), 1).arrive, 0L)"
    fold = f"aggregate(items, cast(array() as array<struct<pos:bigint,evidence_id:string,launch:bigint,arrive:bigint>>), (acc, x) -> concat(acc, array(struct(cast(x.pos as bigint) as pos, x.evidence_id as evidence_id, {launch} as launch, greatest({launch} + x.delay, coalesce(try_element_at(acc, -1).arrive + 1, 0L)) as arrive))))"
    fold = fold.replace("element_at(filter", "try_element_at(filter")
    out = by.withColumn("s", F.explode(F.expr(fold)))
    return out.select(F.format_string("%s::schedule-%02d", "task_id", "variant").alias("example_id"), "task_id", "s.pos", "s.evidence_id", "s.launch", "s.arrive")


def compile_plans(accepted: DataFrame, evidence: DataFrame, frames: DataFrame, seed: int, variants: int) -> DataFrame:
    """(example_id, task_id, step, waiting, display): the accepted tasks' frames over steps: at each step the frame of the last arrival, and how much is under way."""
    own = accepted.filter("accepted").select("task_id")
    plan = schedule(evidence.join(own, "task_id", "left_semi"), seed, variants)
    horizon = plan.groupBy("example_id", "task_id").agg(F.max("arrive").alias("end"), F.array_sort(F.collect_list(F.struct("arrive", "launch", "evidence_id"))).alias("s"))
    steps = horizon.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end"))))
    arrived = F.filter("s", lambda x: x["arrive"] <= F.col("step"))
    phase = F.when(F.size(arrived) == 0, "initial").otherwise(F.concat(F.lit("after:"), F.try_element_at(arrived, F.lit(-1))["evidence_id"]))
    waiting = F.size(F.filter("s", lambda x: (x["launch"] < F.col("step")) & (F.col("step") < x["arrive"])))
    at = steps.select("example_id", "task_id", "step", waiting.alias("waiting"), phase.alias("phase"))
    return at.join(frames.select("task_id", "phase", "display"), ["task_id", "phase"], "left").select("example_id", "task_id", "step", "waiting", "display")

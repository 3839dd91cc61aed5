"""The event-driven runtime as keyed state: needs become bindings, bindings share reads, observations become available.

One state machine, `advance`, serves both forms: a batch replay (applyInPandas over each case's ordered rows) and a
stream (applyInPandasWithState, state kept by Spark). Rows are `case_id, seq, kind, need_id, source, argument, value`
with kind `need`, `observe`, `retire` or `step`; the output is the trace, one row a transition.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INPUT = "case_id long, seq long, kind string, need_id string, source string, argument string, value string"
TRACE = "case_id long, seq long, event string, binding_id string, need_id string, work_key string, generation int, detail string"
STATE = "state string"


def new_state() -> dict:
    return {"serial": 0, "by_need": {}, "cache": {}, "reads": {}}


def work_key(source: str, argument: str) -> str:
    return f"{source}:{json.dumps({'argument': argument}, separators=(',', ':'))}"


def advance(state: dict, case_id: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Apply rows (seq, kind, need_id, source, argument, value) in order; yields trace rows.

    A need that comes again with other arguments loses its observation and starts a new generation; with another
    source it is retired and a new binding made. Bindings with one work key share a read; a value that is known for
    the key is a cache hit. An observation goes to all active bindings of its key; an unchanged value is no update.
    """
    by_need = state["by_need"]
    for seq, kind, need, source, argument, value in rows:
        if kind == "need":
            b = by_need.get(need)
            if b is None or b["source"] != source:
                if b is not None:
                    yield case_id, seq, "binding_retired", b["id"], need, b["key"], b["generation"], "source changed"
                state["serial"] += 1
                b = by_need[need] = {"id": f"b{state['serial']}", "source": source, "key": work_key(source, argument), "generation": 0, "status": "active", "value": None}
                yield case_id, seq, "binding_active", b["id"], need, b["key"], 0, None
            else:
                key = work_key(source, argument)
                b["generation"] += 1
                if key != b["key"]:
                    b |= {"key": key, "value": None, "status": "active"}
                    yield case_id, seq, "observation_invalidated", b["id"], need, key, b["generation"], None
                if b["status"] == "retired":
                    b["status"] = "active"
            if b["value"] is None:
                if b["key"] in state["cache"]:
                    b |= {"value": state["cache"][b["key"]], "status": "available"}
                    yield case_id, seq, "cache_hit", b["id"], need, b["key"], b["generation"], b["value"]
                elif b["key"] in state["reads"]:
                    yield case_id, seq, "job_deduplicated", b["id"], need, b["key"], b["generation"], state["reads"][b["key"]]
                else:
                    state["reads"][b["key"]] = b["id"]
                    yield case_id, seq, "external_refresh_started", b["id"], need, b["key"], b["generation"], None
        elif kind == "observe":
            key = work_key(source, argument)
            state["cache"][key] = value
            if state["reads"].pop(key, None):
                yield case_id, seq, "external_refresh_finished", None, None, key, 0, value
            for n, b in by_need.items():
                if b["key"] == key and b["status"] != "retired" and b["value"] != value:
                    b |= {"value": value, "status": "available"}
                    yield case_id, seq, "binding_observation_updated", b["id"], n, key, b["generation"], value
        elif kind == "retire":
            for n, b in by_need.items():
                if (need is None or n == need) and b["status"] != "retired":
                    b["status"] = "retired"
                    yield case_id, seq, "binding_retired", b["id"], n, b["key"], b["generation"], "absent"
            live = {b["key"] for b in by_need.values() if b["status"] != "retired"}
            for key in [k for k in state["reads"] if k not in live]:
                yield case_id, seq, "external_refresh_cancelled", state["reads"].pop(key), None, key, 0, None
        elif kind == "step":
            for n, b in by_need.items():
                if b["status"] == "available":
                    yield case_id, seq, "cognitive_projection", b["id"], n, b["key"], b["generation"], b["value"]


_COLUMNS = [c.split()[0] for c in TRACE.split(", ")]
_ROW = ["seq", "kind", "need_id", "source", "argument", "value"]


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("seq", kind="stable")[_ROW]
    return [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)]


def _trace(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=_COLUMNS).astype({"case_id": "int64", "seq": "int64", "generation": "int32"})


def replay(rows: DataFrame) -> DataFrame:
    """Trace of each case from its ordered rows. A case is one run, bounded by its number of steps."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _trace(list(advance(new_state(), int(key[0]), _rows(pdf))))

    return rows.groupBy("case_id").applyInPandas(one, TRACE)


def stream(rows: DataFrame) -> DataFrame:
    """The same trace over a stream. Rows of a case must arrive in order of seq from one micro-batch to the next."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else new_state()
        got = pd.concat(list(parts))
        out = list(advance(own, int(key[0]), _rows(got)))
        state.update((json.dumps(own),))
        yield _trace(out)

    return rows.groupBy("case_id").applyInPandasWithState(one, TRACE, STATE, "append", "NoTimeout")


def from_events(events: DataFrame) -> DataFrame:
    """The driver's events as runtime rows: views and clicks are needs, purchases observations, errors retire."""
    kind = F.when(F.col("event_type").isin("view", "click"), "need").when(F.col("event_type") == "purchase", "observe").when(F.col("event_type") == "error", "retire").otherwise("step")
    argument = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(3)).cast("string")
    need = F.when(F.col("event_type").isin("view", "click"), F.concat_ws(":", "event_type", F.pmod("event_id", F.lit(2))))
    source = F.when(F.pmod("event_id", F.lit(11)) == 0, "archive").otherwise("live")
    return events.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), kind.alias("kind"), need.alias("need_id"), source.alias("source"), argument.alias("argument"), F.col("value").cast("string").alias("value"))

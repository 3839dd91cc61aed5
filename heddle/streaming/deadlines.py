"""Cases that fall silent: deadlines as the ends of session windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def deadlines(stream: DataFrame, case: str, time: str, limit: str, late: str) -> DataFrame:
    """(case, silent_since, deadline, events): a row whenever a case has had no event for longer than `limit`, once the watermark
    (`late` behind the latest event) has reached that; events counts those since the case began or was last silent.

    An event before the deadline puts it off, in whatever order events come; one whose own deadline the watermark has
    reached is dropped by Spark. State is one row for each stretch of a case that may still be joined, and goes with its
    deadline. What is not silent yet has no row. Rows with a null case or time are left out; times count in milliseconds.

    Spark joins an event at a session's very end to it, as is meant here.
    """
    at = F.timestamp_millis(F.unix_millis(F.col(time).cast("timestamp")))
    rows = stream.select(F.col(case).cast("string").alias("case"), at.alias("ts")).filter("case is not null and ts is not null")
    rows = rows.withWatermark("ts", f"{_ms(late)} milliseconds")
    silent = rows.groupBy(F.session_window("ts", f"{_ms(limit)} milliseconds"), "case").agg(F.max("ts").alias("silent_since"), F.count("*").alias("events"))
    return silent.select("case", "silent_since", F.timestamp_millis(F.unix_millis("silent_since") + _ms(limit)).alias("deadline"), "events")

"""Keyed state over streams: session risk, flag counts, token windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlake.operators.analytics import blast_radius, flag_milestones

# In hundredths, so that sums are exact.
COSTS = {"irreversible_action": 50, "reversible_write": 25, "read_only": 5}
LIMITS = {"irreversible_action": 70, "reversible_write": 60, "read_only": 1 << 40}
OTHERWISE = {"irreversible_action": "escalate", "reversible_write": "allow", "read_only": "allow"}
FULL = 100
RISK_OUT = "event_id long, session_id long, tool_name string, blast_radius string, risk_before double, guard_verdict string"


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Risk before each call: what earlier requests cost, at most one, and what this request has cost so far."""
    if state.hasTimedOut:
        state.remove()
        return
    carried, request = state.get if state.exists else (0, None)
    rows = pd.concat(list(batches)).sort_values(["request_id", "ts", "event_id"])
    cost = rows["blast_radius"].map(COSTS)
    of_request = cost.groupby(rows["request_id"], sort=False)
    spent = of_request.sum()
    base = (carried + spent.cumsum() - spent).clip(upper=FULL)
    if base.index[0] == request:
        base.iloc[0] = carried  # the request goes on; only a new one begins with the capped sum
    risk = rows["request_id"].map(base) + of_request.cumsum() - cost
    over = risk > rows["blast_radius"].map(LIMITS)
    state.update((int(risk.iloc[-1] + cost.iloc[-1]), int(rows["request_id"].iloc[-1])))
    if keep_ms is not None:
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
    out = rows[["event_id", "tool_name", "blast_radius"]].assign(session_id=key[0], risk_before=risk / 100, guard_verdict=rows["blast_radius"].map(OTHERWISE).mask(over, "block"))
    yield out[["event_id", "session_id", "tool_name", "blast_radius", "risk_before", "guard_verdict"]]


def session_risk(calls: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Tool verdicts with the session's risk carried across batches.

    State per session is one number and the last request. Rows of a session in a batch are those that arrived since
    the last trigger; the trigger's input limit bounds them. With ``keep_ms``, calls carry a watermark on ``ts``, and a
    session is forgotten so long after its last call; calls later than the watermark are then dropped.
    """
    judged = calls.withColumn("blast_radius", blast_radius(F.col("tool_name")))
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.EventTimeTimeout
    return judged.groupBy("session_id").applyInPandasWithState(
        partial(_judge, keep_ms=keep_ms), RISK_OUT, "risk long, request long", "append", timeout
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    """Running totals per day, updated by every batch; milestones follow by summing the days.

    Days instead of one global counter keep the state spread; the aggregate
    combines before the shuffle.
    """
    return flags.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("flags"))


def milestone_step(path: str, every: int = 10) -> Callable[[DataFrame, int], None]:
    """A batch function that writes a row (flag_number, event_id) at exactly every tenth flag since the stream began.

    The counter is a table: each batch writes its number of flags to ``path``/counts under its own id and reads those before
    it, so a batch that is repeated after a failure or restart gives the same rows in the same place. Flags of a
    batch are numbered by time and id.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        flags = batch.where(F.col("decision_action") == "flag").select("event_id", "created_at", "decision_action")
        flags.agg(F.count(F.lit(1)).alias("flags")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        counts = spark.read.option("basePath", f"{path}/counts").schema("flags long, batch long").parquet(f"{path}/counts")
        before = counts.where(F.col("batch") < batch_id).agg(F.coalesce(F.sum("flags"), F.lit(0)).alias("n")).first()["n"]
        number = F.col("flag_count") + before
        due = flag_milestones(flags).select(number.alias("flag_number"), "event_id").where(number % every == 0)
        due.write.mode("overwrite").parquet(f"{path}/due/batch={batch_id}")

    return step

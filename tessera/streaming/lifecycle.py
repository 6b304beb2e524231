"""The lifecycle as a stream: one state an object, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.model import TRANSITIONS

_OUT = "object_id long, state string, n_steps long"


def _guarded(steps: DataFrame, guard: Column | None) -> DataFrame:
    """Adds ``allowed``, whether a trigger may move its object; a guard that is null says no."""
    return steps.select("object_id", "ts", "seq", "trigger", (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))).alias("allowed"))


def _walk(now: str, n: int, rows: pd.DataFrame, table: dict[tuple[str, str], str]) -> tuple[str, int]:
    for trigger, allowed in zip(rows["trigger"], rows["allowed"]):
        now, n = table.get((trigger, now), now) if allowed else now, n + 1
    return now, n


def states(steps: DataFrame, start: str = "Pending", guard: Column | None = None) -> DataFrame:
    """(object_id, state, n_steps) after every micro-batch of (object_id, ts, seq, trigger).

    Triggers of a micro-batch are applied in the order of (ts, seq); one that
    arrives in a later micro-batch is applied later. A state is two values,
    whatever the object's history.
    """
    table = {(t, a): b for t, a, b in TRANSITIONS}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (start, 0)
        now, n = _walk(now, n, pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable"), table)
        state.update((now, n))
        yield pd.DataFrame({"object_id": [key[0]], "state": [now], "n_steps": [n]})

    rows = _guarded(steps, guard)
    return rows.groupBy("object_id").applyInPandasWithState(run, _OUT, "state string, n_steps long", "update", GroupStateTimeout.NoTimeout)


def states_in_order(steps: DataFrame, lateness: str, start: str = "Pending", guard: Column | None = None) -> DataFrame:
    """As ``states``, but in the order of event time over all micro-batches.

    A trigger waits in its object's state until the watermark, ``lateness`` behind
    the latest ts seen, has passed it; then all that are due are applied in the
    order of (ts, seq). One that comes later than that is dropped by the
    watermark. What waits is what ``lateness`` holds of an object's triggers.
    """
    table = {(t, a): b for t, a, b in TRANSITIONS}
    empty = {"ts": [], "seq": [], "trigger": [], "allowed": []}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n, *held = state.get if state.exists else (start, 0, *empty.values())
        waiting = pd.DataFrame({c: list(v) for c, v in zip(empty, held)})
        mark = state.getCurrentWatermarkMs()
        parts = [waiting]
        if not state.hasTimedOut:
            for b in batches:
                parts.append(pd.DataFrame({"ts": (b["ts"].astype("datetime64[us]").astype("int64")), "seq": b["seq"], "trigger": b["trigger"], "allowed": b["allowed"]}))
        rows = pd.concat([p for p in parts if len(p)] or [waiting]).sort_values(["ts", "seq"], kind="stable")
        due = rows["ts"] <= mark * 1000
        if due.any():
            now, n = _walk(now, n, rows[due], table)
            yield pd.DataFrame({"object_id": [key[0]], "state": [now], "n_steps": [n]})
        rest = rows[~due]
        state.update((now, n, *[rest[c].tolist() for c in empty]))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["ts"].iloc[0]) // 1000, mark + 1))

    kept = "state string, n_steps long, ts array<long>, seq array<long>, trigger array<string>, allowed array<boolean>"
    rows = _guarded(steps, guard).withWatermark("ts", lateness)
    return rows.groupBy("object_id").applyInPandasWithState(run, _OUT, kept, "update", GroupStateTimeout.EventTimeTimeout)


def transitions(steps: DataFrame, path: str, checkpoint: str):
    """A running query that appends the topics of triggers to ``path``."""
    from tessera.functions.hashing import topic

    rows = steps.select("object_id", "ts", "seq", topic("trigger").alias("topic"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()

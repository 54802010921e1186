"""Logs of applications: which changes hold, and the state after each, by composing what ranges of a log do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored, text_batches
from .ranks import ordered_parts

# The states of an application, its results, and old names of either.
STATUSES = ("interested", "preparing", "applied", "interview", "final")
RESULTS = ("accepted", "rejected", "withdrawn", "closed")
OLD_STATUSES = {"result": "final"}
OLD_RESULTS = {"expired": "closed"}

#: No application, one in each status, and final with each result.
STATES: tuple[tuple[str | None, str | None], ...] = ((None, None), *((s, None) for s in STATUSES), *(("final", r) for r in RESULTS))
_AT = {s: k for k, s in enumerate(STATES)}
_SAME = tuple(range(len(STATES)))

#: Columns that an event may set beside status and result; an empty text clears one.
_FIELDS = ("note", "next_action", "due_at", "applied_at", "interview_at")


@lru_cache(maxsize=4096)
def transition(action: str | None, status: str | None, result: str | None) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """What an event makes of each state, and whether it holds there.

    A null status or result is not part of the change, an empty result clears it. An unknown status or result is refused, and
    so is a result in any status but final, also one that a change away from final would leave behind. A removal ends the application.
    """
    if action == "remove":
        return (0,) * len(STATES), (True,) * len(STATES)
    to, holds = [], []
    for k, (now, had) in enumerate(STATES):
        then = OLD_STATUSES.get(status, status) if status is not None else now or STATUSES[0]
        asked = had if result is None else OLD_RESULTS.get(result, result) or None
        fine = then in STATUSES and (asked is None or (asked in RESULTS and then == "final"))
        to.append(_AT[then, asked] if fine else k)
        holds.append(fine)
    return tuple(to), tuple(holds)


def application_log(events: DataFrame, *, keys: Sequence[str] = ("user_id", "job_key"), order: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """Events with ``accepted`` and the status (``status_after``, null without an application) and result (``result_after``) after each.

    events have the keys, the order, status, final_result and, if removals are among them, action (``remove``). An event is a function
    on ten states, and functions compose in any grouping: the log is dealt in ranges of (key, order), each range
    says what it does to the key it begins with and the one it ends with, those few rows compose along the ranges, and each range
    then replays from the state it is handed. So a log of any length is spread over tasks. Events with a null key
    are a log of their own. Ties of the order are taken as they are sorted by status and result.
    """
    text_batches(events.sparkSession, 5000)
    action = F.col("action") if "action" in events.columns else F.lit(None).cast("string")
    named = events.withColumns({"_key": F.to_json(F.struct(*keys)), "_action": action})
    by = [F.col("_key"), *[F.col(c) for c in order], F.col("status"), F.col("final_result")]
    parts = ordered_parts(named, by, "applications")
    lead = ["part", "_key", "_action", "status", "final_result"]
    dealt = parts.repartition("part").sortWithinPartitions("part", *by)

    def steps(b: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in lead), strict=True)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the first and last key of each range: what the range does to each state of it."""
        out: list[tuple] = []
        now, does, first = None, _SAME, True

        def close(last: bool) -> None:
            if now is not None and (first or last):
                out.append((*now, list(does)))

        for b in batches:
            for part, key, act, status, result in steps(b):
                if (part, key) != now:
                    close(now is not None and now[0] != part)
                    first = now is None or now[0] != part
                    now, does = (part, key), _SAME
                to = transition(act, status, result)[0]
                does = tuple(to[s] for s in does)
        close(True)
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "_key", "does"])

    ends = stored(dealt.select(*lead).mapInArrow(effects, "part int, _key string, does array<int>"), "applications-ends")
    steps_of = F.array_sort(F.collect_list(F.struct("part", "does")))  # one for each range that the key spans
    runs = ends.groupBy("_key").agg(steps_of.alias("runs")).where(F.size("runs") > 1)
    before = lambda p: F.aggregate(F.filter("runs", lambda r: r["part"] < p), F.lit(0), lambda s, r: F.get(r["does"], s))
    starts = runs.select("_key", "runs", F.explode("runs.part").alias("part")).select("part", "_key", before(F.col("part")).alias("_start"))
    fields = events.schema.fields
    schema = T.StructType([*fields, T.StructField("accepted", T.BooleanType()), T.StructField("status_after", T.StringType()), T.StructField("result_after", T.StringType())])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for b in batches:
            start = b.column(b.schema.get_field_index("_start")).to_pylist()
            flags, after = [], []
            for (part, key, act, status, result), given in zip(steps(b), start, strict=True):
                if (part, key) != now:
                    now, state = (part, key), given or 0
                to, holds = transition(act, status, result)
                flags.append(holds[state])
                state = to[state]
                after.append(STATES[state])
            own = [b.column(b.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(flags, pa.bool_()), pa.array([s for s, _ in after], pa.string()), pa.array([r for _, r in after], pa.string())], schema.names)

    handed = parts.join(F.broadcast(starts), ["part", "_key"], "left")  # a row for each range but the first of a log that spans some
    again = handed.repartition("part").sortWithinPartitions("part", *by)
    return again.mapInArrow(replay, schema)


def application_state(events: DataFrame, *, keys: Sequence[str] = ("user_id", "job_key"), order: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """One row for each application that is not removed: status, final_result, the last value of each other column, created_at, updated_at.

    Only accepted events since the last removal count. An empty text clears a column, null leaves it.
    """
    log = stored(application_log(events, keys=keys, order=order), "applications-log").where("accepted")
    at = F.struct(*order)
    gone = F.coalesce(F.col("action") == "remove", F.lit(False)) if "action" in events.columns else F.lit(False)
    ended = log.where(gone).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(at).alias("_ended"))
    on: Column = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    live = log.join(ended, on, "left").where(~gone & (F.col("_ended").isNull() | (at > F.col("_ended"))))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))["v"]
    cleared = lambda c: (F.nullif(last(c), F.lit("")) if dict(events.dtypes)[c] == "string" else last(c)).alias(c)
    after = F.struct("status_after", "result_after")
    out = live.groupBy(*keys).agg(F.max_by(after, at).alias("_s"), *[cleared(c) for c in _FIELDS if c in events.columns], F.min(order[0]).alias("created_at"), F.max(order[0]).alias("updated_at"))
    return out.withColumns({"status": F.col("_s.status_after"), "final_result": F.col("_s.result_after")}).drop("_s")

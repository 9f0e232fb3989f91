"""Alert rules on streams of bars. A first keyed state remembers the values before, per series and kind of trigger, so
that crosses and changes need no previous columns in the input; rules are then Columns on each row; a second keyed state
holds each rule's cooldown and count, which a timer in event time deletes once the rule has expired.

The state store must be RocksDB (see session.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import alerts
from ..schemas import SERIES
from .keyed import fires

# The kinds of bar events that each kind of trigger listens to.
LISTENS = {
    "bar_close": ["BAR_CLOSED"],
    "bar_update": ["BAR_UPDATED", "BAR_CLOSED", "BAR_AMENDED"],
    "realtime": ["BAR_CREATED", "BAR_UPDATED", "BAR_CLOSED", "BAR_AMENDED"],
}
KEYS = [*SERIES, "interval"]


class Previous(StatefulProcessor):
    """Each event once per kind of trigger that listens to it, with the values of the event before of that kind."""

    def __init__(self, fields: list[str], triggers: list[str]):
        self.fields, self.triggers = fields, triggers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = {t: handle.getValueState(t, ", ".join(f"`{f}` double" for f in self.fields)) for t in self.triggers}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for trigger, state in self.values.items():
            mine = events[events["event_type"].isin(LISTENS[trigger])]
            if mine.empty:
                continue
            values = mine[self.fields].astype("float64")
            before = values.shift(1)
            if state.exists():
                before.iloc[0] = [float("nan") if v is None else v for v in state.get()]
            state.update(tuple(None if pd.isna(v) else float(v) for v in values.iloc[-1]))
            out = mine[["timestamp_ms", "at"]].copy()
            for i, c in enumerate(KEYS):
                out.insert(i, c, key[i])
            out["trigger_on"] = trigger
            # a value that is missing is null, not NaN
            for name, column in [*values.items(), *((alerts.previous(f), before[f]) for f in self.fields)]:
                out[name] = pd.array(column.where(column.notna(), None), dtype="Float64")
            yield out


class Limits(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "last bigint, n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows))
        first = hits.iloc[0]
        whole = lambda v: None if pd.isna(v) else int(v)
        known = self.fired.exists()
        times, state = fires(hits["timestamp_ms"].tolist(), whole(first["cooldownMs"]) or 0, whole(first["maxTriggers"]), whole(first["expiresAt"]), tuple(self.fired.get()) if known else (None, 0))
        if state[1]:
            self.fired.update(state)
        if times and not known and whole(first["expiresAt"]) is not None:
            self.handle.registerTimer(whole(first["expiresAt"]))
        yield pd.DataFrame([(*key, t) for t in times], columns=["rule_id", *KEYS, "triggered_at_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fired.clear()
        return iter(())


def with_previous(events: DataFrame, fields: list[str], triggers: list[str], lateness: str = "1 minute") -> DataFrame:
    """Bar events (KEYS, event_type, timestamp_ms, arrival and the fields) once per trigger that listens to them, with
    previous_<field> of the event before. A missing value, and the one before a series' first event, is null."""
    rows = events.select(*KEYS, "event_type", "timestamp_ms", "arrival", *[F.col(f).cast("double").alias(f) for f in fields])
    rows = rows.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", lateness)
    shape = ", ".join([*(f"`{k}` string" for k in KEYS), "timestamp_ms bigint", "at timestamp", "trigger_on string", *(f"`{f}` double" for f in fields), *(f"`{alerts.previous(f)}` double" for f in fields)])
    return rows.groupBy(*KEYS).transformWithStateInPandas(Previous(fields, triggers), shape, "append", "EventTime", eventTimeColumnName="at")


def hits_of(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """A row for each rule that holds on a row of with_previous, with the rule's limits. rules: id, target (of KEYS; a
    missing part matches all), triggerOn, expression, cooldownMs, maxTriggers, expiresAt, enabled."""
    columns, found = set(rows.columns), []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        holds = alerts.compile_alert(rule["expression"], columns) & (F.col("trigger_on") == rule.get("triggerOn", "bar_close"))
        for k, v in rule.get("target", {}).items():
            holds = holds & (F.col(k) == v)
        limit = lambda name: F.lit(rule.get(name)).cast("bigint").alias(name)  # noqa: B023, E731
        found.append(F.when(holds, F.struct(F.lit(rule["id"]).alias("rule_id"), limit("cooldownMs"), limit("maxTriggers"), limit("expiresAt"))))
    if not found:
        raise ValueError("no rule is enabled")
    rows = rows.select(*KEYS, "timestamp_ms", "at", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("rule"))
    return rows.select("rule.*", *KEYS, "timestamp_ms", "at")


def stream_rule_alerts(events: DataFrame, rules: list[dict], lateness: str = "1 minute") -> DataFrame:
    """rule_id, KEYS, triggered_at_ms of every alert, in append mode. A rule that has expired, reached its count, or is cooling
    down does not fire, but the values before still move on."""
    rules = [r for r in rules if r.get("enabled", True)]
    fields = sorted(set().union(*(alerts.fields(r["expression"]) for r in rules)) & set(events.columns))
    triggers = sorted({r.get("triggerOn", "bar_close") for r in rules})
    hits = hits_of(with_previous(events, fields, triggers, lateness), rules)
    shape = ", ".join(["rule_id string", *(f"`{k}` string" for k in KEYS), "triggered_at_ms bigint"])
    return hits.groupBy("rule_id", *KEYS).transformWithStateInPandas(Limits(), shape, "append", "EventTime")

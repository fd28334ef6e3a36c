"""Target alerts over a stream of closes that may come late, shuffled or corrected.

The state of each target side is a map from year to its days, packed: what each day looked like and the
event that it gave.  A side costs a call of the state store a year, not a day.  A batch puts its days into the map and judges again from the first
day that changed on: what a day no longer gives is taken back, what it gives now is
added.  Events added less events taken back are ``operators.targets.alerts`` of the final history.
"""
from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "target_id long, side string, trade_date date, close double, level double, event string, change int"
#: The state store that keeps maps; a session that runs these streams must name it under `spark.sql.streaming.stateStore.providerClass`.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A packed day.
_DAY = np.dtype([("day", "<i4"), ("close", "<f8"), ("level", "<f8"), ("reached", "?"), ("can_send", "?"), ("event", "u1")])
_EVENTS = (None, "send", "rearm")


_EPOCH = date(1970, 1, 1).toordinal()


def _days(given: pd.DataFrame) -> np.ndarray:
    """A batch's days, packed, in order; of several rows for a day the last to come."""
    out = np.zeros(len(given), _DAY)
    out["day"] = given["trade_date"].to_numpy("datetime64[D]").astype(np.int64) + _EPOCH
    for c in ("close", "level"):
        out[c] = given[c].to_numpy(np.float64, na_value=np.nan)
    for c in ("reached", "can_send"):
        values = given[c].to_numpy()
        out[c] = values if values.dtype == bool else [bool(v) for v in values]
    out = out[np.lexsort((given["arrived"].to_numpy(), out["day"]))]
    return out[np.append(out["day"][1:] != out["day"][:-1], True)[: len(out)]]


def _same(a: np.ndarray, b: np.ndarray, columns: tuple[str, ...]) -> np.ndarray:
    """Where two tables of days agree."""
    return np.logical_and.reduce([(a[c] == b[c]) | ((a[c] != a[c]) & (b[c] != b[c])) for c in columns])


def _events(days: np.ndarray) -> np.ndarray:
    """What each day of a whole history gives: all alerts so far less those up to the last day that was not reached are the ones outstanding."""
    can = days["reached"] & days["can_send"]
    so_far = np.cumsum(can)
    out_now = so_far - np.maximum.accumulate(np.where(days["reached"], 0, so_far))
    before = np.append(0, out_now[:-1])[: len(days)] > 0
    return np.where(can & (out_now == 1), 1, np.where(~days["reached"] & before, 2, 0)).astype(np.uint8)


class AlertDays(StatefulProcessor):
    """Judges the days of one target side; a side has at most one day of the calendar each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.years = handle.getMapState("years", "year int", "days binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = _days(pd.concat(list(rows)))
        known = [np.zeros(0, _DAY), *[np.frombuffer(bytes(held[0]), _DAY) for _, held in self.years.iterator()]]
        known = np.sort(np.concatenate(known), order="day")
        # Every day that is known or given, once: as it was and as it is.
        day = np.union1d(known["day"], given["day"])
        was, now = np.zeros(len(day), _DAY), np.zeros(len(day), _DAY)
        had, came = np.isin(day, known["day"]), np.isin(day, given["day"])
        was[had], now[had] = known, known
        now[came] = given
        now["event"] = _events(now)
        gave = had & _same(was, now, ("close", "level", "event"))
        changed = ~(had & _same(was, now, ("close", "level", "reached", "can_send", "event")))
        lines = [x for x in ((was, -1, np.flatnonzero(~gave & (was["event"] > 0))), (now, 1, np.flatnonzero(~gave & (now["event"] > 0))))]
        at, side = np.concatenate([x[2] for x in lines]), np.repeat([0, 1], [len(x[2]) for x in lines])
        order = np.lexsort((side, at))
        picked = np.concatenate([x[0][x[2]] for x in lines])[order]
        yield pd.DataFrame({
            "target_id": key[0], "side": key[1], "trade_date": [date.fromordinal(d) for d in picked["day"].tolist()], "close": picked["close"], "level": picked["level"],
            "event": [_EVENTS[e] for e in picked["event"].tolist()], "change": np.array([-1, 1], np.int32)[side[order]],
        })
        years = (now["day"] - _EPOCH).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
        for year in np.unique(years[changed]).tolist():
            self.years.updateValue((year,), (now[years == year].tobytes(),))

    def close(self) -> None:
        pass


def stream_alerts(days: DataFrame) -> DataFrame:
    """Events added (change 1) and taken back (change -1) by a stream of ``operators.targets.target_days`` rows.

    Of several rows for a day the one that came last counts: in a later batch, or with the larger ``arrived`` if there is such a column.
    """
    rows = days if "arrived" in days.columns else days.withColumn("arrived", F.lit(0))
    return rows.groupBy("target_id", "side").transformWithStateInPandas(AlertDays(), OUTPUT, "Append", "None")


def net_events(changes: DataFrame) -> DataFrame:
    """The events that stand: those added and not taken back."""
    event = ["target_id", "side", "trade_date", "close", "level", "event"]
    return changes.groupBy(*event).agg(F.sum("change").alias("_n")).filter("_n > 0").select(*event)

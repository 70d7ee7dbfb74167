"""Adaptive grouping inside partitions: online leader clustering.

The kernel is one class for batch and streaming. Groups live on: a leader stays when its window
is over, only the stored outside records of a window go with it. Batch and stream therefore give
the same groups, whatever the windows. Distances to all leaders are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspan.schemas import GROUPED
from nearspan.shipping import ship


class Units:
    """Unit vectors, rows of a matrix that doubles when it is full."""

    def __init__(self):
        self.held, self.n = np.zeros((0, 0)), 0

    @staticmethod
    def of(v) -> np.ndarray:
        v = np.asarray(v, float)
        return v / np.sqrt((v * v).sum())

    def add(self, v: np.ndarray) -> None:
        if self.n == len(self.held):
            more = np.empty((max(16, 2 * self.n), len(v)))
            more[: self.n] = self.held[: self.n] if self.n else more[:0]
            self.held = more
        self.held[self.n] = v
        self.n += 1

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Angular distances of all rows to a unit vector."""
        return np.arccos(np.clip(self.held[: self.n] @ v, -1, 1)) / np.pi if self.n else np.zeros(0)


class Grouper:
    """Leaders of one partition in order of their group ids (from 1), and stored outside records by window."""

    def __init__(self, threshold: float, leaders: Iterable = (), outers: Iterable = ()):
        self.t, self.leaders, self.units = threshold, [], Units()
        self.outers: dict[int, tuple[list[dict], Units]] = {}
        for x in leaders:
            self._led(x, Units.of(x["vec"]))
        for x in outers:
            self._store(x, Units.of(x["vec"]))

    def _led(self, row: dict, v: np.ndarray) -> int:
        self.leaders.append(row)
        self.units.add(v)
        return len(self.leaders)

    def _store(self, row: dict, v: np.ndarray) -> None:
        rows, units = self.outers.setdefault(row.get("win", 0), ([], Units()))
        rows.append(row)
        units.add(v)

    def forget(self, window: int) -> None:
        """Drops the stored outside records of all windows before this one."""
        for w in [w for w in self.outers if w < window]:
            del self.outers[w]

    def add(self, row: dict) -> list[tuple[dict, int, str, int]]:
        """(record, group, type, home group) of everything a record sends to the groups."""
        v, t = Units.of(row["vec"]), self.t
        d = self.units.distances(v)
        if row["ptype"] == "pOuter":
            self._store(row, v)
            return [(row, int(g) + 1, "outer", -1) for g in np.flatnonzero(d <= 2 * t)]
        if not self.leaders or d.min() > t:
            home = self._led(row, v)
            out = [(row, home, "inner", home)]
            rows, units = self.outers.get(row.get("win", 0), ([], Units()))
            out += [(rows[i], home, "outer", -1) for i in np.flatnonzero(units.distances(v) <= 2 * t)]
        else:
            home = int(d.argmin()) + 1
            out = [(row, home, "inner" if d[home - 1] <= 0.5 * t else "outlier", home)]
        # Of two groups only the one with the smaller id gets a copy of the other's record.
        return out + [(row, int(g) + 1, "outer", home) for g in np.flatnonzero(d <= 2 * t) if g + 1 < home]


def assign_groups(partitioned: DataFrame, threshold: float, window: str | None = None) -> DataFrame:
    """Rows of ``space_partition`` dealt to groups, for each partition in order of (event_ts, id).

    Needs event_ts, ingest_ts, id, vec, origin beside the columns of the router, and the window's
    number if there are windows; they ascend with time. One partition's clustering is sequential,
    so its size is set by the number of reference points, which grows with the input.
    """
    ship(partitioned.sparkSession)
    names = [f.name for f in GROUPED] + ([window] if window else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, out = Grouper(threshold), []
        for row in pdf.sort_values(["event_ts", "id", "origin"], kind="stable").to_dict("records"):
            row["win"] = row[window] if window else 0
            g.forget(row["win"])
            for rec, gid, kind, home in g.add(row):
                out.append({**rec, "group_id": gid, "gtype": kind, "home_group": home})
        return pd.DataFrame(out, columns=names)

    schema = T.StructType([*GROUPED.fields, *([T.StructField(window, T.LongType())] if window else [])])
    cols = [c for c in dict.fromkeys([*names, "part"]) if c not in ("group_id", "gtype", "home_group")]
    return partitioned.select(*cols).groupBy("part").applyInPandas(run, schema)


def group_leaders(grouped: DataFrame) -> DataFrame:
    """(part, group_id, ts, id, centroid) of every group: the first record that joined it from inside."""
    first = F.min_by(F.struct("event_ts", "id", "vec"), F.struct("event_ts", "id", "origin"))
    home = grouped.where("gtype = 'inner' AND home_group = group_id").groupBy("part", "group_id").agg(first.alias("x"))
    return home.select("part", "group_id", F.col("x.event_ts").alias("ts"), F.col("x.id").alias("id"), F.col("x.vec").alias("centroid"))


def leader_snapshots(grouped: DataFrame, window: str = "win") -> DataFrame:
    """(window, part, groups, leaders) at the end of every window: all leaders so far, as (group_id, id, ts).

    New leaders of a window are listed first and then accumulated over a partition's windows, so
    what moves is one row for each leader, and a snapshot holds as many entries as there are groups.
    """
    lead = group_leaders(grouped).select("part", F.struct("group_id", "id", "ts").alias("lead"), F.col("ts").alias("__ts"), F.col("id").alias("__id"))
    at = grouped.where("gtype = 'inner'").select(F.col("part").alias("__part"), F.col("id").alias("__gid"), F.col("event_ts").alias("__gts"), F.col(window).alias("win")).distinct()
    new = lead.join(at, (F.col("part") == F.col("__part")) & (F.col("__id") == F.col("__gid")) & (F.col("__ts") == F.col("__gts"))).groupBy("part", "win").agg(F.collect_list("lead").alias("new"))
    every = grouped.select("part", F.col(window).alias("win")).distinct()
    return every.join(new, ["part", "win"], "left").select(
        "part",
        "win",
        F.expr("array_sort(flatten(collect_list(coalesce(new, array())) OVER (PARTITION BY part ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))").alias("leaders"),
    ).select("win", "part", F.size("leaders").alias("groups"), "leaders")

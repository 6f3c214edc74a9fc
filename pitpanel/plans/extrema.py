"""First crossings through a pyramid of lows and highs.

A node holds, in time order, the extremes of up to ``fan`` blocks of the level below; the lowest nodes
hold the bars themselves. A search climbs from its starting bar over the later siblings of each level,
takes the lowest level that can cross, and descends to the bar: one node per level each way, however
long the series is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import div
from pitpanel.session import materialize

#: copies of a node that many searches may start from; the node count shrinks as fast as copies grow
MOST_COPIES = 256


@dataclass(frozen=True)
class Pyramid:
    """``nodes``: by, level, node, children (id, low, high, and the bar's columns at level 0)."""

    nodes: DataFrame
    by: list[str]
    keep: list[str]
    origin: int
    step: int
    fan: int
    levels: int

    def block(self, ts: Column, level: int) -> Column:
        """Number of the block of ``level`` that holds ``ts``; level 0 is one step wide."""
        return div(ts - F.lit(self.origin), self.step * self.fan ** level)

    def copies(self, level: int) -> int:
        return min(MOST_COPIES, self.fan ** level)


def pyramid(bars: DataFrame, by: list[str], ts: str, low: str, high: str, keep: list[str], step: int,
            fan: int = 16) -> Pyramid:
    """The pyramid of ``bars``, written once. ``keep`` names columns (not id, low, high) that a search returns.

    Bars without a key or time are left out. ``step`` is the usual distance of bars; others are allowed,
    but a node of the lowest level holds whatever lies within ``fan`` steps.
    """
    bars = bars.dropna(subset=[*by, ts])
    ends = bars.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    origin, span = (ends["a"], ends["b"] - ends["a"]) if ends["a"] is not None else (0, 0)
    levels = 1
    while step * fan ** levels <= span:
        levels += 1
    empty = Pyramid(bars, by, keep, origin, step, fan, levels)

    def grouped(df: DataFrame, node: Column, child: Column, level: int) -> DataFrame:
        return df.groupBy(*by, node.alias("node")).agg(F.sort_array(F.collect_list(child)).alias("children")) \
            .select(*by, F.lit(level).alias("level"), "node", "children")
    bar = F.struct(F.col(ts).cast("bigint").alias("id"), F.col(low).alias("low"), F.col(high).alias("high"), *keep)
    below = materialize(grouped(bars, empty.block(F.col(ts), 1), bar, 0))
    parts, kinds = [below], {c: bars.schema[c].dataType for c in keep}
    for level in range(1, levels):
        extremes = F.struct(
            F.col("node").cast("bigint").alias("id"), F.array_min(F.transform("children", lambda c: c["low"])).alias("low"),
            F.array_max(F.transform("children", lambda c: c["high"])).alias("high"),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in keep])
        below = materialize(grouped(below, div("node", fan), extremes, level))
        parts.append(below)
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return Pyramid(nodes, by, keep, origin, step, fan, levels)


def _crossing(children: Column, later_than: Column | None) -> Column:
    """First child that reaches down to ``floor`` or up to ``ceil``."""
    def touches(c):
        hit = F.coalesce(c["low"] <= F.col("floor"), F.lit(False)) | F.coalesce(c["high"] >= F.col("ceil"), F.lit(False))
        return hit if later_than is None else hit & (c["id"] > later_than)
    return F.get(F.filter(children, touches), 0)


def _copied(tower: Pyramid, levels: list[int]) -> DataFrame:
    """Nodes of ``levels`` with a copy per salt: as many rows per level as the lowest has, at most."""
    copies = F.lit(1)
    for level in levels:
        copies = F.when(F.col("level") == level, F.lit(tower.copies(level))).otherwise(copies)
    return tower.nodes.where(F.col("level").isin(levels)).withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))


def climb(searches: DataFrame, tower: Pyramid, key: list[str], start: str) -> DataFrame:
    """One row per search and level: the node around its start and the first later child that crosses."""
    at = F.greatest(F.col(start), F.lit(tower.origin))
    salt = F.xxhash64(*key)
    steps = [F.struct(F.lit(k).alias("level"), tower.block(at, k + 1).alias("node"),
                      # a bar at the start itself counts
                      (at - 1 if k == 0 else tower.block(at, k)).cast("bigint").alias("own"),
                      F.pmod(salt, F.lit(tower.copies(k))).cast("int").alias("salt")) for k in range(tower.levels)]
    spread = searches.select("*", F.explode(F.array(*steps)).alias("_s")).select("*", "_s.*").drop("_s")
    nodes = _copied(tower, list(range(tower.levels)))
    met = spread.join(nodes, [*tower.by, "level", "node", "salt"])
    return met.withColumn("child", _crossing(F.col("children"), F.col("own"))).drop("children", "own", "node", "salt")


def first_crossing(searches: DataFrame, tower: Pyramid, key: list[str], start: str, floor: str, ceil: str) -> DataFrame:
    """``key`` and ``hit``, the first bar (id, low, high, keep...) at or after ``start`` whose low is at
    or below ``floor`` or whose high is at or above ``ceil``; searches without one are absent.

    ``key`` names the searches and holds ``tower.by``. A null limit is never reached.
    """
    asked = searches.select(*key, F.col(start).alias("start"), F.col(floor).alias("floor"), F.col(ceil).alias("ceil"))
    met = climb(asked, tower, key, "start").where("child IS NOT NULL")
    # a lower level's later siblings end before those of the level above begin
    best = met.groupBy(*key, "floor", "ceil").agg(F.min_by(F.struct("level", "child"), "level").alias("b"))
    found = best.select(*key, "floor", "ceil", "b.level", "b.child")
    for level in range(tower.levels - 1, 0, -1):
        here = F.col("level") == level
        nodes = _copied(tower, [level - 1]).select(*tower.by, "node", "salt", "children")
        asked = found.withColumns({"node": F.when(here, F.col("child.id")),
                                   "salt": F.pmod(F.xxhash64(*key), F.lit(tower.copies(level - 1))).cast("int")})
        found = asked.join(nodes, [*tower.by, "node", "salt"], "left").select(
            *key, "floor", "ceil", F.when(here, level - 1).otherwise(F.col("level")).alias("level"),
            F.when(here, _crossing(F.col("children"), None)).otherwise(F.col("child")).alias("child"))
    return found.select(*key, F.col("child").alias("hit"))

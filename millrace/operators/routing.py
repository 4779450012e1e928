"""Travel networks: who may use an edge, cheapest routes for many travellers, alternatives, and tours of points.

Edges: ``source``, ``target``, ``method``, ``cost_seconds``, ``name``, and what they require (``faction``,
``min_level``).  The network is a dimension (hundreds of edges); travellers are many.  Travellers who may
use the same edges form a class, and routes are found once per class and origin.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.broadcasts import small
from millrace.operators.checkpoints import settled
from millrace.operators.groups import by_group

#: How convenient each method is, best first.
CONVENIENCE = {
    "portal": 0, "mage portal": 1, "dreamwalk": 1, "class teleport": 2, "item": 2, "engineering": 3, "hearthstone": 4,
    "tram": 5, "boat": 6, "zeppelin": 6, "flight path": 7, "fly": 8, "walk": 9,
}
SECONDS_PER_UNIT = 70.0
GROUND_FACTOR = 2.2
TWO_OPT_LIMIT = 60
TWO_OPT_PASSES = 8


def convenience(method: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CONVENIENCE.items() for x in pair]), method), F.lit(9))


def usable(faction: Column, level: Column) -> Column:
    """Unknown never satisfies: a requirement holds only if the traveller is known to meet it."""
    return (F.col("faction").isNull() | F.coalesce(faction == F.col("faction"), F.lit(False))) & (F.col("min_level").isNull() | F.coalesce(level >= F.col("min_level"), F.lit(False)))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def zone_seconds(distance: Column, flyable: Column) -> Column:
    return distance * SECONDS_PER_UNIT * F.when(flyable, 1.0).otherwise(GROUND_FACTOR)


def cheapest(network: DataFrame, key: list[str]) -> DataFrame:
    """(key..., origin, node, seconds, conv, path): the cheapest way from every node to every node reached.

    network: the edges of each key.  Ways are compared by cost, then convenience, then their names.
    Every round makes all ways one edge longer and keeps the best per node; it ends when none got better.
    A cheapest way has fewer edges than there are nodes, so more rounds mean a circle of negative cost,
    which is an error."""
    hop = network.select(*key, F.col("source").alias("node"), F.col("target").alias("next"), F.struct(F.col("cost_seconds").alias("cost"), convenience(F.col("method")).alias("conv"), "name").alias("e"))
    near = small(settled(hop))
    starts = network.select(*key, F.col("source").alias("node")).unionByName(network.select(*key, F.col("target").alias("node"))).distinct()
    empty = F.struct(F.lit(0.0).alias("seconds"), F.lit(0).alias("conv"), F.expr("cast(array() as array<string>)").alias("path"))
    best = settled(starts.select(*key, F.col("node").alias("origin"), "node", empty.alias("way")))
    for _ in range(starts.select("node").distinct().count() + 1):
        longer = best.join(near, [*key, "node"]).select(
            *key, "origin", F.col("next").alias("node"),
            F.struct((F.col("way.seconds") + F.col("e.cost")).alias("seconds"), (F.col("way.conv") + F.col("e.conv")).alias("conv"), F.array_append("way.path", F.col("e.name")).alias("path")).alias("way"),
        )
        after = settled(best.unionByName(longer).groupBy(*key, "origin", "node").agg(F.min("way").alias("way")))
        same = best.select(*key, "origin", "node", F.col("way").alias("old")).join(after, [*key, "origin", "node"], "right").where(~F.col("way").eqNullSafe(F.col("old"))).isEmpty()
        best = after
        if same:
            return best.select(*key, "origin", "node", "way.seconds", "way.conv", "way.path")
    raise ValueError("the network has a circle of negative cost")


def by_capability(edges: DataFrame, travellers: DataFrame) -> DataFrame:
    """(faction, grown, source, ...): the edges that each kind of traveller (faction, level 40 or more) may use."""
    kinds = travellers.select(F.col("faction").alias("have"), F.col("grown")).distinct()
    open_ = edges.join(small(kinds), usable(F.col("have"), F.when(F.col("grown"), 40).otherwise(0)))
    return open_.drop("faction", "min_level").withColumnRenamed("have", "faction")


def for_characters(costs: DataFrame, characters: DataFrame) -> DataFrame:
    """(char_id, map_id, seconds): what it costs each character to get to each zone within reach."""
    who = characters.select("char_id", "faction", (F.col("level") >= 40).alias("grown"), F.col("map_id").alias("origin"))
    return who.join(small(costs), ["faction", "grown", "origin"]).select("char_id", F.col("node").alias("map_id"), "seconds")


def with_own_edges(costs: DataFrame, characters: DataFrame, own: DataFrame) -> DataFrame:
    """(char_id, map_id, seconds): as ``for_characters``, where a character may first take an edge of its own.

    own: char_id, target, seconds; such edges start wherever the character stands, so they serve once.
    Characters who may begin at the same places at the same cost share one list of what they reach."""
    who = characters.select("char_id", "faction", (F.col("level") >= 40).alias("grown"), F.col("map_id").alias("origin"))
    first = who.select("*", F.lit(0.0).alias("before")).unionByName(who.drop("origin").join(own.select("char_id", F.col("target").alias("origin"), F.col("seconds").alias("before")), "char_id"))
    begun = first.groupBy("char_id").agg(F.sort_array(F.collect_set(F.struct("faction", "grown", "origin", "before"))).alias("starts"))
    starts = begun.select("starts").distinct().select("starts", F.explode("starts").alias("s")).select("starts", "s.*")
    reached = starts.join(small(costs), ["faction", "grown", "origin"]).groupBy("starts", F.col("node").alias("map_id")).agg(F.min(F.col("before") + F.col("seconds")).alias("seconds"))
    lists = settled(reached.groupBy("starts").agg(F.collect_list(F.struct("map_id", "seconds")).alias("reached")))
    return begun.join(small(lists), "starts").select("char_id", F.explode("reached").alias("r")).select("char_id", "r.*")


def skipped(chosen: DataFrame, completed: DataFrame, quests: DataFrame) -> DataFrame:
    """(char_id, quest_id, reason) of the chosen quests that no plan can take: a prerequisite is neither done nor
    chosen too, or the quest has no place.  quests: quest_id, prerequisites (a null among them asks for nothing), map_id."""
    want = chosen.select("char_id", "quest_id").distinct().join(quests.select("quest_id", "prerequisites", "map_id"), "quest_id")
    need = want.select("char_id", "quest_id", F.explode("prerequisites").alias("pre")).where("pre is not null")
    met = completed.select("char_id", F.col("quest_id").alias("pre")).unionByName(chosen.select("char_id", F.col("quest_id").alias("pre"))).distinct()
    unmet = need.join(met, ["char_id", "pre"], "left_anti").groupBy("char_id", "quest_id").agg(F.sort_array(F.collect_set("pre")).alias("unmet"))
    told = want.join(unmet, ["char_id", "quest_id"], "left").withColumn(
        "reason", F.when(F.col("unmet").isNotNull(), F.concat(F.lit("requires "), F.array_join(F.transform("unmet", lambda x: x.cast("string")), ", "))).when(F.col("map_id").isNull(), "no known place")
    )
    return told.where("reason is not null").select("char_id", "quest_id", "reason")


def alternatives(network: DataFrame, requests: DataFrame, limit: int = 3) -> DataFrame:
    """(origin, destination, rank, seconds, path): the cheapest way and those found with one of its edges banned.

    network: edges without a key; requests: origin, destination.  The dearest edge is banned first; ways
    with the same names count once.  An edge is banned for all requests that need it at once, so there is
    one search per banned edge, not per request."""
    best = cheapest(network.withColumn("banned", F.lit("")), ["banned"]).join(requests.select("origin", F.col("destination").alias("node")).distinct(), ["origin", "node"])
    cost = network.select(F.col("name").alias("banned"), F.col("cost_seconds").alias("cost"))
    bans = best.select("origin", "node", F.col("path").alias("first"), F.posexplode("path").alias("pos", "ban")).join(small(cost.withColumnRenamed("banned", "ban")), "ban")
    bans = settled(bans)
    names = bans.select(F.col("ban").alias("banned")).distinct()
    kept = network.join(small(names), network["name"] != names["banned"])
    other = cheapest(kept, ["banned"]).withColumnRenamed("banned", "ban")
    found = bans.join(other, ["origin", "node", "ban"]).where(F.size("path") > 0)
    order = Window.partitionBy("origin", "node", "path").orderBy(F.desc("cost"), "pos")
    once = found.where(F.col("path") != F.col("first")).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    some = once.withColumn("nth", F.row_number().over(Window.partitionBy("origin", "node").orderBy(F.desc("cost"), "pos"))).where(F.col("nth") < limit)
    every = best.select("origin", "node", F.lit(0).alias("nth"), "seconds", "path").unionByName(some.select("origin", "node", "nth", "seconds", "path"))
    w = Window.partitionBy("origin", "node").orderBy("seconds", "nth")
    return every.withColumn("rank", F.row_number().over(w).cast("long")).select("origin", F.col("node").alias("destination"), "rank", "seconds", "path")


def route_steps(routes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., pos, name, seconds, total): the edges of each route's path with their running sum."""
    steps = routes.select(*key, F.posexplode("path").alias("pos", "name")).join(small(edges.select("name", F.col("cost_seconds").alias("seconds"))), "name")
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("total", F.sum("seconds").over(w)).withColumn("pos", F.col("pos").cast("long"))


def network_violations(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(kind, name): edges from or to unknown zones, negative costs, loops, and names given twice on one way."""
    ends = edges.select("name", F.explode(F.array("source", "target")).alias("map_id")).join(zones.select("map_id"), "map_id", "left_anti").select(F.lit("zone").alias("kind"), "name").distinct()
    bad = edges.select("name", F.explode(F.array_compact(F.array(F.when(F.col("cost_seconds") < 0, "cost"), F.when(F.col("source") == F.col("target"), "loop")))).alias("kind")).select("kind", "name")
    twice = edges.groupBy("source", "target", "name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("twice").alias("kind"), "name")
    return ends.unionByName(bad).unionByName(twice)


def requirement_text(faction: Column, min_level: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(faction.isNotNull(), F.concat(F.initcap(faction), F.lit(" only"))), F.when(min_level.isNotNull(), F.concat(F.lit("level "), min_level.cast("string"))))), ", ")


# ---------------------------------------------------------------- tours of points


def nearest_neighbours(xy: np.ndarray) -> np.ndarray:
    """Orders of many tours of equal size, (tours, places) from (tours, places, 2): each starts at its first
    place and always goes on to the nearest left, the earlier on ties."""
    g, n = xy.shape[:2]
    tour, left, at = np.arange(g), np.ones((g, n), dtype=bool), xy[:, 0]
    out = np.empty((g, n), dtype=np.int64)
    for k in range(n):
        gap = np.hypot(xy[:, :, 0] - at[:, None, 0], xy[:, :, 1] - at[:, None, 1])
        gap[~left] = np.inf
        out[:, k] = gap.argmin(axis=1)
        left[tour, out[:, k]] = False
        at = xy[tour, out[:, k]]
    return out


def legs(xy: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The way to each place of the tours from the one before; 0 to the first."""
    p = np.take_along_axis(xy, order[:, :, None], axis=1)
    way = np.zeros(order.shape)
    way[:, 1:] = np.hypot(*np.moveaxis(p[:, 1:] - p[:, :-1], 2, 0))
    return way


def two_opt(xy: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The orders with runs reversed while that makes a tour shorter; first places stay.  Tours of fewer than
    4 or more than TWO_OPT_LIMIT places stay as they are."""
    n = order.shape[1]
    if not 4 <= n <= TWO_OPT_LIMIT:
        return order
    order = order.copy()
    p = np.take_along_axis(xy, order[:, :, None], axis=1)
    gap = lambda q, a, b: np.hypot(q[:, a, 0] - q[:, b, 0], q[:, a, 1] - q[:, b, 1])
    live = np.arange(len(order))
    for _ in range(TWO_OPT_PASSES):
        better = np.zeros(len(live), dtype=bool)
        q, o = p[live], order[live]
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                gain = gap(q, i - 1, i) - gap(q, i - 1, j)
                if j + 1 < n:
                    gain += gap(q, j, j + 1) - gap(q, i, j + 1)
                hit = np.flatnonzero(gain > 1e-9)
                if len(hit):
                    q[hit, i : j + 1] = q[hit, i : j + 1][:, ::-1]
                    o[hit, i : j + 1] = o[hit, i : j + 1][:, ::-1]
                    better[hit] = True
        p[live], order[live] = q, o
        live = live[better]
        if not len(live):
            break
    return order


def tours(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., pos, point_id, distance): each group's points in touring order, with the way from the one before.

    points: keys, ord, point_id, x, y.  A group is what one traveller visits in one zone: dozens of points.
    Groups of equal size are toured together, in arrays."""

    def make(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        xy = np.stack([t.column(c).to_numpy().astype(np.float64) for c in ("x", "y")], axis=1)
        sizes = np.diff(bounds)
        take, way = np.empty(len(xy), dtype=np.int64), np.empty(len(xy))
        for n in np.unique(sizes):
            at = bounds[:-1][sizes == n][:, None] + np.arange(n)
            here = xy[at]
            order = two_opt(here, nearest_neighbours(here))
            take[at], way[at] = np.take_along_axis(at, order, axis=1), legs(here, order)
        pos = np.arange(len(xy)) - np.repeat(bounds[:-1], sizes) + 1
        columns = [*(t.column(k).combine_chunks() for k in keys), pa.array(pos), t.column("point_id").combine_chunks().take(pa.array(take)), pa.array(way)]
        return pa.RecordBatch.from_arrays(columns, [*keys, "pos", "point_id", "distance"])

    kinds = {k: points.schema[k].dataType.simpleString() for k in [*keys, "point_id"]}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "pos long", f"point_id {kinds['point_id']}", "distance double"])
    return by_group(points.select(*keys, "ord", "point_id", "x", "y"), keys, ["ord", "point_id"], schema, make)


def zone_order(zones: DataFrame, costs: DataFrame, unreachable: float = 600.0) -> DataFrame:
    """(char_id, pos, map_id, seconds): the zones of each plan, greedily the cheapest next, the smaller on ties.

    zones: char_id, map_id, origin, faction, grown.  costs: (faction, grown, origin, node, seconds).
    A plan's zones are few; they meet with the costs between them in one group per character."""
    pairs = zones.select("char_id", "faction", "grown", F.col("map_id").alias("node"), F.col("origin").alias("start"))
    sources = pairs.select("char_id", F.col("node").alias("origin")).unionByName(pairs.select("char_id", F.col("start").alias("origin"))).distinct()
    legs = pairs.join(sources, "char_id").join(small(costs.select("faction", "grown", "origin", "node", "seconds")), ["faction", "grown", "origin", "node"], "left")
    known = legs.select("char_id", "start", "origin", "node", F.coalesce("seconds", F.lit(unreachable)).alias("seconds"))

    def make(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        who, start, origin, node, seconds = (t.column(c).to_pylist() for c in ("char_id", "start", "origin", "node", "seconds"))
        out: list[tuple] = []
        for lo, hi in itertools.pairwise(bounds.tolist()):
            cost = {(origin[k], node[k]): seconds[k] for k in range(lo, hi)}
            left, at, pos = set(node[lo:hi]), start[lo], 0
            while left:
                way, at = min((0.0 if z == at else cost[at, z], z) for z in left)
                left.remove(at)
                out.append((who[lo], pos := pos + 1, at, way))
        columns = list(zip(*out, strict=True))
        kinds = [t.column("char_id").type, pa.int64(), t.column("node").type, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["char_id", "pos", "map_id", "seconds"])

    return by_group(known, ["char_id"], ["node", "origin"], f"char_id {zones.schema['char_id'].dataType.simpleString()}, pos long, map_id {zones.schema['map_id'].dataType.simpleString()}, seconds double", make)


# ---------------------------------------------------------------- waypoint texts


def sanitised(c: Column, limit: int = 180) -> Column:
    """Line ends and bars to blanks, blanks collapsed, cut to limit characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\r\n|]", " "), " +", " ")), 1, limit)


def way_command(map_id: Column, x: Column, y: Column, label: Column) -> Column:
    """``/way #map x y label`` with coordinates in percent, two decimals."""
    return F.format_string("/way #%d %.2f %.2f %s", map_id.cast("long"), (x * 100).cast("double"), (y * 100).cast("double"), sanitised(label))


def parsed_way(c: Column) -> dict[str, Column]:
    """map_id, x, y (0 to 1) and label of a command; all null if it is malformed or out of range."""
    pattern = r"^\s*/way\s+#(\d+)\s+(\d+(?:\.\d+)?)[\s,]+(\d+(?:\.\d+)?)(?:\s+(.*?))?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    x, y = part(2).cast("double"), part(3).cast("double")
    ok = F.coalesce(c.rlike(pattern) & x.between(0, 100) & y.between(0, 100), F.lit(False))
    return {"map_id": F.when(ok, part(1).cast("long")), "x": F.when(ok, x / 100), "y": F.when(ok, y / 100), "label": F.when(ok, F.coalesce(part(4), F.lit("")))}


def macro(points: DataFrame, key: str) -> DataFrame:
    """(key, macro): one command a line in the points' order.  points: key, pos, map_id, x, y, label."""
    lines = points.select(key, "pos", way_command(F.col("map_id"), F.col("x"), F.col("y"), F.col("label")).alias("line"))
    got = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return got.select(key, F.array_join(F.col("l.line"), "\n").alias("macro"))

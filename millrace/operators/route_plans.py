"""Whole route plans: legs that never put a quest before what it needs, tours inside them, reasons and totals."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import graph, routing
from millrace.operators.broadcasts import small
from millrace.operators.checkpoints import settled
from millrace.operators.groups import by_group

#: Seconds charged for a way that no network knows.
UNREACHABLE = 600.0


def doable(zone: int, left: dict[int, list[tuple[int, int]]], needs: dict[int, set[int]], done: set[int]) -> list[int]:
    """The quests of a zone that one stay can do, in their order: what they need is done, or is done in the stay."""
    stay: list[int] = []
    met = set(done)
    for _, quest in left[zone]:
        if needs[quest] <= met:
            stay.append(quest)
            met.add(quest)
    return stay


def merged_legs(quests: list[tuple[int, int, int]], needs: dict[int, set[int]], start: int | None, cost: dict[tuple[int | None, int], float]) -> list[tuple[int, float, list[int]]]:
    """(zone, seconds to it, quests) of each leg.  quests: (place in a topological order, quest, zone).

    The next zone is one that can be finished in one stay, if there is any, else one where something can be
    done; among these the cheapest to reach, then the smaller.  So a zone is left unfinished only where
    something elsewhere must come first, and where the greedy order of whole zones breaks no dependency, the
    legs are that order.  This is greedy: a plan may have a leg more than the best (over random small plans the
    tests find at most a hundredth more than the fewest of all orders).  In a circle of dependencies the first quest left is done as if it needed nothing."""
    left: dict[int, list[tuple[int, int]]] = {}
    for place, quest, zone in sorted(quests):
        left.setdefault(zone, []).append((place, quest))
    done: set[int] = set()
    legs: list[tuple[int, float, list[int]]] = []
    at = start
    while left:
        stays = {z: doable(z, left, needs, done) for z in left}
        open_ = [z for z in stays if len(stays[z]) == len(left[z])] or [z for z in stays if stays[z]]
        if not open_:
            _, quest, zone = min((left[z][0][0], left[z][0][1], z) for z in left)
            needs = {**needs, quest: set()}
            open_, stays = [zone], {zone: doable(zone, left, needs, done)}
        seconds, zone = min((0.0 if z == at or at is None else cost.get((at, z), UNREACHABLE), z) for z in open_)
        legs.append((zone, seconds, stays[zone]))
        done.update(stays[zone])
        left[zone] = [x for x in left[zone] if x[1] not in done]
        if not left[zone]:
            del left[zone]
        at = zone
    return legs


def ordered_legs(chosen: DataFrame, quests: DataFrame, travellers: DataFrame, costs: DataFrame) -> DataFrame:
    """(char_id, leg, step, map_id, quest_id, travel_seconds, estimated): each traveller's quests, leg by leg.

    chosen: char_id, quest_id, all with a zone; travellers: char_id, faction, grown, origin; costs: faction, grown, origin,
    node, seconds.  A traveller's quests and the costs between their zones (dozens of rows) meet in one group; without
    an origin the way to the first leg costs nothing."""
    order = graph.ordered_subsets(chosen, quests).join(quests.select("quest_id", "map_id", "prerequisites"), "quest_id")
    ends = settled(order.join(travellers.select("char_id", "faction", "grown", "origin"), "char_id", "left"))
    nodes = ends.select("char_id", "faction", "grown", F.col("map_id").alias("node")).distinct()
    froms = ends.select("char_id", F.explode(F.array("map_id", "origin")).alias("origin")).where("origin is not null").distinct()
    ways = nodes.join(froms, "char_id").join(small(costs.select("faction", "grown", "origin", "node", "seconds")), ["faction", "grown", "origin", "node"])
    long = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    rows = ends.select(*long("char_id", "pos", "quest_id", "map_id", "origin"), F.coalesce("prerequisites", F.array()).cast("array<long>").alias("needs"), F.lit(None).cast("double").alias("seconds")).unionByName(
        ways.select(*long("char_id", "origin"), F.col("node").cast("long").alias("map_id"), "seconds"), allowMissingColumns=True
    )

    def make(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        who, pos, quest, zone, origin, before, seconds = (t.column(c).to_pylist() for c in ("char_id", "pos", "quest_id", "map_id", "origin", "needs", "seconds"))
        out: list[tuple] = []
        for lo, hi in itertools.pairwise(bounds.tolist()):
            own = [k for k in range(lo, hi) if quest[k] is not None]
            cost = {(origin[k], zone[k]): seconds[k] for k in range(lo, hi) if quest[k] is None}
            known = {quest[k] for k in own}
            needs = {quest[k]: (known & set(before[k])) - {quest[k]} for k in own}
            legs, step, at = merged_legs([(pos[k], quest[k], zone[k]) for k in own], needs, origin[own[0]], cost), 0, origin[own[0]]
            for leg, (z, s, stay) in enumerate(legs, 1):
                guess = at is not None and at != z and (at, z) not in cost
                for q in stay:
                    out.append((who[lo], leg, step := step + 1, z, q, s, guess))
                at = z
        columns = list(zip(*out, strict=True))
        kinds = [*[pa.int64()] * 5, pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _LEGS)

    return by_group(rows, ["char_id"], ["quest_id", "map_id"], "char_id long, leg long, step long, map_id long, quest_id long, travel_seconds double, estimated boolean", make)


_LEGS = ["char_id", "leg", "step", "map_id", "quest_id", "travel_seconds", "estimated"]


def leg_points(legs: DataFrame, points: DataFrame) -> DataFrame:
    """(char_id, leg, pos, quest_id, nth, label, x, y, distance): each leg's points in touring order.

    points: quest_id, pos, x, y, label, as ``graph.waypoints`` gives them: pick-up, objectives, turn-in.  A tour
    starts where the leg's first quest does."""
    own = points.select("quest_id", F.col("pos").alias("nth"), "x", "y", "label")
    stops = settled(legs.select("char_id", "leg", "step", "quest_id").join(own, "quest_id").withColumn("point_id", F.concat_ws(":", "quest_id", "nth")))
    number = F.row_number().over(Window.partitionBy("char_id", "leg").orderBy("step", "nth")).alias("ord")
    toured = routing.tours(stops.select("char_id", "leg", number, "point_id", "x", "y"), ["char_id", "leg"])
    return toured.join(stops, ["char_id", "leg", "point_id"]).select("char_id", "leg", "pos", "quest_id", "nth", "label", "x", "y", "distance")


def route_plans(chosen: DataFrame, completed: DataFrame, quests: DataFrame, points: DataFrame, travellers: DataFrame, costs: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per traveller who chose something: char_id, legs, skipped, travel_seconds, total_seconds.

    legs: array of (leg, map_id, quests, points, travel_seconds, estimated, zone_seconds, quest_seconds) in order;
    skipped: array of (quest_id, reason) by id.  quests: quest_id, quest_type, required_level, prerequisites,
    map_id, seconds; zones: map_id, flyable.  A zone that is not known counts as flyable, a quest without seconds
    as none.  Totals are 0 where nothing can be planned."""
    left_out = settled(routing.skipped(chosen, completed, quests))
    fit = chosen.select("char_id", "quest_id").distinct().join(left_out, ["char_id", "quest_id"], "left_anti").join(quests.select("quest_id"), "quest_id", "left_semi")
    steps = settled(ordered_legs(fit, quests, travellers, costs))
    stops = leg_points(steps, points)
    place = F.struct("pos", "quest_id", "nth", "label", "x", "y", "distance")
    inside = stops.groupBy("char_id", "leg").agg(F.array_sort(F.collect_list(place)).alias("points")).withColumn("way", F.aggregate("points", F.lit(0.0), lambda a, p: a + p["distance"]))
    legs = steps.join(quests.select("quest_id", F.coalesce("seconds", F.lit(0.0)).alias("seconds")), "quest_id").groupBy("char_id", "leg").agg(
        F.first("map_id").alias("map_id"), F.first("travel_seconds").alias("travel_seconds"), F.first("estimated").alias("estimated"),
        F.array_sort(F.collect_list(F.struct("step", "quest_id", "seconds"))).alias("taken"),
    )
    legs = legs.join(inside, ["char_id", "leg"], "left").join(small(zones.select("map_id", "flyable")), "map_id", "left")
    leg = F.struct(
        "leg", "map_id", F.col("taken.quest_id").alias("quests"), F.coalesce("points", F.array()).alias("points"), "travel_seconds", "estimated",
        routing.zone_seconds(F.coalesce("way", F.lit(0.0)), F.coalesce("flyable", F.lit(True))).alias("zone_seconds"),
        F.aggregate("taken", F.lit(0.0), lambda a, q: a + q["seconds"]).alias("quest_seconds"),
    )
    planned = legs.groupBy("char_id").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    reasons = left_out.groupBy("char_id").agg(F.sort_array(F.collect_list(F.struct("quest_id", "reason"))).alias("skipped"))
    both = planned.join(reasons, "char_id", "full")
    moving = F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["travel_seconds"] + x["zone_seconds"])
    doing = F.aggregate("legs", F.lit(0.0), lambda a, x: a + x["quest_seconds"])
    out = both.withColumn("legs", F.coalesce("legs", F.array())).withColumn("skipped", F.coalesce("skipped", F.array()))
    return out.select("char_id", "legs", "skipped", moving.alias("travel_seconds"), (moving + doing).alias("total_seconds"))

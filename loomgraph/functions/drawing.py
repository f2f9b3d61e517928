"""Sizes, distances and camera arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import checkpoint, ship

#: World size, least and most pixels by kind; the same of strokes by relation; charges and links.
SIZES = {
    "decision": (10, 14, 22), "file": (5, 7, 12), "component": (4.5, 6, 11), "reference": (3, 5, 9), "function": (2.5, 5, 8), "path": (2.5, 5, 8),
    "group": (8, 12, 26), "variable": (2.5, 5, 8), "section": (2, 4, 7), "type": (3, 5, 9), "project": (8, 12, 20),
}
STROKES = {"GOVERNS": (0.8, 0.6, 2.4), "SUPERSEDES": (0.8, 0.5, 2.0), "CALLS": (0.5, 0.3, 1.6), "IMPORTS": (0.5, 0.3, 1.6), "REFERENCES": (0.4, 0.3, 1.4), "co-changed": (0.3, 0.2, 1.0)}
CHARGES = {"decision": -220, "file": -80, "function": -40, "component": -40, "reference": -40, "path": -25, "group": -180}
DISTANCES = {"GOVERNS": 45, "CALLS": 55, "IMPORTS": 70, "SUPERSEDES": 40, "REFERENCES": 70, "co-changed": 140}
STRENGTHS = {"GOVERNS": 0.8, "CALLS": 0.5, "IMPORTS": 0.4, "SUPERSEDES": 0.6, "REFERENCES": 0.4, "co-changed": 0.1}
OTHER_SIZE, OTHER_STROKE, OTHER_CHARGE, OTHER_DISTANCE, OTHER_STRENGTH = (4, 5, 10), (0.5, 0.3, 1.6), -50, 120, 0.3
LEAST_ZOOM, MOST_ZOOM = 0.2, 5.0
#: Milliseconds of coming and going, the size at which what goes is gone, how far what comes overshoots.
ENTER_MS, EXIT_MS, GONE_SCALE, OVERSHOOT = 280.0, 220.0, 0.6, 1.70158
PULL = 0.25


def _look(table: dict, key: Column, other, at: int | None = None) -> Column:
    pick = (lambda v: v) if at is None else (lambda v: v[at])
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(pick(v))))])
    return F.coalesce(F.element_at(known, key), F.lit(float(pick(other))))


def world_size(kind: Column) -> Column:
    return _look(SIZES, kind, OTHER_SIZE, 0)


def size_at(kind: Column, zoom: float) -> Column:
    """World size that keeps the size on screen within its kind's pixels."""
    return F.least(F.greatest(world_size(kind) * zoom, _look(SIZES, kind, OTHER_SIZE, 1)), _look(SIZES, kind, OTHER_SIZE, 2)) / zoom


def stroke_at(relation: Column, zoom: float) -> Column:
    return F.least(F.greatest(_look(STROKES, relation, OTHER_STROKE, 0) * zoom, _look(STROKES, relation, OTHER_STROKE, 1)), _look(STROKES, relation, OTHER_STROKE, 2)) / zoom


def group_world_size(members: Column) -> Column:
    return 4 + 2 * F.log2(F.greatest(F.lit(1), members).cast("double"))


def box(label: Column) -> Column:
    """Width, height and radius of a group's box, six units a letter."""
    width = F.greatest(F.lit(32.0), F.length(label) * 6.0 + 18)
    return F.struct(width.alias("w"), F.lit(20.0).alias("h"), (F.hypot(width, F.lit(20.0)) / 2).alias("radius"))


def charge(kind: Column) -> Column:
    return _look(CHARGES, kind, OTHER_CHARGE)


def link_distance(relation: Column) -> Column:
    return _look(DISTANCES, relation, OTHER_DISTANCE)


def link_strength(relation: Column) -> Column:
    return _look(STRENGTHS, relation, OTHER_STRENGTH)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def hit_node(nodes: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """The nearest node (id, kind, x, y) that the point is less than its kind's size and three away from, both as pixels."""
    away = F.hypot(F.col("x") - x, F.col("y") - y)
    return nodes.withColumn("away", away).where(F.col("away") < (world_size(F.col("kind")) + 3) / zoom).orderBy("away", "id").limit(1)


def bounding_camera(points: DataFrame, width: float, height: float, pad: float = 40.0) -> DataFrame:
    """(x, y, zoom) that shows all points (x, y): the identity for none, zoom 1 for one."""
    box_ = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))))
    fit = F.least(F.try_divide(F.lit(width - 2 * pad), F.col("x1") - F.col("x0")), F.try_divide(F.lit(height - 2 * pad), F.col("y1") - F.col("y0")))
    zoom = F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.lit(MOST_ZOOM), F.greatest(F.lit(LEAST_ZOOM), F.coalesce(fit, F.lit(1.0)))))
    centre = lambda c: F.coalesce((F.col(f"{c}0") + F.col(f"{c}1")) / 2, F.lit(0.0)).alias(c)
    return box_.select(centre("x"), centre("y"), zoom.alias("zoom"), "n")


def clamp_zoom(zoom: Column) -> Column:
    return F.least(F.lit(MOST_ZOOM), F.greatest(F.lit(LEAST_ZOOM), zoom))


def to_screen(camera: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """The pixel (x, y) at which a camera (struct of x, y, zoom) shows a point."""
    return F.struct(((x - camera.x) * camera.zoom + width / 2).alias("x"), ((y - camera.y) * camera.zoom + height / 2).alias("y"))


def to_world(camera: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """The point that a camera shows at a pixel."""
    return F.struct(((x - width / 2) / camera.zoom + camera.x).alias("x"), ((y - height / 2) / camera.zoom + camera.y).alias("y"))


def zoom_at(camera: Column, factor: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """The camera zoomed by a factor, the point at pixel (x, y) staying there."""
    zoom = clamp_zoom(camera.zoom * factor)
    there, here = (to_world(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), z.alias("zoom")), x, y, width, height) for z in (camera.zoom, zoom))
    return F.struct((camera.x + there.x - here.x).alias("x"), (camera.y + there.y - here.y).alias("y"), zoom.alias("zoom"))


def between(start: Column, end: Column, t: Column) -> Column:
    """The camera at share t of the way."""
    return F.struct(*((start[c] + (end[c] - start[c]) * t).alias(c) for c in ("x", "y", "zoom")))


def moving(transitions: DataFrame, passed: float) -> DataFrame:
    """Transitions (phase, age, ...) that many milliseconds later, without those that are over."""
    lasts = F.when(F.col("phase") == "entering", ENTER_MS).otherwise(EXIT_MS)
    return transitions.withColumn("age", F.col("age") + passed).where(F.col("age") < lasts)


def appearance(phase: Column, age: Column, start: Column, end: Column) -> Column:
    """How a node looks within a transition, as a struct of x, y, opacity and scale.

    One that enters stands at end and grows there, its scale overshooting; one that exits moves evenly
    from start, a struct of the same four, to end and fades ever faster.
    """
    enters = phase == "entering"
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), age / F.when(enters, ENTER_MS).otherwise(EXIT_MS)))
    left = t - 1
    bloom = F.when(t <= 0, 0.0).when(t >= 1, 1.0).otherwise(1 + left * left * (left * (OVERSHOOT + 1) + OVERSHOOT))
    exits = lambda c, last, share: start[c] + (last - start[c]) * share
    return F.struct(
        F.when(enters, end.x).otherwise(exits("x", end.x, t)).alias("x"), F.when(enters, end.y).otherwise(exits("y", end.y, t)).alias("y"),
        F.when(enters, 1 + left * left * left).otherwise(exits("opacity", 0.0, t * t)).alias("opacity"),
        F.when(enters, bloom).otherwise(exits("scale", GONE_SCALE, t * t)).alias("scale"),
    )


def hit_edge(edges: DataFrame, nodes: DataFrame, x: float, y: float, threshold: float) -> DataFrame:
    """The aggregate edge, the first by its ends, that passes a point within a threshold; edges without both nodes (id, x, y) do not count."""
    folded = edges.where("aggregate")
    for end, k in (("source_id", "a"), ("target_id", "b")):
        folded = folded.join(nodes.select(F.col("id").alias(end), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), end)
    near = segment_distance(F.lit(x), F.lit(y), *(F.col(c) for c in ("ax", "ay", "bx", "by"))) <= threshold
    return folded.where(near).select(*edges.columns).orderBy("source_id", "target_id").limit(1)


def governance_pull(nodes: DataFrame, edges: DataFrame, alpha: float = 1.0, strength: float = PULL) -> DataFrame:
    """(id, x, y, n, vx, vy): the centroid of the shown nodes (id, kind, x, y) that each decision governs, and how it is drawn there.

    A decision that governs no shown node feels nothing and has no row.
    """
    decisions = nodes.where("kind = 'decision'").select("id", F.col("x").alias("own_x"), F.col("y").alias("own_y"))
    targets = nodes.select(F.col("id").alias("target_id"), "x", "y")
    held = edges.where("relation = 'GOVERNS'").select(F.col("source_id").alias("id"), "target_id").join(targets, "target_id")
    mean = held.groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    pull = lambda c: ((F.col(c) - F.col(f"own_{c}")) * strength * alpha).alias(f"v{c}")
    return mean.join(decisions, "id").select("id", "x", "y", "n", pull("x"), pull("y"))


def centroids(points: DataFrame, group: str) -> DataFrame:
    return points.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def link_scale(nodes: DataFrame) -> DataFrame:
    """How far links and charges shrink as more nodes are shown."""
    return nodes.agg((50 / F.sqrt(F.greatest(F.lit(1), F.count("*")).cast("double"))).alias("scale"))


#: Points of a group that one task takes to a hull.
HULL_POINTS = 10_000


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points are the hull's corners, counter-clockwise from the leftmost (of equal ones the lowest)."""
    order = np.lexsort((y, x))
    order = order[np.concatenate(([True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)))]
    px, py, chains = x[order].tolist(), y[order].tolist(), []
    for walk in (range(len(px)), range(len(px) - 1, -1, -1)):
        chain: list[int] = []
        for k in walk:
            while len(chain) > 1 and (px[chain[-1]] - px[chain[-2]]) * (py[k] - py[chain[-2]]) <= (py[chain[-1]] - py[chain[-2]]) * (px[k] - px[chain[-2]]):
                chain.pop()
            chain.append(k)
        chains.append(chain[:-1] if len(px) > 1 else chain)
    return order[chains[0] + (chains[1] if len(px) > 1 else [])]


def convex_hulls(points: DataFrame, group: str) -> DataFrame:
    """(group, x, y, position) of the corners of each group's convex hull, counter-clockwise from the leftmost.

    Corners of a part of the points hold all corners of the whole that lie in it. So a group is dealt into blocks of
    HULL_POINTS, the blocks' corners are gathered and dealt again, and in the end one block has no more than the
    corners of a few. Null coordinates are no points.
    """
    ship(points.sparkSession)
    kind = dict(points.dtypes)[group]
    left = points.where("x is not null and y is not null").select(F.struct(F.col(group).alias("of")).alias("part"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def hull(found: pa.Table) -> pa.Table:
        x, y = found.column("x").to_numpy(), found.column("y").to_numpy()
        own = _corners(x, y)
        return pa.table({"part": found.column("part").take(pa.array(own)), "x": x[own], "y": y[own], "position": pa.array(range(len(own)), pa.int32())})

    schema = f"part struct<of:{kind}>, x double, y double, position int"
    while True:
        size = left.groupBy("part").agg(F.count("*").alias("n"))
        blocks = F.ceil(F.col("n") / HULL_POINTS)
        dealt = left.join(size, "part").withColumn("block", F.pmod(F.xxhash64("x", "y"), blocks))
        found = checkpoint(dealt.select("part", "x", "y", "block").groupBy("part", "block").applyInArrow(hull, schema))
        most, after = size.agg(F.max("n")).first()[0] or 0, found.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= HULL_POINTS:
            return found.select(F.col("part.of").alias(group), "x", "y", "position")
        left = found.select("part", "x", "y")
        if after > most / 2:  # nearly all are corners: what is left is the result's own size
            last = left.groupBy("part").applyInArrow(hull, schema)
            return last.select(F.col("part.of").alias(group), "x", "y", "position")

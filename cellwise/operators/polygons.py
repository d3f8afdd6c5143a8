"""Polygons as edge tables: point membership, rasterising, clipping.

An edge table holds ``(polygon, x1, y1, x2, y2)``; all rings of a polygon go
together, so holes come out by parity. Membership uses an index of grid cells: a
cell that no edge touches is inside or outside as a whole, and only points in
edge cells test the edges of their own cell. Cells with many edges are split
again and again, so a point tests few edges wherever it lies; points that crowd
in one cell are dealt over salts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, single
from .grid import GridSpec
from .joins import dealt_join

#: Edges that a cell may hold before it is split, cells per side of a split, and how often cells are split.
CELL_EDGES, SPLIT, LEVELS = 128, 4, 10


def ring_edges(polygons: DataFrame, polygon: str, ring: str) -> DataFrame:
    """Edges of closed rings given as arrays of ``struct<x, y>``."""
    n = F.size(ring)
    pts = polygons.select(polygon, F.col(ring).alias("_p"),
                          F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).alias("_i"))
    a, b = F.try_element_at("_p", F.col("_i")), F.try_element_at("_p", F.col("_i") + 1)
    return pts.select(polygon, a["x"].alias("x1"), a["y"].alias("y1"),
                      b["x"].alias("x2"), b["y"].alias("y2")).dropna()


def ring_area(ring: Column | str) -> Column:
    """Signed area of a closed ring (array of ``struct<x, y>``)."""
    p = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(p)
    nxt = F.slice(p, F.lit(2), F.greatest(n - 1, F.lit(0)))
    terms = F.zip_with(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), nxt,
                       lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2.0


def ring_ok(ring: Column | str) -> Column:
    """A usable ring: closed, four vertices or more, non-zero area."""
    p = F.col(ring) if isinstance(ring, str) else ring
    closed = F.try_element_at(p, F.lit(1)) == F.try_element_at(p, F.lit(-1))
    return F.coalesce((F.size(p) >= 4) & closed & (F.abs(ring_area(p)) > 0), F.lit(False))


def _runs(edges: DataFrame, polygon: str, grid: GridSpec, offset: float) -> DataFrame:
    """Columns of each row whose reference point lies inside, as runs ``(r, c0, c1)``.

    The reference point of a cell is at its middle row and at ``offset`` cells from
    its left side.
    """
    y = grid.y("r")
    top = F.greatest(grid.row(F.greatest("y1", "y2")) - 1, F.lit(0).cast("bigint"))
    low = F.least(grid.row(F.least("y1", "y2")) + 1, F.lit(grid.height - 1).cast("bigint"))
    hit = (edges.where((F.col("y1") != F.col("y2")) & (top <= low))
           .select(polygon, "x1", "y1", "x2", "y2", F.explode(F.sequence(top, low)).alias("r"))
           .where((F.col("y1") > y) != (F.col("y2") > y))
           .select(polygon, "r", ((F.col("x2") - F.col("x1")) * (y - F.col("y1"))
                                  / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("at")))
    line = Window.partitionBy(polygon, "r").orderBy("at")
    spans = hit.select(polygon, "r", F.col("at").alias("from"), F.lead("at").over(line).alias("to"),
                       F.row_number().over(line).alias("k")).where(
        (F.pmod("k", F.lit(2)) == 1) & F.col("to").isNotNull())
    first = F.ceil((F.col("from") - F.lit(grid.x0)) / F.lit(grid.dx) - F.lit(offset))
    last = F.ceil((F.col("to") - F.lit(grid.x0)) / F.lit(grid.dx) - F.lit(offset)) - 1
    c0 = F.greatest(first, F.lit(0).cast("bigint"))
    c1 = F.least(last, F.lit(grid.width - 1).cast("bigint"))
    return spans.select(polygon, "r", c0.alias("c0"), c1.alias("c1")).where(F.col("c0") <= F.col("c1"))


def _fill(runs: DataFrame, polygon: str) -> DataFrame:
    return runs.select(polygon, "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def _touched(edges: DataFrame, polygon: str, grid: GridSpec, slack: float, split: int = 0) -> DataFrame:
    """Cells that an edge passes through, with the edge; with ``split``, only the
    cells of ``grid`` into which the edge's own cell ``(r, c)`` is divided."""
    r, c = F.col("r"), F.col("c")
    r_low, r_high = (r * split, r * split + split - 1) if split else (F.lit(0).cast("bigint"), F.lit(grid.height - 1).cast("bigint"))
    c_low, c_high = (c * split, c * split + split - 1) if split else (F.lit(0).cast("bigint"), F.lit(grid.width - 1).cast("bigint"))
    eps_y, eps_x = slack * grid.dy, slack * grid.dx
    # a cell met only in a point of its far side does not count
    last_row = F.ceil((F.lit(grid.y0) - F.least("y1", "y2") + eps_y) / F.lit(grid.dy)) - 1
    first_row = grid.row(F.greatest("y1", "y2") + eps_y)
    top = F.greatest(first_row, r_low)
    low = F.least(F.greatest(first_row, last_row), r_high)
    rows = edges.where(top <= low).select(polygon, "x1", "y1", "x2", "y2", c_low.alias("c_low"), c_high.alias("c_high"),
                                          F.explode(F.sequence(top, low)).alias("r"))
    y_hi = F.lit(grid.y0) - F.col("r") * grid.dy + eps_y
    y_lo = F.lit(grid.y0) - (F.col("r") + 1) * grid.dy - eps_y

    def x_at(y: Column) -> Column:
        inside = F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
        return F.when(F.col("y1") == F.col("y2"), None).otherwise(
            F.col("x1") + (inside - F.col("y1")) * (F.col("x2") - F.col("x1"))
            / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))

    lo = F.coalesce(F.least(x_at(y_hi), x_at(y_lo)), F.least("x1", "x2"))
    hi = F.coalesce(F.greatest(x_at(y_hi), x_at(y_lo)), F.greatest("x1", "x2"))
    first = grid.column(lo - eps_x)
    last = F.ceil((hi + eps_x - F.lit(grid.x0)) / F.lit(grid.dx)) - 1
    c0 = F.greatest(first, F.col("c_low"))
    c1 = F.least(F.greatest(first, last), F.col("c_high"))
    rows = rows.select("*", c0.alias("c0"), c1.alias("c1")).where(F.col("c0") <= F.col("c1"))
    return rows.select(polygon, "r", F.explode(F.sequence("c0", "c1")).alias("c"), "x1", "y1", "x2", "y2")


def rasterize(edges: DataFrame, polygon: str, grid: GridSpec, all_touched: bool = False) -> DataFrame:
    """Cells ``(polygon, r, c)`` covered by each polygon: by centre, or all it touches."""
    centre = _fill(_runs(edges, polygon, grid, 0.5), polygon)
    if not all_touched:
        return centre
    edge = _touched(edges, polygon, grid, 0.0).select(polygon, "r", "c")
    return centre.union(edge).distinct()


def rasterize_lines(segments: DataFrame, key: str, grid: GridSpec) -> DataFrame:
    """Cells that each line touches."""
    return _touched(segments, key, grid, 0.0).select(key, "r", "c").distinct()


def rasterize_discs(points: DataFrame, key: str, radius: str, grid: GridSpec) -> DataFrame:
    """Cells whose centre lies within the radius of a point (installed footprint)."""
    r0 = F.greatest(grid.row(F.col("y") + F.col(radius)), F.lit(0).cast("bigint"))
    r1 = F.least(grid.row(F.col("y") - F.col(radius)), F.lit(grid.height - 1).cast("bigint"))
    c0 = F.greatest(grid.column(F.col("x") - F.col(radius)), F.lit(0).cast("bigint"))
    c1 = F.least(grid.column(F.col("x") + F.col(radius)), F.lit(grid.width - 1).cast("bigint"))
    box = points.select(key, "x", "y", radius, r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))
    box = box.where((F.col("r0") <= F.col("r1")) & (F.col("c0") <= F.col("c1")))
    cells = box.select("*", F.explode(F.sequence("r0", "r1")).alias("r"))
    cells = cells.select("*", F.explode(F.sequence("c0", "c1")).alias("c"))
    dx, dy = grid.x() - F.col("x"), grid.y() - F.col("y")
    return cells.where(F.sqrt(dx * dx + dy * dy) <= F.col(radius)).select(key, "r", "c")


def _index_grid(edges: DataFrame) -> GridSpec:
    b = single(edges.agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"),
                         F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1"),
                         F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n")), "the polygon layer is empty")
    side = int(min(2048, max(16, 2 * math.sqrt(b["n"]))))
    w, h = (b["x1"] - b["x0"]) or 1.0, (b["y1"] - b["y0"]) or 1.0
    # an irregular offset keeps cell sides off round coordinates
    dx, dy = w / side * 1.0371931, h / side * 1.0293717
    return GridSpec(b["x0"] - 0.3719 * dx, b["y1"] + 0.4127 * dy, dx, dy, side + 1, side + 1)


def _flips(grid: GridSpec, px: Column, py: Column) -> Column:
    """How many edges of its cell lie between a point and the reference of the cell: east of the point up to the side of
    the cell, then along the side to its middle."""
    side, mid = F.lit(grid.x0) + (F.col("c") + 1) * grid.dx, grid.y("r")
    x_on = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    y_on = (F.col("y2") - F.col("y1")) * (side - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)) + F.col("y1")
    east = ((F.col("y1") > py) != (F.col("y2") > py)) & (px < x_on) & (x_on <= side)
    along = ((F.col("x1") > side) != (F.col("x2") > side)) & ((y_on > py) != (y_on > mid))
    return F.sum(F.coalesce(east, F.lit(False)).cast("int") + F.coalesce(along, F.lit(False)).cast("int"))


def _finer(grid: GridSpec) -> GridSpec:
    return GridSpec(grid.x0, grid.y0, grid.dx / SPLIT, grid.dy / SPLIT, grid.width * SPLIT, grid.height * SPLIT)


def cell_index(edges: DataFrame, polygon: str, grid: GridSpec, held: int = CELL_EDGES,
               levels: int = LEVELS) -> list[tuple[GridSpec, DataFrame, DataFrame | None]]:
    """Per level its grid, the rows ``(polygon, r, c, ref, x1..y2)`` to test, and the cells that go on a level below.

    ``ref`` says whether the middle of the right side of the cell is inside; a row without an edge is a cell that lies
    inside as a whole. A cell with more than ``held`` edges hands them to its parts, the references of which are
    found from the edges of the cell itself.
    """
    inside = _fill(_runs(edges, polygon, grid, 1.0), polygon).withColumn("ref", F.lit(1))
    rows = cut(_touched(edges, polygon, grid, 1e-6).join(inside, [polygon, "r", "c"], "full")
               .withColumn("ref", F.coalesce("ref", F.lit(0))))
    out = []
    for level in range(levels):
        crowded = cut(rows.where(F.col("x1").isNotNull()).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > held).select("r", "c"))
        if level == levels - 1 or crowded.isEmpty():
            return [*out, (grid, rows, None)]
        stay = rows.where(F.col("x1").isNull()).unionByName(
            rows.where(F.col("x1").isNotNull()).join(crowded, ["r", "c"], "left_anti").select(rows.columns))
        out.append((grid, stay, crowded))
        busy = rows.where(F.col("x1").isNotNull()).join(crowded, ["r", "c"], "left_semi")
        finer = _finer(grid)
        step = F.sequence(F.lit(0), F.lit(SPLIT - 1))
        parts = busy.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns(
            {"nr": F.col("r") * SPLIT + F.col("i"), "nc": F.col("c") * SPLIT + F.col("j")})
        at_x, at_y = F.lit(finer.x0) + (F.col("nc") + 1) * finer.dx, finer.y("nr")
        refs = parts.groupBy(polygon, "nr", "nc").agg(_flips(grid, at_x, at_y).alias("n"), F.max("ref").alias("above"))
        refs = refs.select(polygon, F.col("nr").alias("r"), F.col("nc").alias("c"), F.pmod(F.col("n") + F.col("above"), F.lit(2)).cast("int").alias("ref"))
        touched = _touched(busy, polygon, finer, 1e-6, SPLIT)
        rows = cut(touched.join(refs, [polygon, "r", "c"], "full").withColumn("ref", F.coalesce("ref", F.lit(0)))
                   .where(F.col("x1").isNotNull() | (F.col("ref") == 1)))
        grid = finer
    return out


def memberships(points: DataFrame, edges: DataFrame, key: str, polygon: str, held: int = CELL_EDGES) -> DataFrame:
    """All pairs ``(key, polygon)`` with the point inside the polygon."""
    edges = edges.select(polygon, *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    grid = _index_grid(edges)
    at = points.dropna(subset=["x", "y"]).select(
        key, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    left, low, right, high = grid.bounds
    at = at.where(F.col("px").between(left, right) & F.col("py").between(low, high)).select(
        "*", grid.row("py").alias("r"), grid.column("px").alias("c"))
    out = None
    for grid, index, crowded in cell_index(edges, polygon, grid, held):
        both = dealt_join(at, index, ["r", "c"], F.struct(key, "px", "py"))
        whole = both.where(F.col("x1").isNull()).select(key, polygon)
        tested = (both.where(F.col("x1").isNotNull()).groupBy(key, polygon, "px", "py")
                  .agg(_flips(grid, F.col("px"), F.col("py")).alias("n"), F.max("ref").alias("ref"))
                  .where(F.pmod(F.col("n") + F.col("ref"), F.lit(2)) == 1).select(key, polygon))
        found = whole.unionByName(tested)
        out = found if out is None else out.unionByName(found)
        if crowded is not None:
            finer = _finer(grid)
            inner = lambda own, cell: F.greatest(F.least(own, cell * SPLIT + SPLIT - 1), cell * SPLIT)
            at = cut(dealt_join(at, crowded, ["r", "c"], F.struct(key, "px", "py"), "left_semi").select(
                key, "px", "py", inner(finer.row("py"), F.col("r")).alias("r"), inner(finer.column("px"), F.col("c")).alias("c")))
    return out


def cut_lines(lines: DataFrame, edges: DataFrame, key: str, polygon: str) -> DataFrame:
    """The parts of straight lines inside each polygon: ``key, polygon, x1, y1, x2, y2, length``.

    A line is divided where it meets an edge of any polygon (and where an edge on it begins or ends); a piece belongs to the polygons
    that hold its middle, and pieces that follow one another in a polygon are joined. Lines without length are left out. A piece on a border
    belongs to one side, as its middle does.
    """
    ends = ["x1", "y1", "x2", "y2"]
    edges = edges.select(polygon, *[F.col(c).cast("double") for c in ends])
    lines = lines.dropna(subset=ends).select(key, *[F.col(c).cast("double") for c in ends]).where("x1 <> x2 or y1 <> y2").distinct()
    grid = _index_grid(edges)
    lines = lines.withColumn("_line", F.struct(key, *ends))
    index = _touched(edges, polygon, grid, 1e-6).select("r", "c", *[F.col(c).alias(f"e{c}") for c in ends]).distinct()
    near = dealt_join(cut(_touched(lines, "_line", grid, 1e-6)), index, ["r", "c"], F.col("_line")).select("_line", *ends, *[f"e{c}" for c in ends]).distinct()
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    ax, ay = F.col("ex1") - F.col("x1"), F.col("ey1") - F.col("y1")
    den, off = dx * ey - dy * ex, ax * dy - ay * dx
    on_edge = off / F.nullif(den, F.lit(0.0))
    meets = F.when((den != 0) & on_edge.between(0.0, 1.0), F.array((ax * ey - ay * ex) / F.nullif(den, F.lit(0.0))))
    along = lambda x, y: ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / (dx * dx + dy * dy)
    meets = F.coalesce(meets, F.when((den == 0) & (off == 0), F.array(along("ex1", "ey1"), along("ex2", "ey2"))))
    places = near.select("_line", F.explode(meets).alias("t")).where("t > 0 and t < 1").union(
        lines.select("_line", F.explode(F.array(F.lit(0.0), F.lit(1.0)))))
    pieces = places.distinct().withColumn("t1", F.lead("t").over(Window.partitionBy("_line").orderBy("t"))).dropna(subset=["t1"])
    point = lambda a, t: F.col(f"_line.{a}1") + (F.col(f"_line.{a}2") - F.col(f"_line.{a}1")) * t
    half = (F.col("t") + F.col("t1")) / 2.0
    pieces = cut(pieces.select(F.struct("_line", "t", "t1").alias("_piece"), point("x", half).alias("x"), point("y", half).alias("y")))
    held = memberships(pieces, edges, "_piece", polygon).select(polygon, "_piece._line", "_piece.t", "_piece.t1")
    by = Window.partitionBy("_line", polygon).orderBy("t")
    held = held.withColumn("_new", F.coalesce(F.col("t") != F.lag("t1").over(by), F.lit(True)).cast("int"))
    joined = held.withColumn("_run", F.sum("_new").over(by)).groupBy("_line", polygon, "_run").agg(F.min("t").alias("t"), F.max("t1").alias("t1"))
    lx, ly = F.col("_line.x2") - F.col("_line.x1"), F.col("_line.y2") - F.col("_line.y1")
    return joined.select(F.col(f"_line.{key}").alias(key), polygon, point("x", F.col("t")).alias("x1"), point("y", F.col("t")).alias("y1"),
                         point("x", F.col("t1")).alias("x2"), point("y", F.col("t1")).alias("y2"),
                         (F.sqrt(lx * lx + ly * ly) * (F.col("t1") - F.col("t"))).alias("length"))


def assign_polygon(points: DataFrame, edges: DataFrame, key: str, polygon: str,
                   how: str = "inner") -> DataFrame:
    """Points with the first polygon that holds them; unmatched rows drop (or stay NULL)."""
    first = memberships(points, edges, key, polygon).groupBy(key).agg(F.min(polygon).alias(polygon))
    return points.join(first, key, how)


def inside(points: DataFrame, edges: DataFrame, key: str, polygon: str, keep: bool = True) -> DataFrame:
    """Points inside (or outside) the union of the polygons."""
    return points.join(memberships(points, edges, key, polygon).select(key).distinct(), key,
                       "left_semi" if keep else "left_anti")

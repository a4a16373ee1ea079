"""Text regions on pages: filters, pairs, merging and reading order. Everything is keyed by page."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytext.functions.text import is_noise_text, py_strip

MIN_SIDE, MAX_ASPECT, MAX_AREA, MIN_CONFIDENCE = 8, 15, 0.12, 0.1
SIZE_RATIO, AREA_RATIO = 2.5, 1.7
#: Per orientation: largest gap across in character sizes, least overlap along as a share of the smaller side.
GAPS = {"vertical": (1.8, 0.2), "horizontal": (2.0, 0.15)}

#: Side of a cell in which regions meet, in character sizes: large enough that most regions lie in one.
CELL = 16.0


def region_bounds(polygon: Column) -> Column:
    """(x0, y0, x1, y1) of an array of (x, y)."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def region_orientation(width: Column, height: Column) -> Column:
    return F.when(height > width * 1.2, F.lit("vertical")).otherwise(F.lit("horizontal"))


def with_orientation(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("orientation", region_orientation(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def _fits(width: Column, height: Column, min_side: int, max_aspect: float) -> Column:
    return (F.least(width, height) >= min_side) & (F.greatest(width, height) <= F.greatest(F.lit(1), F.least(width, height)) * max_aspect)


def filter_recognized_boxes(boxes: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_side: int = MIN_SIDE) -> DataFrame:
    """Boxes that are sure, legible, large and compact enough; their text is stripped."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.withColumn("text", py_strip("text")).where(
        (F.col("confidence") >= min_confidence) & ~is_noise_text(F.col("text")) & _fits(width, height, min_side, MAX_ASPECT)
    )


def filter_detected_boxes(boxes: DataFrame, pages: DataFrame, min_side: int = MIN_SIDE, max_area: float = MAX_AREA) -> DataFrame:
    """Boxes that are large and compact enough and cover at most ``max_area`` of their page (page_id, width, height)."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = boxes.where(_fits(width, height, min_side, MAX_ASPECT)).join(pages.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h")), "page_id")
    return kept.where(width * height <= F.col("__w") * F.col("__h") * max_area).drop("__w", "__h")


def crop_box(boxes: DataFrame, pages: DataFrame, padding: float = 0.15) -> DataFrame:
    """Boxes grown on all sides by max(2, padding times the longer side), within their page."""
    pad = F.greatest(F.lit(2), (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * padding).cast("int"))
    sized = boxes.join(pages, "page_id")
    return sized.select(
        "page_id", "region_id", F.greatest(F.lit(0), F.col("x0") - pad).alias("x0"), F.greatest(F.lit(0), F.col("y0") - pad).alias("y0"),
        F.least(F.col("width"), F.col("x1") + pad).alias("x1"), F.least(F.col("height"), F.col("y1") + pad).alias("y1"),
    )


def char_size(orientation: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.when(orientation == "vertical", width).otherwise(height))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def _mergeable() -> Column:
    """Whether regions a and b of a page and an orientation belong together."""
    c = F.col
    side = lambda s, lo, hi: F.greatest(F.lit(1), c(f"{s}.{hi}") - c(f"{s}.{lo}"))
    aw, ah, bw, bh = side("a", "x0", "x1"), side("a", "y0", "y1"), side("b", "x0", "x1"), side("b", "y0", "y1")
    size_a, size_b = char_size(c("a.orientation"), aw, ah), char_size(c("a.orientation"), bw, bh)
    union = (F.greatest(c("a.x1"), c("b.x1")) - F.least(c("a.x0"), c("b.x0"))) * (F.greatest(c("a.y1"), c("b.y1")) - F.least(c("a.y0"), c("b.y0")))
    gap = lambda lo, hi: F.greatest(F.lit(0), F.greatest(c(f"a.{lo}"), c(f"b.{lo}")) - F.least(c(f"a.{hi}"), c(f"b.{hi}")))
    size = (size_a + size_b) / 2
    lap = lambda lo, hi: overlap(c(f"a.{lo}"), c(f"a.{hi}"), c(f"b.{lo}"), c(f"b.{hi}"))
    (v_gap, v_lap), (h_gap, h_lap) = GAPS["vertical"], GAPS["horizontal"]
    vertical = (gap("x0", "x1") <= size * v_gap) & (lap("y0", "y1") >= F.least(ah, bh) * v_lap)
    horizontal = (gap("y0", "y1") <= size * h_gap) & (lap("x0", "x1") >= F.least(aw, bw) * h_lap)
    return (
        (F.greatest(size_a, size_b) / F.least(size_a, size_b) <= SIZE_RATIO)
        & (union <= (aw * ah + bw * bh) * AREA_RATIO)
        & F.when(c("a.orientation") == "vertical", vertical).otherwise(horizontal)
    )


def region_pairs(regions: DataFrame) -> DataFrame:
    """(page_id, a, b), a < b: regions of one page and orientation that belong together. Pages of at most AT_ONCE regions are
    tested many at a time, in the exchange that their regions came by. On larger ones regions meet in cells of a grid of
    their page only, so that those far from each other are no candidates and a page with many regions is many groups."""
    known = regions.dropna(subset=["page_id", "region_id", "orientation", "x0", "y0", "x1", "y1"])
    large = known.groupBy("page_id").count().where(F.col("count") > AT_ONCE).select("page_id")
    if large.isEmpty():
        return _pairs_by_page(known)
    pairs, ids = _candidates(known.join(large, "page_id", "left_semi")).where(_mergeable() & (F.col("a.region_id") != F.col("b.region_id"))), ("a.region_id", "b.region_id")
    met = pairs.select(F.col("a.page_id"), F.least(*ids).alias("a"), F.greatest(*ids).alias("b"))
    return _pairs_by_page(known.join(large, "page_id", "left_anti")).unionByName(met)


def _pairs_by_page(regions: DataFrame) -> DataFrame:
    """The pairs of pages of few regions: pages of one number of regions are tested together."""
    page, region = (regions.schema[c].dataType.simpleString() for c in ("page_id", "region_id"))
    names = ["region_id", "orientation", "x0", "y0", "x1", "y1"]
    pages = regions.groupBy("page_id").agg(F.collect_list(F.struct(*names)).alias("regions")).where(F.size("regions") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = batch.column(0), batch.column(1)
            n, column = np.diff(found.offsets.to_numpy()), found.flatten().field
            first, ids, kind = np.cumsum(n) - n, column("region_id").to_numpy(), column("region_id").type
            box = np.stack([column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1).astype(np.int64)
            vertical = pc.equal(column("orientation"), "vertical").to_numpy(zero_copy_only=False)
            for k in np.unique(n):
                one, other = np.triu_indices(k, 1)
                alike, step = np.flatnonzero(n == k), max(1, (1 << 18) // len(one))
                for at in range(0, len(alike), step):
                    some = alike[at : at + step]
                    i, j = first[some, None] + one, first[some, None] + other
                    row, pair = np.nonzero(_together(box[i], box[j], vertical[i], vertical[j]) & (ids[i] != ids[j]))
                    a, b = ids[i[row, pair]], ids[j[row, pair]]
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(some[row])), pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind)], ["page_id", "a", "b"]
                    )

    return pages.mapInArrow(run, f"page_id {page}, a {region}, b {region}")


def _candidates(regions: DataFrame) -> DataFrame:
    """Regions a and b that meet in a cell, a being in a higher octave of character sizes or, in the same, of the lesser id.
    Cells are squares of CELL times the octave's least size. Sizes that are near enough differ by two octaves at most: a
    stands in the cells of its octave, grown across by the farthest gap that is allowed, b in those of its own octave and
    the two above. Of the cells in which a pair meets only that counts which holds the lower corner of the overlap."""
    c = F.col
    width, height = F.greatest(F.lit(1), c("x1") - c("x0")), F.greatest(F.lit(1), c("y1") - c("y0"))
    size, upright = char_size(c("orientation"), width, height), c("orientation") == "vertical"
    octave = F.floor(F.log2(size)).cast("int")
    grown = [F.when(upright == flag, F.ceil(size * GAPS[kind][0])).otherwise(0) for flag, kind in ((True, "vertical"), (False, "horizontal"))]
    side = lambda octave: F.lit(CELL) * F.pow(F.lit(2.0), octave)

    def celled(rows: DataFrame) -> DataFrame:
        cells = lambda lo, hi, by: F.sequence(*(F.floor(v / side(c("level"))) for v in (c(lo) - c(by), F.greatest(lo, hi) + c(by))))
        return rows.select("*", F.explode(cells("x0", "x1", "by_x")).alias("cx")).select("*", F.explode(cells("y0", "y1", "by_y")).alias("cy"))

    sized = regions.select("page_id", "region_id", "orientation", "x0", "y0", "x1", "y1", octave.alias("octave"))
    by = {"by_x": grown[0].cast("long"), "by_y": grown[1].cast("long")}
    a = celled(sized.withColumns({"level": c("octave"), **by})).alias("a")
    levels = F.explode(F.sequence(c("octave"), c("octave") + math.ceil(math.log2(SIZE_RATIO))))
    b = celled(sized.withColumns({"level": levels, **dict.fromkeys(by, F.lit(0))})).alias("b")
    same = [c(f"a.{k}") == c(f"b.{k}") for k in ("page_id", "orientation", "level", "cx", "cy")]
    larger = (c("a.octave") > c("b.octave")) | ((c("a.octave") == c("b.octave")) & (c("a.region_id") < c("b.region_id")))
    first = [F.floor(F.greatest(c(f"a.{k}0") - c(f"a.by_{k}"), c(f"b.{k}0")) / side(c("a.level"))) == c(f"a.c{k}") for k in "xy"]
    return a.join(b, reduce(and_, [*same, larger, *first]))


def _together(a: np.ndarray, b: np.ndarray, a_vertical: np.ndarray, b_vertical: np.ndarray) -> np.ndarray:
    """The same test for boxes (x0, y0, x1, y1 in the last axis) that stand opposite each other."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = np.moveaxis(a, -1, 0), np.moveaxis(b, -1, 0)
    aw, ah, bw, bh = (np.maximum(1, x) for x in (ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0))
    a_size, b_size = np.where(a_vertical, aw, ah), np.where(b_vertical, bw, bh)
    union = (np.maximum(ax1, bx1) - np.minimum(ax0, bx0)) * (np.maximum(ay1, by1) - np.minimum(ay0, by0))
    mean = (a_size + b_size) / 2
    cx, cy = np.minimum(ax1, bx1) - np.maximum(ax0, bx0), np.minimum(ay1, by1) - np.maximum(ay0, by0)
    (v_gap, v_lap), (h_gap, h_lap) = GAPS["vertical"], GAPS["horizontal"]
    along_v = (-cx <= mean * v_gap) & (np.maximum(0, cy) >= np.minimum(ah, bh) * v_lap)
    along_h = (-cy <= mean * h_gap) & (np.maximum(0, cx) >= np.minimum(aw, bw) * h_lap)
    return (
        (a_vertical == b_vertical)
        & (np.maximum(a_size, b_size) / np.minimum(a_size, b_size) <= SIZE_RATIO)
        & (union <= (aw * ah + bw * bh) * AREA_RATIO)
        & np.where(a_vertical, along_v, along_h)
    )


def _pair_matrix(box: np.ndarray, vertical: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The test for all regions of a page at once: rows for those of ``of``, or all."""
    of = np.arange(len(box)) if of is None else of
    return _together(box[of, None], box[None], vertical[of, None], vertical[None])


def column_order(box: list[list[int]] | np.ndarray) -> list[int]:
    """Vertical reading order: from the right, each box joins the column that it overlaps most in y (at least 1, or 4 or its
    height if less), or begins one; columns by their right edge, boxes in a column by top."""
    x0, y0, x1, y1 = np.array(box, np.int64).reshape(-1, 4).T
    visit = np.argsort(-x0, kind="stable")
    column, tops, bottoms, rights = np.zeros(len(x0), np.int64), [], [], []
    for i in visit:
        lap = np.minimum(bottoms, y1[i]) - np.maximum(tops, y0[i]) if tops else np.zeros(1)
        k = int(lap.argmax())
        if lap[k] < max(1, min(y1[i] - y0[i], 4)):
            k = len(tops)
            for edges, v in ((tops, y0[i]), (bottoms, y1[i]), (rights, x1[i])):
                edges.append(v)
        column[i], tops[k], bottoms[k], rights[k] = k, min(tops[k], y0[i]), max(bottoms[k], y1[i]), max(rights[k], x1[i])
    rank = np.empty(len(x0), np.int64)
    rank[visit] = np.arange(len(x0))
    return np.lexsort((rank, y0, column, -np.array(rights, np.int64)[column])).tolist()


def _groups(belongs: Callable[[int], np.ndarray], box: np.ndarray, cap: float) -> list[list[int]]:
    """Groups joined until nothing changes: always the first two, in order, of which a pair belongs together and (cap > 0)
    whose common box is at most cap. ``belongs``: which regions belong to one.

    As the first group is tried with all others, it takes one region after the other, each time the first that may come,
    until none may. A box only grows, so what was refused stays refused, also as a part of a larger group: groups are
    made one by one, and every region's row is looked up once."""
    free, groups = np.ones(len(box), bool), []
    while free.any():
        i = int(free.argmax())
        group, near, common = [], np.zeros(len(box), bool), box[i].copy()
        while True:
            group.append(i)
            free[i] = False
            near |= belongs(i)
            common[:2], common[2:] = np.minimum(common[:2], box[i, :2]), np.maximum(common[2:], box[i, 2:])
            may = near & free
            if cap > 0 and may.any():
                low, high = np.minimum(common[:2], box[:, :2]), np.maximum(common[2:], box[:, 2:])
                may &= (high - low).prod(axis=1) <= cap
            i = int(may.argmax())
            if not may[i]:
                break
        groups.append(group)
    return groups


#: Regions of a page up to which all pairs are tested at once; beyond it one region's pairs at a time, in bounded memory.
AT_ONCE = 512

MERGED = (
    "page_id long, nth int, x0 int, y0 int, x1 int, y1 int, text string, confidence double, orientation string, n_regions int"
)


def merge_regions(regions: DataFrame, cap: float = 0) -> DataFrame:
    """(page_id, nth, box, text, confidence, orientation, n_regions): regions of a page merged into groups, numbered by
    (y0, x0). ``cap``: largest area of a group's box; 0 for none, when groups are the connected components of
    ``region_pairs``. Regions are taken in order of region_id. A page is one task's work."""

    def page(page_id: int, regions: list[dict]) -> list[tuple]:
        box = np.array([[r[c] for c in ("x0", "y0", "x1", "y1")] for r in regions], np.int64)
        vertical = np.array([r["orientation"] == "vertical" for r in regions])
        if len(box) > AT_ONCE:
            belongs, alone = lambda i: _pair_matrix(box, vertical, np.array([i]))[0], False
        else:
            pairs = _pair_matrix(box, vertical) if len(box) > 1 else np.eye(1, dtype=bool)
            belongs, alone = pairs.__getitem__, pairs.sum() == len(box)  # alone: each goes with itself only
        rows = []
        for group in [[i] for i in range(len(box))] if alone else _groups(belongs, box, cap):
            if len(group) > 1:
                if vertical[group[0]]:
                    group = [group[k] for k in column_order(box[group].tolist())]
                else:
                    group = sorted(group, key=lambda i: (box[i][1], box[i][0]))
            mean = sum(regions[i]["confidence"] for i in group) / len(group)
            text = "".join(regions[i]["text"] for i in group)
            rows.append((*box[group, :2].min(0).tolist(), *box[group, 2:].max(0).tolist(), text, mean, regions[group[0]]["orientation"], len(group)))
        rows.sort(key=lambda r: (r[1], r[0]))
        return [(page_id, nth, *row) for nth, row in enumerate(rows)]

    names = ["region_id", "x0", "y0", "x1", "y1", "text", "confidence", "orientation"]
    return _by_page(regions, names, page, MERGED, _unmerged)


#: Regions of a page up to which all pages of a batch are tested for pairs together.
FEW = 16


def _unmerged(keys: pa.Array, found: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Which pages have so few regions, none of which belong together, and their rows: each region is a group."""
    n = np.diff(found.offsets.to_numpy())
    first, found_ = np.cumsum(n) - n, found.flatten()
    column = lambda c: found_.field(c)
    box = np.stack([column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1).astype(np.int64)
    vertical = pc.fill_null(pc.equal(column("orientation"), "vertical"), False).to_numpy(zero_copy_only=False)
    alone = n <= FEW
    for k in range(2, int(n[alone].max(initial=0)) + 1):
        pages = np.flatnonzero(n == k)
        i, j = (first[pages, None] + side for side in np.triu_indices(k, 1))
        alone[pages] = ~_together(box[i], box[j], vertical[i], vertical[j]).any(axis=1)
    page = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(alone[page])
    at = at[np.lexsort((at, box[at, 0], box[at, 1], page[at]))]
    start = np.cumsum(n * alone) - n * alone
    take = lambda c: column(c).take(pa.array(at))
    nth = pa.array((np.arange(len(at)) - start[page[at]]).astype(np.int32))
    boxes = [pa.array(box[at, c].astype(np.int32)) for c in range(4)]
    return alone, [keys.take(pa.array(page[at])), nth, *boxes, take("text"), take("confidence"), take("orientation"), pa.array(np.ones(len(at), np.int32))]


def _by_page(
    regions: DataFrame, names: list[str], page: Callable[[int, list[dict]], list[tuple]], schema: str, at_once: Callable | None = None
) -> DataFrame:
    """Rows of ``page`` (page_id, its regions in order of region_id) for every page, many pages at a time: one exchange,
    and no frame per page. ``at_once`` settles pages of a batch together and tells which; the rest go to ``page``."""
    pages = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("regions"))
    columns = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if at_once:
                settled, made = at_once(batch.column(0), batch.column(1))
                yield pa.RecordBatch.from_arrays(made, columns)
                batch = batch.filter(pa.array(~settled))
            rows = [r for key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in page(key, found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)

    return pages.mapInArrow(run, schema)


def merge_group_agg(members: DataFrame) -> DataFrame:
    """(page_id, grp, box, confidence, text, n_regions) of regions with a group number: box union, mean confidence, text by
    (y0, x0)."""
    order = F.array_sort(F.collect_list(F.struct("y0", "x0", "region_id", "text")))
    return members.groupBy("page_id", "grp").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg("confidence").alias("confidence"), F.array_join(F.transform(order, lambda r: r["text"]), "").alias("text"),
        F.count("*").alias("n_regions"),
    )


def vertical_reading_order(regions: DataFrame) -> DataFrame:
    """(page_id, region_id, nth) of each page's regions by ``column_order``."""

    def page(page_id: int, found: list[dict]) -> list[tuple]:
        order = column_order([[r[c] for c in ("x0", "y0", "x1", "y1")] for r in found])
        return [(page_id, found[i]["region_id"], nth) for nth, i in enumerate(order)]

    return _by_page(regions, ["region_id", "x0", "y0", "x1", "y1"], page, "page_id long, region_id int, nth int")


def page_report(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, regions, mean_confidence): also for pages without regions. Sums are exact, in any order."""
    exact = F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double")
    counted = regions.groupBy("page_id").agg(F.count("*").alias("regions"), F.round(exact / F.count("*"), 3).alias("mean_confidence"))
    return pages.select("page_id").join(counted, "page_id", "left").select("page_id", F.coalesce("regions", F.lit(0)).alias("regions"), "mean_confidence")


def split_pages_without_text(pages: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with regions, and pages that pass through."""
    keys = regions.select("page_id").distinct()
    return pages.join(keys, "page_id", "left_semi"), pages.join(keys, "page_id", "left_anti")


def union_box_sources(boxes: DataFrame, quads: DataFrame) -> DataFrame:
    """Axis-aligned boxes (x0, x1, y0, y1) and free quads (polygon) as one table of polygons."""
    return boxes.select("page_id", box_polygon(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("polygon")).unionByName(quads.select("page_id", "polygon"))

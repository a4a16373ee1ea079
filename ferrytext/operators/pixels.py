"""Colours of page regions, and erasing text on flat ground: numpy over the regions of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of what counts as text in a region, and the colours it takes where its own is too near the ground's.
PADDING = 3
LEAST_DIFFERENCE, PERCENTILE, MIN_FILL, MAX_FILL, BOLD, FLAT, CONTRAST = 24, 58, 0.015, 0.55, 0.45, 20, 45
LUMA, LUMA_STEP, STRONGEST = np.array([0.299, 0.587, 0.114]), 28, 0.2
DARK, LIGHT = [25] * 3, [245] * 3


def _grow(mask: np.ndarray) -> np.ndarray:
    """3 x 3 dilation of a mask, or of each of many."""
    wide = mask.copy()
    wide[..., 1:, :] |= mask[..., :-1, :]
    wide[..., :-1, :] |= mask[..., 1:, :]
    out = wide.copy()
    out[..., 1:] |= wide[..., :-1]
    out[..., :-1] |= wide[..., 1:]
    return out


def _shrink(mask: np.ndarray) -> np.ndarray:
    return ~_grow(~mask)


def polygon_mask(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centres are inside a polygon, by scan lines, and those on its edges. Every edge turns inside and outside
    about from where it crosses a line on; the work is one step for each line that an edge crosses, and one a pixel."""
    turns, edge = np.zeros((height, width + 1), np.int32), np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0)):
        if ay != by:
            y = np.arange(max(min(ay, by), 0), min(max(ay, by), height))
            x = np.ceil(ax + (y - ay) * (bx - ax) / (by - ay)).clip(0, width).astype(int)
            turns[y, x] += 1
        n = int(max(abs(bx - ax), abs(by - ay), 1))
        at = np.round(np.linspace((ax, ay), (bx, by), n + 1)).astype(int)
        at = at[(at >= 0).all(1) & (at[:, 0] < width) & (at[:, 1] < height)]
        edge[at[:, 1], at[:, 0]] = True
    return (np.cumsum(turns, axis=1)[:, :width] % 2 == 1) | edge


def runs_of(mask: np.ndarray) -> list[dict]:
    """Runs (start, length) of a mask's pixels, counted row by row."""
    ends = np.flatnonzero(np.diff(mask.ravel().astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return [{"start": int(a), "length": int(b - a)} for a, b in ends]


def _cut(rgb: np.ndarray, polygon: np.ndarray, padding: int) -> tuple[int, int, np.ndarray]:
    """Where a region with its padding begins in its picture, and its pixels."""
    (x0, y0), (x1, y1) = np.maximum(polygon.min(0) - padding, 0), np.minimum(polygon.max(0) + padding, [rgb.shape[1] - 1, rgb.shape[0] - 1])
    return int(x0), int(y0), rgb[y0 : y1 + 1, x0 : x1 + 1]


def region_stats(rgb: np.ndarray, polygon: np.ndarray, padding: int = PADDING) -> dict:
    """Of a region (its corners, which belong to it) with some padding: place in the picture, background (median of the
    border) and its spread, the text's colour, weight and share of the polygon, and the text's mask."""
    x0, y0, crop = _cut(rgb, polygon, padding)
    return {"x0": x0, "y0": y0, **_stats_of(crop[None], polygon_mask(polygon - [x0, y0], *crop.shape[:2]))[0]}


def _stats_of(crops: np.ndarray, shape: np.ndarray) -> list[dict]:
    """The statistics of regions of one size and shape.

    Text differs from the background by the percentile of the polygon or the least difference; where that is next to
    nothing, it is what is clearly darker than a light ground or lighter than a dark one; where it is too much, only
    the strongest part is. Its colour is that of the fifth that is farthest from the ground in brightness.
    """
    n, area, values = len(crops), max(1, int(shape.sum())), crops.astype(np.float32)
    edge = np.concatenate([values[:, 0], values[:, -1], values[:, :, 0], values[:, :, -1]], axis=1)
    background, spread = np.median(edge, axis=1), edge.reshape(n, -1).std(axis=1)
    grounds, planes = background.mean(axis=1), np.ascontiguousarray(np.moveaxis(values, 3, 0))
    bright, off = (planes[0] + planes[1] + planes[2]) / np.float32(3), planes - background.T[:, :, None, None]
    off *= off
    difference = np.sqrt(off[0] + off[1] + off[2])
    inside = difference[:, shape]
    share = lambda x, q: np.percentile(x, q, axis=-1).astype(np.float32) if shape.any() else np.zeros(x.shape[:-1], np.float32)
    least = np.maximum(np.float32(LEAST_DIFFERENCE), share(inside, PERCENTILE))
    masks = shape & (difference >= least[:, None, None])
    sums = masks.sum((1, 2))
    for i in np.flatnonzero(sums < MIN_FILL * area):
        light, ground = np.floor(values[i] @ LUMA + 0.5), float(grounds[i])
        masks[i] = shape & (light < int(ground - LUMA_STEP) if ground > 128 else light > min(255, int(ground + LUMA_STEP)))
        sums[i] = masks[i].sum()
    for i in np.flatnonzero(sums > MAX_FILL * area):
        masks[i] = shape & (difference[i] >= share(inside[i], 100 * (1 - MAX_FILL)))
        sums[i] = masks[i].sum()
    masks = _grow(_shrink(_grow(masks)))
    colors, found = _strongest(crops, masks, np.abs(bright - grounds[:, None, None]))
    rows = []
    for i, (mask, color, ground, fill) in enumerate(zip(masks, colors.tolist(), background.astype(int).tolist(), (sums / area).tolist())):
        contrast = DARK if grounds[i] > 128 else LIGHT
        color = color if found[i] else contrast
        if sum((a - b) ** 2 for a, b in zip(color, ground)) < CONTRAST**2:
            color = contrast
        weight = "bold" if fill > BOLD else "normal"
        rows.append({"background": ground, "spread": float(spread[i]), "color": color, "weight": weight, "fill": fill, "mask": mask})
    return rows


def _strongest(crops: np.ndarray, masks: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each region the median colour of the fifth of its mask that is farthest, of equally far pixels the first ones; and
    whether its mask has any pixel. Pixels are sorted by distance and place in one number."""
    n, counts = len(crops), masks.sum((1, 2))
    taken = np.maximum(1, (counts * STRONGEST).astype(int))
    places = np.arange(far[0].size, dtype=np.uint64)
    keys = ~far.reshape(n, -1).view(np.uint32) & np.uint64(0xFFFFFFFF)
    keys = np.where(masks.reshape(n, -1), keys << np.uint64(32) | places, np.iinfo(np.uint64).max)
    keys.sort(axis=1)
    first = keys[:, : taken.max()] & np.uint64(0xFFFFFFFF)
    colors = np.take_along_axis(crops.reshape(n, -1, 3), np.minimum(first, places[-1]).astype(np.int64)[:, :, None], axis=1).astype(np.uint16)
    colors[np.arange(first.shape[1]) >= taken[:, None]] = 1 << 15
    colors, nth = np.sort(colors.transpose(0, 2, 1), axis=2), np.arange(n)
    return (colors[nth, :, (taken - 1) // 2] + colors[nth, :, taken // 2]) // 2, counts > 0


PIXELS = "page_id long, region_id int, background array<int>, color array<int>, weight string, fill double, flat boolean"


def _pages(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Images (page_id, height, width, rgb) with the corners of their regions, given as ``polygon`` (an array of x, y) or as
    x0, y0, x1, y1: pictures are shuffled once and never sorted."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    polygon = F.col("polygon") if "polygon" in regions.columns else box
    shapes = regions.select("page_id", F.struct("region_id", polygon.alias("polygon")).alias("r"))
    shapes = shapes.groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("regions"))
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small pictures are much work too
    return images.select("page_id", "height", "width", "rgb").repartition(parts, "page_id").join(shapes.hint("shuffle_hash"), "page_id", "left")


#: Pages whose regions are judged together, and regions of one size and shape, by their pixels at most.
PAGES_AT_ONCE, PIXELS_AT_ONCE = 64, 1 << 18


def _on_pages(regions: pa.ListArray, sizes: list[tuple[int, int]], padding: int) -> Iterator[tuple[int, int, list[int], list[int], np.ndarray]]:
    """Of regions of which any part lies on their pages (of these widths and heights): number of the page, id, where they begin
    and end with their padding, and the corners from there on."""
    flat, of_page = regions.flatten(), pc.fill_null(regions.value_lengths(), 0).to_numpy()
    polygons = flat.field("polygon")
    points, n = polygons.flatten(), polygons.value_lengths()
    if n.null_count or points.null_count or any(points.field(c).null_count for c in "xy"):
        raise ValueError("a region without its corners")
    corners = np.stack([points.field(c).to_numpy() for c in "xy"], axis=1).astype(np.int64)
    n, extents = n.to_numpy(), np.array(sizes, np.int64).reshape(-1, 2)
    pages, ids, ends, filled = np.repeat(np.arange(len(of_page)), of_page), flat.field("region_id").to_pylist(), np.cumsum(n), np.flatnonzero(n)
    if not len(filled):
        return
    starts, extents = (ends - n)[filled], extents[pages[filled]]
    low, high = np.minimum.reduceat(corners, starts), np.maximum.reduceat(corners, starts)
    begin, end = np.maximum(low - padding, 0), np.minimum(high + padding + 1, extents)
    inside = (low < extents).all(1) & (high >= 0).all(1)
    for i, k in zip(np.flatnonzero(inside).tolist(), filled[inside].tolist()):
        yield int(pages[k]), ids[k], begin[i].tolist(), end[i].tolist(), corners[ends[k] - n[k] : ends[k]] - begin[i]


def _each(batch: pa.RecordBatch, padding: int) -> Iterator[tuple[int, np.ndarray, list[tuple[int, dict]]]]:
    """Pages with the statistics of their regions, in order. Regions of one size and shape are judged together."""
    for first in range(0, batch.num_rows, PAGES_AT_ONCE):
        some, pages, alike = batch.slice(first, PAGES_AT_ONCE), [], {}
        for page_id, height, width, rgb in zip(*(some.column(c) for c in ("page_id", "height", "width", "rgb"))):
            rgb = np.frombuffer(rgb.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), 3)
            pages.append((page_id.as_py(), rgb, []))
        for page, region_id, (x0, y0), (x1, y1), polygon in _on_pages(some.column("regions"), [rgb.shape[1::-1] for _, rgb, _ in pages], padding):
            crop, stats = pages[page][1][y0:y1, x0:x1], {"x0": x0, "y0": y0}
            pages[page][2].append((region_id, stats))
            alike.setdefault((crop.shape, polygon.tobytes()), []).append((stats, crop, polygon))
        for ((height, width, _), _), rows in alike.items():
            shape, step = polygon_mask(rows[0][2], height, width), max(1, PIXELS_AT_ONCE // (height * width))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                for (stats, _, _), made in zip(some, _stats_of(np.stack([crop for _, crop, _ in some]), shape)):
                    stats.update(made)
        yield from pages


def region_pixel_stats(images: DataFrame, regions: DataFrame, padding: int = PADDING) -> DataFrame:
    """Colours, weight and flatness of every region of which any part lies on its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, s["background"], s["color"], s["weight"], s["fill"], s["spread"] < FLAT) for p, _, found in _each(batch, padding) for i, s in found]
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in PIXELS.split(", ")])

    return _pages(images, regions).mapInArrow(run, PIXELS)


RUNS = "runs array<struct<start: bigint, length: bigint>>"


def erase_flat_regions(images: DataFrame, regions: DataFrame, padding: int = PADDING) -> DataFrame:
    """(page_id, rgb, needs_inpaint, runs): text on flat ground, and some pixels around it, filled with its background, in
    order of regions; the ids of other regions are listed, and the union of their texts' masks, which is to be painted
    anew, is given as runs (start, length) of pixels, counted row by row. All regions are judged on the picture as it
    came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, rgb, found in _each(batch, padding):
                out, rest, anew = rgb.copy(), [], np.zeros(rgb.shape[:2], bool)
                for region_id, s in found:
                    mask = s["mask"]
                    if s["spread"] >= FLAT:
                        rest.append(region_id)
                        anew[s["y0"] : s["y0"] + mask.shape[0], s["x0"] : s["x0"] + mask.shape[1]] |= mask
                        continue
                    for _ in range(max(2, min(4, padding))):
                        mask = _grow(mask)
                    out[s["y0"] : s["y0"] + mask.shape[0], s["x0"] : s["x0"] + mask.shape[1]][mask] = s["background"]
                rows.append((page_id, out.tobytes(), rest, runs_of(anew)))
            types = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page_id", "rgb", "needs_inpaint", "runs"])

    return _pages(images, regions).mapInArrow(run, f"page_id long, rgb binary, needs_inpaint array<int>, {RUNS}")

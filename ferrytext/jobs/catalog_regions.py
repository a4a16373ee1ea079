"""Registered queries over page regions and typesetting, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytext.jobs.catalog import Catalog
from ferrytext.operators import layout as L
from ferrytext.operators import regions as R
from ferrytext.sources.views import BOXES_SQL, PAGE_HEIGHT, PAGE_WIDTH, boxes

_catalog = Catalog()
QUERIES, ORACLE_SQL, query = _catalog.queries, _catalog.sql, _catalog.query

_FIT = f"least(x1 - x0, y1 - y0) >= {R.MIN_SIDE} AND greatest(x1 - x0, y1 - y0) <= least(x1 - x0, y1 - y0) * {R.MAX_ASPECT}"
BOXES = f"boxes AS ({BOXES_SQL}), fit AS (SELECT *, CASE WHEN y1 - y0 > (x1 - x0) * 1.2 THEN 'vertical' ELSE 'horizontal' END AS orientation FROM boxes WHERE {_FIT})"
_LAP = lambda lo, hi: f"greatest(0, least(a.{hi}, b.{hi}) - greatest(a.{lo}, b.{lo}))"
_GAP = lambda lo, hi: f"greatest(0, greatest(a.{lo}, b.{lo}) - least(a.{hi}, b.{hi}))"
_SIZE = lambda s: f"(CASE WHEN {s}.orientation = 'vertical' THEN {s}.x1 - {s}.x0 ELSE {s}.y1 - {s}.y0 END)"
PAIRS = f"""pairs AS (SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM fit a JOIN fit b USING (page_id, orientation)
  WHERE a.region_id < b.region_id AND greatest({_SIZE("a")}, {_SIZE("b")}) / least({_SIZE("a")}, {_SIZE("b")}) <= {R.SIZE_RATIO}
  AND (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) <=
    ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)) * {R.AREA_RATIO}::DOUBLE
  AND CASE WHEN a.orientation = 'vertical'
    THEN {_GAP("x0", "x1")} <= ({_SIZE("a")} + {_SIZE("b")}) / 2 * 1.8::DOUBLE AND {_LAP("y0", "y1")} >= least(a.y1 - a.y0, b.y1 - b.y0) * 0.2::DOUBLE
    ELSE {_GAP("y0", "y1")} <= ({_SIZE("a")} + {_SIZE("b")}) / 2 * 2.0::DOUBLE AND {_LAP("x0", "x1")} >= least(a.x1 - a.x0, b.x1 - b.x0) * 0.15::DOUBLE END)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = boxes(spark, sf_dir).select("page_id").distinct()
    more = ids.select((F.col("page_id") + 1_000_000_000).alias("page_id"))
    return ids.unionByName(more.where("page_id % 10 = 0")).withColumns({"width": F.lit(PAGE_WIDTH), "height": F.lit(PAGE_HEIGHT)})


PAGES = "pages AS (SELECT DISTINCT page_id FROM boxes UNION ALL SELECT DISTINCT page_id + 1000000000 FROM boxes WHERE (page_id + 1000000000) % 10 = 0)"


def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return R.with_orientation(R.filter_detected_boxes(rows, pages(spark, sf_dir), max_area=1e9))


@query(f"WITH {BOXES} SELECT page_id, region_id, x0, y0, x1, y1 FROM boxes")
def region_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygon = R.box_polygon(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return boxes(spark, sf_dir).select("page_id", "region_id", R.region_bounds(polygon).alias("b")).select("page_id", "region_id", "b.*")


@query(f"WITH {BOXES} SELECT page_id, region_id, text, confidence FROM fit WHERE confidence >= 0.1")
def filter_recognized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_recognized_boxes(boxes(spark, sf_dir)).select("page_id", "region_id", "text", "confidence")


@query(f"WITH {BOXES} SELECT page_id, region_id FROM fit WHERE (x1 - x0) * (y1 - y0) <= {PAGE_WIDTH * PAGE_HEIGHT} * 0.05::DOUBLE")
def filter_detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_detected_boxes(boxes(spark, sf_dir), pages(spark, sf_dir), max_area=0.05).select("page_id", "region_id")


@query(f"WITH {BOXES} SELECT page_id, region_id, orientation FROM fit")
def region_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(spark, sf_dir).select("page_id", "region_id", "orientation")


@query(
    f"""WITH {BOXES} SELECT page_id, region_id, greatest(0, x0 - p) AS x0, greatest(0, y0 - p) AS y0, least({PAGE_WIDTH}, x1 + p) AS x1, least({PAGE_HEIGHT}, y1 + p) AS y1
    FROM (SELECT *, greatest(2, floor(greatest(x1 - x0, y1 - y0) * 0.15::DOUBLE)::INT) AS p FROM boxes)"""
)
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crop_box(boxes(spark, sf_dir), pages(spark, sf_dir))


@query(f"WITH {BOXES} SELECT page_id, region_id, greatest(1, {_SIZE('f')})::INT AS size, greatest(0, least(x1, 120) - greatest(x0, 60))::INT AS lap FROM fit f")
def char_size_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = R.char_size(F.col("orientation"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    lap = R.overlap(F.col("x0"), F.col("x1"), F.lit(60), F.lit(120))
    return fit(spark, sf_dir).select("page_id", "region_id", size.alias("size"), lap.alias("lap"))


@query(f"WITH {BOXES}, {PAIRS} SELECT * FROM pairs")
def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_pairs(fit(spark, sf_dir))


_COMPONENTS = f"""{BOXES}, {PAIRS}, links AS (SELECT page_id, a, b FROM pairs UNION ALL SELECT page_id, b, a FROM pairs),
  reach AS (SELECT page_id, region_id AS a, region_id AS b FROM fit UNION SELECT r.page_id, r.a, l.b FROM reach r JOIN links l ON l.page_id = r.page_id AND l.a = r.b),
  grouped AS (SELECT page_id, a AS region_id, min(b) AS grp FROM reach GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {_COMPONENTS} SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(confidence), 6) AS confidence,
    any_value(orientation) AS orientation, count(*)::INT AS n_regions, list_sort(list(region_id))::VARCHAR AS ids
    FROM grouped JOIN fit USING (page_id, region_id) GROUP BY page_id, grp"""
)
def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fit(spark, sf_dir).withColumn("text", F.concat("region_id", F.lit(",")))
    ids = F.array_sort(F.transform(F.split(F.regexp_replace("text", ",$", ""), ","), lambda x: x.cast("int")))
    return R.merge_regions(rows).select(
        "page_id", "x0", "y0", "x1", "y1", F.round("confidence", 6).alias("confidence"), "orientation", "n_regions",
        F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("ids"),
    )


@query()
def merge_regions_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at most a fifth of the page."""
    return R.merge_regions(fit(spark, sf_dir), cap=PAGE_WIDTH * PAGE_HEIGHT / 5)


@query(
    f"""WITH {BOXES} SELECT page_id, (region_id % 3)::INT AS grp, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(confidence), 6) AS confidence,
    string_agg(text, '' ORDER BY y0, x0, region_id) AS text, count(*) AS n_regions FROM fit GROUP BY page_id, region_id % 3"""
)
def merge_group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.merge_group_agg(fit(spark, sf_dir).withColumn("grp", (F.col("region_id") % 3).cast("int")))
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {BOXES} SELECT page_id, region_id, (row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, region_id) - 1)::INT AS unit_idx FROM fit")
def region_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrytext.operators.units import unit_index

    return unit_index(fit(spark, sf_dir), ["page_id"], ["y0", "x0", "region_id"]).select("page_id", "region_id", "unit_idx")


@query()
def vertical_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vertical_reading_order(fit(spark, sf_dir).where("orientation = 'vertical'"))


@query(
    f"""WITH {BOXES}, {PAGES} SELECT page_id, coalesce(n, 0) AS regions, m AS mean_confidence FROM pages LEFT JOIN
    (SELECT page_id, count(*) AS n, round(sum(confidence::DECIMAL(20,6))::DOUBLE / count(*), 3) AS m FROM fit GROUP BY page_id) USING (page_id)"""
)
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_report(pages(spark, sf_dir), fit(spark, sf_dir))


@query(f"WITH {BOXES}, {PAGES} SELECT page_id, page_id IN (SELECT page_id FROM fit) AS rendered FROM pages")
def split_pages_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    some, none = R.split_pages_without_text(pages(spark, sf_dir), fit(spark, sf_dir))
    return some.select("page_id", F.lit(True).alias("rendered")).unionByName(none.select("page_id", F.lit(False).alias("rendered")))


@query(f"WITH {BOXES} SELECT page_id, x0, y0, x1, y1 FROM boxes WHERE region_id % 2 = 0 UNION ALL SELECT page_id, x0 - 1, y0, x1, y1 + 1 FROM boxes WHERE region_id % 2 = 1")
def union_box_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    quads = rows.where("region_id % 2 = 1").select("page_id", F.array(point(x0, y0), point(x1, y0), point(x1, y1 + 1), point(x0 - 1, y1)).alias("polygon"))
    return R.union_box_sources(rows.where("region_id % 2 = 0"), quads).select("page_id", R.region_bounds(F.col("polygon")).alias("b")).select("page_id", "b.*")


_LEN = "(region_id * 7 % 40 + 1)"


def _length() -> Column:
    return (F.col("region_id") * 7 % 40 + 1).cast("int")


@query(
    f"""WITH {BOXES} SELECT page_id, region_id, floor(least((CASE WHEN orientation = 'vertical' THEN x1 - x0 ELSE y1 - y0 END)::DOUBLE,
    greatest(6.0::DOUBLE, sqrt((x1 - x0) * (y1 - y0) / {_LEN}))))::INT AS size FROM fit"""
)
def estimate_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return fit(spark, sf_dir).select("page_id", "region_id", L.estimate_font_size(w, h, _length(), F.col("orientation")).alias("size"))


_CELL = lambda s: f"greatest(1, floor({s} * 1.08::DOUBLE)::INT)"
_ROWS = lambda s, h: f"greatest(1, {h} // {_CELL(s)})"
_COLS = lambda n, s, h: f"(({n} + {_ROWS(s, h)} - 1) // {_ROWS(s, h)})"


@query(
    f"""WITH {BOXES} SELECT page_id, region_id, {_COLS(_LEN, '14', '(y1 - y0)')}::INT AS n_columns, ({_COLS(_LEN, '14', '(y1 - y0)')} * {_CELL('14')})::INT AS used_width,
    (least({_ROWS('14', '(y1 - y0)')}, {_LEN}) * {_CELL('14')})::INT AS used_height FROM fit"""
)
def vertical_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.vertical_layout(_length(), F.lit(14), F.col("y1") - F.col("y0"))
    return fit(spark, sf_dir).select("page_id", "region_id", x.alias("x")).select("page_id", "region_id", "x.n_columns", "x.used_width", "x.used_height")


_FITS = lambda w, h: f"{_COLS(_LEN, 's', h)} * {_CELL('s')} <= {w} AND least({_ROWS('s', h)}, {_LEN}) * {_CELL('s')} <= {h}"


@query(
    f"""WITH {BOXES} SELECT page_id, region_id, coalesce(list_max(list_filter(range(12, 41), lambda s: {_FITS('(x1 - x0)', '(y1 - y0)')})), 12)::INT AS size FROM fit"""
)
def fit_vertical_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = L.fit_vertical_font(_length(), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(40))
    return fit(spark, sf_dir).select("page_id", "region_id", size.alias("size"))


_COLOR = "sqrt(pow(x0 % 256 - y1 % 256, 2) + pow(y0 % 256 - 90, 2) + pow(60 - x1 % 256, 2))"


@query(
    f"""WITH {BOXES} SELECT page_id, region_id, round({_COLOR}, 6) AS distance, CASE WHEN {_COLOR} < 45 THEN
    CASE WHEN (y1 % 256 + 90 + x1 % 256) / 3 > 128 THEN 25 ELSE 245 END ELSE x0 % 256 END::INT AS r FROM fit"""
)
def color_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = lambda r, g, b: F.struct((r % 256).cast("int").alias("r"), (g % 256).cast("int").alias("g"), (b % 256).cast("int").alias("b"))
    text, back = rgb(F.col("x0"), F.col("y0"), F.lit(60)), rgb(F.col("y1"), F.lit(90), F.col("x1"))
    return fit(spark, sf_dir).select(
        "page_id", "region_id", F.round(L.color_distance(text, back), 6).alias("distance"), L.guarded_color(text, back)["r"].alias("r")
    )


@query(
    f"""WITH {BOXES}, i AS (SELECT *, greatest(1, floor(least(x1 - x0, y1 - y0) * 0.03::DOUBLE)::INT) AS inset FROM fit),
    p AS (SELECT page_id, region_id, x0 + inset AS ax0, y0 + inset AS ay0, x1 - inset AS ax1, y1 - inset AS ay1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM i),
    w AS (SELECT *, greatest(4, ax1 - ax0) AS w, greatest(4, ay1 - ay0) AS h FROM p),
    e AS (SELECT *, least(40, greatest(12, floor(floor(least(w::DOUBLE, greatest(6.0::DOUBLE, sqrt(w * h / {_LEN}))))::INT * 1.2::DOUBLE)::INT)) AS cap FROM w),
    z AS (SELECT *, coalesce(list_max(list_filter(range(12, cap + 1), lambda s: {_FITS('w', 'h')})), 12)::INT AS size FROM e),
    o AS (SELECT *, {_COLS(_LEN, 'size', 'h')} * {_CELL('size')} > w OR least({_ROWS('size', 'h')}, {_LEN}) * {_CELL('size')} > h AS over,
      greatest(1, floor(w * 0.05::DOUBLE)::INT) AS gx, greatest(1, floor(h * 0.05::DOUBLE)::INT) AS gy FROM z),
    b AS (SELECT *, CASE WHEN over THEN greatest(0, ax0 - gx) ELSE ax0 END AS bx0, CASE WHEN over THEN greatest(0, ay0 - gy) ELSE ay0 END AS by0,
      CASE WHEN over THEN ax1 + gx ELSE ax1 END AS bx1, CASE WHEN over THEN ay1 + gy ELSE ay1 END AS by1 FROM o)
    SELECT page_id, region_id, bx0, by0, bx1, by1, size, round(least(1.0, greatest(0.0, (cx - bx0) / greatest(4, bx1 - bx0))), 6)::DOUBLE AS anchor_x,
      round(least(1.0, greatest(0.0, (cy - by0) / greatest(4, by1 - by0))), 6)::DOUBLE AS anchor_y,
      CASE WHEN region_id % 3 * 40 < 60 THEN greatest(1, size // 16) ELSE 0 END::INT AS stroke FROM b"""
)
def typeset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    plan = L.typeset_plan(x0, y0, x1, y1, (x0 + x1) / 2, (y0 + y1) / 2, _length(), 40, F.col("region_id") % 3 * 40)
    rows = fit(spark, sf_dir).select("page_id", "region_id", plan.alias("p")).select("page_id", "region_id", "p.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("anchor_x", "anchor_y")})

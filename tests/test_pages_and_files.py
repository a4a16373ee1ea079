"""Regions, archives, books, jobs and streams on small fixtures."""

import io
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrytext.operators import archives as A
from ferrytext.operators import markup as M
from ferrytext.operators import ops as O
from ferrytext.operators import pixels as P
from ferrytext.operators import regions as R
from ferrytext.sources import archives as Z
from ferrytext.streaming import jobs as S

REGION = "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int, confidence double, text string, orientation string"


def regions(spark, *boxes, orientation="horizontal"):
    return spark.createDataFrame([(1, i, *b, 0.9, f"t{i}", orientation) for i, b in enumerate(boxes, 1)], REGION)


def test_adjacent_lines_merge(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 100, 20, 0.9, "a", "horizontal"), (1, 2, 5, 23, 95, 43, 0.8, "b", "horizontal")], REGION)
    out = R.merge_regions(rows).collect()
    assert len(out) == 1 and out[0]["text"] == "ab" and abs(out[0]["confidence"] - 0.85) < 1e-9
    assert (out[0]["x0"], out[0]["y1"]) == (0, 43)


def test_cap_limits_merging(spark):
    rows = regions(spark, (0, 0, 100, 20), (0, 22, 100, 42), (0, 44, 100, 64))
    assert R.merge_regions(rows).count() == 1
    assert [r["n_regions"] for r in R.merge_regions(rows, cap=100 * 42).orderBy("nth").collect()] == [2, 1]


def test_vertical_columns_from_the_right():
    assert R.column_order([[0, 0, 10, 50], [20, 0, 30, 50]]) == [1, 0]
    assert R.column_order([[0, 0, 10, 20], [0, 40, 10, 60]]) == [0, 1]


def test_limits_are_inclusive(spark):
    page = spark.createDataFrame([(1, 1000, 1000)], "page_id long, width int, height int")
    rows = regions(spark, (0, 0, 8, 8), (0, 0, 7, 8), (0, 0, 8, 120), (0, 0, 8, 121))
    assert [r["region_id"] for r in R.filter_detected_boxes(rows, page).orderBy("region_id").collect()] == [1, 3]


def test_natural_order_and_kinds(spark):
    names = [(0, i, n) for i, n in enumerate(["10.jpg", "2.jpg", "1.jpg", "a/2.png"])]
    rows = spark.createDataFrame(names, "archive_id int, ordinal long, name string")
    assert [r["name"] for r in A.natural_path_order(rows).orderBy("nth").collect()] == ["1.jpg", "2.jpg", "10.jpg", "a/2.png"]
    names = ["p2", "p007", "p10", "p" + "9" * 40, "p1" + "0" * 40, "p", "p0", "p2a"]
    many = spark.createDataFrame([(1, i, n) for i, n in enumerate(names[::-1])], "archive_id int, ordinal int, name string")
    want = ["p", "p0", "p2", "p2a", "p007", "p10", "p" + "9" * 40, "p1" + "0" * 40]
    assert [r["name"] for r in A.natural_path_order(many).orderBy("nth").collect()] == want
    assert A.classify_archive(rows).first()["kind"] == "manga"
    tie = spark.createDataFrame([(0, "a.jpg"), (0, "b.txt"), (1, "c.epub"), (2, "d.txt")], "archive_id int, name string")
    assert {r["archive_id"]: r["kind"] for r in A.classify_archive(tie).collect()} == {0: "manga", 1: "error", 2: "novel"}


def test_quota_is_strict(spark):
    rows = spark.createDataFrame([(0, i, f"{i}", 10) for i in range(3)], "archive_id int, ordinal long, name string, size long")
    assert A.archive_quota(rows, 3, 30).first()["ok"] and not A.archive_quota(rows, 2, 30).first()["ok"]
    assert A.running_quota(rows, 3, 30).count() == 0 and A.running_quota(rows, 3, 29).first()["ordinal"] == 2


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_members_and_books(spark):
    book = zipped(("mimetype", "application/epub+zip"), ("d/", ""), ("c1.xhtml", "<p>あ</p>"), ("p.png", b"\x00\x01"))
    rows = spark.createDataFrame([(1, bytearray(book)), (2, bytearray(b"broken"))], "archive_id long, content binary")
    members = Z.read_archive_members(rows)
    assert members.where("archive_id = 1").count() == 4 and members.where("archive_id = 2").first()["error"]
    assert Z.read_archive_members(rows.where("archive_id = 1"), max_files=3).first()["error"] == "over the quota"
    mine = members.where("archive_id = 1").withColumnRenamed("archive_id", "book_id")
    new = spark.createDataFrame([(1, "c1.xhtml", 0, bytearray(b"<p>b</p>"))], "book_id long, name string, nth int, content binary")
    again = Z.repack_book(A.member_override(mine, new).select("book_id", "ordinal", "name", "is_dir", "content")).first()["content"]
    with zipfile.ZipFile(io.BytesIO(again)) as z:
        assert z.namelist() == ["mimetype", "c1.xhtml", "p.png"]
        assert z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.read("c1.xhtml") == b"<p>b</p>" and z.read("p.png") == b"\x00\x01"


def test_members_of_one_name_are_told_apart(spark):
    mine = spark.createDataFrame([(1, i, "a.xhtml", "old") for i in range(3)], "book_id long, ordinal long, name string, content string")
    new = spark.createDataFrame([(1, i, "a.xhtml", n, f"{i}.{n}") for i in (0, 2) for n in (0, 1)], "book_id long, ordinal long, name string, nth int, content string")
    assert [r["content"] for r in A.member_override(mine, new).orderBy("ordinal").collect()] == ["0.1", "old", "2.1"]


def test_markup_spans_and_splice(spark):
    page = "<h1>題</h1><blockquote class='q'><p>内<ruby>漢<rt>かん</rt></ruby>&amp;</p></blockquote><p><img/>絵</p><p>English</p>"
    rows = spark.createDataFrame([(1, page)], "page_id long, html string")
    spans = M.block_spans(rows, "page_id", "html")
    assert [r["text"] for r in spans.orderBy("nth").collect()] == ["題", "内漢&"]
    out = M.rebuild_markup(rows, spans.withColumn("translation", F.lit("<x>")), "page_id", "html").first()["html"]
    assert out == "<h1>&lt;x&gt;</h1><blockquote class='q'><p>&lt;x&gt;</p></blockquote><p><img/>絵</p><p>English</p>"


def test_media_in_a_quote_skips_all_of_it(spark):
    rows = spark.createDataFrame([(1, "<blockquote><img><p>日本</p></blockquote>")], "page_id long, html string")
    assert M.block_spans(rows, "page_id", "html").count() == 0


def test_reading_order_falls_back(spark):
    members = spark.createDataFrame([(1, "b.xhtml"), (1, "a.html"), (1, "x.css"), (2, "z.xhtml")], "book_id long, name string")
    items = spark.createDataFrame([(2, "i", "y.xhtml", 0), (2, "i", "z.xhtml", 1)], "book_id long, item_id string, href string, ord long")
    spine = spark.createDataFrame([(2, 0, "i"), (1, 0, "none")], "book_id long, ord long, idref string")
    out = A.reading_order(spine, items, members).orderBy("book_id", "nth").collect()
    assert [(r["book_id"], r["name"]) for r in out] == [(1, "a.html"), (1, "b.xhtml"), (2, "z.xhtml")]


def test_flat_bubble_is_erased(spark):
    import numpy as np

    rgb = np.full((40, 60, 3), 255, np.uint8)
    rgb[15:25, 20:22] = 0
    images = spark.createDataFrame([(1, 40, 60, bytearray(rgb.tobytes()))], "page_id long, height int, width int, rgb binary")
    box = spark.createDataFrame([(1, 1, 5, 5, 55, 35)], "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int")
    stats = P.region_pixel_stats(images, box).first()
    assert stats["background"] == [255] * 3 and max(stats["color"]) < 60 and stats["flat"]
    out = P.erase_flat_regions(images, box).first()
    assert set(out["rgb"]) == {255} and out["needs_inpaint"] == []


def test_region_statistics_by_definition():
    import numpy as np

    rng = np.random.default_rng(5)
    for kind in range(40):
        rgb = rng.integers(0, 256, (24, 30, 3), np.uint8) if kind % 4 == 0 else np.full((24, 30, 3), [255, 20, 130, 100][kind % 4], np.uint8)
        if kind % 4:
            for _ in range(kind % 7 * 30):
                rgb[rng.integers(5, 19), rng.integers(5, 25)] = rng.integers(0, 256, 3)
        box = np.array([(4, 4), (25, 4), (25, 19), (4, 19)])
        got = P.region_stats(rgb, box, 2)
        crop = rgb[2:22, 2:28].astype(float)
        edge = np.concatenate([crop[0], crop[-1], crop[:, 0], crop[:, -1]])
        ground = np.median(edge, axis=0)
        inside = np.zeros(crop.shape[:2], bool)
        inside[2:18, 2:24] = True
        far = np.sqrt(((crop - ground) ** 2).sum(2))
        mask = inside & (far >= max(24, np.percentile(far[inside], 58)))
        if mask.sum() < 0.015 * inside.sum():
            grey = np.floor(crop @ [0.299, 0.587, 0.114] + 0.5)
            mask = inside & (grey < int(ground.mean() - 28) if ground.mean() > 128 else grey > int(ground.mean() + 28))
        if mask.sum() > 0.55 * inside.sum():
            mask = inside & (far >= np.percentile(far[inside], 45))
        assert got["background"] == ground.astype(int).tolist() and got["spread"] == pytest.approx(edge.std(), rel=1e-4)
        assert got["fill"] == pytest.approx(mask.sum() / inside.sum(), abs=0.01) and got["weight"] == ("bold" if got["fill"] > 0.45 else "normal")
        assert len(got["color"]) == 3 and np.linalg.norm(np.subtract(got["color"], got["background"])) >= 40
    blank = P.region_stats(np.full((20, 20, 3), 250, np.uint8), np.array([(2, 2), (17, 2), (17, 17), (2, 17)]))
    assert blank["color"] == [25] * 3 and blank["fill"] == 0 and not blank["mask"].any()
    assert P.region_stats(np.full((20, 20, 3), 9, np.uint8), np.array([(2, 2), (17, 2), (17, 17), (2, 17)]))["color"] == [245] * 3
    triangle = P.polygon_mask(np.array([(0, 0), (8, 0), (0, 8)]), 9, 9)
    assert triangle.sum() == 45 and triangle[0, 8] and triangle[8, 0] and not triangle[5, 5]


def png(rgb):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    rows = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_page_images_and_text_files_are_read(spark, tmp_path):
    import numpy as np

    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3), np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.PNG").write_bytes(png(rgb))
    (tmp_path / "in" / "broken.png").write_bytes(b"no picture")
    (tmp_path / "in" / "a.txt").write_bytes("あ".encode("cp932"))
    rows = Z.read_page_images(spark, str(tmp_path / "in")).collect()
    assert [(r["height"], r["width"], bytes(r["rgb"])) for r in rows] == [(5, 7, rgb.tobytes())]
    texts = Z.read_text_files(spark, str(tmp_path / "in")).collect()
    assert [bytes(r["content"]) for r in texts] == ["あ".encode("cp932")]


def test_throttle():
    out, *_ = S.throttled([(0.0, 0, False), (0.5, 5, False), (0.9, 9, False), (5.0, 50, False), (5.1, 51, True)], None, [])
    assert [x[0] for x in out] == [0.0, 0.9, 5.0, 5.1]
    assert out[2][2] == 0.0 and out[1][2] == pytest.approx(10.0) and out[3][2] == pytest.approx(10.0)


def events(spark, rows):
    return spark.createDataFrame(rows, "job_id long, seq long, ts timestamp, kind string, status string, progress int, message string")


def test_old_updates_change_nothing_and_stream_equals_batch(spark, tmp_path):
    import datetime as d

    at = lambda s: d.datetime(2024, 1, 1, 0, 0, s)
    rows = events(spark, [(1, 2, at(9), "t", "completed", 100, "b"), (1, 1, at(3), "t", "running", 10, "a"), (2, 3, at(4), "t", "failed", 1, "c")])
    want = sorted(map(tuple, O.job_status_fold(rows).collect()))
    assert [w[4] for w in want] == ["completed", "failed"]
    rows.write.parquet(str(tmp_path / "in"))
    stream = S.stream_job_status(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("folded").collect())) == want


def test_stream_throughput_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, t / 2, t * 10 * k, t == 19) for k in (1, 2) for t in range(20)], "download_id long, t double, bytes long, force boolean")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    out = S.stream_throughput(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("append").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, S.batch_throughput(rows).collect()))


def test_stream_throughput_makes_no_frame_work_per_download(spark, tmp_path, monkeypatch):
    """Its groups are many and small, so each costs a few lists: frames are neither joined nor sorted nor walked."""
    run = []
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandasWithState", lambda self, f, *_: run.append(f))
    S.stream_throughput(spark.createDataFrame([], "download_id long, t double, bytes long, force boolean"))

    class State:
        hasTimedOut, exists, get, due = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, ms):
            self.due = ms

        def getCurrentWatermarkMs(self):
            return 0

    for name in ("sort_values", "itertuples", "insert"):
        monkeypatch.setattr(pd.DataFrame, name, None)
    state, samples, got = State(), [(t / 2, t * 10, t == 19) for t in range(20)], []
    for frames in ([samples[5:10], samples[:5]], [samples[10:][::-1]]):
        got += [f for f in run[0]((7,), iter([pd.DataFrame(x, columns=["t", "bytes", "force"]) for x in frames]), state)]
    want, last, kept = S.throttled(samples, None, [])
    assert [tuple(x) for f in got for x in f.to_numpy().tolist()] == [(7, *x) for x in want]
    assert state.get == (last, [t for t, _ in kept], [n for _, n in kept]) and state.due > 0


def test_stream_ingest_takes_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("あ。", encoding="utf-8")
    (tmp_path / "in" / "b.bin").write_text("x")
    seen = []
    q = S.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda rows: seen.extend(r["path"] for r in rows.collect()))
    q.awaitTermination(60)
    assert [p.rsplit("/", 1)[-1] for p in seen] == ["a.txt"]


def test_queries_take_whole_documents(spark, tmp_path):
    import numpy as np

    from ferrytext.jobs import catalog_files as Q
    from ferrytext.operators import cleanup as C

    body = "\n".join(f"line {i} " + "abcdefgh"[i % 8] * (i % 37) for i in range(70))
    texts = {1: body, 2: "short", 3: "x" * 3_600, 4: "y" * 3_601, 5: "", 6: None, 9: "\n".join(f"{i} {i * i}" for i in range(120))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    images = {r["page_id"]: r for r in Q.page_images(spark, str(tmp_path)).collect()}
    assert sorted(images) == [1, 2, 3, 4, 9] and [images[i]["height"] for i in (2, 3, 4)] == [40, 40, 60]
    for i, r in images.items():
        assert len(r["rgb"]) == 180 * r["height"] and bytes(r["rgb"]).rstrip(b"\xff") == texts[i].encode()
    stats = Q.region_pixel_stats(spark, str(tmp_path)).collect()
    for i, r in images.items():
        assert sorted(s["region_id"] for s in stats if s["page_id"] == i) == list(range(1, r["height"] // 20 + 1))
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], 60, 3)
        for s in stats:
            if s["page_id"] == i and s["region_id"] < r["height"] // 20:
                top = 20 * s["region_id"] - 18
                corners = np.array([(2, top), (50, top), (50, top + 16), (2, top + 16)])
                assert s["background"] == P.region_stats(rgb, corners)["background"]
    assert Q.erase_flat_regions(spark, str(tmp_path)).count() == 5
    lines = {i: [x.replace(" ", "") for x in (t or "").split("\n") if x] for i, t in texts.items()}
    got = {r["doc_id"]: r["text"] for r in Q.collapse_line_blocks(spark, str(tmp_path)).collect()}
    for i in (1, 2, 9):
        assert got[i] == "\n".join(C.collapse_blocks(lines[i] * (3 if i % 3 == 0 else 1)))
    assert {r["doc_id"]: r["lines"] for r in Q.looping_lines(spark, str(tmp_path)).collect()}[1] == lines[1]
    assert Q.truncate_loop_tail(spark, str(tmp_path)).count() == Q.clean_recognition(spark, str(tmp_path)).count() == 7


def test_archives_over_the_quota_are_cut_into_volumes(spark, tmp_path, monkeypatch):
    from ferrytext.jobs import catalog_files as Q

    rows = [(50 * i, f"text {i}", "a") for i in range(A.MAX_FILES + 1)] + [(7, "x" * 900, "b")] * 5 + [(57, "y", "b"), (-3, "z", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for a in (0, 7, -3):
        mine = sorted(r for r in rows if (abs(r[0]) % 50) * (-1 if r[0] < 0 else 1) == a)
        want += [(a, n, f"{s}/{i}.txt", len(t), False, t) for n, (i, t, s) in enumerate(mine)]
    for size in (Q.VOLUME_BYTES, 1_000):
        monkeypatch.setattr(Q, "VOLUME_BYTES", size)
        got = Q.read_archive_members(spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        assert sorted(map(tuple, Q.repack_book(spark, str(tmp_path)).collect())) == sorted(r[:3] for r in want)
        sums = {r["archive_id"]: (r["members"], r["bytes"]) for r in Q.write_packages(spark, str(tmp_path)).collect()}
        assert sums == {a: (sum(r[0] == a for r in want), sum(r[3] for r in want if r[0] == a)) for a in (0, 7, -3)}
        packed = Z.read_archive_members(Q.packages(spark, str(tmp_path))[0]).groupBy("archive_id").count()
        assert packed.agg(F.max("count")).first()[0] <= Q.VOLUME_FILES and (packed.count() > 8) == (size < 2_000)


def test_files_appear_together_or_not_at_all(spark, tmp_path):
    from pyspark.errors import PySparkException

    from ferrytext.sources.writers import write_document_files

    docs = lambda *rows: spark.createDataFrame(list(rows), "path string, text string, content string").repartition(3)
    out = tmp_path / "out"
    write_document_files(docs(("a/x.txt", "あ", "clash"), ("a/y.txt", None, ""), ("z.txt", "w" * 300_000, None)), str(out))
    assert not [p for p in tmp_path.iterdir() if p.name != "out"]
    files = lambda: {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()}
    want = {"a/x.txt": "﻿あ".encode(), "a/y.txt": b"\xef\xbb\xbf", "z.txt": b"\xef\xbb\xbf" + b"w" * 300_000}
    assert files() == want
    for bad in ("/etc/x", "a/../../x", "a/", None):
        with pytest.raises(PySparkException):
            write_document_files(docs(("fine.txt", "t", ""), (bad, "t", "")), f"{tmp_path}/failed")
    with pytest.raises(ValueError):
        write_document_files(docs(("q.txt", "1", ""), ("q.txt", "2", "")), f"{tmp_path}/failed")
    with pytest.raises(PySparkException):
        write_document_files(docs(("n.txt", "n", "")), str(out))
    assert files() == want
    write_document_files(docs(("n.txt", "n", "")), f"file://{out}", "overwrite")
    write_document_files(docs(), f"{tmp_path}/empty")
    assert files() == {"n.txt": b"\xef\xbb\xbfn"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty", "out"] and not list((tmp_path / "empty").iterdir())


def test_bitmaps_are_read_back(spark, tmp_path):
    import numpy as np

    from ferrytext.sources.writers import write_page_images

    rng = np.random.default_rng(2)
    pictures = {f"{w}x{h}": (h, w, rng.integers(0, 256, (h, w, 3), np.uint8).tobytes()) for w, h in ((1, 1), (5, 3), (8, 2), (60, 41))}
    rows = [(f"{k}.bmp", *v) for k, v in pictures.items()]
    write_page_images(spark.createDataFrame(rows, "path string, height int, width int, rgb binary"), f"{tmp_path}/out")
    got = Z.read_page_images(spark, f"{tmp_path}/out").collect()
    assert {r["origin"].rsplit("/", 1)[1][:-4]: (r["height"], r["width"], bytes(r["rgb"])) for r in got} == pictures


def random_regions(rng, n, spread):
    lefts, tops = rng.integers(-20, spread, n), rng.integers(-20, spread, n)
    return [(int(x), int(y), int(x + rng.integers(1, 70)), int(y + rng.integers(1, 40))) for x, y in zip(lefts, tops)]


def test_groups_are_those_of_merging_the_first_two_again_and_again():
    import time

    import numpy as np

    def by_rule(pairs, box, cap):
        groups = [[i] for i in range(len(box))]
        fits = lambda g: cap <= 0 or (box[g, 2:].max(0) - box[g, :2].min(0)).prod() <= cap
        while True:
            found = ((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if fits(groups[i] + groups[j]) and pairs[np.ix_(groups[i], groups[j])].any())
            i, j = next(found, (None, None))
            if i is None:
                return groups
            groups[i] += groups.pop(j)

    rng = np.random.default_rng(3)
    for n in [0, 1, 2, *range(3, 40)] * 3:
        box = np.array(random_regions(rng, n, 150), np.int64).reshape(-1, 4)
        vertical = rng.random(n) < 0.3
        pairs = R._pair_matrix(box, vertical)
        for i in range(n):
            assert (R._pair_matrix(box, vertical, np.array([i]))[0] == pairs[i]).all()
        for cap in (0, 900, 4_000, 12_000):
            assert R._groups(pairs.__getitem__, box, cap) == by_rule(pairs, box, cap)
    box = np.array(random_regions(rng, 2_000, 1_500), np.int64)
    began = time.process_time()
    row = lambda i: R._pair_matrix(box, vertical=np.zeros(2_000, bool), of=np.array([i]))[0]
    assert sum(map(len, R._groups(row, box, 0))) == 2_000 and time.process_time() - began < 4


def test_regions_meet_in_cells(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    box = random_regions(rng, 1_500, 2_000) + [(0, 0, 700, 9), (0, 12, 690, 21), (5, 5, 5, 5), (5, 5, 4, 4), (3, 3, 9, 900)]
    rows = [(1 + i % 2, i, *b, 0.9, "t", "vertical" if i % 3 == 0 else "horizontal") for i, b in enumerate(box * 2)]
    page = [[r for r in rows if r[0] == p] for p in (1, 2)]
    want = set()
    for some in page:
        pairs = R._pair_matrix(np.array([r[2:6] for r in some]), np.array([r[8] == "vertical" for r in some]))
        want |= {(some[0][0], some[i][1], some[j][1]) for i, j in np.argwhere(np.triu(pairs, 1))}
    frame = spark.createDataFrame(rows, REGION)
    got = [tuple(r) for r in R.region_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert R._candidates(frame).count() < sum(len(p) ** 2 / 2 for p in page) / 4


def test_scan_lines_fill_what_a_ray_to_the_left_says():
    import numpy as np

    rng = np.random.default_rng(6)
    for k in range(200):
        points = rng.integers(-6, 30, (3 + k % 6, 2))
        y, x = np.mgrid[:22, :19]
        want = np.zeros((22, 19), bool)
        for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0)):
            if ay != by:
                want ^= (y >= min(ay, by)) & (y < max(ay, by)) & (x >= ax + (y - ay) * (bx - ax) / (by - ay))
        got = P.polygon_mask(points, 22, 19)
        lines = P.polygon_mask(np.repeat(points, 1, axis=0), 22, 19) & ~want
        assert not (want & ~got).any()
        for py, px in np.argwhere(lines):  # the rest lies on an edge, to half a pixel
            near = []
            for p, q in zip(points.astype(float), np.roll(points, -1, axis=0).astype(float)):
                t = 0 if (p == q).all() else np.clip(np.dot([px, py] - p, q - p) / np.dot(q - p, q - p), 0, 1)
                near.append(np.abs([px, py] - (p + t * (q - p))).max())
            assert min(near) <= 0.5 + 1e-9


def test_masks_to_be_painted_anew_are_runs(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    rgb = rng.integers(0, 256, (40, 50, 3), np.uint8)
    boxes = [(1, 4, 4, 30, 20), (2, 10, 12, 44, 33), (3, 90, 90, 99, 99)]
    images = spark.createDataFrame([(1, 40, 50, rgb.tobytes()), (2, 2, 2, b"\xff" * 12)], "page_id long, height int, width int, rgb binary")
    regions = spark.createDataFrame([(1, *b) for b in boxes], "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int")
    got = {r["page_id"]: r for r in P.erase_flat_regions(images, regions).collect()}
    want = np.zeros((40, 50), bool)
    for _, x0, y0, x1, y1 in boxes[:2]:
        s = P.region_stats(rgb, np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]))
        for y, x in np.argwhere(s["mask"]):
            want[s["y0"] + y, s["x0"] + x] = True
    assert got[1]["needs_inpaint"] == [1, 2] and bytes(got[1]["rgb"]) == rgb.tobytes() and got[2]["runs"] == []
    marked = [i for r in got[1]["runs"] for i in range(r["start"], r["start"] + r["length"])]
    assert marked == np.flatnonzero(want).tolist() and want.any()


def _small_pictures(spark, n):
    import numpy as np

    rng = np.random.default_rng(8)
    pictures = [np.where(rng.random((24, 30, 1)) < rng.random(), 250, rng.integers(0, 256, (24, 30, 3))).astype(np.uint8) for _ in range(n)]
    images = spark.createDataFrame([(i, 24, 30, x.tobytes()) for i, x in enumerate(pictures)], "page_id long, height int, width int, rgb binary")
    boxes = [(1, 3, 3, 20, 15), (2, -4, 9, 18, 40), (3, 6, 6, 23, 18)]
    regions = spark.createDataFrame([(i, *b) for i in range(n) for b in boxes], "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int")
    corners = {i: np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) for i, x0, y0, x1, y1 in boxes}
    return pictures, images.coalesce(1), regions.coalesce(1), corners


def test_small_pictures_are_erased_in_many_tasks(spark):
    pictures, images, regions, corners = _small_pictures(spark, 150)
    got = P.erase_flat_regions(images, regions).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 1 and len(got) == 150
    for r in got:
        assert r["needs_inpaint"] == [i for i, c in corners.items() if P.region_stats(pictures[r["page_id"]], c)["spread"] >= P.FLAT]


def test_statistics_of_regions_judged_together_are_those_of_each(spark):
    pictures, images, regions, corners = _small_pictures(spark, 150)
    got = P.region_pixel_stats(images, regions).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 1 and len(got) == 450
    for r in got:
        s = P.region_stats(pictures[r["page_id"]], corners[r["region_id"]])
        assert (r["background"], r["color"], r["weight"], r["fill"], r["flat"]) == (s["background"], s["color"], s["weight"], s["fill"], s["spread"] < P.FLAT)


def test_pages_from_tables_are_recognised_in_batches(spark):
    from ferrytext.operators import recognition as G

    cells = "array<struct<region_id: int, x0: int, y0: int, x1: int, y1: int, confidence: double, text: string>>"
    pages = spark.createDataFrame([(5, [(1, 2, 3, 4, 5, 0.5, "a"), (2, 6, 7, 8, 9, None, None)]), (6, None), (7, []), (8, [(1, 0, 0, 1, 1, 1.0, "b")])], f"page_id long, regions {cells}")
    got = sorted(map(tuple, G.recognize_pages(pages.coalesce(1), G.from_table).collect()))
    assert got == sorted(map(tuple, G.recognize_pages(pages, lambda p: G.from_table(p) if p["regions"] else []).collect()))
    page, columns = G.from_table.at_once(pa.record_batch({"page_id": [5], "regions": [[{c: 1 for c in ("x0", "y0", "x1", "y1", "confidence", "text")}]]}))
    assert page.tolist() == [0] and len(columns) == 6


def test_pairs_of_small_pages_need_no_cells_and_those_of_large_ones_do(spark):
    rng, rows = np.random.default_rng(9), []
    for page, n in [*((p, 1 + p % 20) for p in range(60)), (99, 600)]:
        x, y, w, h = (rng.integers(lo, hi, n) for lo, hi in ((0, 300), (0, 300), (8, 60), (8, 60)))
        rows += [(page, i, *map(int, (x[i], y[i], x[i] + w[i], y[i] + h[i]))) for i in range(n)]
    frame = R.with_orientation(spark.createDataFrame([*rows, (None, 1, 0, 0, 9, 9)], "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int"))
    want = set()
    for page in {r[0] for r in rows}:
        box = np.array([r[2:] for r in rows if r[0] == page])
        upright = box[:, 3] - box[:, 1] > (box[:, 2] - box[:, 0]) * 1.2
        want |= {(page, int(a), int(b)) for a, b in np.argwhere(R._pair_matrix(box, upright)) if a < b}
    got = [tuple(r) for r in R.region_pairs(frame).collect()]
    assert len(got) == len(want) and set(got) == want
    plan = R.region_pairs(frame.where("page_id < 60"))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_finished_jobs_leave_the_state_and_late_rows_are_counted(spark, tmp_path):
    import datetime as d

    at = lambda h: d.datetime(2024, 1, 1) + d.timedelta(hours=h)
    first = [(1, 1, at(0), "t", "running", 5, "a"), (1, 2, at(1), "t", "completed", 100, "b"), (2, 3, at(2), "t", "failed", None, None), (3, 4, at(48), "t", "queued", 0, "")]
    second = [(1, 5, at(43), "t", "running", 9, "again"), (2, 6, at(42), "t", "running", 1, "at the mark"), (2, 7, at(3), "t", "running", 1, "late"), (3, 8, at(45), "t", "failed", 7, "older"), (4, 9, at(200), "t", "failed", 1, "new")]
    out, late, seen = [], [], []
    for rows in (first, second):
        frame = events(spark, rows).withColumn("extra", F.lit(1))
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        log = S.stream_job_state(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
        with S.rocksdb_state(spark):
            run = log.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            run.awaitTermination(120)
        late.append(S.late_rows(run.recentProgress))
        found = [r for r in spark.read.schema(log.schema).parquet(f"{tmp_path}/out").collect() if r not in seen]
        seen += found
        out.append({(r["job_id"], r["expired"]): (r["created_at"], r["updated_at"], r["status"], r["progress"], r["message"]) for r in found})
    one, two = (at(0), at(1), "completed", 100, "b"), (at(2), at(2), "failed", None, None)
    assert out[0] == {(1, False): one, (1, True): one, (2, False): two, (2, True): two, (3, False): (at(48), at(48), "queued", 0, "")}
    new = (at(200), at(200), "failed", 1, "new")
    assert out[1] == {(1, False): (at(43), at(43), "running", 9, "again"), (3, False): (at(45), at(48), "queued", 0, ""), (4, False): new}
    assert late == [0, 2] and "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_pages_without_pairs_are_settled_together():
    draw = np.random.default_rng(5)
    pages = []
    for n in draw.integers(0, 20, 300):
        low = draw.integers(0, 900, (n, 2))
        boxes = np.concatenate([low, low + draw.integers(8, 60, (n, 2))], axis=1).tolist()
        pages.append([dict(zip(("x0", "y0", "x1", "y1"), b), text=f"{k}", confidence=0.5, orientation=("vertical", "horizontal")[k % 2]) for k, b in enumerate(boxes)])
    alone, columns = R._unmerged(pa.array(range(10, 10 + len(pages))), pa.array(pages).cast(pa.list_(pa.struct(
        [*((c, pa.int32()) for c in ("x0", "y0", "x1", "y1")), ("text", pa.string()), ("confidence", pa.float64()), ("orientation", pa.string())]
    ))))
    want = []
    for i, page in enumerate(pages):
        box = np.array([[r[c] for c in ("x0", "y0", "x1", "y1")] for r in page], np.int64).reshape(-1, 4)
        pairs = R._pair_matrix(box, np.array([r["orientation"] == "vertical" for r in page], bool))
        assert alone[i] == (len(page) <= R.FEW and pairs.sum() == len(page))
        if alone[i]:
            order = sorted(range(len(page)), key=lambda k: (box[k][1], box[k][0]))
            want += [(i + 10, nth, *box[k].tolist(), page[k]["text"], 0.5, page[k]["orientation"], 1) for nth, k in enumerate(order)]
    assert 50 < alone.sum() < 300 and list(zip(*(c.to_pylist() for c in columns))) == want


def test_strongest_pixels_of_many_regions_at_once_and_pictures_unsorted(spark):
    rng = np.random.default_rng(5)
    crops = rng.integers(0, 6, (40, 9, 7, 3), np.uint8) * 40
    masks = rng.random((40, 9, 7)) < rng.random((40, 1, 1))
    masks[3] = False
    far = np.abs(crops.astype(np.float32).mean(3) - np.float32(100))
    colors, found = P._strongest(crops, masks, far)
    for i in range(40):
        at = np.argsort(-far[i][masks[i]], kind="stable")
        assert found[i] == bool(len(at))
        if len(at):
            strongest = np.sort(crops[i][masks[i]][at[: max(1, int(len(at) * P.STRONGEST))]].astype(float), axis=0)
            assert colors[i].tolist() == np.median(strongest, axis=0).astype(int).tolist()
    images = spark.createDataFrame([(1, 4, 4, bytes(48))], "page_id long, height int, width int, rgb binary")
    regions = spark.createDataFrame([(1, 1, 0, 0, 3, 3)], "page_id long, region_id int, x0 int, y0 int, x1 int, y1 int")
    plan = P._pages(images, regions)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan

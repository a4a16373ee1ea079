"""Text operators on small fixtures with exact expectations, and against plain statements of the same rules."""

import random
import time
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrytext.functions import text as T
from ferrytext.operators import cleanup as C
from ferrytext.operators import layout as L
from ferrytext.operators import units as U
from ferrytext.sources.decoding import decode_text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["out"] for r in rows.select("i", f(F.col("c")).alias("out")).orderBy("i").collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_layout_round_trip(spark):
    rows = docs(spark, "彼は来た。\r\n\r\n帰った！")
    layout = U.build_units(rows)
    assert layout.where("kind = 'unit'").count() == 2
    found = layout.where("kind = 'unit'").select("doc_id", "unit_idx", F.col("piece").alias("unit"))
    out = U.restore_document(layout, U.translate_units(found, U.prefix("x"))).first()["text"]
    assert out == "x彼は来た。\r\n\r\nx帰った！"


def test_echo_restores_any_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("あ漢a。！?\n\r\x0b\x0c\x1c\x85  　") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = docs(spark, *texts)
    layout = U.build_units(rows, 20)
    found = layout.where("kind = 'unit'").select("doc_id", "unit_idx", F.col("piece").alias("unit"))
    got = {r["doc_id"]: r["text"] for r in U.restore_document(layout, U.translate_units(found, U.echo)).collect()}
    assert got == dict(enumerate(texts))
    assert found.where(F.length("unit") > 20).count() == 0


def test_other_separators_stay_in_the_unit(spark):
    lines = column(spark, ["あ\x0bい\r\nう\x85え\n"], T.split_lines)[0]
    assert [(x["content"], x["ending"]) for x in lines] == [("あ\x0b", ""), ("い", "\r\n"), ("う\x85", ""), ("え", "\n")]


def packed(text, n):
    if len(text) <= n:
        return [text]
    out, open_, sentence = [], "", ""
    sentences = []
    for ch in text:
        sentence += ch
        if ch in "。！？!?":
            sentences.append(sentence)
            sentence = ""
    for s in sentences + [sentence] * bool(sentence):
        if len(s) > n:
            out += [open_] * bool(open_) + [s[i : i + n] for i in range(0, len(s), n)]
            open_ = ""
        elif open_ and len(open_) + len(s) > n:
            out.append(open_)
            open_ = s
        else:
            open_ += s
    return out + [open_] * bool(open_)


def test_packing_follows_the_rule(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("あいう。!") if rng.random() < 0.9 else "う" * 9 for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert column(spark, texts, lambda c: T.pack_sentences(c, 8)) == [packed(t, 8) for t in texts]


def test_rolling_context_is_what_the_translator_saw(spark):
    rows = spark.createDataFrame([(0, i, f"{i}。") for i in range(3)], "doc_id long, unit_idx int, unit string")
    out = U.translate_units(rows, lambda texts, *, context: [f"[{context}]{t}" for t in texts], batch=1, k=2).orderBy("unit_idx").collect()
    assert [r["translation"] for r in out] == ["[]0。", "[[]0。]1。", "[[]0。\n[[]0。]1。]2。"]


def test_unknown_translator():
    with pytest.raises(ValueError):
        U.translator("none")


def test_clean_translation(spark):
    raw = ["<think>a\nb</think> 好", "译文： \"x\"", "“x”", '"', "'y'", "翻译:z", "翻译 \u3000： z", "a翻译:z"]
    assert column(spark, raw, T.clean_translation) == ["好", "x", "“x”", '"', "y", "z", "z", "a翻译:z"]


def test_inner_text_knows_all_entities(spark):
    raw = [" <b>a</b>&nbsp;&hellip;<ruby>漢<rt>かん</rt></ruby>&#x3042;&#12356;&eacute;&copy;&amp;lt;", "plain", None, "&unknown; &"]
    assert column(spark, raw, T.inner_text) == ["a\xa0…漢あいé©&lt;", "plain", None, "&unknown; &"]


@pytest.mark.parametrize(("batch", "k", "chars"), [(8, 4, 1800), (2, 5, 40), (3, 1, 7), (4, 0, 10), (1, 3, 0)])
def test_contexts_are_what_translators_see(spark, batch, k, chars):
    rng = random.Random(batch)
    rows = [(d, i, "xyz"[: rng.randint(0, 3)] + str(i)) for d in range(4) for i in range(rng.randint(1, 30))]
    units = spark.createDataFrame(rows, "doc_id long, unit_idx int, unit string")
    seen = {}
    for kind, context in (("rolling", U.last_translations(k, chars)), ("page", U.grown(chars))):
        for d in range(4):
            U.in_turn([r[2] for r in rows if r[0] == d], lambda t, *, context: seen.setdefault((kind, d), []).append(context) or t, batch, context)
    done = units.withColumnRenamed("unit", "translation")
    of = lambda found: {(r["doc_id"], r["batch"]): r["context"] for r in found.collect()}
    rolling = of(U.rolling_context(done, batch, k, chars))
    assert rolling == {(d, i): c for (kind, d), cs in seen.items() if kind == "rolling" for i, c in enumerate(cs)}
    if chars:
        assert of(U.page_context(done, batch, chars)) == {(d, i): c for (kind, d), cs in seen.items() if kind == "page" for i, c in enumerate(cs)}


def test_localized_documents_equal_the_steps_one_by_one(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("あ漢a。！?\n\r 　") for _ in range(rng.randint(0, 300))) for _ in range(30)] + ["", None, "no script\n"]
    rows = docs(spark, *texts)
    layout = U.build_units(rows, 20)
    found = layout.where("kind = 'unit'").select("doc_id", "unit_idx", F.col("piece").alias("unit"))
    want = {r["doc_id"]: r["text"] for r in U.restore_document(layout, U.translate_units(found, U.tail)).collect()}
    got = {r["doc_id"]: r for r in U.localized(rows, U.tail, max_chars=20).collect()}
    for i, t in enumerate(texts):
        assert got[i]["text"] == want.get(i, "") and got[i]["characters"] == (None if t is None else len(t))
        assert got[i]["segments"] == sum(r["doc_id"] == i for r in found.collect()) if i < 3 else True


def test_lines_are_filled_greedily(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aあbい\n漢c") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None]

    def filled(text, size, width):
        text = text.replace("\n", "")
        if len(text) <= 3:
            return [text]
        out, line, used = [], "", 0
        for c in text:
            w = 500 if c.isascii() else 1000
            if line and (used + w) * size > width * 1000:
                out, line, used = out + [line], "", 0
            line, used = line + c, used + w
        return out + [line]

    got = column(spark, texts, lambda c: L.horizontal_wrap(c, F.lit(14), F.lit(100)))
    assert got == [None if t is None else filled(t, 14, 100) for t in texts]


def test_clip_noise_and_names(spark):
    assert column(spark, ["12345678901234567890", " ab "], lambda c: T.clip(c, 8)) == ["12345678\n[…]", "ab"]
    assert column(spark, ["", " ", "a", "あ", "ab"], T.is_noise_text) == [True, True, True, False, False]
    names = ["..%2Fbook%3F.txt", "a/b\\c+d%zz.md", " .. ", "a%20b%zz.txt", "\tx\u3000", "%E3%81%82%e3%81.txt", "²ⅷ%", None, "n" * 200]
    assert column(spark, names, T.sanitize_filename) == ["book_.txt", "c_d_zz.md", "upload.bin", "a b_zz.txt", "x", "あ_.txt", "²ⅷ_", None, "n" * 180]
    assert column(spark, ["../outside.txt", "/a", "a/..b", "a\\..\\b"], T.unsafe_member) == [True, True, False, True]
    assert column(spark, ["a/b.txt", ".hidden", "x"], T.output_name) == ["a/b_zh.txt", ".hidden_zh", "x_zh"]


def test_collapse_repeats(spark):
    raw = ["abc" * 5, "abc" * 6, "abcd" * 3, "abcd" * 3 + "ab", "abcd" * 3 + "xy"]
    assert column(spark, raw, T.collapse_repeats) == ["abc" * 5, "abcabc", "abcd", "abcd", "abcdxy"]


def test_blocks_and_tails():
    assert C.collapse_blocks(["a", "b"] * 3 + ["a"]) == ["a", "b"]
    assert C.collapse_blocks(["a", "b"] * 2) == ["a", "b", "a", "b"]
    assert C.truncate_tail("0123456789\n0123456789") == "0123456789"
    assert C.truncate_tail("0123456\n0123456") == "0123456\n0123456"


def test_clean_recognition(spark):
    raw = ["# 題\n**本文**\n本文\nPlease transcribe\n<b>終</b>"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(raw + [None])], "i int, c string")
    got = C.clean_recognition(rows, "c", ["transcribe"]).orderBy("i").collect()
    assert [r["c"] for r in got] == ["題\n本文\n終", None]
    known = spark.createDataFrame([("请按照图片内容\n本文\nAs markdown:",)], "c string")
    assert C.clean_recognition(known, "c").first()["c"] == "本文"


def test_lines_are_cut_once_and_at_every_line_end(spark, tmp_path):
    from ferrytext.jobs import catalog_files as Q

    raw = ["# a\r\n*b*\n\r`c `\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029<b>k l", "", "\n", "x\r", None]
    assert column(spark, raw, T.normalize_ocr_lines) == [list("abcdefghij") + ["kl"], [], [], ["x"], None]
    spark.createDataFrame([(i, t) for i, t in enumerate(raw)] + [(None, "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.looping_lines(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "regexp_extract_all" not in plan
    got = {r["doc_id"]: r["lines"] for r in rows.collect()}
    assert got == {0: (list("abcdefghij") + ["kl"]) * 3, 1: [], 2: [], 3: ["x"] * 3, 4: None, None: ["y"]}


def test_decoding(spark):
    cases = [
        ("日本語。".encode("cp932"), "日本語。", "cp932"), (b"\xef\xbb\xbfa", "a", "utf-8-sig"), ("あ".encode("utf-16"), "あ", "utf-16"),
        ("あ".encode(), "あ", "utf-8"), (b"\xff\xfea", None, "utf-16"), (b"", "", "utf-8"),
    ]
    rows = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, content binary")
    got = decode_text(rows).orderBy("i").collect()
    assert [(r["text"], r["encoding"]) for r in got] == [c[1:] for c in cases]
    assert got[4]["error"]


def test_long_documents_are_searched_for_loops_in_time():
    draw = random.Random(3)
    syllables = ["th", "er", "an", "in", "ou", "re", "ti", "on", "es", "qua", "x", "vel", "j", "ko"]
    lines = ["".join(draw.choice(syllables) for _ in range(130)) for _ in range(80)]
    began = time.monotonic()
    assert C.collapse_blocks(lines) == lines
    assert C.collapse_blocks(lines * 3) == lines
    assert C.truncate_tail("\n".join(lines)) == "\n".join(lines)
    assert time.monotonic() - began < 5


def test_likeness_is_that_of_difflib():
    draw = random.Random(4)
    for n in (3, 20, 150, 400):
        for _ in range(25):
            a = "".join(draw.choice("abcdefgh") for _ in range(n))
            b = "".join(draw.choice("abcdefgh") if draw.random() < 0.3 else c for c in a)
            ratio = SequenceMatcher(None, a, b).ratio()
            assert C._alike(a, b, 0.7) == (ratio >= 0.7) and C._alike(a, b, ratio)
            assert 2.0 * C._shared(a, b) / (2 * n) >= ratio


@pytest.mark.parametrize("pairs", [C._PAIRS, 10])
def test_matches_in_long_texts_are_those_of_difflib(monkeypatch, pairs):
    monkeypatch.setattr(C, "_PAIRS", pairs)
    draw = random.Random(6)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyzäö .", "".join(chr(0x4E00 + i) for i in range(150)), "ab" + "".join(chr(0x1F600 + i) for i in range(60))):
        weights = [draw.random() ** 4 + 1e-3 for _ in alphabet]
        for n in (200, 201, 299, 300, 900):
            a = "".join(draw.choices(alphabet, weights, k=n + draw.randint(0, 40)))
            for b in ("".join(draw.choices(alphabet, weights, k=n)), a[n // 3 :] + a[: n // 3], a[: n // 2] + "".join(draw.choices(alphabet, weights, k=20)) + a[n // 2 :], a):
                plain, ours = SequenceMatcher(None, a, b), C._Matcher(a, b)
                for _ in range(6):
                    (a0, a1), (b0, b1) = (sorted(draw.sample(range(len(x) + 1), 2)) for x in (a, b))
                    assert ours.find_longest_match(a0, a1, b0, b1) == tuple(plain.find_longest_match(a0, a1, b0, b1))
                assert ours.find_longest_match(0, len(a), 0, len(b)) == tuple(plain.find_longest_match())
                assert 2.0 * ours.most() / (len(a) + len(b)) == plain.quick_ratio()
                assert C._alike(a, b, plain.ratio()) and (a == b or not C._alike(a, b, plain.ratio() + 1e-9))


def test_stretches_never_share_more_than_their_bounds():
    draw = random.Random(8)
    words = ["".join(draw.choices("etaoinshrdlucmq", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 1], k=draw.randint(1, 9))) for _ in range(40)]
    refuted = 0
    for repeats in (0, 0.02, 0.3, 0.9):
        lines = []
        for _ in range(48):
            lines.append(draw.choice(lines) if lines and draw.random() < repeats else "".join(draw.choices(words, k=20)))
            if repeats and draw.random() < 0.2:
                lines[-1] = lines[-1][: draw.randint(20, 60)] + lines[0][:50]
        text, at = "".join(lines), [0, *accumulate(map(len, lines))]
        places = C._Places(text)
        places.by_line(np.array(at))
        for start in range(0, 40, 3):
            size = np.arange(3, (len(lines) - start) // 2 + 1)
            at_once = places.most_of_blocks(start, size) if places.sums else np.full(size.size, len(text))
            for k, most in zip(size.tolist(), at_once):
                a, b, c = at[start], at[start + k], at[start + 2 * k]
                if c - b >= 200:
                    shared = sum(m.size for m in SequenceMatcher(None, text[a:b], text[b:c]).get_matching_blocks())
                    assert shared <= places.most(a, b, c) and shared <= most
                    refuted += 2.0 * most / (c - a) < 0.75
    assert refuted > 100


def test_blocks_of_a_long_text_without_loops_are_settled_by_bounds(monkeypatch):
    compared = []
    alike, shared = C._alike, C._shared
    monkeypatch.setattr(C, "_alike", lambda *of: compared.append(of) or alike(*of))
    monkeypatch.setattr(C, "_shared", lambda *of: compared.append(of) or shared(*of))
    draw = random.Random(9)
    words = ["".join(draw.choices("etaoinshrdlucmq", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 1], k=draw.randint(2, 9))) for _ in range(90)]
    lines = ["".join(draw.choices(words, k=60)) for _ in range(60)]
    assert C.collapse_blocks(lines) == lines
    assert sum(len(b) >= 1_000 for _, b, *_ in compared) < 10


def test_long_texts_are_not_walked_character_by_character(monkeypatch):
    def walked(*_):
        raise AssertionError("difflib's own search")

    draw = random.Random(7)
    lines = ["".join(draw.choices("etaoinqvxjkz", [50] * 4 + [20] * 2 + [1] * 6, k=240)) for _ in range(60)]
    halves = [SequenceMatcher(None, "".join(lines[:k]), "".join(lines[k : 2 * k])).ratio() for k in (10, 30)]
    monkeypatch.setattr(C, "SequenceMatcher", walked)
    assert [C._alike("".join(lines[:k]), "".join(lines[k : 2 * k]), r) for k, r in zip((10, 30), halves)] == [True, True]
    assert C.truncate_tail("\n".join(lines)) == "\n".join(lines)
    assert C.truncate_tail("\n".join(lines * 3)).startswith("\n".join(lines))


def test_entities_that_were_cut_stay(spark):
    raw = ["a &amp;&amp", "x &eacute; &lt &#12354; &#x3042 &notit; &am"]
    assert column(spark, raw, lambda c: T.inner_text(c, closed=True)) == ["a &&amp", "x é &lt あ &#x3042 &notit; &am"]


def test_long_batches_of_documents_keep_their_rows(spark):
    n = 2 * U._ROWS + 3
    rows = docs(spark, *(f"あ{i}。\nplain" for i in range(n)))
    got = U.localized(rows.coalesce(1), U.echo).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [f"あ{i}。\nplain" for i in range(n)] and {r["segments"] for r in got} == {1}

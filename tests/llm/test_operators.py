"""The operators against brute force and on odd tables: nulls, empty and very long texts, ties, repeated rows, no rows,
and extra columns with clashing names."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from ferrytext.llm import attention, decontaminate, langid, license_scan, lm_score, media, sharding, simhash, suffix_dedup, toxicity
from ferrytext.llm.bpe import encode_decode
from ferrytext.llm.components import components
from ferrytext.llm.lm_score import score_texts
from ferrytext.llm.suffix_sort import deep_shallow_sort

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k1 long, block long, words string, score double, nth int"
RNG = random.Random(11)
WORDS = ["alpha", "Beta", "gamma", "été", "Delta,", "one", "two", "MIT", "license", "GNU", "general", "public", "cc", "by"]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


TEXTS = [sentence(RNG.randint(1, 80)) for _ in range(30)]
TEXTS += [None, "", "   ", "!?", TEXTS[0], TEXTS[0], TEXTS[1] + " more", "x" * 50_000, "ab " * 9_000, "The MIT License\nthe MIT  license mit licence"]
ROWS = [(i, t, RNG.choice(["en", "fr", None]), "s", len(t or ""), 1, 2, 3, "w", 0.5, 4) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], (None, "no id", None, None, None, *[None] * 6), (None, None, None, None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_licenses(docs, none):
    got = by_id(license_scan.scan_licenses(docs))
    for i, t in enumerate(TEXTS):
        words, want = alnum(t), []
        for n in license_scan.NOTICES:
            p = n.phrase.split()
            if n.base:
                want += [(k, n.label) for k in range(len(words)) if words[k : k + len(p)] == p]
        assert got[i]["n_words"] == len(words)
        assert sorted((m["start_word"], m["label"]) for m in got[i]["matches"] if m["base"] and not m["edits"]) == sorted(want)
    fuzzy = [m for m in got[len(TEXTS) - 1]["matches"] if m["edits"]]
    assert [(m["label"], m["matched"], m["edits"]) for m in fuzzy] == [("mit", "mit licence", 1)]
    assert license_scan.scan_licenses(docs).count() == len(ROWS) and license_scan.scan_licenses(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_licenses_against_all_windows():
    rng = random.Random(3)
    notices = [n for n in license_scan.NOTICES if n.label in ("mit", "gpl", "mpl", "apache", "reserved") and len(n.phrase) < 30]

    def damaged(phrase):
        out = list(phrase)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "e"])
        return "".join(out)

    def brute(text, n):
        words, at, spans = text.split(" "), 0, []
        starts = []
        for w in words:
            starts.append((at, at + len(w)))
            at += len(w) + 1
        for i in range(len(words)):
            for j in range(i, min(len(words), i + 12)):
                s, e = starts[i][0], starts[j][1]
                firm = n.firm + " " if n.firm else ""
                if abs(e - s - len(n.phrase)) <= n.max_edits and text.startswith(firm, s):
                    d = distance(text[s + len(firm) : e], n.phrase[len(firm) :])
                    if d <= n.max_edits:
                        spans.append((d, s, e))
        out = [x for x in spans if not x[0]]
        for x in sorted(spans, key=lambda x: (x[0], x[1], -x[2])):
            if x[0] and all(x[2] <= s or e <= x[1] for _, s, e in out):
                out.append(x)
        return sorted((text.count(" ", 0, s), d, text[s:e]) for d, s, e in out)

    texts = ["gnu genral publik license gnu general publik license", "as it license was given", "hit license", "mit mit license", "mozillapublic license"]
    for _ in range(150):
        parts = [damaged(rng.choice(notices).phrase) if rng.random() < 0.6 else rng.choice(["a", "gnu", "public", "mit", "license xx"]) for _ in range(rng.randint(1, 5))]
        texts.append(" ".join(" ".join(parts).split()))
    for text in texts:
        for n in notices:
            got = sorted((m["start_word"], m["edits"], m["matched"]) for m in license_scan.find_notices(text.encode(), (n,)))
            assert got == brute(text, n), (text, n)
    found = license_scan.find_notices(texts[0].encode())
    assert [(m["label"], m["start_word"], m["edits"]) for m in found] == [("gpl", 0, 2), ("gpl", 4, 1)]
    assert not license_scan.find_notices(texts[1].encode()) and not license_scan.find_notices(texts[2].encode())


def test_language_model(docs, none):
    got = by_id(score_texts(docs, RANKS, P.PATTERN))
    tokens = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", lower(t)) if w] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for r in ROWS if not held(r[0]) for w in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in enumerate(TEXTS):
        words, r = tokens(t), got[i]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert got[0]["score"] == got[34]["score"]
    assert score_texts(none, RANKS, P.PATTERN).count() == 0


def test_language_model_scores_depend_on_no_partitioning(spark, docs):
    def scores(parts):
        rows = RNG.sample(ROWS, len(ROWS))
        got = score_texts(spark.createDataFrame(rows, SCHEMA).repartition(parts), RANKS, P.PATTERN).collect()
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in got)

    first = scores(1)
    assert first == scores(3) == scores(7)


def test_a_windows_score_depends_on_no_other_window():
    rng = np.random.default_rng(5)
    windows = rng.integers(0, 60, (400, attention.WINDOW + 1))
    follows = rng.integers(0, 9, (61, attention.CLASSES))
    pairs = tuple(np.zeros(0, np.int64) for _ in range(3))
    model = attention.AttentionModel(np.arange(61) + 1, np.arange(61) % attention.CLASSES, follows, pairs, windows, steps=20)
    texts = [rng.integers(0, 60, n) for n in (5, 31, 400, 9, 1)]
    alone = [model.log10(t, np.array([len(t)]))[0] for t in texts]
    for n in (0, 3, 64, 501):
        others = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(n)]
        every = others + texts + others[:7]
        got = model.log10(np.concatenate(every), np.array(list(map(len, every))))
        assert got[n : n + len(texts)].tolist() == alone


def test_subwords_of_a_word_depend_on_the_word_alone():
    subwords = lm_score.Subwords(RANKS, P.PATTERN)
    words = ["the", "\u00a0", "\u00a0x\u00a0", "a" * 1_500, "été", "(x).", "\u2003", "中文字", "the", "12345", "é" * 700]
    ids, sizes = subwords.encode([w.encode() for w in words])
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for w, got in zip(words, parts):
        assert got.tolist() == subwords.encoding.encode_ordinary(" " + w)
    assert [len(x) for x in subwords.encode([])] == [0, 0]


def test_language_model_learns_from_all_parts_of_all_texts(spark):
    texts = [("alpha beta " * 500 + f"gamma{i % 7}") if i % 2 else f"zeta{i} two" for i in range(900)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "cast(coalesce(text, '') as binary) text", "false held")
    subwords = lm_score.Subwords(RANKS, P.PATTERN)
    end, frequent = subwords.end, [b"alpha", b"beta"]
    ids = [subwords.encode(lm_score.words_of((t or "").encode()))[0].tolist() for t in texts]
    pairs = Counter((a, b) for t in ids for a, b in zip([end, *t], [*t, end]))
    table = lm_score.blocks(rows.repartition(3), frequent, RANKS, P.PATTERN).cache()
    got = {r["key"]: r["n"] for r in lm_score.counted(table, 2, end).collect()}
    assert {k: n for k, n in got.items() if k >= 0} == {a * (end + 1) + b: n for (a, b), n in pairs.items()}
    assert (got[-1], got[-2]) == (225_000, 225_000)
    model, occurrences = lm_score.learned(table, 2, end)
    counts = np.bincount([i for t in ids for i in (*t, end)], minlength=end + 1)
    assert occurrences.tolist() == [225_000, 225_000]
    assert (model.cls[counts > 0] > 0).all() and (model.cls[counts == 0] == 0).all()
    windows = lm_score.drawn_windows(table, end)
    assert (windows == ids[1][-1]).any() and set(np.unique(windows)) <= {*np.flatnonzero(counts), end + 1}
    again = lm_score.blocks(rows.coalesce(1), frequent, RANKS, P.PATTERN)
    assert (lm_score.drawn_windows(again, end) == windows).all()
    held = rows.withColumn("held", F.lit(True))
    assert lm_score.counted(lm_score.blocks(held, frequent, RANKS, P.PATTERN), 2, end).where("key >= 0").count() == 0


def test_network_learns_from_every_window(spark):
    """Though only few windows are drawn for its start."""
    texts = [f"one {'two ' * (i % 9)}three{i % 50} four five {i}" for i in range(600)] + [None, "", "rare " * 900]
    rows = spark.createDataFrame([*enumerate(texts), (None, "no id"), (None, "no id")], "doc_id long, text string")
    rows = rows.selectExpr("doc_id", "cast(coalesce(text, '') as binary) text", "coalesce(doc_id % 5 = 1, false) held")
    subwords = lm_score.Subwords(RANKS, P.PATTERN)
    end, held = subwords.end, lambda i: i is not None and i % 5 == 1
    want = sum(1 + len(subwords.encode(lm_score.words_of((t or "").encode()))[0]) // attention.FRESH for i, t in enumerate(texts) if not held(i)) + 2
    found = []
    for parts in (1, 4):
        table = lm_score.blocks(rows.repartition(parts), [b"two", b"rare"], RANKS, P.PATTERN).cache()
        model, _ = lm_score.learned(table, 2, end)
        weights, n = lm_score.passed_over(table, model, group=300)
        assert n == want
        found.append(weights)
    assert (found[0] == found[1]).all()
    few = lm_score._windows([np.array([], lm_score.packed(end)).tobytes()], end)
    before = model.w["b"].copy()
    model.settle(weights)
    assert len(few) == 1 and (model.w["b"] != before).any()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_language_model_beats_word_counts_on_held_out_texts(spark, sf):
    got = score_texts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), RANKS, P.PATTERN)
    base, score = got.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def model_of(texts, end, steps=1_200):
    """As ``lm_score.learned`` does, from lists of ids."""
    n = end + 1
    pairs = Counter((a, b) for t in texts for a, b in zip([end, *t], [*t, end]))
    keys, times = np.array(list(pairs), np.int64).reshape(-1, 2), np.array(list(pairs.values()), np.int64)
    counts = np.bincount(keys[:, 1], times, n).astype(np.int64)
    before, follows = np.zeros((n, attention.HEADS)), np.zeros((n, attention.CLASSES))
    np.add.at(before, (keys[:, 1], attention.heads_of(counts)[keys[:, 0]]), times)
    cls = attention.classes_of(counts, before)
    np.add.at(follows, (keys[:, 0], cls[keys[:, 1]]), times)
    stream, first = attention.framed(np.array([i for t in texts for i in t], np.int64), np.array([len(t) for t in texts]), end)
    return attention.AttentionModel(counts, cls, follows, (keys[:, 1], keys[:, 0], times), attention.windows_of(stream, attention.scored_rows(stream, first)), steps=steps)


def test_attention_scores_each_token_once_in_its_window():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 200, n).tolist() for n in (0, 1, 7, 8, 9, 15, 16, 17, 30, 31, 300, 300)]
    model = model_of(texts, 300, steps=60)
    w, got = model.w, model.log10(np.array([i for t in texts for i in t], np.int64), np.array([len(t) for t in texts]), batch=3)
    for text, value in zip(texts, got):
        stream, want = [300] * 9 + text + [300], 0.0
        for t in range(8, len(stream) - 1):
            start = (t // 8 - 1) * 8
            x = w["E"][model.inputs[stream[start : t + 1]]] + w["P"][: t + 1 - start]
            s = (x @ w["K"]) @ (x[-1] @ w["Q"]) / attention.WIDTH**0.5
            a = np.exp(s - s.max())
            h = a @ (x @ w["V"]) / a.sum() + x[-1]
            z = (h @ w["O"] + w["b"] + model.after[model.row[stream[t]]]).astype(float)
            y = stream[t + 1]
            want += z[model.cls[y]] - np.log(np.exp(z).sum()) + model.within(np.array([y]), np.array([stream[t]]))[0]
            assert t - start >= attention.FRESH
        assert value == pytest.approx(want / np.log(10), rel=1e-3)


def test_shares_of_a_class_sum_to_one_after_every_id():
    rng = np.random.default_rng(3)
    model = model_of([rng.zipf(1.4, 400).clip(max=290).tolist() for _ in range(20)], 300, steps=5)
    for before in (0, 1, 2, 5, 50, 299, 300):
        share = np.exp(model.within(np.arange(301), np.full(301, before)).astype(float))
        sums = np.bincount(model.cls, share)[np.unique(model.cls)]
        assert sums == pytest.approx(np.ones(len(sums)), abs=1e-4)


def test_attention_gradients():
    model = model_of([np.random.default_rng(6).integers(0, 200, 900).tolist()], 300, steps=3)
    ids = np.random.default_rng(2).integers(0, 302, (4, attention.WINDOW + 1))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, g = model.loss(ids)
    for name in ("Q", "K", "V", "O", "P", "b"):
        at = (0,) * model.w[name].ndim
        model.w[name][at] += 1e-5
        up = model.loss(ids)[0]
        model.w[name][at] -= 2e-5
        down = model.loss(ids)[0]
        model.w[name][at] += 1e-5
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-6)


def test_a_step_of_learning_asks_for_little_memory():
    """Steps write to the same arrays; what each asked the system for anew took a good part of the pass over all windows."""
    rng = np.random.default_rng(8)
    model = model_of([rng.integers(0, 200, 900).tolist()], 300, steps=3)
    windows, text = rng.integers(0, 302, (256, attention.WINDOW + 1)), rng.integers(0, 300, 16_384)
    room = attention._Room(len(windows), np.float32)

    def peak(run):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(lambda: model.loss(windows, room)) < 2_500_000
    assert peak(lambda: model.log10(text, np.array([len(text)]))) < 5_000_000


def test_attention_gradients_of_embeddings():
    model = model_of([np.random.default_rng(6).integers(0, 200, 900).tolist()], 300, steps=3)
    ids = np.random.default_rng(2).integers(0, 9, (4, attention.WINDOW + 1))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, g = model.loss(ids)
    for at in [(model.inputs[i], i) for i in range(9)] + [(model.inputs[200], 0)]:
        model.w["E"][at] += 1e-5
        up = model.loss(ids)[0]
        model.w["E"][at] -= 2e-5
        down = model.loss(ids)[0]
        model.w["E"][at] += 1e-5
        assert g["E"][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-6)


def test_words_of_a_batch_are_numbered_once():
    texts = [t.encode() for t in ("", "Two  two\tone", " \n\r\x0b\x0c ", "\x1fa \u00a0x \x00 \u00c9T\u00c9 one", "ONE zzz", "")]
    known = [b"one", b"never", b"two"]
    for batch in (texts, texts[:1], texts[2:3], texts * 40):
        for column in (pa.array(batch, pa.binary()), pa.array([b"skip", *batch, b"skip"], pa.binary()).slice(1, len(batch))):
            parts, new = lm_score.numbered(column, pa.array(known, pa.binary()))
            words = [[(known + new)[i] for i in part] for part in parts]
            assert words == [lm_score.words_of(t) for t in batch] and len(set(known + new)) == len(known + new)
    parts, new = lm_score.numbered(pa.array(texts, pa.binary()), pa.array([], pa.binary()))
    assert [[new[i] for i in part] for part in parts] == [lm_score.words_of(t) for t in texts]


def test_simhash(docs, none):
    got = by_id(simhash.near_duplicates(docs))

    def fingerprint(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in enumerate(TEXTS)}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in prints.items())
    root = dict.fromkeys(prints, None)
    for i in prints:
        if root[i] is None:
            work, root[i] = [i], i
            while work:
                a = work.pop()
                for b in prints:
                    if root[b] is None and bin(prints[a] ^ prints[b]).count("1") <= 3:
                        root[b] = i
                        work.append(b)
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert simhash.near_duplicates(docs).count() == len(ROWS) and simhash.near_duplicates(none).count() == 0


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3, 4)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps.tolist()[i + 1 :] if bin(a ^ b).count("1") <= 3}
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(rows).collect()}
    assert got == {tuple(sorted(p)) for p in want}


def test_links_are_never_broadcast(spark):
    plan = simhash.links(spark.range(50).withColumnRenamed("id", "fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def removed(texts, n):
    counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                hit[i] += 1
                hit[i + n] -= 1
        hit = np.cumsum(hit)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        out.append((len(t), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1_000, 2])
def test_suffix_dedup(spark, most):
    rng = random.Random(most)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 120))) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [rng.choice([rng.choice(shared), rng.choice(shared)[5:60], "".join(rng.choice("ijklmné ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 4))]
        texts.append("".join(parts))
    texts += ["z" * 300, "zy" * 100, texts[0], ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(suffix_dedup.removal_digests(rows, length=40, gram=8, most_variants=most, passage=25))
    want = removed([t.encode() for t in texts], 40)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == want
    assert [got[i]["n_repeated"] for i in range(len(texts))] == [n for _, n, _, _ in removed([t.encode() for t in texts], 25)]


def test_windows_of_hot_spans_are_never_broadcast(spark):
    rows = spark.range(50).selectExpr("id AS gram", "id AS k1", "id AS k2", "id AS first", "id AS anchor", "true AS single", "binary('ab') AS text")
    plan = suffix_dedup._repeated(suffix_dedup._windows(rows, 1))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_texts_over_a_segment(spark, monkeypatch):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = make(90)
    texts = [make(2_500) + shared + make(2_000), make(700) + shared + make(3_000) + shared[10:70], make(50), shared]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1_000)
    spans = suffix_dedup.Anchors(40, 8)
    for text in texts:
        data = text.encode()
        whole = spans.spans([data])
        assert len(whole[0]) and whole[1][0] == 0 and whole[2][-1] == len(data) - 40
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffix_dedup.removal_digests(rows, length=40, gram=8))
    want = removed([t.encode() for t in texts], 40)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == want


def test_suffix_dedup_on_odd_tables(docs, none):
    got = by_id(suffix_dedup.removal_digests(docs))
    assert got[30]["n_bytes"] == 0 and got[37]["n_removed"] == 50_000
    assert suffix_dedup.removal_digests(docs).count() == len(ROWS) and suffix_dedup.removal_digests(none).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.where("text is null").count() == 2 and out.where("doc_id = 37 and text = ''").count() == 1


def test_deep_shallow_sort():
    rng = random.Random(2)
    for _ in range(300):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(rng.randint(1, 12))] * 2
        order, lcp = deep_shallow_sort(strings, 0, rng.choice([0, 8, 24]))
        assert [strings[i] for i in order] == sorted(strings)
        for a, b, n in zip(order, order[1:], lcp[1:]):
            a, b = strings[a], strings[b]
            assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])


def test_media(docs, none, spark):
    got = by_id(media.text_media_digests(docs))
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["n_tiles"] == len(payload) // 576
    assert media.text_media_digests(none).count() == 0
    rng = np.random.default_rng(3)
    grey, rgb = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (6, 9, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all() and (media.decode(b"P6 9 6 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P2\n# c\n2 1\n255\n3 200\n") == [[3, 200]]).all() and (media.decode(b"P1 3 1 1 0 1") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4 9 1\n\x80\x00") == [[0, *[255] * 8]]).all() and (media.decode(b"P3 1 1 255 1 2 3") == [[[1, 2, 3]]]).all()
    fine = np.repeat(np.repeat(grey.astype(float), 8, 0), 9, 1)  # 56 x 45: both grids divide it
    want = fine.reshape(8, 7, 9, 5).mean(axis=(1, 3))
    assert media.area_resize(grey, 8, 9) == pytest.approx(want)
    rows = spark.createDataFrame([(1, bytearray(media.encode_pgm(grey)), 5), (2, bytearray(b"P9"), 5), (3, None, 5)], "id int, media binary, height int")
    out = {r["id"]: r for r in media.media_tiles(rows).collect()}
    assert out[1]["height"] == 7 and media.read_npy(bytes(out[1]["npy"])).shape == (1, 24, 24) and out[2]["error"] and out[3]["npy"] is None


def test_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(encode_decode(docs, RANKS, P.PATTERN, with_ids=True, cache_entries=50))
    for i, t in enumerate(TEXTS):
        ids = known.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_decode(none, RANKS, P.PATTERN).count() == 0


def test_language_id(spark, docs, none):
    rng = random.Random(4)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(n))
    parts = {"aa": ["ba", "ko", "ri"], "bb": ["sch", "unge", "tz"]}
    rows = [(i, make(parts[lang], 60), lang) for i in range(60) for lang in [("aa", "bb")[i % 2]]] + [(60, "12 !", "aa"), (61, None, "bb"), (62, "", None)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.identify(known, langid.training_sample(known)))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:60]) and all(got[i]["lang_pred"] == "und" for i in (60, 61, 62))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs, ()).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs, langid.training_sample(docs)).count() == len(ROWS) and langid.training_sample(none) == ()


def test_phrases_against_plain_search():
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = (("x", make("abc ", 200)), ("y", make("cdé ", 150)), ("z", make("中文字母", 120)))
    parser = langid.Parser(samples)
    texts = [make("abcdéxyz 中文字母汉", n) for n in (0, 1, 2, 511, 512, 513, 1_500)] + [make("abc ", 3_000), make("cdé", 700), "Ω", "ABÉ"]
    for text, row in zip(texts, parser.phrases([parser.code(parser.data(t)[0]) for t in texts])):
        data = parser.data(text)[0]
        for (_, sample), got in zip(samples, row):
            known, n, i = parser.data(sample)[0], 0, 0
            while i < len(data):
                k = 1
                while i + k < len(data) and data[i : i + k + 1] in known:
                    k += 1
                n, i = n + 1, i + k
            assert got == n
    assert parser.data("ABÉ 1中")[0] == "abé  中".encode()


def test_language_id_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.training_sample(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    rows = [r for r in found.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)


def test_decontamination(docs, none, spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (10, item), (None, "")], "item_id long, text string")
    texts = ["x " + item + " y", " ".join(item.split()[:13]) + " z" * 300, " ".join(item.split()[:12]), "a SHORT-one b", None, "", item.upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(decontaminate.contamination(rows, items))
    want = [(22, 20, 2, True), (313, 13, 2, False), (12, 0, 0, False), (4, 2, 1, True), (0, 0, 0, False), (0, 0, 0, False), (20, 20, 2, True)]
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for _, r in sorted(got.items())] == want
    assert got[0]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest() and got[4]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(docs, items).count() == len(ROWS) and decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).where("contaminated").count() == 0


def test_proximity_against_all_windows(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(12)] + [(99, "absent word"), (100, "")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    near = by_id(decontaminate.search(decontaminate.build_index(rows), decontaminate.benchmark_words(table))[0])
    counted = by_id(decontaminate.contamination(rows, table, proximity=True))
    for d, text in enumerate(texts):
        w, want = text.split(), set()
        for i, item in items:
            need, n = set(item.split()), len(item.split())
            if need and any(need <= set(w[k : k + n]) for k in range(len(w))):
                want.add(str(i))
        assert set(near[d]["near"]) == want and counted[d]["n_near"] == len(want)
    assert any(near[d]["near"] for d in near)


def test_chunks_of_the_benchmark_give_the_same(spark, monkeypatch):
    texts = [sentence(60) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, t[:150]) for i, t in enumerate(texts[:8])], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contamination(rows, items).collect()))
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 300)
    assert sorted(map(tuple, decontaminate.contamination(rows, items).collect())) == whole


def test_words_of_a_large_benchmark_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 300)
    rows = spark.range(30).selectExpr("id AS doc_id", "concat('a b ', id) AS text")
    words = spark.range(30).selectExpr("binary(concat('word', id)) AS term")
    plan = decontaminate.build_index(rows, words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shards(docs, none):
    rows = sharding.hilbert_shards(docs, 8, bucket_rows=5).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(ROWS) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["h"] for r in order] == sorted(r["h"] for r in rows)
    assert sharding.hilbert_shards(none).count() == 0


def test_shards_of_rows_that_are_equal_or_have_no_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 7)
    rows = [(None, "same", "a", "en")] * 50 + [(3, f"t{i % 9}", "a", "en") for i in range(40)] + [(None, f"u{i}", None, None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    got = sharding.hilbert_shards(docs, 8, bucket_rows=10).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t.encode())) for i, t, _, _ in rows)
    key = lambda r: (r["h"], zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['size']}:{r['text_crc32']}".encode()), r["doc_id"] or -1, r["size"], r["text_crc32"])
    placed = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [key(r) for r in placed] == sorted(map(key, got))
    assert [(r["shard"], r["slot"]) for r in placed] == [(s, n) for s in range(8) for n in range(15)]


def test_curve_visits_neighbours(spark):
    cells = {r["h"]: r["cell"] for r in sharding.curve(spark).collect()}
    assert sorted(cells) == list(range(4096))
    xyz = np.array([(c >> 8, c >> 4 & 15, c & 15) for _, c in sorted(cells.items())])
    assert (np.abs(np.diff(xyz, axis=0)).sum(1) == 1).all()


def test_segments_against_all_pairs():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.choice([-2, -1, -0.4, 1, 2]) for _ in range(rng.randint(0, 14))]
        found = toxicity.maximal_segments(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert max((x[2] for x in found), default=0) == pytest.approx(max(0, best))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:])) and all(sum(s[a:b]) == pytest.approx(v) for a, b, v in found)
        assert all(any(a <= i < b for a, b, _ in found) for i, v in enumerate(s) if v > 0)


def test_all_maximal_segments_against_recursion():
    rng = random.Random(12)

    def brute(s, a, b):
        best = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        return [] if best[0] <= 0 else [*brute(s, a, best[1]), (best[1], best[2]), *brute(s, best[2], b)]

    for _ in range(200):
        s = [rng.uniform(-1.5, 1) for _ in range(rng.randint(0, 18))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute(s, 0, len(s))


def test_extreme_value_law_and_score():
    rate, log_k = toxicity._fit_gumbel({1.0: 60, 2.0: 40}, {1.0: 50, 3.0: 50}, 1_000, -0.4)
    assert 0.06 * np.exp(rate) + 0.04 * np.exp(2 * rate) + 0.9 * np.exp(-0.4 * rate) == pytest.approx(1, abs=1e-6)
    assert log_k == pytest.approx(np.log(100) + rate - np.log(1_000))
    assert toxicity._fit_gumbel({}, {}, 50, -0.4) == (1.0, -np.log(50))
    model = toxicity.Model({b"wbad": 4.0}, -0.4, rate=1.0, log_k=0.0, slope=2.0, intercept=-1.0)
    lookup = toxicity._Scores(model.scores, model.neutral)
    found = model.passages(b"a bad bad b".split(), lookup)
    assert [(a, b) for a, b, *_ in found] == [(1, 3)] and found[0][3] == pytest.approx(8 - np.log(4))
    assert model.score(found) == pytest.approx(1 / (1 + np.exp(1 - 2 * np.log1p(8 - np.log(4))))) and model.score([]) == pytest.approx(1 / (1 + np.e))
    assert model.passages([], lookup) == [] and model.passages([b"a"], lookup) == []


def test_sample_of_labelled_rows_is_bounded(spark):
    docs = spark.range(4_000).selectExpr("id doc_id", "cast(id as string) text")
    labels = spark.range(4_000).selectExpr("id doc_id", "cast(id % 10 = 0 as int) toxic")
    rows = toxicity.training_sample(docs, labels, toxicity.Settings(rows_per_class=200)).groupBy("toxic").count().collect()
    assert all(150 <= r["count"] <= 200 for r in rows) and len(rows) == 2
    all_rows = toxicity.training_sample(docs, labels, toxicity.Settings()).count()
    assert all_rows == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(4_000))


def test_toxicity_takes_one_row_of_an_id(spark):
    docs = spark.range(20_000).selectExpr("id % 10 doc_id", "concat('text ', id % 3000) text").repartition(4)
    labels = spark.range(10).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    rows = toxicity.training_sample(docs, labels, toxicity.Settings(rows_per_class=5)).collect()
    taught = [i for i in range(10) if zlib.crc32(str(i).encode()) % 5]
    assert Counter(r["toxic"] for r in rows) == Counter(i % 2 for i in taught)
    again = toxicity.training_sample(docs.repartition(7), labels, toxicity.Settings(rows_per_class=5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_toxicity(spark, docs, none):
    rows = [(i, sentence(40) + (" vile scum fool" * 2 if i % 5 == 0 else ""), i % 5 == 0) for i in range(400)]
    known = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows] + [(0, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(known, labels)
    got = by_id(toxicity.score_documents(known, model))
    assert [bool(got[i]["predicted"]) for i, _, _ in rows] == [t for _, _, t in rows]
    assert toxicity.without_toxic(known, model).count() == 320
    assert toxicity.score_documents(docs, model).where("predicted = 1").count() == 0
    blank = toxicity.train(docs, labels.where("false"))
    assert toxicity.score_documents(docs, blank).where("predicted = 1").count() == 0 and toxicity.without_toxic(none, model).count() == 0


def test_worker_drops_tables_of_another_operator():
    from ferrytext.llm import common

    def one(batches):
        yield len(common.worker_copy(bytes, 5))

    def other(batches):
        yield common._KEPT[1]

    assert list(common.tidied(one)(iter([]))) == [5] and common._KEPT[1] == bytes(5)
    assert list(common.tidied(one)(iter([]))) == [5]
    assert list(common.tidied(other)(iter([]))) == [None]


def test_spans_of_long_texts_take_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(3).integers(97, 123, 2 << 20, np.uint8).tobytes()
    batch = suffix_dedup.pa.RecordBatch.from_arrays(
        [suffix_dedup.pa.array(x, t) for x, t in (([1], "int64"), ([2], "int64"), ([3], "int64"), ([text], "binary"))], ["doc_id", "k1", "k2", "text"]
    )

    class Keyed:
        mapInArrow = staticmethod(lambda run, ddl: run)

    tracemalloc.start()
    found = list(suffix_dedup._spans(Keyed(), suffix_dedup.PASSAGE, suffix_dedup.GRAM)(iter([batch])))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found[0].column("n_bytes").to_pylist() == [len(text)] and most < 64 << 20

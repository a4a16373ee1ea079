"""Fill-in-the-middle, fingerprints and Merkle manifests against brute force and on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrytext.llm import fill_in_middle as fim
from ferrytext.llm import fingerprints as fp
from ferrytext.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, h1 long, bucket int, form string, path string, ahead int"
RNG = random.Random(19)
LETTERS = "ab é字😀\n"
TEXTS = ["".join(RNG.choice(LETTERS) for _ in range(RNG.randint(1, 60))) for _ in range(60)]
TEXTS += [None, "", " ", "x", "<", "a<P>b", "has <M> within", "<S", TEXTS[0], TEXTS[0], "x" * 300_000, "".join(RNG.choice(LETTERS) for _ in range(200_000))]
ROWS = [(i, t, RNG.choice(["en", "fr", "", None]), RNG.choice(["s", None]), None if i == 5 else len(t or ""), "t", 2, 3, "w", "p", 9) for i, t in enumerate(TEXTS)]
ODD = [ROWS[3], ROWS[3], (3, "other text", "en", "s", 1, *[None] * 6), (None, "no id", None, None, None, *[None] * 6), (None, None, None, None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text, plan):
    g = sha(f"{plan.seed}:{'' if doc_id is None else doc_id}")
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, p, s, m = len(text), *plan.markers()
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or p in text or s in text or m in text or h[2] % 100 >= 100 - plan.plain_percent:
        return n, "plain", None, None, text
    spm = h[3] % 100 < plan.spm_percent
    pieces = (s + text[b:] + p + text[:a] + m + text[a:b]) if spm else (p + text[:a] + s + text[b:] + m + text[a:b])
    return n, "spm" if spm else "psm", a, b - a, pieces


def test_fill_in_middle(docs, none):
    for plan in (fim.Plan(), fim.Plan(seed=7, plain_percent=0, spm_percent=50, prefix="[one]", suffix="{two}", middle="|3")):
        rows = fim.fill_in_middle(docs, plan).withColumn("back", fim.restored(F.col("output"), F.col("form"), plan)).collect()
        want = sorted([(i, *cut(i, t or "", plan), t or "") for i, t, *_ in ROWS + ODD], key=str)
        assert sorted([tuple(r) for r in rows], key=str) == want
        assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(none).count() == 0


def test_units():
    text = "one two\tthree\n\nfour 五 six"
    codes = fim.decode(text.encode())
    places = {u: [int(x) for x in fim.boundaries(codes, u)] for u in fim.UNITS}
    assert places["code_point"] == list(range(len(text) + 1))
    assert places["line"] == [0, 14, 15, len(text)]
    assert [text[a:b] for a, b in zip(places["word"], places["word"][1:], strict=False)] == ["one", " ", "two", "\t", "three", "\n\n", "four", " ", "五", " ", "six"]
    assert fim.pieces(text.encode(), 2, 4, "word")[:3] == (b"one ", b"two\t", text[8:].encode())
    assert fim.boundaries(fim.decode(b""), "word").tolist() == [0]
    broken = b"a\xff\xed\xa0\x80b"
    assert fim.encode(fim.decode(broken)) == broken
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("", "x", "y")):
        with pytest.raises(ValueError):
            fim.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_prefix_hashes_answer_spans():
    rng = random.Random(2)
    text = fp.code_points("".join(rng.choice("ab") for _ in range(400)).encode())
    hashes = fp.PrefixHashes(text, fp.tables())
    for _ in range(3000):
        i, j, n = rng.randrange(380), rng.randrange(380), rng.randrange(1, 12)
        i, j = min(i, 400 - n), min(j, 400 - n)
        assert (hashes.span(i, i + n) == hashes.span(j, j + n)) == (text[i : i + n] == text[j : j + n]).all()
    assert hashes.grams(5).tolist() == [hashes.span(i, i + 5) for i in range(396)]
    prime = (1 << 31) - 1
    exact = [sum((int(c) + 1) * pow(b, i, prime) for i, c in enumerate(text)) % prime for b in fp.BASES]
    assert hashes.span(0, 400) == exact[0] << 31 | exact[1]


def test_longest_common_extension(monkeypatch):
    rng = np.random.default_rng(4)
    for block in (7, 64, fp.BLOCK):
        monkeypatch.setattr(fp, "BLOCK", block)
        for _ in range(120):
            a = rng.integers(97, 99, rng.integers(0, 200)).astype(np.uint32)
            b = a.copy()[: rng.integers(0, len(a) + 1)]
            if len(b) and rng.random() < 0.7:
                b[rng.integers(0, len(b))] += 1
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            assert fp.common_extension(a, b) == (differ[0] if len(differ) else n)


def slots(text, powers):
    """The definition: the smallest hash of all spans of every slot."""
    codes = fp.code_points(text.encode())
    n = min(fp.GRAM, len(codes))
    least = [None] * fp.SLOTS
    for i in range(len(codes) - n + 1 if n else 0):
        h = int(fp._mixed(np.array([fp.PrefixHashes(codes[i : i + n], powers).span(0, n)], np.uint64))[0])
        at = h >> (64 - fp.SLOT_BITS)
        least[at] = h if least[at] is None else min(h, least[at])
    return [0 if h is None else h % 65535 + 1 for h in least]


def test_fingerprints(docs, none, monkeypatch):
    powers = fp.tables()
    texts = [t or "" for t in TEXTS[:40]] + ["long " * 20 + "text " * 30]
    whole = fp.fingerprint_all([fp.code_points(t.encode()) for t in texts], powers)
    assert [[int(f[i : i + 4], 16) for i in range(0, len(f), 4)] for f in whole] == [slots(t, powers) for t in texts]
    monkeypatch.setattr(fp, "BLOCK", 50)
    assert fp.fingerprint_all([fp.code_points(t.encode()) for t in texts], powers) == whole
    monkeypatch.undo()
    found = fp.edited_fingerprints(docs).collect()
    ordered = sorted(ROWS + ODD, key=lambda r: (r[0] is None, -(r[0] or 0)))
    tie = {(r["doc_id"], r["t"]): r["h"] for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[0], r[1] or ""]))
    want = []
    for r, after in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, head = r[1] or "", after[1] or ""
        n = len(text) // 3
        want.append((r[0], len(text), text[: len(text) - n] + head[:n]))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in found), key=str) == sorted(want, key=str)
    prints = dict(zip([t or "" for t in TEXTS] + ["other text", "no id"], fp.fingerprint_all([fp.code_points((t or "").encode()) for t in [*TEXTS, "other text", "no id"]], powers), strict=True))
    nexts = {(r[0], r[1] or ""): after[1] or "" for r, after in zip(ordered, ordered[1:] + ordered[:1], strict=True)}

    def like(a, b):
        pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
        filled = [x for x in pairs if x != ("0000", "0000")]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    for r in found:
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        text = TEXTS[r["doc_id"]] or ""
        assert r["fingerprint"] == prints[text]
        assert r["near_next"] == pytest.approx(like(prints[text], prints[nexts[r["doc_id"], text]]))
        assert r["near_edited"] == pytest.approx(like(r["fingerprint"], r["edited_fingerprint"]))
        same = next((i for i, (x, y) in enumerate(zip(text, r["edited"], strict=False)) if x != y), min(len(text), len(r["edited"])))
        assert r["common_prefix"] == same
    assert fp.edited_fingerprints(none).count() == 0


def test_order_in_many_buckets(spark, monkeypatch):
    """Whatever the cuts, every row meets the next one."""
    rows = [(RNG.randrange(-400, 400) if RNG.random() < 0.7 else 7, f"text {i} " + "w" * RNG.randrange(30)) for i in range(600)] + [(7, "same")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    for per in (1, 8):
        monkeypatch.setattr(fp, "KEYS_PER_BUCKET", per)
        seen.append(sorted((r["doc_id"], r["edited"]) for r in fp.edited_fingerprints(docs).select("doc_id", "edited").collect()))
    tie = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (-r[0], -tie[r[1]]))
    want = sorted((i, t[: len(t) - len(t) // 3] + u[: len(t) // 3]) for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert seen == [want, want]


def tree(hashes, fanout):
    """Root and, for each leaf, its siblings and steps, by the definition."""
    level, at = list(hashes), list(range(len(hashes)))
    siblings, steps = [[] for _ in hashes], [[] for _ in hashes]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf, i in enumerate(at):
            run, own = runs[i // fanout], i % fanout
            siblings[leaf] += run[:own] + run[own + 1 :]
            steps[leaf].append((run[:own], run[own + 1 :]))
            at[leaf] = i // fanout
        level = [sha("".join(run)) for run in runs]
    return level[0], siblings, steps


def leaf(row, more=0):
    i, text, lang, source, n, *_ = row
    values = (i, source, lang, None if n is None else n + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("fanout, leaves, merged", [(2, 50_000, 256), (2, 4, 2), (3, 3, 2), (5, 7, 3)])
def test_manifest(docs, fanout, leaves, merged, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "MERGED", merged)
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    found = merkle.manifest(docs, fanout, changed).withColumn("proof", merkle.proof(F.col("path")))
    found = found.withColumn("back", merkle.folded(F.coalesce("other_leaf", "leaf"), F.col("path"))).collect()
    langs = sorted({r[2] for r in ROWS + ODD}, key=lambda x: (x is not None, (x or "").encode()))
    rows = {x: sorted((r for r in ROWS + ODD if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    subs = {x: tree([leaf(r) for r in rows[x]], fanout) for x in langs}
    root, over, over_steps = tree([subs[x][0] for x in langs], fanout)
    want = []
    for k, x in enumerate(langs):
        for r, siblings, steps in zip(rows[x], *subs[x][1:], strict=True):
            crc = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            h = leaf(r, 1) if crc else leaf(r)
            for left, right in steps + over_steps[k]:
                h = sha("".join([*left, h, *right]))
            assert (h == root) == (not crc or r[4] is None)
            want.append((r[0], leaf(r), leaf(r, 1) if crc else None, subs[x][0], root, sha("".join(siblings + over[k])), h))
    names = ("doc_id", "leaf", "other_leaf", "subroot", "root", "proof", "back")
    assert sorted((tuple(r[c] for c in names) for r in found), key=str) == sorted(want, key=str)


def test_small_trees_and_node_records(spark, none):
    assert merkle.manifest(none).count() == 0
    rows = [(1, "a", "en", "s", 1)]
    one = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"]) for r in one] == [(leaf(rows[0]), leaf(rows[0]), leaf(rows[0]), "")]
    hashes = [sha(str(i)) for i in range(11)]
    made = {}
    peaks = merkle.mountain_range([(0, i, h) for i, h in enumerate(hashes)], 11, 2, lambda level, index, run, own: made.update({(level, index): own}))
    assert peaks == [(4, 0, tree(hashes, 2)[0])] and len(made) == 6 + 3 + 2 + 1
    peaks = merkle.mountain_range([(0, i, hashes[i]) for i in range(3, 9)], 11, 2, lambda *_: None)
    assert [(level, index) for level, index, _ in peaks] == [(0, 3), (2, 1), (0, 8)]
    frame = spark.createDataFrame([("", i, h) for i, h in enumerate(hashes)], "tree string, nth long, leaf string")
    nodes = {(r["level"], r["index"]): r["hash"] for r in merkle.grow(frame, ["nth"]).nodes().collect()}
    assert nodes.items() <= made.items() and nodes

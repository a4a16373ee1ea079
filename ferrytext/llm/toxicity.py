"""Toxic passages by maximum-scoring segment search.

Token log-odds with an informative Dirichlet prior are learned from a bounded sample of labelled rows; a
linear-time scan finds every maximal scoring segment of a text; an extreme-value (Gumbel) law fitted to clean
texts turns segment scores into significance, and a logistic curve on the summed significance gives the score.

Scoring is per document: no shuffle. What is broadcast are at most ``Settings.features`` tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytext.llm.common import ALNUM_TABLE, dropped, fold, slices, stored, text_rows, tidied


@dataclass(frozen=True)
class Settings:
    """rows_per_class: bound of the labelled sample, per label; features: bound of the token table; min_docs and
    min_z: what a token needs to be in it; prior: weight of the Dirichlet prior, as a share of the smaller class; neutral: score of all
    other tokens; cap: largest score of a token."""

    rows_per_class: int = 20_000
    features: int = 50_000
    min_docs: int = 4
    min_z: float = 3.0
    min_odds: float = 2.0
    prior: float = 0.5
    neutral: float = -0.4
    cap: float = 6.0


#: A token is scored by its word if that is in the table, else by the first 5 or 4 bytes of it.
def _levels(word: bytes) -> tuple[bytes, bytes, bytes]:
    return b"w" + word, b"5" + word[:5], b"4" + word[:4]


class _Scores(dict):
    """Word to score; emptied when full."""

    def __init__(self, table: dict[bytes, float], neutral: float) -> None:
        super().__init__()
        self.table, self.neutral = table, neutral

    def __missing__(self, word: bytes) -> float:
        for key in _levels(word):
            if (s := self.table.get(key)) is not None:
                break
        else:
            s = self.neutral
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = s
        return s


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, sum), in order: each has a positive sum, and no part or
    extension of it scores more (Ruzzo and Tompa). Linear time."""
    sums = list(accumulate(scores, initial=0.0))
    start: list[int] = []
    low: list[float] = []
    high: list[float] = []
    end: list[int] = []
    link: list[int] = []  # the nearest earlier segment with a smaller low
    for i, s in enumerate(scores):
        if s <= 0:
            continue
        a, lo, hi = i, sums[i], sums[i + 1]
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            a, lo = start[j], low[j]
            del start[j:], low[j:], high[j:], end[j:], link[j:]
            j -= 1
        start.append(a), low.append(lo), high.append(hi), end.append(i + 1), link.append(j)
    return [(a, b, hi - lo) for a, b, lo, hi in zip(start, end, low, high)]


@dataclass(frozen=True)
class Model:
    """scores: by token key; rate and log_k: the Gumbel law of a clean text's best segment (significance of a
    segment: rate * sum - log_k - log(words)); slope and intercept: logistic curve over log(1 + evidence)."""

    scores: dict
    neutral: float
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -20.0

    def passages(self, words: list[bytes], lookup: _Scores) -> list[tuple[int, int, float, float]]:
        """Significant segments: (start, end, sum, significance over 0)."""
        scores = list(map(lookup.__getitem__, words))
        if not scores or max(scores) <= 0:
            return []
        floor = self.log_k + math.log(len(words))
        found = ((a, b, s, self.rate * s - floor) for a, b, s in maximal_segments(scores))
        return [x for x in found if x[3] > 0]

    def score(self, passages: list[tuple[int, int, float, float]]) -> float:
        x = self.slope * math.log1p(sum(p[3] for p in passages)) + self.intercept
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def training_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """text (binary), toxic and half (0 or 1, by hash) of at most rows_per_class documents per label, the lowest
    by hash of the id among the labelled rows of folds 1 to 4 of 5.

    The chosen ids are at most 2 * rows_per_class rows, so they are broadcast. Of an id that many rows have, one row is taken,
    that with the lowest hash of its text: the bound is on rows, and no id outweighs others.
    """
    ids = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # places of ids on a scale on which a label's bound is 64 steps; only the first 128 are counted, for both labels
    totals = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    share = lambda n: F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)) * F.lit(64.0 * n / settings.rows_per_class)
    ids = ids.withColumn("step", F.floor(F.when(F.col("toxic") == 1, share(totals.get(1, 0))).otherwise(share(totals.get(0, 0)))))
    limit, held = {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sorted(ids.where("step < 128").groupBy("toxic", "step").count().collect(), key=lambda r: r["step"]):
        held[r["toxic"]] += r["count"]
        if held[r["toxic"]] <= settings.rows_per_class:
            limit[r["toxic"]] = r["step"] + 1
    ids = ids.where(F.col("step") < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0]))
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary")) % 2
    rows = text_rows(docs).join(F.broadcast(ids.select("doc_id", "toxic")), "doc_id")
    first = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    return first.select(F.col("row.text").alias("text"), "toxic", half.cast("int").alias("half"))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per token key, by label and half, added up over the task's rows as far as memory is bounded."""
    kinds = ((0, 0), (0, 1), (1, 0), (1, 1))
    counts = {kind: Counter() for kind in kinds}

    def out() -> pa.RecordBatch:
        keys = list(set().union(*counts.values()))
        arrays = [pa.array(keys, pa.binary()), *(pa.array([counts[kind][k] for k in keys], pa.int64()) for kind in kinds)]
        for c in counts.values():
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, ["key", "c0", "c1", "t0", "t1"])

    for batch in slices(batches, 4 << 20):
        for text, *kind in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half"))):
            counts[tuple(kind)].update({k for w in set(words_of(text)) for k in _levels(w)})
        if sum(map(len, counts.values())) > 500_000:
            yield out()
    yield out()


def _log_odds(t, c, nt, nc, settings: Settings):  # noqa: ANN001, ANN202  columns or arrays alike
    a = settings.prior * np.minimum(nt, nc) * (t + c) / (nt + nc)
    odds = np.log((t + a) / (nt * (1 + settings.prior) - t - a)) - np.log((c + a) / (nc * (1 + settings.prior) - c - a))
    return odds, odds / np.sqrt(1 / (t + a) + 1 / (c + a))


def learn_scores(sample: DataFrame, settings: Settings) -> list[dict[bytes, float]]:
    """Token log-odds, shrunk by the prior, from half 0, half 1 and both; of each at most ``settings.features``
    tokens. Those with the largest z over both halves come to the driver."""
    columns = ["c0", "c1", "t0", "t1"]
    counted = (
        sample.mapInArrow(tidied(_token_counts), "key binary, c0 long, c1 long, t0 long, t1 long")
        .groupBy("key")
        .agg(*(F.sum(c).alias(c) for c in columns))
        .withColumn("level", F.substring("key", 1, 1))
    )
    totals = counted.groupBy("level").agg(*(F.sum(c).alias(f"n{c}") for c in columns))  # three rows
    t, c, nt, nc = (F.col(x) + F.col(y) for x, y in (("t0", "t1"), ("c0", "c1"), ("nt0", "nt1"), ("nc0", "nc1")))
    a = settings.prior * F.least(nt, nc) * (t + c) / (nt + nc)
    side = lambda n, total: F.log((n + a) / (total * (1 + settings.prior) - n - a))
    z = (side(t, nt) - side(c, nc)) / F.sqrt(1 / (t + a) + 1 / (c + a))
    rows = (
        counted.where(t + c >= settings.min_docs)
        .join(F.broadcast(totals), "level")
        .where((nt > 0) & (nc > 0))
        .withColumn("z", z)
        .where(F.col("z") >= settings.min_z / 2)
        .orderBy(F.col("z").desc(), "key")
        .limit(settings.features)
        .collect()
    )
    keys = [bytes(r["key"]) for r in rows]
    n = {k: np.array([r[k] for r in rows], float) for k in (*columns, *(f"n{c}" for c in columns))}
    out = []
    for parts in ("0", "1", "01"):
        t, c, nt, nc = (sum(n[f"{x}{p}"] for p in parts) for x in ("t", "c", "nt", "nc"))
        with np.errstate(all="ignore"):
            odds, z = _log_odds(t, c, nt, nc, settings)
        keep = (t + c >= settings.min_docs) & (z >= settings.min_z) & (odds >= settings.min_odds)
        out.append({k: min(settings.cap, float(o)) for k, o, ok in zip(keys, odds, keep) if ok})
    return out


def _fit_gumbel(positive: dict[float, int], sums: dict[float, int], words: int, neutral: float) -> tuple[float, float]:
    """Rate and log K of the law of clean texts' best segments, P(best < x) = exp(-K words exp(-rate x)). The rate solves
    mean(exp(rate * score)) = 1 over clean tokens (``positive`` scores and how many there are, all others neutral); K follows
    from how many of their segments (``sums`` and how many there are) reach the median sum."""
    if not positive:
        return 1.0, -math.log(max(2, words))
    scores, times = np.array(list(positive)), np.array(list(positive.values()))
    low, high = 1e-3, 8.0
    for _ in range(60):
        rate = (low + high) / 2
        mean = ((np.exp(np.minimum(rate * scores, 600)) * times).sum() + (words - times.sum()) * math.exp(rate * neutral)) / words
        low, high = (rate, high) if mean < 1 else (low, rate)
    left, total = 0, sum(sums.values())
    for middle in sorted(sums):
        left += sums[middle]
        if 2 * left >= total:
            break
    return rate, math.log(total - left + sums[middle]) + rate * middle - math.log(words)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept, by Newton's method with a small ridge."""
    w = np.zeros(2)
    rows = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from labelled rows of folds 1 to 4 of 5. Without rows of both labels every score is near 0.

    Null texts, labels and ids, repeated rows and labels, and texts of any length are taken as they are; an id that has
    both labels counts as toxic. The driver gets at most ``features`` tokens, a row per distinct token score and rounded
    sum, and a number per row of the bounded sample.
    """
    sample = stored(training_sample(docs, labels, settings), "sample")
    *halves, scores = learn_scores(sample, settings)
    raw = Model(scores, settings.neutral)
    if not scores:
        dropped(sample)
        return raw

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [_Scores(halves[1], settings.neutral), _Scores(halves[0], settings.neutral)]
        for batch in slices(batches, 4 << 20):
            sums, positive, sizes = [], [], []
            for text, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist()):
                scores = list(map(other[half].__getitem__, words_of(text)))
                sums.append([s for _, _, s in maximal_segments(scores)])
                positive.append([s for s in scores if s > 0])
                sizes.append(len(scores))
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (sums, positive)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *lists, pa.array(sizes, pa.int64())], ["toxic", "sums", "positive", "words"])

    # each half is scored with what the other half taught
    seen = stored(sample.mapInArrow(tidied(best), "toxic int, sums array<double>, positive array<double>, words long"), "sample-scores")
    clean = seen.where("toxic = 0")
    times = lambda c, digits: {r[0]: r[1] for r in clean.select(F.explode(F.transform(c, lambda s: F.round(s, digits))).alias("s")).groupBy("s").count().collect()}
    words = clean.agg(F.sum("words")).first()[0] or 0
    rate, log_k = _fit_gumbel(times("positive", 3), times("sums", 1), max(1, words), settings.neutral)
    floor = F.log(F.greatest(F.col("words"), F.lit(1))) + log_k
    evidence = F.aggregate("sums", F.lit(0.0), lambda x, s: x + F.greatest(F.lit(0.0), s * rate - floor))
    rows = seen.select("toxic", F.log1p(evidence).alias("x")).toArrow()
    dropped(sample, seen)
    y = rows["toxic"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return raw
    slope, intercept = _fit_logistic(rows["x"].to_numpy(), y)
    return Model(scores, settings.neutral, rate, log_k, slope, intercept)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 from score 0.5) and ``passages``: first word, word after the last, sum and
    significance of every significant segment.

    Null and empty texts have no passage and the score of such texts. Repeated rows give repeated rows, texts are
    scanned whole, an empty table gives an empty result, and columns other than doc_id and text are ignored. Of segments
    that tie, the scan reports all: they don't overlap.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("sum", pa.float64()), ("significance", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        lookup = _Scores(m.scores, m.neutral)
        for batch in slices(batches, 4 << 20):
            found = [m.passages(words_of(t), lookup) for t in batch.column("text").to_pylist()]
            scores = [m.score(p) for p in found]
            arrays = [
                batch.column("doc_id"),
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([[dict(zip(("start", "end", "sum", "significance"), p)) for p in ps] for ps in found], pa.list_(passage)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "passages"])

    ddl = "doc_id bigint, score double, predicted int, passages array<struct<start:int,end:int,sum:double,significance:double>>"
    return text_rows(docs).mapInArrow(tidied(run), ddl)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't predicted toxic. Null texts count as empty; repeated rows stay or
    go together. Only texts go to Python, and an answer per row comes back."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shipped.value
        lookup = _Scores(m.scores, m.neutral)
        for part in texts:
            yield pa.array([m.score(m.passages(words_of(t.as_buffer().to_pybytes()), lookup)) < 0.5 for t in part], pa.bool_())

    return docs.where(clean(F.coalesce(docs["text"], F.lit("")).cast("binary")))

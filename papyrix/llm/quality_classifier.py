"""Operator 6: a quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good over one labelled poor) train a linear document score: the chance that the
first wins is the logistic function of the difference of the scores, so the loss is logistic on feature differences and
has no intercept. Features are hashed words and hashed runs of four bytes of the text, and a few measures of its surface. A
second, one-dimensional logistic fit turns scores into probabilities of label 1. Documents are then kept above a quantile of
the scores of good training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetable import concat, span_hashes, word_spans
from .common import prepare, row_digest
from .words import SPACES, WORD

#: The classifier is fitted on at most so many labelled rows (those with the smallest hash of doc_id).
MAX_TRAINING_ROWS = 20_000
#: Partners of each training document; pairs are dealt by a fixed rule, not drawn.
PAIRS_EACH = 8
#: Documents below this quantile of the good training scores are dropped.
DROP_QUANTILE = 0.005
RIDGE = 1e-3
#: Buckets of hashed words, and as many again of hashed runs of four bytes; and the bytes looked at at once.
BUCKETS, PART = 512, 1 << 21

_MARKS = ".,;:!?'\"()[]{}|*#$%&<>@/\\=+-_~^`"
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "|", "*#$%&<>", "@/\\=+_~^`{}[]", ":;'\"()-", "\n", " \t\r\x0b\x0c"], 1):
    _CLASS[np.frombuffer(_chars.encode(), "u1")] = _i
_CLASS[128:] = 13
N_CLASSES = 14

FEATURES = [f"class_{i}" for i in range(1, N_CLASSES)] + [
    "log_words", "word_length", "word_spread", "distinct_share", "top_share", "short_share", "upper_words", "tail_words", "line_words", "dup_lines", "sentence_words", "marks_per_word", "bigram_repeat", "plain_words",
]


def features(text: str) -> list[float]:
    """The features of one text; all are 0 for an empty one. Only the text is looked at."""
    raw = np.frombuffer(text.encode(), "u1")
    if not len(raw):
        return [0.0] * len(FEATURES)
    share = np.bincount(_CLASS[raw], minlength=N_CLASSES) / len(raw)
    out = np.sqrt(share[1:]).tolist()
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return out + [0.0] * (len(FEATURES) - len(out))
    lens = np.fromiter(map(len, words), np.float64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ends = sum(text.count(e) for e in (". ", "! ", "? ", ".\n")) + 1
    upper = sum(map(str.isupper, words)) / n
    tails = sum(1 for w in words if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum()) / n
    plain = sum(map(str.isalpha, words)) / n
    return out + [
        np.log1p(n), lens.mean(), lens.std(), len(counts) / n**0.8, max(counts.values()) / n, (lens <= 3).mean(), upper, tails,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / ends), sum(map(text.count, _MARKS)) / n, 1 - (pairs + 1) / n, plain,
    ]


def _byte_runs(data: np.ndarray) -> np.ndarray:
    """The bucket of the run of four bytes at each place."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    runs = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    return ((runs * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def grams(texts: list[bytes]) -> np.ndarray:
    """For each text the square roots of the shares of hashed words and, after them, of hashed runs of bytes; A-Z as a-z."""
    out = np.zeros((len(texts), 2 * BUCKETS))
    data, bounds = concat(texts)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, n_words = word_spans(lower, bounds)
    bucket = (span_hashes(lower, starts, ends) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    place = np.repeat(np.arange(len(texts)), n_words) * BUCKETS + bucket
    out[:, :BUCKETS] = np.bincount(place, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for at in range(a, b, PART):
            out[i, BUCKETS:] += np.bincount(_byte_runs(lower[at : min(at + PART + 3, b)]), minlength=BUCKETS)
    for half in (out[:, :BUCKETS], out[:, BUCKETS:]):
        half /= np.maximum(half.sum(1, keepdims=True), 1)
    return np.sqrt(out)


def feature_matrix(texts: list[str]) -> np.ndarray:
    """The surface measures of each text and its hashed words and runs."""
    surface = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
    return np.hstack([surface, grams([t.encode() for t in texts])])


WIDTH = len(FEATURES) + 2 * BUCKETS


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised surface features and their squares, cut at four deviations so that no odd text runs away; the rest as it is."""
    surface = np.clip(x[:, : len(FEATURES)], -4, 4)
    return np.hstack([surface, surface * surface / 4, x[:, len(FEATURES) :]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Newton's method for ridge logistic regression without intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _minimum(loss, start: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS: ``loss`` gives value and gradient."""
    x, (value, grad), steps = start, loss(start), []
    for _ in range(rounds):
        way, alphas = -grad, []
        for s, y, r in reversed(steps):
            alphas.append(r * (s @ way))
            way = way - alphas[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(alphas)):
            way = way + s * (a - r * (y @ way))
        slope, length = grad @ way, 1.0
        while (after := loss(x + length * way))[0] > value + 1e-4 * length * slope and length > 1e-8:
            length /= 2
        s, y = length * way, after[1] - grad
        x, gain, (value, grad) = x + s, value - after[0], after
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        if gain < 1e-8:
            break
    return x


def _ranked(z: np.ndarray, win: np.ndarray, lose: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of least logistic loss on the differences z[win] - z[lose]; differences are never written out."""

    def loss(w: np.ndarray):
        u = (z @ w.astype(z.dtype)).astype(np.float64)
        gap = np.clip(u[win] - u[lose], -30, 30)
        pull = -1 / (1 + np.exp(gap)) / len(win)
        by_row = np.bincount(win, pull, len(z)) - np.bincount(lose, pull, len(z))
        return np.log1p(np.exp(-gap)).mean() + ridge / 2 * (w @ w), (by_row.astype(z.dtype) @ z).astype(np.float64) + ridge * w

    return _minimum(loss, np.zeros(z.shape[1]))


@dataclass
class Ranker:
    """A fitted Bradley-Terry score and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    intercept: float
    threshold: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1, between 0 and 1."""
        return self.chance(self.utility(x))

    def chance(self, utility: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * utility + self.intercept, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, quantile: float = DROP_QUANTILE) -> Ranker:
    """Fit on feature rows and 0/1 labels. Without both labels every score is the (smoothed) share of label 1."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        rate = (len(good) + 1) / (len(y) + 2)
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + len(FEATURES)), 0.0, float(np.log(rate / (1 - rate))), 0.0)
    mean, scale = np.zeros(WIDTH, x.dtype), np.ones(WIDTH, x.dtype)  # hashed shares are alike in scale
    mean[: len(FEATURES)], scale[: len(FEATURES)] = x[:, : len(FEATURES)].mean(0), np.maximum(x[:, : len(FEATURES)].std(0), 1e-6)
    z = expand((x - mean) / scale)
    few, many = sorted((good, poor), key=len)
    each = np.arange(max(pairs_each * len(few), 2 * len(many)))
    a, b = few[each % len(few)], many[(each * 7919 + each // len(few)) % len(many)]
    weights = _ranked(z, a, b, RIDGE) if few is good else _ranked(z, b, a, RIDGE)
    u = z @ weights
    slope, intercept = _logistic(np.column_stack([u, np.ones(len(u))]), y.astype(float), 1e-6)
    made = Ranker(mean, scale, weights, float(slope), float(intercept), 0.0)
    made.threshold = float(min(0.5, np.quantile(made.chance(u[good]), quantile)))
    return made


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = feature_matrix([t or "" for t in batch.column(0).to_pylist()])
        surface, hashed = x[:, : len(FEATURES)], x[:, len(FEATURES) :].astype(np.float16)
        at = [np.flatnonzero(h).astype(np.uint16) for h in hashed]
        yield pa.RecordBatch.from_pydict({
            "label": batch.column(1), "x": pa.array(list(surface), pa.list_(pa.float64())), "at": pa.array([a.tobytes() for a in at], pa.binary()),
            "share": pa.array([h[a].tobytes() for h, a in zip(hashed, at)], pa.binary()),
        })


def held_out(doc_id) -> F.Column:
    """Rows kept for evaluation: crc32 of doc_id as text leaves 1 modulo 3. Null counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_ranker(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Ranker:
    """Fit on labelled rows of ``docs`` that are not held out: at most ``max_rows`` of them, by hash of doc_id.

    Contradicting labels of one document are both used; null labels and null ids are left out. Of rows that share a doc_id the
    one with the least text counts. The sample's ids are broadcast: ``max_rows`` bounds them, and the feature rows (some
    kilobytes each) that come back.
    """
    prepare(docs.sparkSession)
    usable = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).distinct()
    sample = usable.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
    got = texts.mapInArrow(_featurise, "label int, x array<double>, at binary, share binary").toPandas()
    surface, label = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(FEATURES)), got["label"].to_numpy(np.int64)
    order = np.lexsort([*surface.T[::-1], label])  # the fit does not depend on the order of rows
    x = np.zeros((len(got), WIDTH), np.float32)
    x[:, : len(FEATURES)] = surface[order]
    for row, i in zip(x, order.tolist()):
        row[len(FEATURES) + np.frombuffer(got["at"][i], np.uint16).astype(np.int64)] = np.frombuffer(got["share"][i], np.float16)
    return fit_pairs(x, label[order])


def _scorer(model: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(feature_matrix([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_pydict({"row_key": batch.column(0), "score": pa.array(s)} | {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i > 1})

    return run


def _row_key() -> F.Column:
    return row_digest(F.col("doc_id"), F.col("text"))


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """Per row of ``docs``: row_key (equal for equal doc_id and text), doc_id, score. Empty and null texts score too."""
    prepare(docs.sparkSession)
    rows = docs.select(_row_key().alias("row_key"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_scorer(model), "row_key string, score double, doc_id long")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` under a ranker fitted on ``labels``; no other column of ``docs`` than text is an input.

    Null and empty texts have the same score; repeated rows have results alike; texts of any length are read whole. Without
    labels of both kinds all scores are one. An empty table gives no rows.
    """
    scored = score_documents(docs, train_ranker(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` at or above the ranker's score quantile, repeated rows included, with their columns as they were."""
    model = train_ranker(docs, labels)
    kept = score_documents(docs, model).filter(F.col("score") >= model.threshold).select(F.col("row_key").alias("__row"))
    return docs.withColumn("__row", _row_key()).join(kept, "__row", "left_semi").select(*docs.columns)

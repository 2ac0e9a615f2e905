"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import WORD_BASE, U, mix, rolling, utf8_slices, word_hashes, words

SAMPLE = 6000  # labelled documents that are read at most
LINES = 250  # a labelled document of more lines teaches nothing
FOLDS, HELD_OUT = 3, 1
RIDGE = 1.0
LINE = ("upper", "symbols", "stops", "digits", "word_length", "words", "marked_words", "distinct", "stutter", "longest_word", "bare_marks", "short_words", "beyond_ascii", "capitalised", "copy_in_text", "known_words")
NEAR = ("upper", "symbols", "stops", "marked_words", "distinct", "stutter", "word_length", "words")
FEATURES = (*LINE, *(f"before_{x}" for x in NEAR), *(f"after_{x}" for x in NEAR), "same_as_before", "same_as_after", "first", "last")

_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _HIGH = range(6)
_CLASS = np.full(256, _SYMBOL, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = _STOP


def _firsts(key: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its value, in the given order."""
    order = np.argsort(key, kind="stable")
    out = np.ones(len(key), dtype=bool)
    out[order[1:]] = key[order[1:]] != key[order[:-1]]
    return out


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES of the lines of a slice of documents, the bytes of words of each line, and each document's bounds among the lines.

    A line ends at a line feed; lines without words are passed over.
    """
    s, e, bounds = words(data, offs)
    if not len(s):
        return np.zeros((0, len(FEATURES)), dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    feeds = np.cumsum(data == 10)[s]
    opens = np.ones(len(s), dtype=bool)
    opens[1:] = (feeds[1:] != feeds[:-1]) | (document[1:] != document[:-1])
    line = np.cumsum(opens) - 1
    at = np.flatnonzero(opens)
    to = np.append(at[1:], len(s))
    of_line = document[at]
    n, size = to - at, np.add.reduceat(e - s, at)

    kind = _CLASS[data]
    total = lambda x: np.add.reduceat(x, at)
    per_word = {}
    for c in (_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _HIGH):
        upto = np.concatenate(([0], np.cumsum(kind == c)))
        per_word[c] = upto[e] - upto[s]
    letters = per_word[_UPPER] + per_word[_LOWER] + per_word[_HIGH]
    all_letters = np.maximum(total(letters), 1)
    h = word_hashes(data, s, e, lower=True)
    ends = kind[e - 1]
    stutter = np.zeros(len(s), dtype=bool)
    stutter[1:] = (h[1:] == h[:-1]) & ~opens[1:]
    new = _firsts(mix(h + line.astype(U) * U(0x9E3779B97F4A7C15)))
    new_in_text = _firsts(mix(h + document.astype(U) * U(0xC2B2AE3D27D4EB4F)))
    whole = mix(rolling(h, at, to, WORD_BASE) + n.astype(U))
    in_text = mix(whole + of_line.astype(U) * U(0xC2B2AE3D27D4EB4F))
    _, where, count = np.unique(in_text, return_inverse=True, return_counts=True)

    f = {
        "upper": total(per_word[_UPPER]) / all_letters,
        "symbols": total(per_word[_SYMBOL]) / size,
        "stops": total(per_word[_STOP]) / size,
        "digits": total(per_word[_DIGIT]) / size,
        "word_length": np.log1p(size / n),
        "words": np.log1p(n) / 4,
        "marked_words": total(ends == _SYMBOL) / n,
        "distinct": total(new) / n,
        "stutter": total(stutter) / n,
        "longest_word": np.log1p(np.maximum.reduceat(e - s, at)) / 4,
        "bare_marks": total(letters == 0) / n,
        "short_words": total((e - s) <= 3) / n,
        "beyond_ascii": total(per_word[_HIGH]) / size,
        "capitalised": total(kind[s] == _UPPER) / n,
        "copy_in_text": (count[where] > 1).astype(float),
        "known_words": 1 - total(new_in_text) / n,
    }
    inner = of_line[1:] == of_line[:-1]
    none = np.zeros(1, dtype=bool)
    has_before, has_after = np.concatenate((none, inner)), np.concatenate((inner, none))
    for k in NEAR:
        f[f"before_{k}"] = np.where(has_before, np.roll(f[k], 1), f[k])
        f[f"after_{k}"] = np.where(has_after, np.roll(f[k], -1), f[k])
    f |= {"same_as_before": has_before & (np.roll(whole, 1) == whole), "same_as_after": has_after & (np.roll(whole, -1) == whole), "first": ~has_before, "last": ~has_after}
    return np.stack([f[k] for k in FEATURES], axis=1).astype(np.float32), size, np.searchsorted(of_line, np.arange(len(bounds)))


class Chains:
    """Chains of lines of several documents, longest first, so that step t takes the first ``wide[t]`` of them."""

    def __init__(self, bounds: np.ndarray):
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        self.begin, n = bounds[:-1][order], n[order]
        self.wide = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
        self.last = self.begin + n - 1
        self.some = n > 0

    def steps(self) -> Iterator[np.ndarray]:
        """The lines at place t of all chains that have one."""
        for t, m in enumerate(self.wide):
            yield self.begin[:m] + t

    def messages(self, theta: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward log odds of good against bad at each line, and the sum of the chains' log partition functions.

        ``theta`` is a line's own log odds, ``turn[a, b]`` the weight of label b after a.
        """
        forward, backward = theta.astype(float).copy(), np.zeros(len(theta))
        rest = np.zeros(len(theta))  # log weight of all labellings up to a line that end in bad
        for t, at in enumerate(self.steps()):
            if t:
                f = forward[at - 1]
                bad = np.logaddexp(f + turn[1, 0], turn[0, 0])
                forward[at] += np.logaddexp(f + turn[1, 1], turn[0, 1]) - bad
                rest[at] = rest[at - 1] + bad
        for t in range(len(self.wide) - 1, 0, -1):
            at = self.begin[: self.wide[t]] + t
            b = theta[at] + backward[at]
            backward[at - 1] = np.logaddexp(b + turn[1, 1], turn[1, 0]) - np.logaddexp(b + turn[0, 1], turn[0, 0])
        end = self.last[self.some]
        return forward, backward, float((rest[end] + np.logaddexp(forward[end], 0)).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_field(x: np.ndarray, bounds: np.ndarray, good: np.ndarray, ridge: float = RIDGE, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bias first) and turns of the field in which the lines of a document have its label, by L-BFGS."""
    chains, n = Chains(bounds), np.diff(bounds)
    x = np.hstack([np.ones((len(x), 1), dtype=np.float32), x])
    y = np.repeat(good, n).astype(float)
    inner = np.ones(len(x), dtype=bool)
    inner[bounds[:-1][n > 0]] = False
    second = np.flatnonzero(inner)
    pairs = np.array([[((1 - y[second - 1]) * (1 - y[second])).sum(), ((1 - y[second - 1]) * y[second]).sum()], [(y[second - 1] * (1 - y[second])).sum(), (y[second - 1] * y[second]).sum()]])
    penalty = np.full(x.shape[1] + 4, ridge)
    penalty[0] = 1e-3

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        theta, turn = x @ w[:-4], w[-4:].reshape(2, 2)
        f, b, log_z = chains.messages(theta, turn)
        marginal = _sigmoid(f + b)
        before, after = f[second - 1], theta[second] + b[second]
        joint = np.stack([np.full(len(second), turn[0, 0]), after + turn[0, 1], before + turn[1, 0], before + after + turn[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        value = log_z - float(theta @ y) - float((turn * pairs).sum()) + 0.5 * float(penalty @ w**2)
        return value, np.concatenate((x.T @ (marginal - y), (joint - pairs).ravel())) + penalty * w

    return _descend(loss, np.zeros(x.shape[1] + 4), rounds)


def _descend(loss, w: np.ndarray, rounds: int, memory: int = 12) -> tuple[np.ndarray, np.ndarray]:
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, used = slope.copy(), []
        for ds, dg in reversed(past):
            a = (ds @ step) / (ds @ dg)
            step -= a * dg
            used.append(a)
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).sum())
        for (ds, dg), a in zip(past, reversed(used), strict=True):
            step += ds * (a - (dg @ step) / (ds @ dg))
        rate = 1.0
        while rate > 1e-8:
            new_value, new_slope = loss(w - rate * step)
            if new_value <= value - 1e-4 * rate * float(slope @ step):
                break
            rate /= 2
        else:
            break
        ds, dg = -rate * step, new_slope - slope
        if ds @ dg > 1e-12:
            past = [*past[1 - memory :], (ds, dg)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, slope = w + ds, new_value, new_slope
        if done:
            break
    return w[:-4], w[-4:].reshape(2, 2)


@dataclass(frozen=True)
class Model:
    """The field, and how a document's share of good words becomes a score; without a field every document scores ``prior``."""

    prior: float
    weights: np.ndarray | None = None
    turn: np.ndarray | None = None
    scale: tuple[float, float] = (0.0, 1.0)

    def good_lines(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The marginal probability that each line is good."""
        theta = self.weights[0] + x @ self.weights[1:]
        f, b, _ = Chains(bounds).messages(theta, self.turn)
        return _sigmoid(f + b)

    def shares(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mean of the lines' marginals, each weighted by the bytes of its words; without lines NaN."""
        upto = lambda v: np.concatenate(([0.0], np.cumsum(v)))[bounds]
        with np.errstate(invalid="ignore"):
            return np.diff(upto(self.good_lines(x, bounds) * size)) / np.diff(upto(size))

    def scores(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bounds) - 1, self.prior)
        share = self.shares(x, size, bounds)
        return np.where(np.isnan(share), self.prior, _sigmoid(self.scale[0] + self.scale[1] * _log_odds(share)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on one number, with a small ridge, by Newton's method."""
    x, w = np.stack([np.ones(len(z)), z], axis=1), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag([1e-3, 1.0]), x.T @ (p - y) + np.array([1e-3, 1.0]) * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod FOLDS is HELD_OUT; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(quality, text) of the SAMPLE labelled documents outside the held-out fold with the smallest hashes of their ids.

    The ids are few by SAMPLE, so they are broadcast to the documents.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("quality", "text").distinct()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The field of the sampled documents.  Features of SAMPLE * LINES lines at most reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in utf8_slices(batch["text"]):
                x, size, bounds = line_features(data, offs)
                n = np.diff(bounds)
                at = np.flatnonzero(n <= LINES)
                cut = [(x[bounds[i] : bounds[i + 1]].tobytes(), size[bounds[i] : bounds[i + 1]].tobytes()) for i in at]
                quality = batch["quality"].take(pa.array(row + at)).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([quality, pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], ["quality", "x", "size"])

    rows = sample_of(docs, labels, id_col, text_col).mapInArrow(features, "quality int, x binary, size binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["x"], r["quality"]))  # the same sums in the same order, however the rows came
    good = np.array([r["quality"] for r in rows], dtype=float)
    prior = float((good.sum() + 0.5) / (len(good) + 1))
    if len(set(good.tolist())) < 2:
        return Model(prior)
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(-1, len(FEATURES))
    size = np.frombuffer(b"".join(r["size"] for r in rows), dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(r["size"]) // 8 for r in rows])))
    field = Model(prior, *fit_field(x, bounds, good))
    share = field.shares(x, size, bounds)
    some = ~np.isnan(share)
    return Model(prior, field.weights, field.turn, _scale(_log_odds(share[some]), good[some]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "quality") -> DataFrame:
    """``docs`` with ``score_col``, a double from 0 to 1: how likely the whole text is a good document.

    A linear-chain conditional random field labels each line with words good or bad, by
    features of the line and of the lines before and after it and by the labels next to it; it is
    trained on labelled documents, whose lines all take their document's label.  Forward-backward
    marginals, weighted by the bytes of the lines' words, give a share of good text, and
    the share a score by logistic regression.  Labels, language, source and ids are no
    input of a score.  Null, empty and blank texts have no line and score the share of good
    documents, as all texts do without labels of both classes.  Null and repeated ids
    are scored row by row; very long texts and lines are read whole.  A column of
    ``docs`` named ``score_col`` gives way.
    """
    model = learn(docs, labels, id_col, text_col)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        found = [model.scores(*line_features(data, offs)) for _, data, offs in utf8_slices(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(score_col, quality(F.col(text_col).cast("string")))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))

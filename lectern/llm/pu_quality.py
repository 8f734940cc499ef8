"""Text quality by positive-unlabelled learning.

Trusted positives are documents that labels call good; the rest of the corpus, whose labels are not
looked at, is unlabelled.  The share of positives in it (the class prior) is estimated first.  The
classifier then minimises the non-negative unbiased risk: what positives cost as positives, weighted
by the prior, plus what unlabelled texts cost as negatives less the positives' part of that, the
latter never below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters.  At most so many rows are fitted on; everything else covers all rows.
POSITIVES = 4_000
UNLABELLED = 8_000
STEPS = 500
RATE = 0.05
RIDGE = 1e-3
#: The prior is read off sets that hold at least this share of the positives.
PRIOR_SHARE = 0.2
FOLDS, HELD_OUT = 3, 1

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>~^{}[]\\_=@/+`\""
STOPS = b".,;:?"
NAMES = ["log_words", "word_length", "word_length_sd", "upper", "digits", "symbols", "stops", "bangs", "bars", "distinct", "top_word", "repeat_next", "repeat_trigram", "dup_lines", "log_line_words", "one_char_words", "symbol_kinds"]


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text; no label, language, source or id is among them.  Without words, zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(NAMES))
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number))))
    w = np.fromiter(map(number.__getitem__, words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    again = 0.0
    if n > 3 and len(number) < n:
        k = len(number)
        pairs = w[:-2] * k + w[1:-1]
        if k > 2_000_000:  # three numbers of words no longer fit into one integer: number the pairs
            pairs = np.unique(pairs, return_inverse=True)[1]
        code = pairs * k + w[2:]
        again = 1 - len(np.unique(code)) / len(code)
    return np.array([
        np.log1p(n), lengths.mean(), lengths.std(), share(UPPER), share(DIGITS), share(SYMBOLS), share(STOPS), share(b"!"), share(b"|"),
        len(number) / n, np.bincount(w).max() / n, float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0, again,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), float((lengths == 1).mean()), float(sum(c in raw for c in SYMBOLS)),
    ])


class Model:
    """A linear score of standardised figures and their squares."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z / 6, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def _adam(grad, size: int, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the unlabelled's share to the
    positives' over sets a positive-against-unlabelled score picks, by cross-fitting on two halves."""
    def grad_of(a, b):
        return lambda w: -(a.T @ (1 - _sigmoid(a @ w))) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + RIDGE * w

    got = []
    for half in (0, 1):
        w = _adam(grad_of(p[half::2], u[half::2]), p.shape[1], 200)
        a, b = p[1 - half :: 2] @ w, u[1 - half :: 2] @ w
        cuts = np.quantile(a, np.linspace(0, 1 - PRIOR_SHARE, 50))
        got.append(min(((b >= c).mean() + 1 / np.sqrt(len(b)) * 0.5) / max((a >= c).mean(), 1e-9) for c in cuts))
    return float(np.clip(np.mean(got), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Minimise the non-negative unbiased risk with the sigmoid loss."""
    both = np.vstack([positive, unlabelled])
    mean, scale = np.median(both, 0), np.maximum(np.quantile(both, 0.84, 0) - np.quantile(both, 0.16, 0), 1e-3) / 2
    model = Model(mean, scale, np.zeros(0), 0.0)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    prior = estimated_prior(p, u)

    def grad(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        # Losses: as positive 1 - s, as negative s; their gradients are -/+ s (1 - s) x.
        up, down = p.T @ (sp * (1 - sp)) / len(p), u.T @ (su * (1 - su)) / len(u)
        rest = su.mean() - prior * sp.mean()
        if rest < 0:
            return -(down - prior * up) + RIDGE * w  # step back from a negative part that overfits
        return -prior * up + down - prior * up + RIDGE * w

    model.weights, model.prior = _adam(grad, p.shape[1]), prior
    return model


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of these tables (docs: doc_id, text; labels: doc_id, quality); None without positives.

    Positives: labelled 1 and not in the held-out fold, the first POSITIVES by a hash of their ids.
    Unlabelled: the first UNLABELLED documents by another hash; their labels are not joined."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()

    def drawn(ids: DataFrame, salt: int, most: int) -> np.ndarray:
        few = ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(most)
        got = scored_frame(docs.join(F.broadcast(few), "doc_id", "left_semi"), None).orderBy("doc_id").limit(2 * most).toPandas()
        return np.array(got.figures.tolist(), np.float64).reshape(-1, len(NAMES))

    positive = drawn(good, 1, POSITIVES)
    if not len(positive):
        return None
    return fit(positive, drawn(docs.where("doc_id is not null").select("doc_id").distinct(), 2, UNLABELLED))


def scored_frame(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id with the figures of its text, or with its score if a model is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], np.float64).reshape(-1, len(NAMES))
            made = pa.array(list(x), pa.list_(pa.float64())) if model is None else pa.array(model.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=["doc_id", name])

    name = "figures" if model is None else "score"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {name} " + ("array<double>" if model is None else "double"))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored as texts of no words; a null id is null, and not held out;
    repeated rows are scored each; an empty table gives no rows.  Without trusted positives every
    score is 0.5.  Other columns are not read."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = trained(src, labels)
    scores = src.select("doc_id", F.lit(0.5).alias("score")) if model is None else scored_frame(src, model)
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

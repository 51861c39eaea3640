"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the presence of lower-cased words and of their first 4, 5 and 6
bytes, as 64-bit hashes.  On a bounded sample of labelled documents the features
that tell grades apart are chosen by a chi-square test; then one weight vector
w and ordered thresholds t are fitted so that
P(grade <= k) = sigmoid(t[k] - w.x).  Every document gets the probabilities and
its expected severity, the sum over k of P(grade > k).

Defined cases: null, empty and blank texts have no features and get the
severity of the bare thresholds; null and repeated ids are scored row by row;
labels for absent documents, null grades and repeated labels (the highest
counts) do no harm; without labels of two grades every severity is 0; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import Texts, U, lists, pieces, signed

PREFIXES = (4, 5, 6)
#: Labelled documents used for training, at most, of each label; and the features kept.
SAMPLE, FEATURES = 1500, 2048
#: Probability of any toxicity from which a document counts as toxic; the weights are shrunk, so it lies under one half.
THRESHOLD = 0.35


def _present(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) entries, ordered, and words per text; with ``wanted`` (ascending) only those features."""
    texts = Texts(column)
    owner = np.repeat(np.arange(len(texts.counts)), texts.counts)
    if wanted is not None:
        likely = np.zeros(1 << 20, bool)
        likely[(wanted & U((1 << 20) - 1)).astype(np.int64)] = True
    text, feature = [], []
    for k, prefix in enumerate((None, *PREFIXES)):
        h = texts.hashes(lower=True, prefix=prefix) + U(k)
        who = owner
        if wanted is not None:
            at = np.flatnonzero(likely[(h & U((1 << 20) - 1)).astype(np.int64)])
            at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]] if len(wanted) else at[:0]
            h, who = h[at], owner[at]
        text.append(who)
        feature.append(h)
    text, feature = np.concatenate(text), np.concatenate(feature)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    return text[new], feature[new], texts.counts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        text, feature, n = _present(batch.column("text"))
        counts = np.bincount(text, minlength=len(n))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(n, pa.int64()), lists(signed(feature), counts, pa.int64())], ["label", "n_words", "features"])


@dataclass
class Model:
    features: np.ndarray  #: ascending hashes
    weights: np.ndarray
    thresholds: np.ndarray  #: ascending, one fewer than grades

    def exceed(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and k."""
        text, feature, n = _present(column, self.features)
        score = np.bincount(text, self.weights[np.searchsorted(self.features, feature)], minlength=len(n)) if len(feature) else np.zeros(len(n))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def choose(rows: np.ndarray, feature: np.ndarray, high: np.ndarray, least: float = 15.0) -> np.ndarray:
    """Features whose presence differs between ``high`` texts and the others by the chi-square test, ascending."""
    names, where = np.unique(feature, return_inverse=True)
    a = np.bincount(where, high[rows].astype(float), minlength=len(names))
    b = np.bincount(where, minlength=len(names)) - a
    n_a, n_b = high.sum(), (~high).sum()
    n = n_a + n_b
    c, d = n_a - a, n_b - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n_a * n_b, 1)
    ok = np.flatnonzero((chi >= least) & (a + b >= 3) & (a * n_b > b * n_a))
    return names[np.sort(ok[np.argsort(-chi[ok], kind="stable")[:FEATURES]])]


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_columns: int, *, penalty: float = 0.002, steps: int = 600, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean negative log-likelihood and an L2 penalty (Adam)."""
    k = int(grades.max())
    w, n = np.zeros(n_columns), len(grades)
    share = np.array([(grades <= j).mean() for j in range(k)])
    cut = np.log(share / (1 - share))
    free = np.concatenate([w, cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])  # the steps between thresholds are positive
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        w, low, gaps = free[:n_columns], free[n_columns], np.exp(free[n_columns + 1 :])
        t = np.concatenate([[-np.inf], low + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        x = np.bincount(rows, w[columns], minlength=n)
        upper, lower = (1 / (1 + np.exp(-np.clip(t[grades + s] - x, -500, 500))) for s in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n  # of log p by the upper and lower threshold
        dw = np.bincount(columns, (du - dl)[rows], minlength=n_columns) + penalty * w
        dt = np.zeros(k + 2)
        np.add.at(dt, grades + 1, -du)
        np.add.at(dt, grades, dl)
        dt = dt[1:-1]
        grad = np.concatenate([dw, [dt.sum()], [dt[j + 1 :].sum() * g for j, g in enumerate(gaps)]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        free = free - rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return free[:n_columns], free[n_columns] + np.concatenate([[0], np.cumsum(np.exp(free[n_columns + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit on documents of ``labels(doc_id, label)``: label 0 clean, 1 toxic, or grades of one's own (0, 1, 2, ...).

    With only labels 0 and 1, the toxic documents are graded 1 or 2 by whether
    the share of telling features among their words is under or over the median.
    At most ``sample`` documents of each label, chosen by hash, are used.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    grades = sorted(r[0] for r in known.select("label").distinct().collect())
    if len(grades) < 2:
        return Model(np.zeros(0, U), np.zeros(0), np.array([np.inf]))
    chosen = None
    for g in grades:
        part = known.filter(F.col("label") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most len(grades) * sample ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_features, "label int, n_words long, features array<long>").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(0, U), np.zeros(0), np.array([np.inf]))
    grade = rows.column("label").to_numpy().astype(np.int64)
    n_words = rows.column("n_words").to_numpy()
    feature = np.concatenate([c.flatten().to_numpy() for c in rows.column("features").chunks]).view(U)
    row = np.repeat(np.arange(len(grade)), np.concatenate([c.value_lengths().to_numpy() for c in rows.column("features").chunks]))
    if (grade > 0).all() or not (grade > 0).any():
        return Model(np.zeros(0, U), np.zeros(0), np.array([np.inf]))
    wanted = choose(row, feature, grade > 0)
    at = np.flatnonzero(np.isin(feature, wanted))
    row, column = row[at], np.searchsorted(wanted, feature[at])
    if grades == [0, 1]:
        share = np.bincount(row, minlength=len(grade)) / np.maximum(n_words, 1)
        toxic = grade > 0
        grade = np.where(toxic & (share > np.median(share[toxic])), 2, grade)
    _, grade = np.unique(grade, return_inverse=True)  # grades without gaps
    weights, thresholds = fit(row, column, grade, len(wanted))
    return Model(wanted, weights, thresholds)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade), p_any (P(grade > 0)), grade (rounded severity), toxic for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            over = model.exceed(batch.column("text"))
            severity, some = over.sum(axis=1), over[:, 0]
            columns = [batch.column("doc_id"), pa.array(severity.round(6)), pa.array(some.round(6)), pa.array(np.rint(severity), pa.int32()), pa.array(some >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "p_any", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_any double, grade int, toxic boolean")

"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of log-transformed statistics.  Per class, count, sum and sum of outer products
over all labelled training rows are added up by Spark; they give mean and covariance, and the covariance
is shrunk towards the pooled one and then towards its diagonal.  A score is the logistic of
the log-density difference; a density is a Mahalanobis distance through the Cholesky factor,
which is computed once per fit and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import stored
from .textops import flat_texts, segment_hashes, slices, words

FEATURES = ["log_words", "log_word_chars", "upper", "lower", "digit", "mark", "symbol", "bar", "bang", "wide",
            "distinct", "repeat_next", "line_words", "line_repeat", "word_spread"]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _MARK, _SYMBOL, _BAR, _BANG = map(_class, ("0123456789", ".,;:?'\"()-", "#*$%&<>@^~{}[]\\=+_/", "|", "!"))
_WIDE = np.arange(256) >= 0xC0


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; an empty text has the vector of zero counts."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first).astype(float)

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[at[1:]] - total[at[:-1]]
    counts = {k: per_doc(table[data], offsets) for k, table in (
        ("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("mark", _MARK), ("symbol", _SYMBOL), ("bar", _BAR),
        ("bang", _BANG), ("wide", _WIDE))}
    letters = counts["upper"] + counts["lower"] + counts["wide"]
    length = (ends - starts).astype(float)
    chars = per_doc(length, first)
    squares = per_doc(length * length, first)
    h = segment_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])
    distinct = per_doc(new.astype(float), first)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = per_doc(again, first)
    # lines: the hashes of lines that hold a word
    cut = data == 10
    cut_at = np.flatnonzero(cut)
    line_starts = np.unique(np.concatenate([offsets[:-1], cut_at + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_first = np.searchsorted(line_starts, offsets)
    line_ends = line_ends - (cut[np.maximum(line_ends - 1, 0)] if len(data) else 0)
    lh = segment_hashes(data, line_starts, np.maximum(line_ends, line_starts))
    ldoc = np.repeat(np.arange(n), np.diff(line_first))
    lorder = np.lexsort((lh, ldoc))
    lnew = np.ones(len(lh), bool)
    lnew[1:] = (lh[lorder][1:] != lh[lorder][:-1]) | (ldoc[1:] != ldoc[:-1])
    n_lines = np.diff(line_first).astype(float)
    line_repeat = n_lines - per_doc(lnew.astype(float), line_first)

    def rate(part, whole, usual, weight):
        """Log rate, drawn towards a usual one so that a short text is no outlier."""
        return np.log((part + 0.2 + weight * usual) / (whole + 1.0 + weight))
    mean = chars / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n_words, 1) - mean * mean, 0))
    return np.stack([np.log1p(n_words), np.log1p(mean), rate(counts["upper"], letters, 0.03, 100),
                     rate(counts["lower"], letters, 0.95, 100), rate(counts["digit"], chars, 0.002, 100),
                     rate(counts["mark"], n_words, 0.15, 20), rate(counts["symbol"], n_words, 0.01, 20),
                     rate(counts["bar"], n_words, 0.01, 20), rate(counts["bang"], n_words, 0.01, 20),
                     rate(counts["wide"], letters, 0.05, 100),
                     rate(distinct, n_words, 0.9, 20) + 0.25 * np.log1p(n_words), rate(again, n_words, 0.01, 20),
                     np.log1p(n_words / np.maximum(n_lines, 1)), rate(line_repeat, n_lines, 0.02, 5), np.log1p(spread)], 1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = statistics(*flat_texts(batch.column(1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(
                pa.list_(pa.float64()))], names=["id", "x"])


@dataclass
class Discriminant:
    """Means, Cholesky factors of the shrunk covariances and log priors of two classes."""
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in range(2):
            y = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            density.append(self.log_priors[k] - 0.5 * ((y * y).sum(0) + self.log_dets[k]))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled: float, diagonal: float) -> Discriminant:
    """Fit from per-class count, sum and sum of outer products."""
    p = s.shape[1]
    total = max(n.sum(), 1.0)
    means = s / np.maximum(n, 1)[:, None]
    scatter = ss - n[:, None, None] * means[:, :, None] * means[:, None, :]
    common = scatter.sum(0) / total + 1e-6 * np.eye(p)
    factors, log_dets = [], []
    for k in range(2):
        own = (scatter[k] + common) / (max(n[k], 0) + 1)
        c = (1 - pooled) * own + pooled * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(p)
        factors.append(np.linalg.cholesky(c))
        log_dets.append(2 * np.log(np.diag(factors[-1])).sum())
    return Discriminant(means, np.array(factors), np.array(log_dets), np.log((n + 1) / (total + 2)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(x))], names=["id", "score"])
    return run


def fit(described: DataFrame, labels: DataFrame, pooled: float = 0.05, diagonal: float = 0.1) -> Discriminant:
    """Fit on (id, x) rows and labels (id, y).  All labelled rows count; labels other than 0 and 1 are
    ignored, and a row with several labels counts once for each.  With no labels at all every score is 0.5."""
    rows = labels.filter("y in (0, 1)").join(described, "id").select("y", "x")
    p = len(FEATURES)
    terms = F.concat(F.array(F.lit(1.0)), "x", F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b))))
    sums = (rows.select("y", F.posexplode(terms)).groupBy("y", "pos").agg(F.sum("col").alias("v"))).collect()
    table = np.zeros((2, 1 + p + p * p))
    for y, pos, v in sums:
        table[int(y), pos] = v
    return from_sums(table[:, 0], table[:, 1:1 + p], table[:, 1 + p:].reshape(2, p, p), pooled, diagonal)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int,
          held_fold: int) -> tuple[DataFrame, Discriminant]:
    """Statistics of all rows (stored) and the model fitted on the rows that may be learned from."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    described = stored(rows.mapInArrow(_describe, "id long, x array<double>"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")) \
        .filter(F.crc32(F.col("id").cast("string")) % folds != held_fold)
    return described, fit(described, known)


def keep_good(docs: DataFrame, model: Discriminant, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(shared.value.scores(statistics(*flat_texts(batch.column(place)))) >= least))
    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Labels are learned only from rows whose crc32(id as text) mod ``folds`` is not ``held_fold``; the only
    input of a score is the text (null: empty).  Rows with a null id are scored, not learned from, and
    count as not held out.  Other columns of both tables are ignored.
    """
    described, fitted = learn(docs, labels, id_col, text_col, label_col, folds, held_fold)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False))
    return described.mapInArrow(_score(model), "id long, score double").select(
        F.col("id").alias(id_col), held.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))

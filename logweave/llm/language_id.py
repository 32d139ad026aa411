"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (letters; all else is a blank) are hashed into
``BUCKETS`` features.  Document frequencies are counted over all training documents.  The weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of whole documents, of
which every fifth is kept apart to calibrate the temperature of the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .textops import slices

BITS = 14
BUCKETS = 1 << BITS
#: Largest number of documents (all languages together) the weights are fitted on.
MAX_TRAIN = 3000
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: a code for letters, 0 for everything else."""
    if not _TABLE:
        table = np.arange(0x110000, dtype=np.uint32)
        table[[k for k in range(0x110000) if not chr(k).isalpha()]] = 0
        _TABLE.append(table)
    return _TABLE[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the character n-grams of one text; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[points]
    keep = c != 0
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0)
    keep[1:] |= c[:-1] != 0
    c = np.concatenate([[0], c[keep], [0]]).astype(np.uint64)
    a = c * np.uint64(0x9E3779B97F4A7C15)
    b = (a[:-1] ^ (a[:-1] >> np.uint64(29))) * np.uint64(3) + a[1:]
    t = (b[:-1] ^ (b[:-1] >> np.uint64(31))) * np.uint64(5) + a[2:]
    shift = np.uint64(64 - BITS)
    mult = np.uint64(0xD6E8FEB86659FD93)
    buckets = np.concatenate([((x ^ (x >> np.uint64(32))) * mult) >> shift for x in (a[c != 0], b, t)])
    counts = np.bincount(buckets.view(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(counts)) * idf[at]
    return value / max(np.sqrt((value * value).sum()), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in slices(batches, "text"):
        for text in batch.column(0).to_pylist():
            at, _ = features(text)
            total[at] += 1
            n += 1
    total[BUCKETS] = n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray | None:
        at, counts = features(text)
        if not len(at) or not self.languages:
            return None
        return self.weights[:, at] @ tfidf(at, counts, self.idf)

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple], n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05,
         epochs: int = 3, seed: int = 5) -> np.ndarray:
    """Follow-the-regularised-leader on (indices, values, class) rows; weights (classes, BUCKETS)."""
    z, n = np.zeros((n_classes, BUCKETS)), np.zeros((n_classes, BUCKETS))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value, y = rows[k]
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            p = softmax(w @ value)
            p[y] -= 1
            g = p[:, None] * value
            g2 = g * g
            z[:, at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[:, at] = ni + g2
    return weights(z, n)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss, by bisection of the interval on a logarithmic scale."""
    if not len(y):
        return 1.0

    def loss(t):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())
    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(training: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Fit on (id, text, lang) rows.  The sample takes an equal share of each language, by hash of the id;
    only it (at most about ``max_train`` documents), the counts per language and the document frequencies
    (BUCKETS numbers) reach the driver."""
    usable = training.filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    total = usable.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1)
    for bucket, n in total.collect():
        df[bucket] = n
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    if len(languages) < 1:
        return LanguageModel([], idf, np.zeros((0, BUCKETS)), 1.0)
    each = max_train / len(languages)
    span = 1 << 31
    chosen = F.lit(False)
    ticket = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(span))
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & (ticket < int(span * min(1.0, each / sizes[lang]))))
    sample = usable.filter(chosen).select("id", "lang", "text").mapInArrow(_sampled, "id long, lang string, at binary, n binary")
    rows, apart = [], []
    for id_, lang, at, n in sample.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        at = np.frombuffer(at, np.int32)
        if len(at):
            row = (at, tfidf(at, np.frombuffer(n, np.float32), idf).astype(np.float32), languages.index(lang))
            (apart if len(rows) >= 4 * (len(apart) + 1) else rows).append(row)
    weights = ftrl(rows, len(languages))
    logits = np.array([weights[:, at] @ v for at, v, _ in apart]).reshape(len(apart), len(languages))
    return LanguageModel(languages, idf, weights, calibrate(logits, np.array([y for *_, y in apart], np.int64)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [features(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()),
             pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary())], names=["id", "lang", "at", "n"])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [model.value.predict(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in found], pa.string()),
                                              pa.array([p for _, p in found], pa.float64())],
                                             names=["id", "lang_pred", "score"])
    return run


def keep_recognised(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is recognised with probability
    ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = [shared.value.predict(t or "") for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([k != UNKNOWN and p >= least for k, p in found], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_fold: int) -> DataFrame:
    """(id, text, lang) of the rows that may be learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    return rows.filter("id is not null").filter(F.crc32(F.col("id").cast("string")) % folds != held_fold)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       folds: int = 4, held_fold: int = 2, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score (calibrated probability, 0 to 1).

    The model learns only from text and non-null ``lang`` of documents whose crc32(id as text) mod
    ``folds`` is not ``held_fold``.  A text that is null or has no letters (or any text, where nothing
    could be learned) is ``und`` with score 0.  Rows with a null id are predicted, not learned from.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False))
    model = spark.sparkContext.broadcast(fit(training_rows(docs, id_col, text_col, lang_col, folds, held_fold), max_train))
    return rows.mapInArrow(_predict(model), "id long, lang_pred string, score double").select(
        F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")

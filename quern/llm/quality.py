"""Quality classifier: a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns for hashed words. Only words of the training sample carry weight, so more columns than these would stay empty.
BUCKETS = 1 << 16
FACTORS = 4
#: Expected number of labelled rows that the fit sees at most; the choice hangs on a hash of the doc_id alone.
MAX_TRAIN = 3000
THRESHOLD = 0.7
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _MARKS = b"#*$%&|<>=~^_", b".,;:!?"
SHAPES = 12


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text's sparse vector: hashed word counts, damped to length 1 at most, then SHAPES
    columns of structure and size, each within 0 to 1."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    columns = np.fromiter((crc32(w) % BUCKETS for w in counts), np.int64, len(counts))
    values = np.fromiter(counts.values(), float, len(counts))
    values /= max(6.0, float(np.sqrt(values @ values)))

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    shapes = (
        1.0, share(_UPPER), min(1.0, 10 * share(_SYMBOLS)), share(_DIGITS), min(1.0, 4 * share(_MARKS)),
        min(1.0, 10 * share(b"!")), min(1.0, size / n / 20), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, np.log1p(n) / 20),
    )
    return np.r_[columns, BUCKETS + np.arange(SHAPES)], np.r_[values, shapes]


class FactorisationMachine:
    """Logistic factorisation machine. The pairwise interactions of a row are summed in time linear in its non-zero
    features: half of (the sum of v x) squared minus the sum of (v x) squared, for each factor."""

    def __init__(self, seed: int = 7) -> None:
        self.w = np.zeros(BUCKETS + SHAPES)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (BUCKETS + SHAPES, FACTORS))

    def raw(self, columns: np.ndarray, values: np.ndarray) -> float:
        vx = self.v[columns] * values[:, None]
        total = vx.sum(axis=0)
        return float(self.w[columns] @ values + 0.5 * (total @ total - (vx * vx).sum()))

    def probability(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 150, rate: float = 0.03, l2: float = 1e-5) -> None:
        """Full-batch Adam on the log loss, over the columns that rows have; others get no weight. Rows come in a fixed order,
        so fits agree."""
        starts = np.cumsum([0, *(len(c) for c, _ in rows[:-1])])
        sizes = np.array([len(c) for c, _ in rows])
        columns, x = (np.concatenate(k) for k in zip(*rows, strict=True))
        used, columns = np.unique(columns, return_inverse=True)
        params = np.c_[self.w, self.v][used]
        m, s = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, epochs + 1):
            vx = params[columns, 1:] * x[:, None]
            total = np.add.reduceat(vx, starts)
            raw = np.add.reduceat(params[columns, 0] * x, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y) / len(y)
            each = np.repeat(error, sizes) * x
            slopes = np.c_[each, each[:, None] * (np.repeat(total, sizes, axis=0) - vx)]
            grad = np.stack([np.bincount(columns, slopes[:, k], len(params)) for k in range(slopes.shape[1])], axis=1) + l2 * params
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.w, self.v = np.zeros_like(self.w), np.zeros_like(self.v)
        self.w[used], self.v[used] = params[:, 0], params[:, 1:]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine | float:
    """Fit on labelled rows that are not held out. Without rows of both labels: the share of label 1, or 1.0.

    A doc_id labelled more than once counts once, by its mean; of rows that repeat a labelled doc_id, that with the least
    text hash teaches. So the driver gets ``max_train`` sparse vectors at most, those whose hashed ids are least; their
    labels can be broadcast, and only their texts are shuffled, one for each task and id.
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    counts = known.agg(F.count("*"), F.sum("label")).first()
    n, ones = counts[0], counts[1] or 0.0
    if ones in (0.0, float(n)):
        return ones / n if n else 1.0
    chosen = known.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), "doc_id").limit(max_train)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column("text").cast(pa.binary())]
            lists = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *lists], ["doc_id", "label", "columns", "x"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    rows = sample.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label double, columns array<long>, x array<double>").toArrow()
    rows = rows.combine_chunks().sort_by("doc_id")
    y = rows["label"].to_numpy()
    if len(set(y)) < 2:
        return ones / n
    model = FactorisationMachine()
    model.fit([(c.values.to_numpy(), x.values.to_numpy()) for c, x in zip(rows["columns"], rows["x"], strict=True)], y)
    return model


def score(docs: DataFrame, model: FactorisationMachine | float) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, in place of any column of that name."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"))
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index("text")).cast(pa.binary())
            scores = np.fromiter((model.probability(t.as_py()) for t in texts), float, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def judge(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; ``predicted`` is 1 from THRESHOLD on.

    A null text is scored as an empty one, which has the structure columns only; a text of any length is read whole. A
    null doc_id is never held out nor trained on. Repeated rows get equal scores; a repeated doc_id that is labelled
    teaches with one of its texts. A doc_id of several labels counts by their mean, a tie as 1; without labels of both
    kinds, or an empty table of them, every score is the share of label 1 (1 if there is none). An empty table of
    documents gives an empty result. Of the columns only the text is an input of the score; others may have any names.
    """
    model = fit(docs, labels, max_train)
    scored = score(docs.select("doc_id", F.col("text").cast("string")), model)
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns; rows are judged as in ``judge``."""
    model = fit(docs, labels, max_train)
    if isinstance(model, float):
        return docs if model >= THRESHOLD else docs.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index("text")).cast(pa.binary())
            yield b.filter(pa.array([model.probability(t.as_py()) >= THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

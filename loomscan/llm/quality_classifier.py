"""Quality scores by a regularised quadratic discriminant.

Statistics of each whole text are transformed (logarithms of counts and of smoothed shares) and standardised. Each class has a
mean and a covariance that is shrunk towards a multiple of the identity; its Cholesky factor is made once, on the driver, from
moments that the cluster sums over every labelled row. A score compares the two log densities, which are Mahalanobis lengths
through the factors, and squashes their difference by a temperature.

Labels join to the narrow statistics, never to texts. Defined results: null texts count as empty and get a score like any
other; rows with a null id are held out; rows that repeat an id are scored each; labels that repeat an id count once, by their
largest value; null labels don't count; without rows of both classes each score is the training share of class 1 (0.5 with
none at all); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import lots, written

#: Of smoothing weights (0 to 4 times 120 characters, 20 words and 2 lines), shrinkages (0.02 to 0.4) and temperatures (1 to 8)
#: these have the least log loss in a five-fold cross-validation within the training rows of sf0.1, up to a hundredth of it, of
#: which the most shrunken was taken. Held-out rows took no part.
SHRINKAGE = 0.05
TEMPERATURE = 4.0
THRESHOLD = 0.3
FOLDS = 5
NAMES = ["words", "word_length", "upper", "digits", "symbols", "shouts", "marks", "quotes", "wide", "distinct", "top_word", "short_words", "ended_words", "line_words", "distinct_lines"]
#: Short texts are drawn to these usual shares, as if so many characters, words and lines of usual text stood beside them: the
#: medians over labelled training rows of sf0.1 that have 50 words or more.
USUAL = {"upper": 0.013, "digits": 0.0, "symbols": 0.0, "shouts": 0.0, "marks": 0.023, "quotes": 0.0, "wide": 0.0, "distinct": 0.788, "top_word": 0.052, "short_words": 0.295, "ended_words": 0.082, "distinct_lines": 1.0}
USUAL_CHARS, USUAL_WORDS, USUAL_LINES = 480, 80, 8
_UPPER, _DIGITS, _SYMBOLS, _SHOUTS, _MARKS, _QUOTES = (x.encode() for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>=~^_\\{}[]@", "!?", ".,;:", "\"'()-/+`"))
_CLASSES = {"upper": _UPPER, "digits": _DIGITS, "symbols": _SYMBOLS, "shouts": _SHOUTS, "marks": _MARKS, "quotes": _QUOTES, "wide": bytes(range(128, 256))}


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    found = text.split()
    n, size = len(found), len(text)
    counts = Counter(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=n)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    counted = {name: size - len(text.translate(None, drop)) for name, drop in _CLASSES.items()}
    shares = {name: (c, size, USUAL_CHARS) for name, c in counted.items()} | {
        "distinct": (len(counts), n, USUAL_WORDS),
        "top_word": (max(counts.values(), default=0), n, USUAL_WORDS),
        "short_words": (int((lengths <= 3).sum()), n, USUAL_WORDS),
        "ended_words": (sum(map(lambda w: w[-1] in b".!?", found)), n, USUAL_WORDS),
        "distinct_lines": (len(set(lines)), len(lines), USUAL_LINES),
    }
    log = {name: float(np.log((c + USUAL[name] * more) / (of + more) + 0.003)) for name, (c, of, more) in shares.items()}
    shapes = {"words": float(np.log1p(n)), "word_length": float(np.log1p((lengths.sum() + 5 * USUAL_WORDS) / (n + USUAL_WORDS))), "line_words": float(np.log1p(n / (len(lines) + 1)))}
    return [(shapes | log)[name] for name in NAMES]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            rows = [statistics(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {kind}, x array<double>")


class Discriminant:
    """Class means and Cholesky factors over standardised statistics; prior is the share of class 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE):
        n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        total = n[0] + n[1]
        self.temperature = temperature
        self.prior = n[1] / total if total else 0.5
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if not (n[0] and n[1]):
            return
        d = len(moments[0][1])
        mean = (moments[0][1] + moments[1][1]) / total
        spread = np.sqrt(np.maximum(np.diag(moments[0][2] + moments[1][2]) / total - mean**2, 1e-9))
        self.mean, self.spread = mean, spread
        for c in (0, 1):
            centre = moments[c][1] / n[c]
            cov = (moments[c][2] / n[c] - np.outer(centre, centre)) / np.outer(spread, spread)
            roots, axes = np.linalg.eigh(cov)
            cov = (axes * np.maximum(roots, 0)) @ axes.T  # sums round: none is below zero but for that
            scale = max(float(np.trace(cov)) / d, 1e-3)
            factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * scale * np.eye(d))
            self.classes.append(((centre - mean) / spread, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.spread
        density = [-0.5 * (((z - centre) @ back.T) ** 2).sum(axis=1) - 0.5 * log_det for centre, back, log_det in self.classes]
        odds = (density[1] - density[0] + np.log(self.prior / (1 - self.prior))) / self.temperature
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE) -> Discriminant:
    """The discriminant of every labelled row that isn't held out; the driver gets one row of sums a class."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id")
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("x")[i]) for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]
    moments = {}
    for row in rows.groupBy("label").agg(F.count("*").cast("double"), *sums).collect():
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[2 + d :], strict=True):
            square[i, j] = square[j, i] = v
        moments[int(row[0] == 1)] = (row[1], np.array(row[2 : 2 + d]), square)
    return Discriminant(moments, shrinkage, temperature)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    stats = written(document_statistics(docs, id_col, text_col))
    model = fit(stats, labels, id_col, label_col, shrinkage, temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").values.to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

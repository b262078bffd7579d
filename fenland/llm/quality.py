"""Text quality score: ridge regression on random Fourier features of document statistics.

Statistics of each text (lengths, character classes, repetition) are standardised and
mapped to cosines of random projections, which approximates a Gaussian kernel. Each task sums
its share of the normal equations; the sums of a few folds are added up in Spark and
solved for ridge weights, once for all folds and once without each fold. The
left-out scores, counted in fixed bins, give an isotonic map from score to probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenland.llm.common import cut, fold

SYMBOLS = "%*#&$!|?;:()[]{}<>@=_/\\^~+\"'"
NAMES = (
    "log_chars log_words word_length word_spread upper digit space other symbol stop_mark wide entropy "
    "distinct_words top_word repeated_next distinct_pairs distinct_lines line_length symbol_top two_symbols"
).split()
FEATURES = 256  # random features
WIDTH = 1.0  # kernel width in root mean square distances of standardised statistics
RIDGE = 1e-3  # per labelled row
FOLDS = 4
BINS = 4096
ROWS_PER_SUM = 20_000  # labelled rows behind one partial sum

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, all zero for a null or empty one; see NAMES."""
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = counts.sum()
    share = counts / n
    seen = share[share > 0]
    symbols = counts[_SYMBOL]
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    ordered = np.sort(symbols)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        share[_UPPER].sum(),
        share[_DIGIT].sum(),
        share[32],
        share[:32].sum(),
        share[_SYMBOL].sum(),
        share[44] + share[46],
        share[128:].sum(),
        float(-(seen * np.log2(seen)).sum()),
        len(tally) / m,
        max(tally.values(), default=0) / m,
        again / m,
        pairs / max(m - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        ordered[-1] / m,
        ordered[-2] / m,
    ]


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, statistics of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "statistics": [statistics(t) for t in pdf["text"]]})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, statistics array<double>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # last one: constant
    edges: np.ndarray  # raw scores at which the calibrated value steps
    values: np.ndarray

    def mapped(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def score(self, statistics: np.ndarray) -> np.ndarray:
        raw = self.mapped(statistics) @ self.weights
        return np.interp(raw, self.edges, self.values)


def _sums(rows: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Per fold the normal equations [X'X | X'y | rows], added up over all tasks."""
    size = len(model.phases) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = model.mapped(np.array(pdf["statistics"].tolist()))
            y, folds = pdf["label"].to_numpy(np.float64), pdf["fold"].to_numpy()
            for f in np.unique(folds):
                own = folds == f
                part = np.hstack([x[own].T @ x[own], (x[own].T @ y[own])[:, None]])
                total[f] = total.get(f, 0) + part
        for f, part in total.items():
            yield pd.DataFrame({"fold": int(f), "line": range(size), "part": list(part)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"][:1], "line": pdf["line"][:1], "part": [np.sum(np.array(pdf["part"].tolist()), axis=0)]})

    kind = "fold int, line int, part array<double>"
    parts = rows.mapInPandas(partial, kind).groupBy("fold", "line").applyInPandas(add, kind)
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():  # FOLDS * (FEATURES + 1) rows, whatever the input
        out.setdefault(r.fold, np.zeros((size, size + 1)))[r.line] = r.part
    return out


def _solved(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:, :-1], sums[:, -1]
    rows = a[-1, -1]  # the constant with itself
    penalty = np.full(len(b), RIDGE * max(rows, 1.0))
    penalty[-1] = 1e-9 * max(rows, 1.0)
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing values nearest to sums / weights."""
    blocks: list[list[float]] = []  # weight, sum, members
    for w, s in zip(weights, sums, strict=True):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / w) for w, s, n in blocks]) if blocks else np.zeros(0)


def fit(features: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Model from rows (doc_id, statistics) and labels (doc_id, label 0 or 1).

    All labelled rows count. Of contradicting labels of a document the lower one holds; null
    labels and labels of unknown documents are passed over. Without any label each score is 1/2.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    rows = features.join(labels, "doc_id").withColumn("fold", ((F.xxhash64("doc_id") % FOLDS + FOLDS) % FOLDS).cast("int"))
    d, rng = len(NAMES), np.random.default_rng(seed)
    value = lambda k: F.col("statistics")[k]
    rows = cut(rows)
    seen = rows.agg(F.count(F.lit(1)), *[F.avg(value(k)) for k in range(d)], *[F.stddev_pop(value(k)) for k in range(d)]).first()
    n = seen[0]
    mean = np.array([x or 0.0 for x in seen[1 : d + 1]])
    spread = np.array([x if x and x > 1e-9 else 1.0 for x in seen[d + 1 :]])
    directions = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
    model = Model(mean, spread, directions, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    if not n:
        return model
    rows = rows.repartition(max(1, -(-n // ROWS_PER_SUM)))
    sums = _sums(rows, model)
    total = sum(sums.values())
    model.weights = _solved(total)
    left_out = {f: _solved(total - s) if len(sums) > 1 else model.weights for f, s in sums.items()}
    low, high = -0.5, 1.5  # labels are 0 and 1; scores outside count in the outer bins

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((BINS, 2))
        for pdf in batches:
            weights = np.array([left_out[f] for f in pdf["fold"]])
            raw = (model.mapped(np.array(pdf["statistics"].tolist())) * weights).sum(axis=1)
            place = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
            np.add.at(counts, (place, 0), 1)
            np.add.at(counts, (place, 1), pdf["label"].to_numpy(np.float64))
        used = np.flatnonzero(counts[:, 0])
        yield pd.DataFrame({"bin": used, "n": counts[used, 0], "good": counts[used, 1]})

    bins = rows.mapInPandas(binned, "bin int, n double, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    table = bins.orderBy("bin").toPandas()  # BINS rows at most
    # a trace of both labels at the ends keeps the probabilities inside (0, 1)
    model.values = isotonic(table["n"].to_numpy(), table["good"].to_numpy()).clip(0.5 / (n + 1), 1 - 0.5 / (n + 1))
    model.edges = low + (table["bin"].to_numpy() + 0.5) * (high - low) / BINS
    return model


def scored(features: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = features.sparkSession.sparkContext.broadcast(model)  # its size is set by FEATURES and BINS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = shared.value.score(np.array(pdf["statistics"].tolist()).reshape(len(pdf), len(NAMES)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score})

    return features.mapInPandas(run, "doc_id long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    kept = labels.where(fold(F.col("doc_id"), 4) != 2)
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have all statistics zero and a score like any other; repeated
    rows are scored each; a null id is nobody's label. Only id and text of `docs` are read.
    """
    features = cut(with_statistics(docs))
    out = scored(features, fit(features, training_labels(labels)))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more."""
    features = cut(with_statistics(docs))
    model = fit(features, training_labels(labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES))))

    return docs.where(score(F.col("text").cast("string")) >= threshold)

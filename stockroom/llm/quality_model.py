"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text are computed by Spark's own functions. Standardised, they pass through random
cosines that approximate a Gaussian kernel. Each partition of the training rows sums its share of the
normal equations; the sums are small and of fixed size, so the driver adds and solves them. Scores of rows
that the ridge fit did not see are counted in bins, and pool-adjacent-violators over the bins gives
the calibration. Fitting uses at most about ``train_rows`` labelled rows; scoring reads every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored

FOLDS = 5


def statistics(text: Column) -> Column:
    """Statistics of a whole text as an array of doubles; null counts as the empty text."""
    body = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        doubled = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
        return F.array(F.log1p(F.size(words)), F.size(F.array_distinct(words)) / n, doubled / n)

    def of_lines(lines: Column) -> Column:
        return F.array(F.log1p(F.size(lines)), F.size(F.array_distinct(lines)) / F.size(lines))

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    n_chars = F.greatest(F.length(body), F.lit(1))
    share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / n_chars
    signs = [share(p) for p in (r"[#*$%&|<>]", r"\p{Lu}", r"[0-9]", r"[!?]", r"[.,;:]", r"[\x20\x09-\x0D]", r"[@/_=(){}\[\]\\]")]
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.concat(F.array(F.log1p(F.length(body)), *signs), once(words, of_words), once(F.split(body, "\n", -1), of_lines)).cast("array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is never learnt from. Null ids have no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Model:
    """A fitted classifier; it is small, and goes to the tasks with the function."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of the raw score keeps the order where the calibration is flat."""
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in order of ``x``: mean labels ``y`` with counts ``n``."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([yi, ni, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            yb, nb, _, last = blocks.pop()
            ya, na, first, _ = blocks.pop()
            blocks.append([(ya * na + yb * nb) / (na + nb), na + nb, first, last])
    knots = [k for _, _, first, last in blocks for k in ([first] if first == last else [first, last])]
    levels = [y for y, _, first, last in blocks for y in ([y] if first == last else [y, y])]
    return np.array(knots, float), np.array(levels, float)


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, waves: int = 256, gamma: float = 0.05, ridge: float = 1e-3, parts: int = 16, bins: int = 1000, seed: int = 11) -> Model | None:
    """A model of ``labels.quality`` (0 or 1) from rows outside fold 0; None without labelled rows.

    Rows with a null label or id are left out. Where more than ``train_rows`` are labelled, those with the
    smallest shares of a hash of the id are taken. Fold 1 calibrates; the others fit the ridge regression.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"), fold(F.col("doc_id")).alias("fold")).where("fold <> 0")
    total = known.count()
    share = min(1.0, train_rows / max(total, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    if chosen.count() <= 2 * train_rows:  # in rare cases one id may have far more labels than others
        chosen = F.broadcast(chosen)
    train = stored(docs.select("doc_id", "text").join(chosen, "doc_id").select(statistics(F.col("text")).alias("x"), "label", "fold"), "train")
    n = train.count()
    if not n:
        return None
    width = len(train.first().x)
    moments = train.select(*(f(F.get("x", F.lit(i))) for i in range(width) for f in (F.avg, F.stddev_pop))).first()
    rng = np.random.default_rng(seed)
    model = Model(
        mean=np.array(moments[0::2]),
        scale=np.maximum(np.array(moments[1::2]), 1e-9),
        turn=rng.normal(0, np.sqrt(2 * gamma), (width, waves)),
        phase=rng.uniform(0, 2 * np.pi, waves),
        beta=np.zeros(waves + 1),
        knots=np.array([0.0, 1.0]),
        levels=np.array([0.0, 1.0]),
    )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((waves + 1, waves + 1)), np.zeros(waves + 1)
        for batch in batches:
            if len(batch):
                z = model.features(np.vstack(batch["x"].to_numpy()))
                gram += z.T @ z
                right += z.T @ batch["label"].to_numpy()
        yield pd.DataFrame({"gram": [gram.tobytes()], "y": [right.tobytes()]})

    gram, right = np.zeros((waves + 1, waves + 1)), np.zeros(waves + 1)
    learnt = train.where("fold <> 1") if not train.where("fold <> 1").isEmpty() else train
    for row in learnt.repartition(parts).mapInPandas(sums, "gram binary, y binary").toLocalIterator():
        gram += np.frombuffer(row.gram).reshape(gram.shape)
        right += np.frombuffer(row.y)
    penalty = ridge * n * np.eye(waves + 1) / waves
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(gram + penalty, right)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(np.vstack(batch["x"].to_numpy())), -1, 2)
                yield pd.DataFrame({"bin": np.rint(raw * bins).astype(int), "label": batch["label"]})

    held = train.where("fold = 1") if not train.where("fold = 1").isEmpty() else train
    counted = held.mapInPandas(binned, "bin int, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    model.knots, model.levels = isotonic(counted["bin"].to_numpy() / bins, counted["y"].to_numpy(), counted["n"].to_numpy())
    return model


def scores(docs: DataFrame, model: Model | None, *, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    Without a model every score is 0.5. Null and empty texts are scored by their statistics like any other
    text. held_out is null for a row without doc_id. Repeated rows get equal scores. ``keep`` may not name a column of the result.
    """
    if set(keep) & {"held_out", "score", "predicted", "_x"}:
        raise ValueError("keep names a column of the result")
    held = fold(F.col("doc_id")) == 0
    if model is None:
        return docs.select(*keep, held.alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            score = model.score(x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else np.zeros(0)
            columns = [*batch.columns[:-1], pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])

    # a step of its own: the statistics are computed before it, and filters on the score stay after it
    rows = docs.select(*keep, held.alias("held_out"), statistics(F.col("text")).alias("_x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "score double, predicted int"])
    return rows.mapInArrow(apply, schema)

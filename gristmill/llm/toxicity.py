"""Toxicity scores from a linear model over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text's UTF-8 bytes (A-Z lower-cased), hashed to
2**FEATURE_BITS places, which makes the model's size fixed; n-grams that share a place share its
weight, none is left out. Spark counts in how many toxic and clean texts of the sample each place
stands; the log of the ratio of these shares, smoothed by SMOOTHING texts, scales the feature, and a
logistic model with an L2 penalty is fitted to the scaled features: Spark tasks compute the slopes
over the sample where it lies, the driver only moves the fixed number of coefficients. Scoring adds,
for each text, the weights of its distinct features; every text is read whole, in pieces.

Fitting takes at most ``per_class`` labelled texts of each class (by the hash of the id, so that
reruns agree); class weights restore the shares of the classes among all labels given. Defined
cases: null and empty texts have no features and get the model's base score; without labels every
score is 0.5, with those of one class only the smoothed share of label 1; labels with a null id or
label are left out, several labels of an id count by their mean; repeated rows get equal scores.
Extra columns are carried when asked for, else ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textblocks import LOWER, PIECE, text_blocks
from .workspace import Workspace, free_name

ORDERS = (4, 5, 6)
FEATURE_BITS = 18
PER_CLASS = 10_000
PENALTY, STEPS = 1e-5, 25
#: Tasks that the sample's slopes come from, a row of fixed size each, at every step.
FIT_TASKS = 6
#: Texts that are added to the counts of each place, divided by the shares of the classes: what stands in few texts gets a ratio near 1.
SMOOTHING = 100.0
REJECT_FROM = 0.7


@dataclass(frozen=True)
class NgramModel:
    weights: np.ndarray  # by place: coefficient times log-count ratio
    bias: float


def _places(part: np.ndarray) -> Iterator[np.ndarray]:
    """The places of all n-grams of some bytes, an array for each order."""
    gram = np.zeros(len(part), np.uint64)
    for k in range(min(max(ORDERS), len(part))):
        gram[: len(part) - k] |= part[k:].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in ORDERS:
            whole = gram[: len(part) - k] | np.uint64((k + 1) << 56)
            yield (whole * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def block_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct features of each text of a block, ascending."""
    data, seen = LOWER[data], np.zeros(1 << FEATURE_BITS, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for low in range(a, b, PIECE):
            for place in _places(data[low : min(b, low + PIECE + max(ORDERS) - 1)]):
                seen[place] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _features(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_blocks(column):
        yield from block_features(data, offsets)


def _counts(batches):
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)  # of one task
    for batch in batches:
        for label, found in zip(batch.column(1).to_pylist(), _features(batch.column(0)), strict=True):
            counts[label, found] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(c[some]) for c in counts]], ["feature", "clean", "toxic"])


#: Packed features that are unpacked together, and the step that only leads on to the next one.
UNPACKED, ON = 1 << 18, 0xFFFF


def packed(features: np.ndarray) -> bytes:
    """Ascending features as steps of two bytes; a longer step goes over ONs, which stand for no feature."""
    steps = np.diff(features, prepend=0)
    far = np.repeat(np.arange(len(steps)), steps // ON)
    return np.insert(steps % ON, far, ON).astype(np.uint16).tobytes()


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, features, number of each row's features), some rows of packed features at a time."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1] // 2
    data = np.frombuffer(column.buffers()[2] or b"", np.uint16)
    row = 0
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + UNPACKED, side="right")) - 1))
        steps, edges = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        total, real = np.r_[0, np.cumsum(steps, dtype=np.int64)], steps != ON
        places = (total[1:] - np.repeat(total[edges[:-1]], np.diff(edges)))[real]
        yield row, end, places, np.diff(np.r_[0, np.cumsum(real)][edges])
        row = end


def _lists(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([packed(x) for x in _features(batch.column(0))], pa.binary())], ["label", "features"])


def _slopes(scaled: np.ndarray, bias: float, share: tuple[float, float]):
    """Map rows (label, packed features) of a task to one row: their loss, and its slopes for the bias and the weights of all places."""

    def slopes(batches):
        loss, by_bias, by_place = 0.0, 0.0, np.zeros(1 << FEATURE_BITS)
        for batch in batches:
            labels = np.asarray(batch.column(0)).astype(float)
            for row, end, places, sizes in unpacked(batch.column(1)):
                label = labels[row:end]
                z = np.clip(np.bincount(np.repeat(np.arange(end - row), sizes), scaled[places], minlength=end - row) + bias, -40, 40)
                each = np.where(label == 1, share[1], share[0])
                err = each * (1 / (1 + np.exp(-z)) - label)
                loss += float((each * (np.logaddexp(0, z) - label * z)).sum())
                by_bias += float(err.sum())
                by_place += np.bincount(places, np.repeat(err, sizes), minlength=1 << FEATURE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([by_bias]), pa.array([by_place.astype(np.float32).tobytes()], pa.binary())], ["loss", "by_bias", "by_place"])

    return slopes


def minimised(slope, x: np.ndarray, steps: int, kept: int = 10) -> np.ndarray:
    """The point that limited-memory BFGS reaches from ``x``; ``slope`` gives value and gradient."""
    value, gradient = slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = gradient.copy(), []
        for s, y in reversed(moves):
            shares.append((s @ way) / (y @ s))
            way -= shares[-1] * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-12, np.linalg.norm(way))
        for (s, y), part in zip(moves, reversed(shares), strict=True):
            way += (part - (y @ way) / (y @ s)) * s
        size = 1.0
        while True:
            there = x - size * way
            new_value, new_gradient = slope(there)
            if new_value <= value - 1e-4 * size * (gradient @ way) or size < 1e-3:
                break
            size /= 2
        if new_value >= value:
            return x
        if (there - x) @ (new_gradient - gradient) > 0:
            moves = [*moves, (there - x, new_gradient - gradient)][-kept:]
        done = value - new_value < 1e-5 * max(1.0, value)
        x, value, gradient = there, new_value, new_gradient
        if done:
            return x
    return x


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", *, per_class: int = PER_CLASS, penalty: float = PENALTY, steps: int = STEPS) -> NgramModel:
    """Fit to the texts of ``docs`` that ``labels`` (id, label 0 or 1) marks."""
    work = Workspace(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("of").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    known = work.table(known, "known")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = math.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))
    each = [known.filter(F.col("label") == k).orderBy(F.xxhash64("of"), "of").limit(per_class) for k in (0, 1)]
    picked = F.broadcast(each[0].union(each[1]))  # 2 * per_class rows at most
    sample = work.table(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, F.col("id") == F.col("of")).select("text", "label").repartition(FIT_TASKS), "sample")
    used = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(used) < 2:
        work.keep()
        return NgramModel(np.zeros(1 << FEATURE_BITS), base)
    counts = sample.mapInArrow(_counts, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    mean = {k: n / sum(used.values()) for k, n in used.items()}
    ratio = F.log(F.col("toxic") / F.lit(mean[1]) + SMOOTHING) - F.log(F.col("clean") / F.lit(mean[0]) + SMOOTHING)
    known_ratios = counts.select("feature", ratio.alias("ratio")).toArrow()  # one row a place
    ratios = np.zeros(1 << FEATURE_BITS)
    ratios[known_ratios["feature"].to_numpy()] = known_ratios["ratio"].to_numpy()
    # Rows of the sample stand for the classes' shares among all labels.
    share = tuple(shares[k] / used[k] * sum(used.values()) / sum(shares.values()) for k in (0, 1))
    rows = work.table(sample.mapInArrow(_lists, "label int, features binary"), "lists", compression="zstd")
    total = sum(used.values())

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.coalesce(FIT_TASKS).mapInArrow(_slopes((x[:-1] * ratios).astype(np.float32), float(x[-1]), share), "loss double, by_bias double, by_place binary").toArrow().to_pylist()
        by_place = np.zeros(1 << FEATURE_BITS)
        for p in parts:
            by_place += np.frombuffer(p["by_place"], np.float32)
        by_place = by_place * ratios / total + penalty * x[:-1]
        return sum(p["loss"] for p in parts) / total + penalty / 2 * float(x[:-1] @ x[:-1]), np.append(by_place, sum(p["by_bias"] for p in parts) / total)

    found = minimised(slope, np.append(np.zeros(1 << FEATURE_BITS), base), steps)
    work.keep()
    return NgramModel(found[:-1] * ratios, float(found[-1]))


def scored(docs: DataFrame, model: NgramModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score of each text."""

    def score(batches):
        for batch in batches:
            total = np.array([model.weights[found].sum() for found in _features(batch.column(batch.schema.get_field_index(text_col)))], float) + model.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], [*batch.schema.names, score_col])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def drop_toxic(docs: DataFrame, model: NgramModel, text_col: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs`` that score below ``reject_from``, with their columns."""
    name = free_name(docs.columns, "score")
    return scored(docs, model, text_col, name).filter(F.col(name) < reject_from).select(*docs.columns)

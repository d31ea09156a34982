"""Quality scores from a sparse ensemble of rules over document statistics.

One pass computes the statistics of every whole text. Spark ML grows shallow random trees on the
labelled rows; every path from a root to a node becomes a conjunctive rule (bounds of statistics).
A logistic model with an L1 penalty is fitted to the rules' 0/1 values, which leaves a few rules
with weights, and these are compiled into one Spark column expression, which scores the table of
statistics without Python. Fitting uses all labelled rows given; only statistics move, not texts.

Defined cases: null and empty texts have zero statistics and a score like any other; labels with a
null id or label are left out, several labels of an id count by their mean; without labels, or with
one class only, the score is the share of label 1 with one row of each class added (0.5 without
any). Rows that repeat an id join their label each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import LOWER, SPACE, text_blocks, word_hashes, word_pieces
from .workspace import Workspace

STATISTICS = ("words", "word_length", "upper_share", "digit_share", "mark_share", "odd_mark_share", "distinct_words", "distinct_lines", "same_as_last", "pipe_words", "end_marks", "short_words", "high_bytes", "line_words")

_UPPER, _DIGIT, _MARK, _ODD, _HIGH = (np.zeros(256, bool) for _ in range(5))
_HIGH[128:] = True
_CLOSING = np.frombuffer(b".!?", np.uint8)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD[[ord(c) for c in "#$%&*+<=>@[]^_{|}~\\"]] = True


def _counted(flags: np.ndarray, rows: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each row of a block, the number of flags (of the bytes from low to high) in it."""
    total = np.r_[0, np.cumsum(flags)]
    edges = np.clip(rows - low, 0, high - low)
    return total[edges[1:]] - total[edges[:-1]]


def block_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by STATISTICS for the texts of a block; bytes and words are counted piece by piece."""
    n = len(offsets) - 1
    counts = {k: np.zeros(n) for k in ("words", "bytes", "upper", "digit", "mark", "odd", "high", "last", "alone", "marked", "short")}
    hashes, breaks, previous = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], (-1, np.uint64(0))
    for low, high, starts, ends in word_pieces(data, offsets):
        part = data[low:high]
        for name, marked in (("bytes", ~SPACE), ("upper", _UPPER), ("digit", _DIGIT), ("mark", _MARK), ("odd", _ODD), ("high", _HIGH)):
            counts[name] += _counted(marked[part], offsets, low, high)
        breaks.append(np.flatnonzero(part == 10) + low)
        hashed = word_hashes(LOWER[part], starts, ends)
        owner = np.searchsorted(offsets, starts + low, side="right") - 1
        before = np.r_[previous[1], hashed[:-1]]
        same = (hashed == before[: len(hashed)]) & (owner == np.r_[previous[0], owner[:-1]][: len(owner)])
        length, closing = ends - starts, part[ends - 1]
        by_word = lambda flags: np.bincount(owner[flags], minlength=n)
        counts["words"] += np.bincount(owner, minlength=n)
        counts["last"] += by_word(same)
        counts["alone"] += by_word((length == 1) & (closing == ord("|")))
        counts["marked"] += by_word(np.isin(closing, _CLOSING))
        counts["short"] += by_word(length <= 2)
        if len(owner):
            previous = int(owner[-1]), hashed[-1]
        hashes.append(hashed)
    words = counts["words"].astype(np.int64)
    different_words = np.bincount(_distinct(np.repeat(np.arange(n), words), np.concatenate(hashes)), minlength=n)
    # Lines are what stands between line feeds and the ends of rows; empty ones don't count.
    edges = np.unique(np.r_[offsets, np.concatenate(breaks), np.concatenate(breaks) + 1])
    full = (np.diff(edges) > 0) & (data[edges[:-1]] != 10) if len(data) else np.zeros(0, bool)
    line_start, line_end = edges[:-1][full], edges[1:][full]
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    every_line = np.bincount(line_owner, minlength=n)
    different_lines = np.bincount(_distinct(line_owner, word_hashes(data, line_start, line_end)), minlength=n)
    w, b, s, x = (np.maximum(v, 1) for v in (counts["words"], counts["bytes"], np.diff(offsets), every_line))
    return np.stack(
        [
            counts["words"], counts["bytes"] / w, *(counts[k] / b for k in ("upper", "digit", "mark", "odd")), different_words / w, different_lines / x,
            *(counts[k] / w for k in ("last", "alone", "marked", "short")), counts["high"] / s, counts["words"] / x,
        ],
        axis=1,
    ).astype(float)


def _distinct(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The owners of distinct (owner, value), one entry each."""
    if not len(values):
        return np.zeros(0, np.int64)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    return o[np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])]]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column a statistic) for each row, ids as in ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            parts = [block_statistics(data, offsets) for _, _, data, offsets in text_blocks(batch.column(1))]
            table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in table.T]], ["id", *STATISTICS])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(measure, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    bounds: tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound)
    weight: float = 0.0

    def column(self) -> Column:
        tests = [F.col(s) <= b if op == "<=" else F.col(s) > b for s, op, b in self.bounds]
        both = tests[0]
        for t in tests[1:]:
            both &= t
        return both


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as a column over STATISTICS."""
        total = F.lit(self.bias)
        for r in self.rules:
            total += F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(tree) -> list[tuple[tuple[str, str, float], ...]]:
    """The conditions on the way to each node below the root, bounds of one statistic and side merged."""
    found, stack = [], [(tree._call_java("rootNode"), {})]
    while stack:
        node, bounds = stack.pop()
        if bounds:
            found.append(tuple((s, op, b) for (s, op), b in sorted(bounds.items())))
        if node.numDescendants() > 0:
            name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
            low = {**bounds, (name, "<="): min(at, bounds.get((name, "<="), math.inf))}
            high = {**bounds, (name, ">"): max(at, bounds.get((name, ">"), -math.inf))}
            stack += [(node.leftChild(), low), (node.rightChild(), high)]
    return found


def fit(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", *, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit to the rows of a table of ``statistics`` that ``labels`` (id, label 0 or 1) marks."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    work = Workspace(stats.sparkSession)
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("of").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    marked = work.table(stats.join(known, F.col("id") == F.col("of")).select("label", *STATISTICS), "marked")
    n, ones = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = math.log((ones + 1) / (n - ones + 1))
    if ones in (0, n):
        return RuleEnsemble((), base)
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(marked)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, maxBins=64).fit(rows.select("label", "features"))
    paths = sorted({path for tree in forest.trees for path in tree_rules(tree)})
    if not paths:
        return RuleEnsemble((), base)
    rules = [Rule(p) for p in paths]
    values = marked.select("label", F.array(*[r.column().cast("double") for r in rules]).alias("hits"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(values.select("label", array_to_vector("hits").alias("features")))
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def quality(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, RuleEnsemble]:
    """(id, statistics, score) for each row of ``docs``, and the ensemble that scores it."""
    stats = Workspace(docs.sparkSession).table(statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, label_col, id_col, **options)
    return stats.withColumn("score", model.score()).withColumnRenamed("id", id_col), model

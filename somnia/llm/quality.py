"""Quality by a sparse rule ensemble: tree paths over text statistics, weighted by a lasso, compiled into columns."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, remainder, texts, written
from .toxicity import bigrams, sample

STATISTICS = ("words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "commas", "stops", "lines", "repeated_words",
              "doubled", "repeated_pairs", "repeated_lines", "short_words", "top_word", "wide", "bare_words")
CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "symbols": b"#$%&*@^~<>=\\/{}[]_+`", "pipes": b"|", "marks": b"!?", "commas": b",;:", "stops": b"."}


def _luts() -> np.ndarray:
    table = np.zeros((len(CLASSES), 256))
    for k, members in enumerate(CLASSES.values()):
        table[k, list(members)] = 1
    return table


LUTS = _luts()


def _measure(raw: np.ndarray, h: np.ndarray) -> list[float]:
    """Statistics of one text from its bytes and the hashes of its words; all are shares, so long texts count as short ones."""
    n, size = len(h), max(len(raw), 1)
    bytes_ = np.bincount(raw, minlength=256)
    shares = (LUTS @ bytes_) / size
    spaces = bytes_[9:14].sum() + bytes_[32]
    if not n:
        return [0.0, 0.0, *shares, *[0.0] * 9]
    _, counts = np.unique(h, return_counts=True)
    pairs = bigrams(h)
    distinct_pairs = len(np.unique(pairs)) if n > 1 else 0
    breaks = np.flatnonzero(raw == 10)
    edges = np.concatenate([[-1], breaks, [len(raw)]])
    if len(edges) > 2:
        keys = [raw[a + 1:b].tobytes() for a, b in zip(edges, edges[1:]) if b > a + 1]
        repeated_lines = 1 - len(set(keys)) / max(len(keys), 1)
    else:
        repeated_lines = 0.0
    letters = bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[128:].sum()
    return [float(np.log1p(n)), (size - spaces) / n, *shares, len(breaks) / n, 1 - len(counts) / n,
            float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, 1 - distinct_pairs / (n - 1) if n > 1 else 0.0, repeated_lines,
            (n - 1) / size, counts.max() / n, bytes_[128:].sum() / size, letters / size]


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and one double per entry of STATISTICS for every document; NULL and empty texts have zeros."""

    def run(batches):
        for batch in batches:
            column = texts(batch, "__text")
            out = np.zeros((len(batch), len(STATISTICS)))
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            for first, n, h, rows in hashed_words(column):
                edges = np.searchsorted(rows, np.arange(n + 1))
                for k in range(n):
                    raw = data[offsets[first + k]:offsets[first + k + 1]]
                    if len(raw):
                        out[first + k] = _measure(raw, h[edges[k]:edges[k + 1]])
            yield pa.record_batch([*(batch.column(c) for c in carry), *(pa.array(out[:, k]) for k in range(len(STATISTICS)))],
                                  [*carry, *("__" + s for s in STATISTICS)])

    schema = docs.select(*carry).schema
    for s in STATISTICS:
        schema = schema.add("__" + s, "double")
    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)


def holds(rule: tuple) -> Column:
    """A conjunction as a column."""
    return functools.reduce(Column.__and__, [F.col("__" + name) > edge if above else F.col("__" + name) <= edge for name, above, edge in rule])


@dataclass(frozen=True)
class Rules:
    """Conjunctions ((statistic, is_greater, threshold), ...) with their weights."""

    rules: tuple
    weights: tuple
    constant: float

    def column(self) -> Column:
        """The score as one expression of Spark columns."""
        total = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(debug: str) -> set[tuple]:
    """Conjunctions on the paths of every tree in a printed ensemble, inner nodes included."""
    found, path = set(), []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if re.match(r" *Tree ", line):
            path = []
        elif m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[3])], m[4] == ">", float(m[5])))]
            found.add(tuple(p[1] for p in path))
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = 4_000, trees: int = 24, depth: int = 3,
        penalty: float = 4e-4) -> Rules:
    """Rules on at most about ``rows_per_class`` labelled documents of each class (the documented bound).

    Spark grows a boosted ensemble and a forest of shallow trees; each path is a rule; a lasso logistic regression
    keeps few of them. Without both classes there is no rule and the score is the share of the label.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler, VectorSlicer
    from pyspark.ml.functions import array_to_vector
    rows = written(statistics(sample(docs, labels, label, rows_per_class), ["y"]))  # bounded by rows_per_class
    shares = {r.y: r["count"] for r in labels.filter(F.col(label).isin(0, 1) & (remainder("doc_id", 4) != 2)).groupBy(F.col(label).alias("y")).count().collect()}
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        p = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
        return Rules((), (), float(np.log(p / (1 - p))))
    names, mean = ["__" + s for s in STATISTICS], sum(shares.values()) / sum(counts.values())
    rows = rows.withColumn("weight", F.when(F.col("y") == 1, shares[1] / counts[1] / mean).otherwise(shares[0] / counts[0] / mean))
    hashed = F.xxhash64("y", *names)
    rows = rows.repartition(4, hashed).sortWithinPartitions(hashed, "y", *names)  # the same order on every run
    frame = written(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight", "maxDepth": depth, "seed": 7, "maxBins": 64}
    forest = RandomForestClassifier(numTrees=trees, subsamplingRate=0.7, **common).fit(frame)
    boosted = GBTClassifier(maxIter=8, stepSize=0.3, **common).fit(frame)
    rules = sorted(tree_paths(forest.toDebugString) | tree_paths(boosted.toDebugString))
    hits = F.array(*[F.when(holds(rule), 1.0).otherwise(0.0) for rule in rules])
    frame = written(frame.select("y", "weight", F.xxhash64(F.monotonically_increasing_id()).alias("row"), hits.alias("hits")))
    # Rules that hold on the same rows count once: such have the same sum of row hashes.
    marks = frame.select(F.shiftrightunsigned("row", 20).alias("row"), F.posexplode("hits").alias("rule", "hit")).filter("hit > 0")
    marks = marks.groupBy("rule").agg(F.count("*").alias("n"), F.sum("row").alias("mark")).filter(F.col("n") < sum(counts.values()))
    keep = sorted(r.rule for r in marks.groupBy("n", "mark").agg(F.min("rule").alias("rule")).collect())
    if not keep:
        p = (shares[1] + 0.5) / (sum(shares.values()) + 1)
        return Rules((), (), float(np.log(p / (1 - p))))
    table = VectorSlicer(inputCol="every", outputCol="features", indices=keep).transform(frame.select("y", "weight", array_to_vector("hits").alias("every")))
    lasso = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(table)
    weights = lasso.coefficients.toArray()
    used = [j for j in range(len(keep)) if abs(weights[j]) > 1e-6]
    return Rules(tuple(rules[keep[j]] for j in used), tuple(float(weights[j]) for j in used), float(lasso.intercept))


def score(docs: DataFrame, rules: Rules, carry: list[str] | None = None, name: str = "score") -> DataFrame:
    """``carry`` (all columns unless given) with the score of every document.

    NULL and empty texts have zero statistics and the score of those; ids and other columns have no part in it, may be
    NULL and may be called like a statistic. Repeated rows give repeated rows with one score, an empty table none.
    """
    carry = [c for c in docs.columns if c != name] if carry is None else carry
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), "text")
    return statistics(whole, ["__row"]).select("__row.*", rules.column().alias(name))

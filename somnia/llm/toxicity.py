"""Toxicity by class-conditional Kneser-Ney models with shared backoff."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, remainder, texts, written

FEATURES = 5
STEMS = (5, 4)


@dataclass
class ClassModels:
    """Log-likelihood ratios of the toxic to the ordinary model as sorted tables, and the calibration of the score.

    A table holds what exceeds its level's discount in a class; anything else takes the next level's ratio and the
    level's ``rest``, the log ratio of the mass that the classes leave to the next level.
    """

    words: tuple[np.ndarray, np.ndarray]         # sorted hashes, log ratio
    stems: list[tuple[np.ndarray, np.ndarray]]   # the same by length of STEMS
    rest: list[float]                            # of the words, then of each length of stems
    heads: tuple[np.ndarray, np.ndarray]         # histories of kept bigrams, log ratio of the mass left to the word
    pairs: tuple[np.ndarray, np.ndarray]         # kept bigrams, log ratio given the history
    weights: np.ndarray = None
    span: int = 12

    def ratios(self, h: np.ndarray, rows: np.ndarray, *stems: np.ndarray) -> np.ndarray:
        """log p_toxic - log p_ordinary of each word given the one before it in the same row."""
        if not len(h):
            return np.zeros(0)
        result = np.zeros(len(h))
        levels = [(self.words, h), *zip(self.stems, stems, strict=True)]
        for ((table, value), keys), rest in zip(reversed(levels), reversed(self.rest), strict=True):
            at, found = _find(table, keys)
            result = np.where(found, value[at] if len(value) else 0, result + rest)
        after = np.flatnonzero(rows[1:] == rows[:-1]) + 1
        at, found = _find(self.heads[0], h[after - 1])
        after, at = after[found], at[found]
        result[after] += self.heads[1][at]
        where, found = _find(self.pairs[0], bigrams(h[after - 1], h[after]))
        result[after[found]] = self.pairs[1][where[found]]
        return result

    def features(self, n: int, h: np.ndarray, rows: np.ndarray, *stems: np.ndarray) -> np.ndarray:
        """Per row: the length-normalised difference, of the whole text and of its most toxic window, and by how much single words stand out."""
        out = np.zeros((n, FEATURES))
        if not len(h):
            return out
        r = np.clip(self.ratios(h, rows, *stems), -6, 6)
        words = np.bincount(rows, minlength=n)
        count = np.maximum(words, 1)
        out[:, 0] = np.bincount(rows, r, n) / count
        first = np.searchsorted(rows, rows)  # start of the word's own row
        total = np.concatenate([[0], np.cumsum(r)])
        ends = np.arange(1, len(r) + 1)
        window = (total[ends] - total[np.maximum(ends - self.span, first)]) / self.span
        for column, values in ((1, window), (2, r)):
            high = np.full(n, -9.0)
            np.maximum.at(high, rows, values)
            out[:, column] = np.where(words > 0, high, 0)
        strong = np.bincount(rows, np.maximum(r - 2, 0), n)
        out[:, 3], out[:, 4] = np.log1p(strong), np.log1p(100 * strong / count)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def bigrams(h: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Hash of each word with the one after it, or with ``after``."""
    with np.errstate(over="ignore"):
        return mix((h[:-1] if after is None else h) * np.uint64(0xD6E8FEB86659FD93) + (h[1:] if after is None else after))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _kneser_ney(table: DataFrame, words: DataFrame, part: str, discount: float, rare: float) -> ClassModels:
    """Models of one part of the sample ('0' and '1': its halves, 'w': the whole).

    ``table``: bigrams (a, b, s0, s1) with their counts toxic<part>, ordinary<part>; ``words``: (b, s0, s1) with
    continuation counts (distinct histories) of the same names, and every<part> pooled over both classes.

    The chain is bigram, word, longer stem, shorter stem, shared. Each level keeps what exceeds its discount and leaves
    the rest to the next, and the last is pooled over both classes. So an expression that is rare in a class is judged
    by its stem, and one with a rare stem comes out alike in both. Spark counts; what comes to the driver is only what
    exceeds a discount.
    """
    classes = ("toxic", "ordinary")
    table = table.select("a", "b", *[F.col(c + part).alias(c) for c in classes])
    kept = table.filter((F.col("toxic") > discount) | (F.col("ordinary") > discount))
    strong = kept.toPandas()
    heads = table.join(kept.select("a").distinct(), "a", "left_semi").groupBy("a").agg(*[F.sum(c).alias(c) for c in classes]).toPandas()
    types = [F.sum(c + part).alias(c) for c in ("every", *classes)]
    below, rest, tables = None, [], []
    for key, chain in (("s1", ["s1"]), ("s0", ["s0", "s1"]), ("b", ["b", "s0", "s1"])):
        counts = words.groupBy(*chain).agg(*types).filter("every > 0")
        sums = counts.agg(F.sum("every").alias("every"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in classes],
                          *[F.sum(F.greatest(F.col(c) - rare, F.lit(0.0))).alias("kept_" + c) for c in classes]).first()
        wanted = (F.col("toxic") > rare) | (F.col("ordinary") > rare)
        own = counts.filter(wanted)
        if key == "b":  # the words of kept bigrams too
            own = own.unionByName(counts.filter(~wanted).join(kept.select("b").distinct(), "b", "left_semi"))
        own = own.toPandas()
        shared = (own.every.to_numpy() + 0.5) / ((sums.every or 0) + 0.5 * (sums.n + 1))
        keys = own[key].to_numpy(np.int64).view(np.uint64)
        p, left = [], []
        for k, c in enumerate(classes):
            total = max(sums[c] or 0, 1)
            left.append(1 - (sums["kept_" + c] or 0) / total)
            lower = np.ones(len(own)) if below is None else below(own, k)
            p.append(np.maximum(own[c].to_numpy(float) - rare, 0) / total + left[k] * shared * lower)
        order = np.argsort(keys)
        tables.insert(0, (keys[order], np.log(p[0] / p[1])[order]))
        rest.insert(0, float(np.log(left[0] / left[1])))
        ratio = [(keys[order], (p[k] / shared)[order]) for k in (0, 1)]

        def below(rows, k, ratio=ratio, left=left, key=key, lower=below):
            at, found = _find(ratio[k][0], rows[key].to_numpy(np.int64).view(np.uint64))
            return np.where(found, ratio[k][1][at] if len(ratio[k][1]) else 1, left[k] * (1 if lower is None else lower(rows, k)))

    # p of the last round is by word; bigrams and their histories follow.
    v = strong[["a", "b"]].to_numpy(np.int64).view(np.uint64) if len(strong) else np.zeros((0, 2), np.uint64)
    names = heads.a.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    head, word = np.searchsorted(names, v[:, 0]), np.searchsorted(np.sort(keys), v[:, 1])
    by_word = np.argsort(keys)
    left, conditional = [], []
    for k, c in enumerate(classes):
        total = heads[c].to_numpy(float)[order]
        over = np.maximum(strong[c].to_numpy(float) - discount, 0)
        mass = np.bincount(head, over, len(names)) if len(names) else np.zeros(0)
        left.append(np.where(total > 0, np.maximum(1 - mass / np.maximum(total, 1), 1e-3), 1.0))
        conditional.append(over / np.maximum(total[head], 1) + left[k][head] * p[k][by_word][word])
    pair = bigrams(v[:, 0], v[:, 1])
    at = np.argsort(pair)
    return ClassModels(tables[0], tables[1:], rest, (names, np.log(left[0] / left[1])), (pair[at], np.log(conditional[0] / conditional[1])[at]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression on standardised columns, by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], 1)
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (z.shape[1] - 1)) * len(x) ** 0.5
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * centre / scale).sum()], w[1:] / scale])


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most about ``rows`` training documents of each class as (doc_id, text, y), drawn by a hash of the id; of equal texts one."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & (remainder("label_id", 4) != 2)).groupBy("label_id").agg(F.min("y").alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        keep |= (F.col("y") == y) & (F.pmod(F.xxhash64(F.lit("draw"), "label_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, rows / n)))
    drawn = F.broadcast(known.filter(keep))  # bounded by rows
    return docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y").dropDuplicates(["text", "y"])


def _counts(rows: DataFrame) -> DataFrame:
    """Bigrams (a, b, s0, s1) of the sample: history, word and its stems as hashes, with counts by class and half."""
    names = ["a", "b", *(f"s{k}" for k in range(len(STEMS)))]

    def pairs(batches):
        for batch in batches:
            y, half = (np.array(batch.column(c).to_pylist(), np.int32) for c in ("y", "half"))
            for first, _, h, rows, *stems in hashed_words(texts(batch), stems=STEMS):
                same = rows[1:] == rows[:-1]
                columns, row = [h[:-1][same], h[1:][same], *(s[1:][same] for s in stems)], first + rows[1:][same]
                yield pa.record_batch([*(pa.array(c.view(np.int64)) for c in columns), pa.array(y[row] * 2 + half[row])], [*names, "kind"])

    schema = ", ".join(f"{x} long" for x in names) + ", kind int"
    n = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("int")).cast("int")
    return rows.select("text", "y", "half").mapInArrow(pairs, schema).groupBy(*names).agg(
        n(2).alias("toxic0"), n(3).alias("toxic1"), n(0).alias("ordinary0"), n(1).alias("ordinary1")).withColumns(
        {"toxicw": F.col("toxic0") + F.col("toxic1"), "ordinaryw": F.col("ordinary0") + F.col("ordinary1")})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = 5_000, discount: float = 4.0, rare: float = 6.0) -> ClassModels:
    """Fit the two models on at most about ``rows_per_class`` labelled documents of each class (the documented bound).

    Models of one half of the sample give the features on which the other half fits the calibration; the final models
    use the whole sample. Without both classes every score is the share of the label (0.5 without labels).
    """
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    rows = written(sample(docs, labels, label, rows_per_class).withColumn("half", half))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    table = written(_counts(rows))
    some = lambda *c: F.sum((sum(map(F.col, c)) > 0).cast("int")).cast("int")
    words = written(table.groupBy("b", "s0", "s1").agg(*[some(c + p).alias(c + p) for p in "01w" for c in ("toxic", "ordinary")],
                                                       *[some("toxic" + p, "ordinary" + p).alias("every" + p) for p in "01w"]))
    full = _kneser_ney(table, words, "w", discount, rare)
    share = {r.y: r["count"] for r in labels.filter(F.col(label).isin(0, 1) & (remainder("doc_id", 4) != 2)).groupBy(F.col(label).alias("y")).count().collect()}
    if not counts.get(0) or not counts.get(1):
        p = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
        full.weights = np.array([np.log(p / (1 - p))] + [0.0] * FEATURES)
        return full
    xs, ys = [], []
    for part in (0, 1):
        model = _kneser_ney(table, words, str(part), discount, rare)
        found = _features(rows.filter(F.col("half") == 1 - part), model, "y").toArrow()
        xs.append(np.stack([found[f"f{k}"].to_numpy() for k in range(FEATURES)], 1))
        ys.append(found["y"].to_numpy())
    x, y = np.concatenate(xs), np.concatenate(ys)
    order = np.lexsort(x.T)  # the same on every run
    full.weights = logistic(x[order], y[order].astype(float))
    # The sample has other shares of the classes than the labels: move the constant back.
    full.weights[0] += np.log(share[1] / share[0]) - np.log(counts[1] / counts[0])
    return full


def _features(docs: DataFrame, model: ClassModels, carry: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            f = np.zeros((len(batch), FEATURES))
            for first, n, *words in hashed_words(texts(batch), stems=STEMS):
                f[first:first + n] = sent.value.features(n, *words)
            yield pa.record_batch([batch.column(carry), *(pa.array(f[:, k]) for k in range(FEATURES))], [carry, *(f"f{k}" for k in range(FEATURES))])

    schema = docs.select(carry).schema
    for k in range(FEATURES):
        schema = schema.add(f"f{k}", "double")
    return docs.select(carry, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: ClassModels) -> DataFrame:
    """(doc_id, score) for every document; a text without words has the score of no evidence, rows repeat as given."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = np.zeros(len(batch))
            for first, n, *words in hashed_words(texts(batch), stems=STEMS):
                out[first:first + n] = sent.value.score(sent.value.features(n, *words))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))

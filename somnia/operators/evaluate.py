"""Votes, confusion tables and scores.

Everything after ``confusion`` works on counts: at most studies x classes
squared rows, however many epochs were compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from somnia.functions.scalar import argmax, most_frequent, ratio


def hard_vote(df: DataFrame, keys: list[str], label: str = "pred", classes: list[int] | None = None) -> DataFrame:
    """Most frequent label per epoch, the smallest on ties; faster if ``classes`` are known."""
    return df.groupBy(*keys).agg(most_frequent(label, classes).alias(label))


def soft_vote(df: DataFrame, keys: list[str], n_classes: int, how: str = "mean") -> DataFrame:
    """Mean or sum of score vectors per epoch, and the class of the first maximum.

    One aggregate per class keeps vectors from being exploded and collected.
    """
    fn = F.avg if how == "mean" else F.sum
    out = df.groupBy(*keys).agg(F.array(*[fn(F.col("scores")[c]) for c in range(n_classes)]).alias("scores"))
    return out.withColumn("pred", argmax("scores"))


def confusion(df: DataFrame, by: list[str] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by, true, pred).agg(F.count(F.lit(1)).alias("n"))


def label_set(df: DataFrame, ignore: list[int] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    """Classes in either column, less the ignored ones."""
    seen = df.select(F.explode(F.array(true, pred)).alias("label")).distinct()
    return seen.where(~F.col("label").isin(list(ignore))) if ignore else seen


def confusion_matrix(df: DataFrame, labels: list[int], true: str = "true", pred: str = "pred") -> DataFrame:
    """Counts with one column per predicted label; both axes limited to ``labels``."""
    kept = df.where(F.col(true).isin(labels) & F.col(pred).isin(labels))
    out = kept.groupBy(true).pivot(pred, labels).agg(F.count(F.lit(1))).na.fill(0)
    return out.select(true, *[F.col(str(c)).alias(f"pred_{c}") for c in labels])


def normalised_confusion(df: DataFrame, labels: list[int]) -> DataFrame:
    out = confusion_matrix(df, labels)
    total = sum((F.col(f"pred_{c}") for c in labels[1:]), F.col(f"pred_{labels[0]}"))
    return out.select("true", *[ratio(F.col(f"pred_{c}").cast("double"), total.cast("double")).alias(f"pred_{c}")
                                for c in labels])


def class_counts(counts: DataFrame, classes: list[int], by: list[str] = ()) -> DataFrame:
    """``tp fp fn tn`` per class, a row for absent classes too, from ``confusion`` counts."""
    t, p, c, n = F.col("true"), F.col("pred"), F.col("class"), F.col("n")
    # The counts repeat once per class: classes^3 rows per study at most.
    rows = counts.withColumn("class", F.explode(F.array(*[F.lit(k) for k in classes])))
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    return rows.groupBy(*by, "class").agg(
        pick((t == c) & (p == c)).alias("tp"), pick((t != c) & (p == c)).alias("fp"),
        pick((t == c) & (p != c)).alias("fn"), pick((t != c) & (p != c)).alias("tn"))


def _d(expr):
    return expr.cast("double")


def class_scores(cc: DataFrame, undefined: float | None = 0.0) -> DataFrame:
    """Precision, recall and F1 per class; ``undefined`` replaces 0 / 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(_d(tp), _d(tp + fp)), ratio(_d(tp), _d(tp + fn))
    f1 = ratio(2 * precision * recall, precision + recall)
    fill = (lambda x: F.coalesce(x, F.lit(undefined))) if undefined is not None else (lambda x: x)
    return cc.withColumns({"precision": fill(precision), "recall": fill(recall), "f1": fill(f1)})


def one_vs_rest(cc: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and specificity; NULL where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return class_scores(cc, None).withColumns({
        "accuracy": ratio(_d(tp + tn), _d(tp + tn + fp + fn)), "specificity": ratio(_d(tn), _d(tn + fp))})


def global_scores(counts: DataFrame, kept: list[int], classes: list[int]) -> DataFrame:
    """Accuracy, macro and micro F1 and kappa over rows whose true class is kept.

    Macro F1 averages over the classes seen among those rows.
    """
    rows = counts.where(F.col("true").isin(kept))
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    acc = rows.agg(ratio(_d(hit), _d(F.sum("n"))).alias("accuracy"))
    seen = class_scores(class_counts(rows, classes)).where("tp + fp + fn > 0")
    macro = seen.agg(F.avg("f1").alias("macro_f1"))
    return acc.select("accuracy", macro.scalar().alias("macro_f1"), F.col("accuracy").alias("micro_f1"),
                      kappa(rows).select("kappa").scalar().alias("kappa"))


def kappa(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Cohen's kappa from marginals."""
    by = list(by)
    cells = counts.withColumn("side", F.explode(F.array(F.struct(F.lit("t").alias("s"), F.col("true").alias("c")),
                                                        F.struct(F.lit("p").alias("s"), F.col("pred").alias("c")))))
    per = cells.groupBy(*by, F.col("side.c").alias("c")).agg(
        F.sum(F.when(F.col("side.s") == "t", F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("side.s") == "p", F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when((F.col("true") == F.col("pred")) & (F.col("side.s") == "t"), F.col("n")).otherwise(0)).alias("d"))
    total = _d(F.sum("t"))
    po, pe = ratio(_d(F.sum("d")), total), ratio(F.sum(_d(F.col("t")) * F.col("p")), total * total)
    return per.groupBy(*by).agg(ratio(po - pe, 1 - pe).alias("kappa"))


def class_kappa(cc: DataFrame) -> DataFrame:
    """Kappa of class against rest; NULL when the class is on neither side."""
    tp, fp, fn, tn = (_d(F.col(c)) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po = ratio(tp + tn, n)
    pe = ratio((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    return cc.withColumn("kappa", F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, ratio(po - pe, 1 - pe)))


def class_dice(cc: DataFrame) -> DataFrame:
    """Dice per class; 1 when the class is on neither side."""
    tp, fp, fn = (_d(F.col(c)) for c in ("tp", "fp", "fn"))
    return cc.withColumn("dice", F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(1.0)))


def study_table(metrics: DataFrame, classes: list[int], value: str) -> DataFrame:
    """Studies by classes, a mean that skips NULL, and the grand mean of each column."""
    wide = metrics.groupBy("study_id").agg(*[
        F.max(F.when(F.col("class") == c, F.col(value))).alias(f"cls_{c}") for c in classes])
    cols = [f"cls_{c}" for c in classes]
    have = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    wide = wide.select(F.col("study_id").cast("string"), *cols, ratio(total, _d(have)).alias("mean"))
    grand = wide.agg(*[F.avg(c).alias(c) for c in [*cols, "mean"]])
    return wide.unionByName(grand.select(F.lit("Grand mean").alias("study_id"), *cols, "mean"))


def reduced_summary(metrics: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation, min and max over studies per class, then their means."""
    per = metrics.groupBy("class").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    names = ["mean", "std", "min", "max"]
    total = per.agg(*[F.avg(c).alias(c) for c in names])
    return per.select(F.col("class").cast("string"), *names).unionByName(
        total.select(F.lit("mean").alias("class"), *names))


def with_macro_row(scores: DataFrame, names: list[str]) -> DataFrame:
    """The scores per class, and their plain mean as class ``mean``."""
    mean = scores.agg(*[F.avg(c).alias(c) for c in names])
    return scores.select(F.col("class").cast("string"), *names).unionByName(
        mean.select(F.lit("mean").alias("class"), *names))


def class_frequencies(df: DataFrame, label: str = "stage") -> DataFrame:
    out = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy()))


def validation_counters(df: DataFrame, n_classes: int) -> DataFrame:
    """``tp relevant selected`` per dataset and class, out-of-range rows left out."""
    ok = df.where(F.col("true").between(0, n_classes - 1) & F.col("pred").between(0, n_classes - 1))
    cc = class_counts(confusion(ok, ["dataset"]), list(range(n_classes)), ["dataset"])
    return cc.select("dataset", "class", "tp", (F.col("tp") + F.col("fn")).alias("relevant"),
                     (F.col("tp") + F.col("fp")).alias("selected"))


def validation_scores(counters: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 per dataset, and their mean over datasets."""
    tp, rel, sel = (_d(F.col(c)) for c in ("tp", "relevant", "selected"))
    precision, recall = F.coalesce(ratio(tp, sel), F.lit(0.0)), F.coalesce(ratio(tp, rel), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    per = counters.select("dataset", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    names = ["precision", "recall", "f1"]
    macro = per.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in names])
    return macro.unionByName(macro.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("mean").alias("dataset"), *names))


def soft_dice_loss(df: DataFrame, n_classes: int, smooth: float = 1.0) -> DataFrame:
    """``1 - mean over classes of (2 sum(y p) + s) / (sum(y + p) + s)`` per study."""
    terms = []
    for c in range(n_classes):
        y, p = (F.col("true") == c).cast("double"), F.col("scores")[c]
        terms.append((2 * F.sum(y * p) + smooth) / (F.sum(y + p) + smooth))
    return df.groupBy("study_id").agg((1 - sum(terms[1:], terms[0]) / n_classes).alias("loss"))

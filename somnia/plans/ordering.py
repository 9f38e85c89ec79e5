"""Queries: orders, top rows, unions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.operators import order as O
from somnia.operators.sampling import shuffle
from .proxies import COD, LAB, SAMP, coded_epochs, epoch_labels, fin, out, samples
from .registry import query


@query("order_by_state", "K-01", out(LAB, "SELECT row_number() OVER (ORDER BY CASE stage WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 3 END, recording_id, epoch_idx) - 1 AS \"position\", recording_id, epoch_idx, stage FROM lab", "position recording_id epoch_idx stage"))
def _(t):
    rank = F.when(F.col("stage") == 2, 0).when(F.col("stage") == 0, 1).when(F.col("stage") == 4, 2).otherwise(3)
    rows = epoch_labels(t).withColumn("_rank", rank)
    return fin(O.positions(rows, "_rank", "recording_id", "epoch_idx").drop("_rank")
               .select("position", "recording_id", "epoch_idx", "stage"))


@query("chronological_order", "K-02", out(LAB, "SELECT row_number() OVER (ORDER BY recording_id, epoch_idx) - 1 AS position, recording_id, epoch_idx, stage FROM lab", "position recording_id epoch_idx stage"))
def _(t):
    return fin(O.chronological(epoch_labels(t), ["recording_id", "epoch_idx"], "position"))


@query("shuffled_epochs", "K-03", out(LAB, "SELECT row_number() OVER (ORDER BY md5('7|' || recording_id || '|' || epoch_idx)) - 1 AS position, recording_id, epoch_idx, stage FROM lab", "position recording_id epoch_idx stage"))
def _(t):
    return fin(shuffle(epoch_labels(t), ["recording_id", "epoch_idx"], 7, "position"))


@query("top_channel_per_recording", "K-04", out(SAMP + ", p AS (SELECT recording_id, channel, sum(value * value) AS power FROM samp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY power DESC, channel) AS rank FROM p)", "SELECT recording_id, channel, power, rank FROM r WHERE rank <= 1", "recording_id rank", "power"))
def _(t):
    p = samples(t).groupBy("recording_id", "channel").agg(F.sum(F.col("value") * F.col("value")).alias("power"))
    return fin(O.top_per_group(p, ["recording_id"], "power", "channel", 1))


@query("epoch_ids_sorted", "K-05", out(COD, "SELECT row_number() OVER (ORDER BY subject, epoch_id) - 1 AS position, epoch_id, subject, code FROM cod", "position epoch_id subject"))
def _(t):
    return fin(O.chronological(coded_epochs(t).select("epoch_id", "subject", "code"), ["subject", "epoch_id"], "position"))


@query("first_studies", "K-06", out("ds AS (SELECT n_name AS dataset, c_custkey AS study_id, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey)", "SELECT dataset, study_id, rank FROM ds WHERE rank <= 3", "study_id rank"))
def _(t):
    ds = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("dataset"), F.col("c_custkey").alias("study_id"))
    return fin(O.first_n(ds, ["dataset"], "study_id", 3))


@query("union_of_datasets", "U-01 IO-07", out("", "SELECT 'a' AS dataset, CAST(c_custkey AS BIGINT) AS subject, c_acctbal AS bal, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'c', p_partkey, NULL, p_retailprice FROM part", "subject", "bal price"))
def _(t):
    from somnia.sources.store import merge_stores
    parts = {"a": t.customer.select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("bal")),
             "b": t.supplier.select(F.col("s_suppkey").alias("subject"), F.col("s_acctbal").alias("bal")),
             "c": t.part.select(F.col("p_partkey").alias("subject"), F.col("p_retailprice").alias("price"))}
    return fin(merge_stores(parts).select("dataset", "subject", "bal", "price"))


@query("union_distinct_epochs", "U-02", out(SAMP, "SELECT recording_id, sample_idx // 16 AS epoch_idx FROM samp WHERE channel = 'v' AND value > 150 UNION SELECT recording_id, sample_idx // 16 FROM samp WHERE channel = 'k' AND value > 97", "recording_id epoch_idx"))
def _(t):
    rows = samples(t).withColumn("epoch_idx", F.floor(F.col("sample_idx") / 16))
    a = rows.where("channel = 'v' AND value > 150").select("recording_id", "epoch_idx")
    b = rows.where("channel = 'k' AND value > 97").select("recording_id", "epoch_idx")
    return fin(O.union_distinct(a, b))


@query("merge_train_and_val", "U-03", out("st AS (SELECT c_custkey AS study_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'test' WHEN 'MACHINERY' THEN 'val' ELSE 'train' END AS part FROM customer)", "SELECT study_id, 'train' AS part FROM st WHERE part IN ('train', 'val')", "study_id"))
def _(t):
    part = F.when(F.col("c_mktsegment") == "BUILDING", "test").when(F.col("c_mktsegment") == "MACHINERY", "val").otherwise("train")
    st = t.customer.select(F.col("c_custkey").alias("study_id"), part.alias("part"))
    return fin(O.merge_train_val(st.where("part = 'train'"), st.where("part = 'val'")))


@query("distinct_group_channels", "U-05", out("", "SELECT DISTINCT unnest(string_split(lower(url), '/')) AS channel FROM pages"))
def _(t):
    nested = t.pages.select(F.array(F.split(F.lower("url"), "/")).alias("groups"))
    return fin(O.distinct_members(nested, "groups", "channel"))

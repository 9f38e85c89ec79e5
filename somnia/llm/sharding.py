"""Shards by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK_ROWS = 20_000


def ranked(df: DataFrame, keys: list[str], spread: Column, order: list[Column], rows: int, name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0, in two levels, so that no key is sorted in one task.

    ``spread`` is a whole number from 0 to 2^31 that leads the order; its range is cut into about rows / CHUNK_ROWS
    slots, rows are numbered inside (key, slot), and a table of one row per (key, slot) carries the numbers on.
    """
    slots = max(1, rows // CHUNK_ROWS)
    cut = df.withColumn("__slot", F.floor(spread * F.lit(slots) / F.lit(1 << 31)).cast("long"))
    sizes = cut.groupBy(*keys, "__slot").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__slot").orderBy(*order)
    numbered = cut.withColumn("__k", F.row_number().over(inside) - 1)
    joined = numbered.join(sizes, [*keys, "__slot"])
    return joined.select(*df.columns, (F.col("__k") + F.col("__before")).alias(name))


def _unit(*columns) -> Column:
    """A hash as a whole number from 0 to 2^31 - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, group_id, shard, slot, grown_shard) of every row; law 'rows': shard counts differ by one at most.

    Equal texts are linked. Linked rows start where a hash puts them. In each round a group's rows are counted by
    shard, rows look for the shard with room where most of their neighbours are (more than where they stand; on a tie
    the lower number), and as many move as the quota of that shard lets in, those of one group after the other. Rows
    without a neighbour never vote; in the end they fill what is free. A group larger than a quota fills one shard and
    then the next. Quotas: rows / shards, one more for the first rows % shards.

    A NULL text is a text of its own with size 1 and crc32 0; it is linked to other NULLs. Repeated rows are rows of
    their own, NULL ids stay, an empty table gives an empty one. Other columns are ignored.
    """
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit("")).otherwise(F.sha2(text, 256)).alias("group_id"))
    rows = written(rows)
    groups = written(rows.groupBy("group_id").agg(F.count("*").alias("members")).filter("members > 1"))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    quotas = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard").cast("int") + 1)

    # Linked rows; repeated rows of one id are told apart by their number within (group, id).
    linked = rows.join(groups, "group_id")
    linked = linked.withColumn("nth", F.row_number().over(Window.partitionBy("group_id", "doc_id").orderBy("size")))
    linked = written(linked.withColumn("shard", F.pmod(F.xxhash64("group_id", "doc_id", "nth"), F.lit(shards)).cast("int")).drop("members"))
    count = linked.count()
    group_unit = _unit("group_id")
    for _ in range(rounds if count else 0):
        held = linked.groupBy("group_id", "shard").agg(F.count("*").alias("here"))
        held = written(held)
        load = {r.shard: r.n for r in held.groupBy("shard").agg(F.sum("here").alias("n")).collect()}  # one row per shard
        room = F.element_at(F.array(*[F.lit(max(0, quota[s] - load.get(s, 0))) for s in range(shards)]), F.col("to").cast("int") + 1)
        goals = held.select("group_id", F.col("shard").alias("to"), F.col("here").alias("there")).filter(room > 0)
        best = goals.groupBy("group_id").agg(F.max(F.struct("there", (-F.col("to")).alias("less"))).alias("goal"))
        best = best.select("group_id", (-F.col("goal.less")).alias("to"), F.col("goal.there").alias("there"))
        moves = held.join(best, "group_id").filter((F.col("to") != F.col("shard")) & ((F.col("there") > F.col("here")) | ((F.col("there") == F.col("here")) & (F.col("to") < F.col("shard")))))
        # Admission by counts, group after group: what a group sends from one shard is let in as far as room lasts.
        asked = ranked_sums(moves.select("group_id", "shard", "to", "here"), "to", group_unit, [F.col("group_id"), F.col("shard")], "here", count)
        granted = asked.select("group_id", "shard", "to", F.greatest(F.lit(0), F.least(F.col("here"), room - F.col("before"))).alias("granted"), "here").filter("granted > 0")
        granted = written(granted)
        if granted.isEmpty():
            break
        # Which of a group's rows go: all, or those whose hash comes first among the rows of that group and shard.
        partly = granted.filter("granted < here")
        moved = linked.join(granted.filter("granted = here").select("group_id", "shard", "to"), ["group_id", "shard"], "left")
        moved = moved.withColumn("shard", F.coalesce("to", "shard").cast("int")).drop("to")
        if not partly.isEmpty():  # at most one group for each shard that fills up
            ask = moved.join(partly.select("group_id", "shard", "to", "granted"), ["group_id", "shard"])
            stay = moved.join(partly.select("group_id", "shard"), ["group_id", "shard"], "left_anti")
            split = ranked(ask, ["group_id", "shard"], _unit("doc_id", "nth", "shard"), [F.col("doc_id"), F.col("nth")], count)
            split = split.withColumn("shard", F.when(F.col("rank") < F.col("granted"), F.col("to")).otherwise(F.col("shard")).cast("int")).drop("to", "granted", "rank")
            moved = stay.select(*linked.columns).unionByName(split.select(*linked.columns))
        linked = written(moved.select(*linked.columns))

    # Rows beyond a quota, and rows without a neighbour, fill what is free.
    placed = ranked(linked, ["shard"], _unit("doc_id", "nth", "group_id"), [F.col("doc_id"), F.col("group_id"), F.col("nth")], count)
    placed = written(placed.withColumn("over", F.col("rank") >= quotas))
    load = {r.shard: r.n for r in placed.filter("not over").groupBy("shard").count().withColumnRenamed("count", "n").collect()}  # one row per shard
    single = rows.join(groups, "group_id", "left_anti")
    base = ["doc_id", "size", "text_crc32", "group_id"]
    free = placed.filter("over").select(*base).unionByName(single.select(*base))
    free = ranked(free.withColumn("all", F.lit(0)), ["all"], _unit("doc_id", "group_id"), [F.col("doc_id"), F.col("group_id")], total).drop("all")
    shard, edge = F.lit(shards - 1), 0
    steps = []
    for s in range(shards):
        edge += quota[s] - load.get(s, 0)
        steps.append((s, edge))
    for s, edge in reversed(steps[:-1]):
        shard = F.when(F.col("rank") < edge, F.lit(s)).otherwise(shard)
    every = placed.filter("not over").select(*base, "shard").unionByName(free.select(*base, shard.cast("int").alias("shard")))
    every = written(every)
    out = ranked(every, ["shard"], _unit("doc_id", "group_id", "shard"), [F.col("doc_id"), F.col("group_id")], total, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "group_id")


def ranked_sums(df: DataFrame, key: str, spread: Column, order: list[Column], value: str, rows: int) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the earlier rows of the key, in the two levels of ``ranked``."""
    slots = max(1, rows // CHUNK_ROWS)
    cut = df.withColumn("__slot", F.floor(spread * F.lit(slots) / F.lit(1 << 31)).cast("long"))
    sizes = cut.groupBy(key, "__slot").agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "__slot", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("__k", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(sizes, [key, "__slot"]).select(*df.columns, (F.col("__k") + F.col("__before")).alias("before"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """(linked, cut): pairs of rows with equal texts, and those whose rows lie in different shards, by counts."""
    by = sharded.groupBy("group_id", "shard").agg(F.count("*").alias("n"))
    pairs = by.groupBy("group_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return pairs.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2), F.lit(0.0)).alias("linked"),
                     F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0)).alias("cut"))

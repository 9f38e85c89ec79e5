"""Helpers of the corpus operators: hashed words of Arrow batches, held-out rows, written tables, graph components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somnia.session import materialise

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z
FACTOR = 0x9E3779B97F4A7C15 | 1


class Kept(list):
    """A list that tasks get empty, as functions of this package are sent with what they name: each process fills its own."""

    def __reduce__(self):
        return type(self), ()


_POWERS = Kept()


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a NULL id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: crc32 in SQL: its table by the polynomial, as a list of 256.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, beside ``crc_table``."""
    return (f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2^64, grown on demand."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column, NULL as ''."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def hashed_words(column: pa.Array, fold: bool = True, limit: int = 1 << 20, stems: tuple[int, ...] = ()) -> Iterator[tuple]:
    """Words of a text column as (first row, rows, hash of each word, row of each word), in slices of about ``limit`` bytes.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased on request. A slice never cuts a text.
    With ``stems``, hashes of each word's first that many bytes follow, an array for each length.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        at = (offsets[first:last + 1] - offsets[first]).astype(np.int64)
        raw = data[offsets[first]:offsets[last]]
        if not len(raw):
            yield first, last - first, np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * len(stems)
            first = last
            continue
        word = ~SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        power, inverse = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((FOLD[raw] if fold else raw).astype(np.uint64) * power[:len(raw)] + power[:len(raw)], out=sums[1:])
            hashes = [mix((sums[e] - sums[starts]) * inverse[starts]) for e in (ends, *(np.minimum(starts + n, ends) for n in stems))]
        yield first, last - first, hashes[0], np.searchsorted(at, starts, "right") - 1, *hashes[1:]
        first = last


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; cuts the plan and survives lost executors."""
    return materialise(df)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component), the smallest member naming each.

    Large-star and small-star steps in turn, each written to the shared folder; a node's minimum is taken with map-side
    combine and joined back, so a hub's edges are never collected. Nodes without an edge have no row.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b")))
        after = written(small.filter("a <> b").distinct())
        # A star forest: no node is both a member and a centre.
        chained = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        several = after.groupBy("a").count().filter("count > 1").limit(1).count()
        edges = after
        if not chained and not several:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

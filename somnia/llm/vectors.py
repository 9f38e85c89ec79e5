"""Near copies among vectors: PCA-ordered coordinates in written blocks, compared tile by tile with suffix-norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somnia.session import discard

from .common import components, written

TILE = 1024
GRID = 3  # leading coordinates that the grid of cells uses
LEAD = 24  # leading coordinates that the first bound uses
BLOCK_TILES, BLOCK_BYTES = 8, 1 << 22  # most of a block
BLOCKS = 24  # blocks of a table too small for whole ones


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(row, vec_id, v): vectors with finite components, none NULL, and a norm above zero; ``row`` numbers the written rows."""
    kind = vectors.schema[column].dataType.elementType.typeName()
    v = F.col(column).cast(f"array<{kind if kind == 'float' else 'double'}>")  # floats are written as such
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; scaled by the largest component first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(rows: DataFrame, size: int) -> np.ndarray:
    """Principal axes of the unit vectors by falling variance; the second moments come to the driver, size * size numbers."""

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), size))
            total += x.T @ x
        i, j = np.indices((size, size))
        yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "x"])

    table = rows.select("v").mapInArrow(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    second = np.zeros((size, size))
    second[table["i"].to_numpy(), table["j"].to_numpy()] = table["x"].to_numpy()
    _, axes = np.linalg.eigh(second)
    return axes[:, ::-1]


def bounded(x: np.ndarray, lead: int = LEAD) -> np.ndarray:
    """Leading coordinates and the norm of the others, in single precision: two such rows have at least the dot product of the whole ones."""
    return np.column_stack([x[:, :lead], np.linalg.norm(x[:, lead:], axis=1)]).astype(np.float32)


def block_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, lead: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two blocks of rotated unit vectors with a dot product of at least ``threshold``.

    The bound of ``bounded`` first, with a margin of 1e-5 for its single precision (25 terms that add up to 1 at most);
    what it leaves is decided by the whole product in double precision.
    """
    low, high = lead or (bounded(x), bounded(y))
    alive = low @ high.T >= np.float32(threshold - 1e-5)
    if same:
        alive = np.triu(alive, 1)
    if np.count_nonzero(alive) > 0.05 * alive.size:  # dense: a product of the whole block is cheaper than gathering pairs
        alive &= x @ y.T >= threshold
        return np.nonzero(alive)
    i, j = np.nonzero(alive)
    keep = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component within a block."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def links(vectors: DataFrame, threshold: float = 0.9, column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; two vectors are linked when their cosine is at least ``threshold``.

    Unit vectors are rotated to their principal axes and sorted by grid cells over the leading coordinates, as wide as
    two linked vectors can be apart. Blocks of them are written, each one row with the box it lies in, and pairs of
    blocks whose boxes lie near enough are read by the tasks that compare them: no vector is shuffled or kept once for
    each partner. Pairs are compared tile by tile; a task reports counts and a spanning forest, never pairs. Links are
    then summed by row and the forests joined into components. Where the boxes tell nothing apart, as with many
    dimensions of equal weight, all pairs are compared and time grows with the square of the rows; disk does not.

    Vectors that are NULL, zero, or hold a NULL or non-finite component link with nothing, as do vectors of different
    lengths with each other. Repeated rows are vectors of their own. component_id is the smallest vec_id reached; a NULL
    vec_id counts when it is the only one, and is not kept.
    """
    rows = valid(vectors, column)
    found, spent = None, [rows]
    kind = np.dtype(np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64)
    for size, n in sorted(map(tuple, rows.groupBy(F.size("v")).count().collect())):
        blocks, axes = _blocks(rows.filter(F.size("v") == size), size, n, kind, threshold)
        part = _compare(blocks, axes, size, kind, threshold)
        found = part if found is None else found.unionByName(part)
        spent.append(blocks)
    base = vectors.select("vec_id")
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(found)
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("row").alias("a"), F.col("hub").alias("b")))
    own = rows.select("row", "vec_id").join(counts, "row", "left").join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    own = written(own)
    discard(found, *spent)
    low = own.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = own.join(low, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    v = F.col(column).cast("array<double>")
    bad = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNull() | (F.size("v") == 0)
        | F.exists("v", lambda x: F.coalesce(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))) | F.forall("v", lambda x: x == 0))
    every = linked.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _apart(threshold: float) -> float:
    """How far two linked unit vectors can be apart."""
    return max(float(np.sqrt(max(2 - 2 * threshold, 0))) * 1.000001, 1e-6)


def _blocks(rows: DataFrame, size: int, n: int, kind: np.dtype, threshold: float) -> tuple[DataFrame, np.ndarray]:
    """(block, rows, x, lo, hi) of vectors of one length, written, and the axes: row numbers, vectors as given, box after rotation."""
    axes = rotation(rows, size)
    apart, grid = _apart(threshold), min(GRID, size)
    most = max(1, min(BLOCK_TILES * TILE, BLOCK_BYTES // (size * kind.itemsize)))
    most = max(min(most, TILE), min(most, -(-n // BLOCKS)))
    names, given = [f"c{k}" for k in range(grid)], "float" if kind == np.float32 else "double"

    def place(batches):
        for batch in batches:
            cell = np.floor((_unit(_matrix(batch.column("v"), size)) @ axes[:, :grid]) / apart).astype(np.int32)
            yield pa.record_batch([*(pa.array(cell[:, k]) for k in range(grid)), batch.column("row"), batch.column("v")], [*names, "row", "v"])

    def block(row, x):
        turned = _unit(x) @ axes
        box = [pa.array([z.tolist()], pa.list_(pa.float64())) for z in (turned.min(0), turned.max(0))]
        return pa.record_batch([pa.array([row.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), *box], ["rows", "x", "lo", "hi"])

    def pack(batches):
        row, x = np.zeros(0, np.int64), np.zeros((0, size), kind)
        for batch in batches:
            row = np.concatenate([row, batch.column("row").to_numpy()])
            x = np.concatenate([x, _matrix(batch.column("v"), size).astype(kind, copy=False)])
            while len(row) >= most:
                yield block(row[:most], x[:most])
                row, x = row[most:], x[most:]
        if len(row):
            yield block(row, x)

    placed = rows.select("row", "v").mapInArrow(place, ", ".join(f"{c} int" for c in names) + f", row long, v array<{given}>")
    # The row beside the cell, so that a cell which holds most rows is spread as well.
    tasks = max(min(-(-n // most), 64), -(-n // (4 * most)))
    placed = placed.repartitionByRange(tasks, *names, "row").sortWithinPartitions(*names, "row")
    packed = placed.mapInArrow(pack, "rows binary, x binary, lo array<double>, hi array<double>")
    return written(packed.withColumn("block", F.monotonically_increasing_id())), axes


def _compare(blocks: DataFrame, axes: np.ndarray, size: int, kind: np.dtype, threshold: float) -> DataFrame:
    """(row, n, hub) of each pair of blocks with links between them."""
    tile, apart = TILE, _apart(threshold)
    a, b = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    # In each dimension the gap between two boxes, if there is one.
    minus = lambda x, y: F.zip_with(x, y, lambda u, v: u - v)
    gaps = F.zip_with(minus("a_lo", "b_hi"), minus("b_lo", "a_hi"), lambda u, v: F.greatest(u, v, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, u: s + u * u) <= apart ** 2
    # Each task reads two parts of the blocks as they are written.
    pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_block") <= F.col("b_block")) & near)

    def tiles(raw):
        x = _unit(np.frombuffer(raw, kind).reshape(-1, size)) @ axes
        parts = [(k, x[k:k + tile]) for k in range(0, len(x), tile)]
        return [(k, z, bounded(z), z.min(0), z.max(0)) for k, z in parts]

    def compared(row, mine, theirs):
        """``theirs`` is None where a block meets itself."""
        first, ends, n = row.size if theirs is None else sum(len(z) for _, z, *_ in mine), [], np.zeros(row.size, np.int64)
        for at, x, low, lo, hi in mine:
            for to, y, high, under, over in mine if theirs is None else theirs:
                if theirs is None and to < at or (np.maximum(np.maximum(lo - over, under - hi), 0) ** 2).sum() > apart ** 2:
                    continue
                itself = theirs is None and to == at
                i, j = block_links(x, y, threshold, itself, (low, high))
                if not len(i):
                    continue
                n[at:at + len(x)] += np.bincount(i, minlength=len(x))
                to += 0 if theirs is None else first
                n[to:to + len(y)] += np.bincount(j, minlength=len(y))
                label = _forest(len(x) + len(y), i, j if itself else j + len(x))
                place = np.concatenate([np.arange(at, at + len(x)), np.arange(to, to + len(y))])
                hit = np.flatnonzero(label != np.arange(len(label)))
                ends.append((place[hit], place[label[hit]]))
        hit = np.flatnonzero(n)
        label = _forest(row.size, *map(np.concatenate, zip(*ends))) if ends else hit
        return pa.record_batch([pa.array(row[hit]), pa.array(n[hit]), pa.array(row[label[hit]] if ends else row[hit])], ["row", "n", "hub"])

    def compare(batches):
        held, mine = None, None
        for batch in batches:
            for one, two, x, y, rows, more in zip(*(batch.column(c) for c in ("a_block", "b_block", "a_x", "b_x", "a_rows", "b_rows"))):
                if held != one.as_py():
                    held, mine = one.as_py(), tiles(x.as_buffer())
                row = np.frombuffer(rows.as_buffer(), np.int64)
                if one == two:
                    yield compared(row, mine, None)
                else:
                    yield compared(np.concatenate([row, np.frombuffer(more.as_buffer(), np.int64)]), mine, tiles(y.as_buffer()))

    return pairs.select("a_block", "b_block", "a_x", "b_x", "a_rows", "b_rows").mapInArrow(compare, "row long, n long, hub long")

"""Near copies by DartMinHash over weighted word shingles, banded joins and an exact check."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, hashed_words, mix, texts, written

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 7  # a pair at 0.8 shares a band with probability 0.9995
COORDINATES = BANDS * ROWS
SMALL, TILE = 32, 256
CENTRES = 2  # members that a bucket is compared to in each turn after the first


def shingles(h: np.ndarray, rows: np.ndarray, n: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row and the row of each; a text of fewer words is one shingle, an empty one none."""
    with np.errstate(over="ignore"):
        m = len(h) - width + 1
        code = np.zeros(max(m, 0), np.uint64)
        for k in range(width if m > 0 else 0):
            code = code * np.uint64(0xD1342543DE82EF95) + h[k:k + m]
        inside = rows[:m] == rows[width - 1:] if m > 0 else np.zeros(0, bool)
        long_code, long_row = mix(code[inside]), rows[:m][inside] if m > 0 else np.zeros(0, np.int64)
        words = np.bincount(rows, minlength=n)
        short = np.flatnonzero((words > 0) & (words < width))
        first = np.searchsorted(rows, short)
        extra = []
        for r, a in zip(short, first):
            x = np.uint64(words[r])
            for w in h[a:a + words[r]]:
                x = x * np.uint64(0xD1342543DE82EF95) + w
            extra.append(x)
        code = np.concatenate([long_code, mix(np.array(extra, np.uint64))])
    row = np.concatenate([long_row, short])
    order = np.argsort(row, kind="stable")
    return code[order], row[order]


def cells(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The regions of texts: a shingle that occurs w times in its text has weight w, which is w cells of weight one.

    Shingles are put in order within each text; each cell has the shingle's hash and its number among the equal ones.
    """
    order = np.lexsort((code, owner))
    code, owner, at = code[order], owner[order], np.arange(len(code))
    start = np.ones(len(code), bool)
    start[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code, at - np.maximum.accumulate(np.where(start, at, 0)), owner


def darts(code: np.ndarray, copy: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures of ``n`` texts (n x k): in each coordinate the earliest dart that hits one of a text's cells.

    Every cell gets darts at the times of a Poisson process of rate one, drawn from a hash of (shingle, copy, number of
    the dart); another draw sends each to a coordinate. Two texts throw the same darts at the cells that they share, so
    a coordinate agrees with the probability of their weighted Jaccard similarity. Time runs until every coordinate is
    hit: a text's bound starts where that is likely and doubles when it is not. Texts without a cell keep zeros.
    """
    with np.errstate(over="ignore", divide="ignore"):
        seed = mix(code + mix(copy.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        size = np.bincount(owner, minlength=n)
        until = k * (np.log(k) + 2) / size
        result, todo = np.zeros((n, k), np.uint64), size > 0
        while todo.any():
            best, name = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
            own = todo[owner]
            alive, who = seed[own], owner[own]
            bound, time, number = until[who], np.zeros(len(alive)), 0
            while len(alive):
                number += 1
                draw = mix(alive + np.uint64(number) * np.uint64(0xBF58476D1CE4E5B9))
                time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53)
                hit = time < bound
                alive, who, bound, time = alive[hit], who[hit], bound[hit], time[hit]
                landed = mix(draw[hit] ^ np.uint64(0xA0761D6478BD642F))
                place = who * k + (landed % np.uint64(k)).astype(np.int64)
                earlier = time < best[place]
                place, when, landed = place[earlier], time[earlier], landed[earlier]
                np.minimum.at(best, place, when)
                first = best[place] == when
                name[place[first]] = landed[first]
            full = np.isfinite(best.reshape(n, k)).all(1) & todo
            result[full] = name.reshape(n, k)[full]
            todo &= ~full
            until = np.where(todo, until * 2, until)
        return result


def _bands(names: np.ndarray) -> np.ndarray:
    """One hash for each text and band (n x BANDS)."""
    with np.errstate(over="ignore"):
        code = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(names), BANDS)).copy()
        for k in range(ROWS):
            code = mix(code * np.uint64(0xD1342543DE82EF95) + names.reshape(-1, BANDS, ROWS)[:, :, k])
    return code


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, weight, bands, light) of every row with a word; ``key`` is the text's digest, ``light`` the low bytes of its signature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "text")

    def run(batches):
        for batch in batches:
            for first, n, h, row in hashed_words(texts(batch), limit=1 << 18):
                code, owner = shingles(h, row, n)
                names = darts(*cells(code, owner), n)
                weight = np.bincount(owner, minlength=n)
                own = np.flatnonzero(weight)
                light = (names[own] & np.uint64(255)).astype(np.uint8)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(_bands(names[own]).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                at = pa.array(own + first)
                yield pa.record_batch([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(weight[own].astype(np.int64)), bands,
                                       pa.array([x.tobytes() for x in light], pa.binary())], ["doc_id", "key", "weight", "bands", "light"])

    return rows.mapInArrow(run, "doc_id long, key string, weight long, bands array<long>, light binary")


@functools.lru_cache(maxsize=64)
def _multiset(text: str) -> np.ndarray:
    out = [shingles(h, row, n)[0] for _, n, h, row in hashed_words(pa.array([text], pa.large_string()))]
    return np.sort(out[0]) if out else np.zeros(0, np.uint64)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingles, a shingle's weight being its number of occurrences."""
    x, y = _multiset(a), _multiset(b)
    if not len(x) or not len(y):
        return 0.0
    (u, m), (v, n) = (np.unique(z, return_counts=True) for z in (x, y))
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    both = int(np.minimum(m, n[at])[v[at] == u].sum())
    return both / (len(x) + len(y) - both)


def _estimate_at_least(low: float):
    """Column function: do two light signatures agree so often that a similarity of THRESHOLD cannot be excluded?"""

    def run(batches):
        for batch in batches:
            n = len(batch)
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("light_a", "light_b"))
            keep = pa.array((x == y).mean(1) >= low if n else np.zeros(0, bool))
            yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _bodies(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the representatives that share a band with another: the only texts that are read again."""
    wanted = reps.join(nodes, "node").select("node", F.col("key").alias("want"), F.col("of").alias("want_id"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    body = own.join(wanted, (own.id == F.coalesce("want_id", F.lit(-1))) & (own.key == F.col("want"))).groupBy("node").agg(F.first("text").alias("text"))
    return written(body)


def _tiled_links(members: DataFrame, texts_of: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members (band, node, component) of large buckets, of different components.

    Buckets that share members form a cluster; its texts are dealt into tiles of about TILE, those outside its largest
    component (strays) into tiles of their own, and each tile of strays is compared to each tile in one task that
    reports only links. So the rows written grow as strays * members / TILE, not as pairs.
    """
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"))
    own = members.select("node", "component").distinct()
    clusters = components(members.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cluster")
    every = written(clusters.join(own, "node"))
    shares = every.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    sizes = shares.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    sizes = sizes.select("cluster", "largest", F.ceil(F.col("all") / TILE).cast("int").alias("tiles"), F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("stray_tiles"))

    def split(batches):
        for batch in batches:
            for first, n, h, row in hashed_words(texts(batch), limit=1 << 18):
                code, copy, owner = cells(*shingles(h, row, n))
                with np.errstate(over="ignore"):
                    cell = mix(code + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                edges = np.searchsorted(owner, np.arange(n + 1))
                yield pa.record_batch([batch.column("node").slice(first, n), pa.array([cell[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary())], ["node", "cells"])

    named = written(every.join(sizes, "cluster"))
    bodies = texts_of.join(named.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(split, "node long, cells binary")
    dealt = written(bodies).join(named, "node")
    tile = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["cluster", "i", "j", "side", "node", "component", "cells"]
    strays = dealt.filter(F.col("component") != F.col("largest")).withColumns({"i": tile(F.col("stray_tiles")), "side": F.lit(0)}).withColumn("j", to("tiles"))
    others = dealt.filter("stray_tiles > 0").withColumns({"j": tile(F.col("tiles")), "side": F.lit(1)}).withColumn("i", to("stray_tiles"))
    dealt = strays.select(*names).unionByName(others.select(*names))

    def compare(table: pa.Table) -> pa.Table:
        node, component, side = (table[c].to_numpy() for c in ("node", "component", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in table["cells"].to_pylist()]
        size, owner = np.array([len(x) for x in sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(often > 1) - 1
        keep = often[number] > 1
        bits = np.zeros((len(sets), -(-int((often > 1).sum() + 1) // 64) * 64), bool)  # shared cells as bits
        bits[owner[keep], place[number[keep]]] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        a, b = [], []
        for x in np.flatnonzero(side == 0):
            others = np.flatnonzero((side == 1) & (component != component[x]))
            both = np.bitwise_count(words[x] & words[others]).sum(1)
            near = others[both >= threshold * (size[x] + size[others] - both) - 1e-9]
            a += [int(min(node[x], node[y])) for y in near]
            b += [int(max(node[x], node[y])) for y in near]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def _linked(pairs: DataFrame, reps: DataFrame, texts_of: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of representatives whose texts are similar enough: estimate first, then exact."""
    side = lambda c: reps.select(F.col("node").alias(c), F.col("weight").alias(f"weight_{c}"), F.col("light").alias(f"light_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("weight_a", "weight_b") >= threshold * F.greatest("weight_a", "weight_b"))
    # At 0.8 of 224 coordinates 0.66 is more than five deviations low.
    near = written(near.select("a", "b", "light_a", "light_b").mapInArrow(_estimate_at_least(threshold - 0.14), "a long, b long"))
    if near.isEmpty():
        return near
    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    body = texts_of.join(nodes, "node", "left_semi")
    full = near.join(body.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(body.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            keep = pa.array([similarity(x, y) >= threshold for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())], pa.bool_())
            yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return written(full.mapInArrow(run, "a long, b long"))


def spark_pairs(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, node, class_node, class_id) of every row.

    Documents are linked when the weighted Jaccard similarity of their shingles of five words is at least ``threshold``
    (found by a shared band, then computed exactly); classes are the components of the links, named by their smallest
    doc_id. Equal texts are one node from the start, so copies are counted, never paired. In each turn all members of a
    band's bucket are compared to a few of them and classes merge; when few pairs of different classes remain in the
    buckets, or hardly any comparison finds a link, all of those pairs are compared: those of buckets with up to SMALL
    members as rows, at most SMALL for each member, those of larger ones tile by tile inside tasks. So no link between
    classes is lost, and a group of copies or of texts around one passage is not written out in pairs.

    Rows of one doc_id count as one document. A NULL doc_id gets a negative node from its text; its class_id is the
    smallest id of the class, NULL if none has one. Texts without words (NULL, empty) are equal to each other only when
    equal as texts and near to none.
    """
    signed = written(signatures(docs))
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("of"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("light").alias("light"))
    node = F.coalesce("of", -1 - F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)))
    reps = written(reps.withColumn("node", node))
    banded = reps.select("node", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("other"))
    shared = written(banded.join(centres.filter("centre <> other"), "band").select("band", "node"))
    bodies = _bodies(shared.select("node").distinct(), reps, docs)
    found = spark_pairs(docs.sparkSession, "node long, component long")
    size, turn, gained = shared.count(), 0, 1.0
    while True:
        # What a bucket still leaves open: its pairs of different components, counted without writing them out.
        named = shared.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
        by = named.groupBy("band", "component").agg(F.count("*").alias("n"))
        by = by.groupBy("band").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same")).filter("all * all > same")
        several = written(by)
        pairs = several.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2)).first()[0] or 0
        if not pairs:
            break
        open_rows = written(named.join(several.select("band"), "band"))
        last = turn > 0 and (pairs <= size or gained < 0.05)
        if last:
            small = open_rows.join(several.filter(F.col("all") <= SMALL).select("band"), "band", "left_semi")
            left = small.select("band", F.col("node").alias("a"), F.col("component").alias("ca"))
            right = small.select("band", F.col("node").alias("b"), F.col("component").alias("cb"))
            asked = left.join(right, "band").filter("a < b and ca <> cb").select("a", "b").distinct()
        else:  # all of a bucket against a few of it, others in each turn
            orders = [F.col("node")] if turn == 0 else [F.xxhash64("node", F.lit(turn), F.lit(k)) for k in range(CENTRES)]
            one = F.struct(F.col("node").alias("a"), F.col("component").alias("ca"))
            left = open_rows.groupBy("band").agg(F.array_distinct(F.array(*[F.min_by(one, o) for o in orders])).alias("x")).select("band", F.inline("x"))
            right = open_rows.select("band", F.col("node").alias("b"), F.col("component").alias("cb"))
            asked = left.join(right, "band").filter("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        asked = written(asked)
        asked_rows = asked.count()
        links = _linked(asked, reps, bodies, threshold)
        if last:
            large = open_rows.join(several.filter(F.col("all") > SMALL).select("band"), "band", "left_semi")
            if not large.isEmpty():
                links = links.unionByName(_tiled_links(large, bodies, threshold))
        n = links.count()
        gained = n / max(asked_rows, 1)
        if n:
            found = components(links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if last:
            break
        turn += 1
    nodes = reps.select("key", "node", "of").join(found, "node", "left").select("key", "node", "of", F.coalesce("component", "node").alias("class_node"))
    named = nodes.join(nodes.groupBy("class_node").agg(F.min("of").alias("class_id")), "class_node")
    named = written(named.select("key", "node", "class_node", "class_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    # Texts without words have no signature; equal ones form a class of their own.
    bare = rows.join(named, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    bare = bare.select("key", F.coalesce("class_id", -1 - F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1))).alias("node"), "class_id")
    named = named.unionByName(bare.select("key", "node", F.col("node").alias("class_node"), "class_id"))
    return rows.join(named, "key").select("doc_id", "key", "node", "class_node", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one document, the one with the smallest doc_id.

    A document without an id stays only where its class has none with one; a NULL text counts as the empty text. Repeated rows become one,
    other columns are kept whatever their names, and an empty table gives an empty one.
    """
    classes = near_copies(docs, threshold).groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("first"))
    chosen = classes.select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key"))
    own = docs.withColumn("__own", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = own.join(chosen, own.doc_id.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_semi")
    order = [c for c in docs.columns]
    return kept.groupBy("doc_id", "__own").agg(*[F.first(c, ignorenulls=False).alias("__" + c) for c in order if c != "doc_id"]).select(
        *[F.col(c) if c == "doc_id" else F.col("__" + c).alias(c) for c in order])

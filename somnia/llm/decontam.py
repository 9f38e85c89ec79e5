"""Benchmark decontamination: seeds that no passage can lack find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, texts, written

EXPANDED = 1 << 20  # about as many places of seeds are held at once
FOUND = "doc_id long, item_id long, score double, matched long, first_word long, last_word long"


def sure_seeds(length: int, threshold: float, min_words: int) -> tuple[int, int]:
    """Words of a seed, and how many of an item's seeds every reported alignment holds.

    An alignment with M matched words and a score of t times the item's length L has at most 2 (M - t L) edits, which leave
    at least M - 2 (M - t L) - 1 >= (2 t - 1) L - 1 pairs of neighbouring words side by side. Where that is no pair, as in
    short items, single words are the seeds: all M are held.
    """
    pairs = math.ceil((2 * threshold - 1) * length - 1 - 1e-9)
    return (2, pairs) if 1 <= pairs < length else (1, max(1, math.ceil(max(threshold * length, min(min_words, length)) - 1e-9)))


class Items:
    """A block of test items as (id, hashes of its words), with the places of their seeds by the seed's length.

    Given the seeds' counts in the corpus, an item goes without its commonest seeds, half as many as an alignment is sure
    to hold, and ``least`` is what it still holds of the others: no alignment of at least ``threshold`` is lost. Seeds that
    the corpus lacks are left out.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray]], threshold: float, min_words: int, weight: dict[int, int] | None = None):
        self.rows, self.least = rows, np.zeros(len(rows), np.int64)
        parts: dict[int, list] = {}
        for i, (_, h) in enumerate(rows):
            n, least = sure_seeds(len(h), threshold, min_words)
            own = ngrams(h, n)
            place = np.arange(len(own))
            if weight is not None:
                count = np.array([weight.get(g, 0) for g in own.tolist()], np.int64)
                spare = least // 2 if least <= len(own) else 0
                place = np.argsort(count, kind="stable")[:len(own) - spare]
                place, least = place[count[place] > 0], least - spare
            self.least[i] = least
            parts.setdefault(n, []).append((own[place], np.full(len(place), i), place))
        self.index: dict[int, tuple] = {}  # seeds, where the places of each begin, the item and its word of each place
        for n, own in parts.items():
            seed, item, place = (np.concatenate(x) for x in zip(*own))
            order = np.argsort(seed, kind="stable")
            seeds, begin = np.unique(seed[order], return_index=True)
            self.index[n] = seeds, np.append(begin, len(seed)), item[order], place[order]

    def candidates(self, h: np.ndarray, rows: np.ndarray):
        """(row, item, places as (in all words, in the item)) for the texts that hold enough seeds of an item."""
        for n, (seeds, begin, item, place) in self.index.items():
            codes = ngrams(h, n, rows)
            hits = np.flatnonzero(_member(codes, seeds))
            seed = np.searchsorted(seeds, codes[hits])
            times = begin[seed + 1] - begin[seed]
            last = np.flatnonzero(np.append(rows[hits[1:]] != rows[hits[:-1]], True)) + 1 if len(hits) else []  # ends of texts
            done, sums = 0, np.cumsum(times)
            for k, end in enumerate(last):
                if k + 1 < len(last) and sums[last[k + 1] - 1] - (sums[done - 1] if done else 0) <= EXPANDED:
                    continue
                own = times[done:end]
                source = np.repeat(begin[seed[done:end]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                at, of = np.repeat(hits[done:end], own), item[source]
                pair = rows[at] * len(self.rows) + of
                _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
                keep = np.flatnonzero(count[back] >= self.least[of])
                keep = keep[np.argsort(pair[keep], kind="stable")]
                edges = np.flatnonzero(np.diff(pair[keep], prepend=-1, append=-1)) if len(keep) else []
                for a, b in zip(edges, edges[1:]):
                    yield int(rows[at[keep[a]]]), int(of[keep[a]]), list(zip(at[keep[a:b]].tolist(), place[source[keep[a:b]]].tolist()))
                done = end


def ngrams(h: np.ndarray, n: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Seeds of ``n`` words in a row. With ``rows``, 0 where a seed would cross texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0xD1342543DE82EF95) + h[k:k + m]
    if rows is not None:
        code[rows[:m] != rows[n - 1:]] = 0
    return code


def align(item: np.ndarray, text: np.ndarray, match: float = 1.0, mismatch: float = -0.5, gap: float = -0.5) -> tuple[float, int, int, int]:
    """Best Smith-Waterman local alignment of two word sequences: (score, matched words, first, last word of the text).

    Row by row over the item; the gap along the text is a running maximum, so each row is a few array operations.
    """
    n = len(text)
    ramp = gap * np.arange(n + 1)
    score, start, hits = np.zeros(n + 1), np.arange(n + 1), np.zeros(n + 1, np.int64)
    best = (0.0, 0, 0, 0)
    for w in item:
        same = text == w
        diagonal, up = score[:-1] + np.where(same, match, mismatch), score[1:] + gap
        own = np.zeros(n + 1)
        own[1:] = np.maximum(np.maximum(diagonal, up), 0)
        from_diagonal = np.concatenate([[False], diagonal >= up])
        base_start = np.where(from_diagonal, np.concatenate([[0], start[:-1]]), start)
        base_hits = np.where(from_diagonal, np.concatenate([[0], hits[:-1] + same]), hits)
        fresh = own <= 0
        base_start = np.where(fresh, np.arange(n + 1), base_start)
        base_hits = np.where(fresh, 0, base_hits)
        # score[j] = max over i <= j of own[i] + gap * (j - i)
        lifted = own - ramp
        source = np.maximum.accumulate(np.where(lifted >= np.maximum.accumulate(lifted), np.arange(n + 1), 0))
        score = np.maximum(lifted[source] + ramp, 0)
        start, hits = base_start[source], base_hits[source]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), int(hits[k]), int(start[k]), k)
    return best


def _windows(places: list[tuple[int, int]], length: int, n: int, slack: int, least: int) -> list[tuple[int, int]]:
    """Word ranges of a text around the seeds of one item, ``slack`` words wider than the item on both sides.

    Overlapping ones are merged; ranges of fewer than ``least`` different seeds are left out; ``places``: (in text, in item).
    """
    out = []
    for a, b, k in sorted((max(0, t - k - slack), min(n, t - k + length + slack), k) for t, k in places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2].add(k)
        else:
            out.append([a, b, {k}])
    return [(a, b) for a, b, own in out if len(own) >= least]


def _blocks(benchmark: DataFrame, words: int) -> list[list[tuple[int, np.ndarray]]]:
    """The items with a word, in blocks of about ``words`` words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
    size = rows.agg(F.sum(F.length("text") / 5 + 1)).first()[0] or 0
    blocks = max(1, int(-(-size // words)))
    for k in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()  # one block
        block = []
        for r in own:
            for _, _, h, _ in hashed_words(pa.array([r.text], pa.large_string())):
                if len(h):
                    block.append((r.item_id, h))
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_words: int = 8, words_per_block: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, score, matched, first_word, last_word): every row of ``docs`` that holds a test item.

    Test items go to the workers in blocks of about ``words_per_block`` words (some 60 MB with their seeds), each block a
    pass over all documents, so any benchmark is handled. First the seeds' counts over the whole corpus: each item goes
    without its commonest seeds, but keeps so many that no alignment from ``threshold`` on is without one (``sure_seeds``).
    Documents with enough seeds are aligned around them; ``score`` is the alignment's score (match 1, mismatch and gap
    -0.5) by the item's words, 1 for an exact copy. Reported from ``threshold`` on, if at least
    ``min_words`` words match, or the whole of a shorter item. Repeated rows are reported as often as they occur, rows
    without an id with a NULL; items without an id or a word match nothing, repeated items count once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in _blocks(benchmark, words_per_block):
        every = Items(block, threshold, min_words)
        sent = spark.sparkContext.broadcast(every)

        def count(batches, sent=sent):
            index = sent.value.index
            total = {n: np.zeros(len(own[0]), np.int64) for n, own in index.items()}
            for batch in batches:
                for _, _, h, rows in hashed_words(texts(batch)):
                    for n, (seeds, *_) in index.items():
                        codes = ngrams(h, n, rows)
                        total[n] += np.bincount(np.searchsorted(seeds, codes[_member(codes, seeds)]), minlength=len(seeds))
            for n, own in total.items():
                met = np.flatnonzero(own)
                yield pa.record_batch([pa.array(index[n][0][met].view(np.int64)), pa.array(own[met])], ["seed", "n"])

        counts = base.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # one block's seeds
        weight = {int(np.int64(r.seed).view(np.uint64)): r.n for r in counts}
        rare = spark.sparkContext.broadcast(Items(block, threshold, min_words, weight))

        def search(batches, sent=rare):
            items = sent.value
            cached = functools.lru_cache(maxsize=4096)(lambda item, words: align(items.rows[item][1], np.frombuffer(words, np.uint64)))
            for batch in batches:
                ids, out = batch.column("doc_id").to_pylist(), []
                for first, n, h, rows in hashed_words(texts(batch)):
                    begin = np.searchsorted(rows, np.arange(n + 1))
                    for row, item, own in items.candidates(h, rows):
                        start, words = int(begin[row]), h[begin[row]:begin[row + 1]]
                        length, best = len(items.rows[item][1]), (0.0, 0, 0, 0)
                        slack = max(0, int(2 * (1 - threshold) * length)) + 1  # edits that the threshold allows
                        for a, b in _windows([(t - start, k) for t, k in own], length, len(words), slack, int(items.least[item])):
                            s, m, i, j = cached(item, words[a:b].tobytes())
                            if s > best[0]:
                                best = (s, m, a + i, a + j)
                        if best[0] >= threshold * length and best[1] >= min(min_words, length):
                            out.append((ids[first + row], items.rows[item][0], best[0] / length, *best[1:]))
                columns = list(zip(*out)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in FOUND.split(", ")])

        part = base.mapInArrow(search, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def _member(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(codes):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return (table[at] == codes) & (codes != 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows without an id are kept or dropped by their text as well."""
    bad = written(contaminated(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"), benchmark, **parameters).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(bad, F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__bad"), "left_anti")

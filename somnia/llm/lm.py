"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, remainder, texts, written
from .toxicity import bigrams

END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0676A9A99)
BITS_PER_ENTRY, PROBES, BASE = 12, 6, 2.0
SLICE_BYTES = 48 << 20  # the most of a filter that a task builds and probes at once
BLOCK = 1_000_000       # tokens whose distinct n-grams are sent together
MARK = 40               # bits that name a bigram in its segment; a segment has about as many bigrams at any size of the corpus


def quantise(n: np.ndarray) -> np.ndarray:
    """Level of a count: 1 for one, one more for each factor of BASE."""
    return np.where(n > 0, 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


#: The count that a level stands for.
VALUES = np.concatenate([[0.0, 1.0], np.sqrt(BASE ** np.arange(1, 63) * (BASE ** np.arange(2, 64) - 1))])


def tokens(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every text (its words and an end), the row of each, and the hash of (token before or begin, token)."""
    owner = np.concatenate([rows, np.arange(n)])
    order = np.argsort(owner, kind="stable")
    token, owner = np.concatenate([h, np.full(n, END)])[order], owner[order]
    return token, owner, _pairs(token, owner)


def _pairs(token: np.ndarray, owner: np.ndarray) -> np.ndarray:
    before = np.concatenate([[BEGIN], token[:-1]])
    before[np.concatenate([[True], owner[1:] != owner[:-1]])] = BEGIN
    return bigrams(before, token)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(MARK)) % np.uint64(segments)).astype(np.int64)


def _mark(pair: np.ndarray) -> np.ndarray:
    """What names a bigram within its segment: the bits of its hash that did not choose the segment."""
    return pair & np.uint64((1 << MARK) - 1)


def _packed(x: np.ndarray, places: int = 8) -> bytes:
    """Numbers by place of their bytes, so that sorted and small ones compress well where they are shuffled or written."""
    return np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :places].T.tobytes()


def _unpacked(x: bytes, places: int = 8) -> np.ndarray:
    out = np.zeros((len(x) // places, 8), np.uint8)
    out[:, :places] = np.frombuffer(x, np.uint8).reshape(places, -1).T
    return out.view(np.uint64).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where one of each stands, and the place of every key among them."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return keys[order[new]], order[new], back


def _turned(pair: np.ndarray) -> np.ndarray:
    """Hashes of bigrams with their mark first, so that they sort by it."""
    return _mark(pair) << np.uint64(64 - MARK) | pair >> np.uint64(MARK)


def _dealt(hashes: np.ndarray, names: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct hashes by segment and name, and the segments in that order."""
    order = np.argsort(names, kind="stable")
    seg = _segment(hashes[order], segments)
    by = np.argsort(seg.astype(np.uint16 if segments < 1 << 16 else np.int64), kind="stable")
    return order[by], seg[by]


WORD, PAIR, TEXTS, TOTAL = range(4)  # kinds of rows that travel between blocks and segments
KEY = {WORD: 8, PAIR: MARK // 8}     # bytes of a key
TRAVEL = "place long, block long, kind int, keys binary, numbers binary, ids array<long>, sizes array<long>"


def _travel(*rows: tuple) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in TRAVEL.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def blocks(docs: DataFrame, segments: int) -> DataFrame:
    """Rows of TRAVEL for ``docs`` (doc_id, text, train), every text hashed once.

    A task cuts its rows into blocks of about BLOCK tokens. A block sends each segment, its ``place``, one row for words and
    one for bigrams with distinct keys and their training counts (0 where only held-out rows have them), so what is shuffled
    is pre-aggregated and has no row for each n-gram; hashes deal n-grams evenly, so no segment is hot. Words keep the whole
    hash, since their counts must be exact. Bigrams keep the MARK bits that did not choose their segment: of a million in a
    segment, one in a million shares its mark with another, far fewer than the filter mistakes anyway. One more row, at the
    place of the block itself, holds its words, the frequent ones first, and its texts as numbers of them.
    """
    full = BLOCK

    def send(held, number):
        pair, token, train = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
        ids, sizes = (sum((x[i] for x in held), []) for i in (3, 4))
        turned, at, back = _distinct(_turned(pair))
        words, _, ends = _distinct(token[at])
        pairs = np.bincount(back[train], minlength=len(turned))
        common = np.argsort(-np.bincount(ends, np.bincount(back)), kind="stable")
        number_of = np.empty(len(words), np.int64)
        number_of[common] = np.arange(len(words))
        sent = []
        for kind, hashes, names, counts in ((WORD, words, words, np.bincount(ends, pairs)), (PAIR, pair[at], turned, pairs)):
            order, seg = _dealt(hashes, names, segments)
            hashes, counts = hashes[order], counts[order]
            edges = np.searchsorted(seg, np.arange(segments + 1)).tolist()
            sent += [(s, kind, _packed(_mark(hashes[a:b]) if kind else hashes[a:b], KEY[kind]), _packed(counts[a:b], 4))
                     for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        words, told = _packed(words[common]), pa.compress(_packed(number_of[ends[back]], 4), "zstd", asbytes=True)
        # A task that is run again on rows in another order must not pass for the first: the name follows the content.
        content = b"%d %d " % (TaskContext.get().partitionId(), number) + words + told + train.tobytes()
        name = -1 - int.from_bytes(hashlib.blake2b(content, digest_size=7).digest())
        rows = [(place, name, kind, x, y, None, None) for place, kind, x, y in sent]
        return _travel(*rows, (name, name, TEXTS, words, told, ids, sizes)).to_batches()

    def cut(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_numpy(zero_copy_only=False)
            for first, n, h, rows in hashed_words(texts(batch), limit=1 << 19):
                token, owner, pair = tokens(h, rows, n)
                held.append((pair, token, train[first + owner], ids[first:first + n], np.bincount(owner, minlength=n).tolist()))
                size += len(token)
                if size >= full:
                    yield from send(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from send(held, number)

    return docs.select("doc_id", "text", "train").mapInArrow(cut, TRAVEL)


def _places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the probes of (n-gram, level)."""
    with np.errstate(over="ignore"):
        one = mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        return one >> np.uint64(2), ((one * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(34)) | np.uint64(1)


def _tagged(keys: np.ndarray, kind: int) -> np.ndarray:
    """Keys of words and marks of bigrams as one set: marks leave the high bits free for the kind."""
    return keys | np.uint64(1 << 63) if kind else keys


class Filter:
    """A log-frequency Bloom filter: it holds (n-gram, level) for every level up to the n-gram's own."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, bits_per_entry: int):
        self.size = max(64, int(level.sum()) * bits_per_entry // 8 * 8 + 64)
        bits = np.zeros(self.size, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            place, step = _places(keys[level >= q], q)
            for k in range(PROBES):
                bits[((place + np.uint64(k) * step) % np.uint64(self.size)).astype(np.int64)] = True
        self.bits = np.packbits(bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each n-gram by probing level after level until one is missing."""
        out, alive = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for q in range(1, 64):
            place, step = _places(keys[alive], q)
            for k in range(PROBES):
                at = ((place + np.uint64(k) * step) % np.uint64(self.size)).astype(np.int64)
                hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                alive, place, step = alive[hit], place[hit], step[hit]
            if not len(alive):
                break
            out[alive] = q
        return out


def answers(sent: DataFrame) -> DataFrame:
    """Rows of TRAVEL back to the blocks: the level of each key that a block sent, and the exact count of each word.

    A segment's task adds up the training counts, builds the segment's filter from them and probes it once for each distinct
    n-gram that any block asked for, in parts of at most SLICE_BYTES of filter. A last row for block 0 has its number of
    distinct training words. The filter stays in that task: nothing of it passes the driver, and a segment is as large as
    half a partition of the documents at any size of the corpus.
    """
    most, bits_per_entry = SLICE_BYTES, BITS_PER_ENTRY

    def answer(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        if kinds[0] == TEXTS:
            return table
        place, back, number, tagged, counts = table["place"][0].as_py(), {}, {}, [], []
        for kind in (WORD, PAIR):
            own = table.filter(pa.array(kinds == kind))
            keys = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x, KEY[kind]) for x in own["keys"].to_pylist())])
            n = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x, 4) for x in own["numbers"].to_pylist())])
            keys, _, back[kind] = _distinct(keys)
            # Sums of whole numbers below 2^53 are exact.
            number[kind] = np.bincount(back[kind], n, len(keys)).astype(np.int64)
            tagged.append(_tagged(keys, kind))
            counts.append(number[kind])
        keys, level = np.concatenate(tagged), quantise(np.concatenate(counts))
        parts = 1 + int(level.sum()) * bits_per_entry // 8 // most
        part = mix(keys) % np.uint64(parts)
        told = np.zeros(len(keys), np.uint8)
        for x in range(parts):
            own = np.flatnonzero(part == x) if parts > 1 else slice(None)
            known = level[own] > 0
            told[own] = Filter(keys[own][known], level[own][known], bits_per_entry).levels(keys[own])
        level = {WORD: told[:len(number[WORD])], PAIR: told[len(number[WORD]):]}
        rows, start = [], {WORD: 0, PAIR: 0}
        for block, kind, sent in zip(table["block"].to_pylist(), kinds.tolist(), table["keys"]):
            a = start[kind]
            b = start[kind] = a + sent.as_buffer().size // KEY[kind]
            own = back[kind][a:b]
            rows.append((place, block, kind, level[kind][own].tobytes(), _packed(number[kind][own]) if kind == WORD else None, None, None))
        rows.append((place, 0, TOTAL, None, None, None, [int((number[WORD] > 0).sum())]))
        return _travel(*rows)

    return sent.groupBy("place").applyInArrow(answer, TRAVEL)


def token_levels(docs: DataFrame, segments: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, known_log, levels, words) of every row of ``docs`` (doc_id, text, train), written.

    ``levels`` has two bytes for each token, the levels of its word and its bigram. ``n_known`` and ``known_log`` are exact:
    tokens seen in training and the sum of log10(c + 0.1) over all tokens. One more row has the number of distinct training
    words as ``words``, and nothing else. Without ``segments`` there are twice as many as ``docs`` has partitions.
    """
    segments = segments or max(1, 2 * docs.rdd.getNumPartitions())

    def home(table: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "known_log", "levels", "words"]
        if table["kind"][0].as_py() == TOTAL:
            words = sum(x[0] for x in table["sizes"].to_pylist())  # one number for each segment
            return pa.table([pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())] + [pa.array([words], pa.int64())], names)
        table = table.sort_by([("kind", "ascending"), ("place", "ascending")])
        told = {kind: table.filter(pc.equal(table["kind"], kind)) for kind in (WORD, PAIR, TEXTS)}
        level = {kind: np.frombuffer(b"".join(told[kind]["keys"].to_pylist()), np.uint8) for kind in (WORD, PAIR)}
        count = np.concatenate([_unpacked(x) for x in told[WORD]["numbers"].to_pylist()]).astype(np.int64)
        place, [own] = {}, told[TEXTS].to_pylist()
        n, size = len(own["ids"]), sum(own["sizes"])
        owner, words = np.repeat(np.arange(n), own["sizes"]), _unpacked(own["keys"])
        number = _unpacked(pa.decompress(own["numbers"], 4 * size, "zstd", asbytes=True), 4).astype(np.int64)
        pair = _pairs(words[number], owner)
        turned, at, back = _distinct(_turned(pair))
        for kind, order in ((WORD, _dealt(words, words, segments)[0]), (PAIR, _dealt(pair[at], turned, segments)[0])):
            if len(order) != len(level[kind]):
                raise ValueError("a block lacks answers of a segment")
            place[kind] = np.empty(len(order), np.int64)
            place[kind][order] = np.arange(len(order))
        word = place[WORD][number]
        levels = np.stack([level[WORD][word], level[PAIR][place[PAIR][back]]], 1)
        edges = pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(own["sizes"])]).astype(np.int32))
        return pa.table([pa.array(own["ids"], pa.int64()), pa.array(own["sizes"], pa.int64()),
                         pa.array(np.bincount(owner, (count > 0)[word], n).astype(np.int64)), pa.array(np.bincount(owner, np.log10(count + 0.1)[word], n)),
                         pa.Array.from_buffers(pa.binary(), n, [None, edges, pa.py_buffer(levels.tobytes())]), pa.nulls(n, pa.int64())], names)

    back = answers(blocks(docs, segments)).groupBy("block")
    return written(back.applyInArrow(home, "doc_id long, n_tokens long, n_known long, known_log double, levels binary, words long"))


@dataclass
class Model:
    docs_tokens: int    # N
    words: int          # V
    trust: np.ndarray = None  # by level of the history: weight of the bigram estimate


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For every token its levels of word, bigram and history (0 at the begin) in one number, and the first token of every row."""
    column = batch.column("levels").to_pylist()
    levels = np.minimum(np.frombuffer(b"".join(column), np.uint8).reshape(-1, 2), 63).astype(np.int32)
    first = np.cumsum([0, *(len(x) // 2 for x in column)])[:-1]
    history = np.concatenate([[0], levels[:-1, 0]])
    history[first] = 0
    return levels[:, 0] << 12 | levels[:, 1] << 6 | history, first


def _estimates(n: int, v: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every number of ``_cells``: p of the token from words alone, p from its bigram, and the level of its history.

    Words are smoothed as by Witten and Bell, the unseen mass shared by as many unseen words as there are seen ones.
    """
    word, pair, history = (x.ravel() for x in np.indices((64, 64, 64)))
    word, pair = VALUES[word], VALUES[pair]
    context = np.maximum(VALUES[history], pair)
    single = np.maximum(word, 0.5) if not leave_out else np.maximum(word - 1, 0.5)
    one = np.where(single >= 1, single / max(n + v, 1), 1.0 / (n + v) if v else 1.0)
    less = 1.0 if leave_out else 0.0
    two = np.maximum(pair - less - 0.5, 0) / np.maximum(context - less, 1)
    return one, two, history


GRADES = np.linspace(-6, 12, 73)


def calibrate(levels: DataFrame, model: Model, rounds: int = 30) -> np.ndarray:
    """Weights of the bigram estimate by level of the history, by expectation-maximisation over the rows of ``levels`` as if each was left out.

    Levels are read once: a table of (level, graded ratio of the two estimates) is all that EM needs; it has at most
    64 * 74 cells. The rows are training rows, so one is taken off their own counts.
    """
    n, v = model.docs_tokens, model.words

    def grade(batches):
        one, two, history = _estimates(n, v, True)
        cell = np.where(two > 0, np.searchsorted(GRADES, np.log10(np.maximum(two, 1e-30) / one)), 0)
        cell += history * (len(GRADES) + 1)
        table = np.zeros(64 * (len(GRADES) + 1), np.int64)
        for batch in batches:
            table += np.bincount(cell[_cells(batch)[0]], minlength=len(table))
        i, j = np.nonzero(table.reshape(64, -1))
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(table.reshape(64, -1)[i, j])], ["i", "j", "n"])

    cells = levels.select("levels").mapInArrow(grade, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((64, len(GRADES) + 1))
    for r in cells:
        table[r.i, r.j] = r.n
    ratio = np.concatenate([[0.0], 10 ** ((GRADES[1:] + GRADES[:-1]) / 2), [10 ** GRADES[-1]]])
    weight = np.full(64, 0.2)
    for _ in range(rounds):
        share = weight[:, None] * ratio / (weight[:, None] * ratio + 1 - weight[:, None])
        weight = np.clip((table * share).sum(1) + 0.05, 0, None) / (table.sum(1) + 1)
        weight = np.clip(weight, 1e-4, 0.95)
    return weight


def score(levels: DataFrame, model: Model) -> DataFrame:
    """Rows of ``token_levels`` with score, log10 of the model's probability of the whole text, in place of their levels.

    p(w | v) = trust(v) * p_bigram(w | v) + (1 - trust(v)) * p_word(w), all from counts that probes of the filter give.
    """
    n, v, trust = model.docs_tokens, model.words, model.trust

    def total(batches):
        one, two, history = _estimates(n, v, False)
        log = np.log10(trust[history] * two + (1 - trust[history]) * one)
        for batch in batches:
            cells, first = _cells(batch)
            scores = np.add.reduceat(log[cells], first) if len(first) else np.zeros(0)
            yield pa.record_batch([*(c for c, name in zip(batch.columns, batch.schema.names) if name != "levels"), pa.array(scores, pa.float64())],
                                  [*(name for name in batch.schema.names if name != "levels"), "score"])

    kept = levels.drop("words")
    return kept.mapInArrow(total, kept.drop("levels").withColumn("score", F.lit(0.0)).schema)


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Everything is learned from the rows whose crc32(doc_id as text) mod 10 is not 0. A NULL or empty text is its end
    alone; a NULL doc_id is a training row unless crc32('') mod 10 is 0, which it is, so it is held out. Repeated rows
    give repeated rows. An empty table gives an empty one; without training rows N and V are 0.
    """
    held_out = remainder("doc_id", 10) == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    levels = token_levels(docs.withColumn("train", ~held_out))
    rows, train = levels.filter("words is null"), levels.filter("words is null").filter(~held_out)
    sums = levels.agg(F.sum(F.when(F.col("words").isNull() & ~held_out, F.col("n_tokens"))).alias("n"), F.sum("words").alias("v")).first()
    model = Model(sums.n or 0, sums.v or 0)
    model.trust = calibrate(train, model)
    n, v = model.docs_tokens, model.words
    below = float(np.log10(n + 0.1 * (v + 1)))
    return score(rows, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                                     (F.col("known_log") - F.col("n_tokens") * below).alias("base_score"), "score")

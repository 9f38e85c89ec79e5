"""Sum-of-squares packing: every rule against a plain count, ids against the vocabulary's own library."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from somnia.llm import levels

NAME = "word_bpe_49k.json"
TEXTS = ["", "   ", "It's THE end, isn't it? We'll see: 1234 ½² -- l'été d'ici!!", "Straße İstanbul ΣΑΣ é", "x\x1cy\x1dz \x01\x02 a\x85b c d",
         "a<|endoftext|>b <|startoftext|>", "日本語のテキスト Привет 가나", "w" * 5000, "!?" * 1500, "'s'd'la 't''ll ’s _under_score_ \U0001f600\U0001f44d"]


@pytest.fixture(scope="module")
def library():
    return levels.encoder(NAME).library


def brute(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids(library, spark, folder):
    rng = random.Random(1)
    letters = "abcXYZéÉßΔжӤ \n'',.!019_-あ中¼́Σ<|>"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    for _ in range(2):  # learned, then remembered
        got = levels.encoder(NAME).encode(pa.array(texts, pa.large_string()))
        assert [list(g) + [1] for g in got] == [brute(library, t) for t in texts]


def test_ids_after_forgetting(library, monkeypatch):
    monkeypatch.setattr(levels, "REMEMBER", 5)
    own = levels.WordEncoder(NAME)
    for text in ["one two three", "four one five", "six seven eight nine ten eleven", "one"]:
        assert list(own.encode(pa.array([text], pa.large_string()))[0]) + [1] == brute(library, text)


@pytest.mark.parametrize("size", [8, 13])
def test_least_sum_of_squares(size):
    rng, array, fills = random.Random(size), levels.LevelArray(size), collections.Counter()
    for k in range(4000):
        length = rng.choice([1, 2, 3, 5, 7])

        def total(level, length=length):
            after = fills.copy()
            if level:
                after[level] -= 1
            if level + length < size:
                after[level + length] += 1
            return sum(n * n for n in after.values())

        able = [0] + [h for h, n in fills.items() if n and h + length <= size]
        least = min(map(total, able))
        chosen = array.choose(length)
        assert chosen == max(h for h in able if total(h) == least)
        array.place(((k,), 0, length), length)
        if chosen:
            fills[chosen] -= 1
        if chosen + length < size:
            fills[chosen + length] += 1
        assert array.held == sum(h * n for h, n in fills.items())
        assert [array.count[h] for h in range(1, size)] == [fills[h] for h in range(1, size)]


@pytest.mark.parametrize("pieces", [[], [1], [7], [5, 5, 5], [3, 6, 2, 7, 7, 1, 4]])
def test_close_pads_nothing(pieces):
    array, done = levels.LevelArray(8), []
    for k, n in enumerate(pieces):
        done += [w for w in [array.place((k, 0, n), n)] if w]
    done += array.close()
    fills = [sum(b - a for _, a, b in w) for w in done]
    assert all(n & (n - 1) == 0 and n <= 8 for n in fills)
    assert sum(n < 8 for n in fills) <= 3
    held = sorted((k, x) for w in done for k, a, b in w for x in range(a, b))
    assert held == [(k, x) for k, n in enumerate(pieces) for x in range(n)]
    assert array.held == 0 and not array.count.any() and [*array.close()] == []


def check(pieces, ids, size=2048):
    """Pieces tile their documents, sequences are gapless and never padded."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        want, at = np.array(ids[doc], "<u4"), 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(want)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(want[at:at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    return by_sequence


@pytest.mark.parametrize("open_ids", [levels.OPEN_IDS, 3000])
def test_packing(spark, folder, library, open_ids):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = check(levels.pack_levels(docs.repartition(3), open_ids=open_ids).collect(), {r.doc_id: brute(library, r.text) for r in docs.collect()})
    if open_ids == levels.OPEN_IDS:
        assert sum(sum(n for _, n in parts) < 2048 for parts in found.values()) <= 3 * 11


def test_packing_odd_rows(rows, library):
    texts = [None, *TEXTS, "word " * 30_000]
    docs = rows(*enumerate(texts))
    got = levels.pack_levels(docs.withColumnRenamed("lang", "sequence_id").withColumnRenamed("n_chars", "start"))
    check(got.collect(), {k: brute(library, t) for k, t in enumerate(texts)})
    assert levels.pack_levels(rows(*enumerate(texts)).limit(0)).collect() == []
    again = levels.pack_levels(rows((3, "same text"), (3, "same text"), (None, "x")).coalesce(1)).collect()
    assert collections.Counter(p.doc_id for p in again) == {3: 2, None: 1} or sum(p.length for p in again if p.doc_id == 3) == 6

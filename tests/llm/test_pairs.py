"""Near copies, test items, vectors, shards, packing: against brute force on small tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnia.llm import common, decontam, neardup, packing, sharding, vectors

FOLD = {i: i + 32 for i in range(65, 91)}


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
    return collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(texts):
    bags, low = [bag(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                both = sum((bags[i] & bags[j]).values())
                total = sum((bags[i] | bags[j]).values())
                if texts[i] == texts[j] or total and both / total >= 0.8:
                    low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(20)]
    out = []
    for w in base:
        for edits in (0, 0, 1, 2, 3, 6, 12):
            own = list(w)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += ["", "", "one two", "One  two", "one two three", "x " * 400, "x " * 420]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [32, 2])  # 2: every open bucket is compared by tiles
def test_near_copies(rows, copies, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TILE", 16)
    got = neardup.near_copies(rows(*enumerate(copies)))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(brute_classes(copies)))


def test_near_copies_odd_rows(rows):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = rows((None, text), (7, text), (5, None), (6, ""), (None, None), (7, text), (8, "other words of this table here")).withColumn("key", F.lit(1))
    got = sorted([(r.doc_id, r.class_id) for r in neardup.near_copies(docs).collect()], key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (5, 5), (None, 5), (6, 5), (8, 8)], key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 8]
    assert neardup.near_copies(rows()).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 1 << 62, 60).astype(np.uint64)])
    code, copy, owner = neardup.cells(np.concatenate([a, b]), np.repeat([0, 1], 300))
    names = neardup.darts(code, copy, owner, 2, 4096)
    assert abs((names[0] == names[1]).mean() - 240 / 360) < 0.04


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: low[x] for x in linked}


def test_test_items(spark, rows):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(12)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(0, " ".join(items[0])), (98, None), (None, "x y z"), (99, "")], "item_id long, text string")
    filler = lambda n: [word() for _ in range(n)]
    edited = [w if k % 7 else word() for k, w in enumerate(items[1])]
    shorter = items[2][:15] + items[2][19:]
    docs = rows((1, " ".join(filler(80) + items[0] + filler(900))), (2, " ".join(filler(30) + edited + filler(5))), (3, " ".join(shorter)),
                (4, " ".join(filler(300))), (5, None), (6, ""), (7, " ".join(filler(20) + items[3][:8] + filler(20))), (None, " ".join(items[4])))
    for block in (1_000_000, 100):
        got = decontam.contaminated(docs, bench, words_per_block=block).collect()
        assert sorted([(r.doc_id, r.item_id) for r in got], key=str) == sorted([(1, 0), (2, 1), (3, 2), (None, 4)], key=str)
    exact = next(r for r in got if r.doc_id == 1)
    assert exact.score == 1 and (exact.first_word, exact.last_word) == (80, 120)
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [4, 5, 6, 7]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_test_items_with_dense_edits(spark, rows):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(7))
    items = [[word() for _ in range(n)] for n in (20, 40, 20, 40, 20, 40, 25, 6, 2)]
    put = lambda w, every: [x for k, own in enumerate(w, 1) for x in ([own] if k % every else [own, word()])]
    texts = [put(items[0], 3), put(items[1], 3), [w if k % 4 else word() for k, w in enumerate(items[2], 1)], [w if k % 4 else word() for k, w in enumerate(items[3], 1)],
             [w for k, w in enumerate(items[4], 1) if k % 4], [w for k, w in enumerate(items[5], 1) if k % 4],
             [x for k, own in enumerate(items[6]) for x in ([own] if k % 4 == 0 else [own, word()])], put(items[7], 2), items[8]]
    docs = rows(*[(k, " ".join([word() for _ in range(60)] + t + [word() for _ in range(60)])) for k, t in enumerate(texts)], (50, " ".join(word() for _ in range(90))))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(len(items))]
    assert all(0.6 <= r.score == slow_alignment(items[r.item_id], docs.filter(F.col("doc_id") == r.doc_id).first().text.split()) / len(items[r.item_id]) for r in got)
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [50]


def slow_alignment(a, b):
    s, best = np.zeros((len(a) + 1, len(b) + 1)), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), s[i - 1, j] - 0.5, s[i, j - 1] - 0.5)
            best = max(best, s[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64)
        assert decontam.align(a, b)[0] == pytest.approx(slow_alignment(a, b))


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.25 * rng.normal(size=(150, 16)), np.tile(centres[:1], (40, 1))])
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [float("inf")] + [1.0] * 15), (905, []), (906, [1.0, 2.0]), (None, [3.0] * 3), (907, [1e300] * 16), (908, [1e-300] * 16)]
    got = {r.vec_id: r for r in vectors.links(spark.createDataFrame(table + odd, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(table) + len(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(near, low[None], len(x)).min(1)
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == low.tolist()
    assert got[900].n_links == 0 and got[900].component_id == 900 and got[907].n_links == 1 and got[908].component_id == 907 and not got[None].kept
    assert vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_are_not_dealt_to_their_partners(spark, monkeypatch):
    """Blocks are read where they lie: what compares them shuffles nothing, and links over blocks and tiles are those of brute force."""
    monkeypatch.setattr(vectors, "TILE", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 40)).astype(np.float32)
    x[300:] = x[rng.integers(0, 60, 300)] + 0.25 * rng.normal(size=(300, 40)).astype(np.float32)  # some of them stand near 0.9
    plans, write = [], vectors.written

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return write(df)

    monkeypatch.setattr(vectors, "written", seen)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.links(table).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    assert near.sum() > 2 * len(x)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(near, low[None], len(x)).min(1)
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == low.tolist()
    compared = [plan for columns, plan in plans if columns == ["row", "n", "hub"]]
    assert len(compared) == 1 and "Exchange" not in compared[0]


def test_bound_of_vectors():
    rng = np.random.default_rng(6)
    for size in (2, 24, 64):
        x = rng.normal(size=(200, size))
        x[100:] = x[:100] + 0.3 * rng.normal(size=(100, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        low = vectors.bounded(x)
        assert ((low @ low.T) - x @ x.T > -1e-5).all()
        i, j = vectors.block_links(x, x, 0.9, True)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9)) if a < b}


def test_shards(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 37)
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    pairs += [(5000 + k, "the same text") for k in range(150)] + [(9000, None), (9001, None), (9002, ""), (9003, "é"), (9003, "é"), (None, "no id")]
    got = sharding.shard_documents(rows(*pairs).withColumn("shard", F.lit("x"))).toPandas()
    assert len(got) == len(pairs)
    sizes = got["shard"].value_counts()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1 and (got.law == "rows").all() and got.grown_shard.isna().all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    assert sorted((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.size, r.text_crc32) for r in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)
                  ) == want or sorted((str(None if np.isnan(i) else int(i)), s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32)) == want
    spread = got.groupby("group_id")["shard"].nunique()
    assert (spread > 1).sum() <= 3  # the group of 150 is larger than a shard
    assert sharding.shard_documents(rows()).count() == 0


def test_packing(spark, rows, folder):
    from public_tokenizers import path
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()][:120]
    pairs += [(9000, None), (9001, ""), (9002, "a" * 5000), (9003, "see <|endoftext|> here"), (9004, " \n\t " * 1000), (9005, "ß漢字🙂 " * 3000), (None, "no id"), (9006, "twice"), (9006, "twice")]
    got = packing.pack_documents(rows(*pairs)).toPandas()
    want = collections.Counter()
    for i, t in pairs:
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want.update((str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert collections.Counter((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id").length
    assert (by.cumsum() - got.length == got.offset).all() and by.sum().max() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.1 + 1
    assert packing.pack_documents(rows()).count() == 0


def test_open_bins_take_the_best_fit():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 5, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 5)]
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n) for n in (4, 8, 2)] == [(0, 0), (1, 0), (1, 8)]  # bin 0 was closed for room

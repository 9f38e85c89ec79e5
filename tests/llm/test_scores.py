"""Classifiers by held-out accuracy, language-model scores against a count in plain Python."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from somnia.llm import lm, quality, queries, toxicity

FOLD = {i: i + 32 for i in range(65, 91)}
LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.9), ("op3_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().drop_duplicates("doc_id")
    own = got[got.held_out].merge(labels, on="doc_id")
    assert auc(own.score.to_numpy(), own[label].to_numpy()) > least


def test_rules_row_by_row(spark, folder):
    """The compiled column against the rules applied to each row's statistics in plain Python; other columns pass through."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    assert rules.rules and quality.fit(docs.repartition(5), labels).rules == rules.rules
    named = docs.withColumns({"__text": F.lit(7), "__words": F.lit("w"), "__row": F.lit(1)})
    got = {r.doc_id: r for r in quality.score(named, rules).collect()}
    for r in quality.statistics(docs, ["doc_id"]).collect():
        total = rules.constant
        for rule, weight in zip(rules.rules, rules.weights):
            total += weight * all((r["__" + n] > edge) == above for n, above, edge in rule)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
        assert (got[r.doc_id]["__text"], got[r.doc_id]["__words"], got[r.doc_id]["__row"]) == (7, "w", 1)


def test_classifiers_take_odd_rows(spark, rows):
    docs = rows((1, None), (2, ""), (None, "some words"), (3, "word " * 30_000), (3, "word " * 30_000)).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 1)], LABELS)):
        assert toxicity.score(docs, toxicity.fit(docs, labels)).filter("score between 0 and 1").count() == 5
        assert quality.score(docs, quality.fit(docs, labels), ["doc_id"]).filter("score between 0 and 1").count() == 5
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
    assert quality.score(empty, quality.fit(empty, none), ["doc_id"]).count() == 0


def expected(pairs):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None] for _, t in pairs]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in pairs]
    c = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = [sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in words]
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(b, 6)) for (i, _), ws, h, b in zip(pairs, words, held, base)]


def test_language_scores_base(spark, rows, folder):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    pairs += [(9001, None), (9002, ""), (9003, "A a\tb\x0bB c"), (9003, "A a\tb\x0bB c"), (None, "lost words"), (9004, "long " * 50_000)]
    got = lm.language_scores(rows(*pairs)).toPandas()
    mine = [(None if np.isnan(r.doc_id) else int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()]
    assert sorted(mine, key=str) == sorted(expected(pairs), key=str)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_language_scores_by_hand(rows, spark, folder, monkeypatch):
    """Scores from exact counts, put into levels by hand, with a filter too roomy to err; the filter in two and more slices."""
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 96)
    monkeypatch.setattr(lm, "SLICE_BYTES", 100_000)
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None] for i, t in pairs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    one = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    two = collections.Counter(p for i, ws in words.items() if not held[i] for p in zip(["begin", *ws], ws))
    n, v = sum(one.values()), len(one)
    level = lambda c: 0 if c == 0 else c.bit_length()
    value = lambda q: [0, 1][q] if q < 2 else (2.0 ** (q - 1) * (2.0 ** q - 1)) ** 0.5

    def estimates(ws, own):
        out = []
        for before, w in zip([None, *ws], ws):
            first = before is None
            q = 0 if first else level(one[before])
            c, pair = value(level(one[w])), value(level(two[("begin" if first else before, w)]))
            single = max(c - own, 0.5)
            p1 = single / (n + v) if single >= 1 else 1 / (n + v)
            out.append((p1, max(pair - own - 0.5, 0) / max(max(value(q), pair) - own, 1), q))
        return out

    table = np.zeros((64, len(lm.GRADES) + 1))
    for i, ws in words.items():
        for p1, p2, q in estimates(ws, 1) if not held[i] else ():
            table[q, np.searchsorted(lm.GRADES, np.log10(p2 / p1)) if p2 > 0 else 0] += 1
    ratio = np.array([0, *(10 ** ((a + b) / 2) for a, b in zip(lm.GRADES, lm.GRADES[1:])), 10 ** lm.GRADES[-1]])
    trust = np.full(64, 0.2)
    for _ in range(30):
        share = trust[:, None] * ratio / (trust[:, None] * ratio + 1 - trust[:, None])
        trust = np.clip(((table * share).sum(1) + 0.05) / (table.sum(1) + 1), 1e-4, 0.95)
    got = {r.doc_id: r.score for r in lm.language_scores(rows(*pairs)).collect()}
    for i, ws in words.items():
        want = sum(np.log10(trust[q] * p2 + (1 - trust[q]) * p1) for p1, p2, q in estimates(ws, 0))
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_weights_are_learned_from_all_training_rows(rows):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 > 1][:60]
    held = next(i for i in range(400, 900) if zlib.crc32(str(i).encode()) % 10 == 0)
    text = "one red fox ran over two old hills " * 8
    docs = rows(*[(i, text) for i in ids], (held, text))  # no row of remainder 1
    got = next(r for r in lm.language_scores(docs).collect() if r.doc_id == held)
    assert got.score > 0.4 * got.base_score  # every word but the first follows its predecessor for certain


def test_bigrams_seen_once_count(rows):
    split = lambda held: [i for i in range(900) if (zlib.crc32(str(i).encode()) % 10 == 0) == held]
    once, same, other = "a d b f c e", split(True)[0], split(True)[1]
    docs = rows(*[(i, "a b c d e f") for i in split(False)[:40]], (split(False)[40], once), (same, once), (other, "a f d c b e"))
    got = {r.doc_id: r for r in lm.language_scores(docs).collect()}
    assert got[same].base_score == pytest.approx(got[other].base_score) and got[same].score > got[other].score + 0.1


def test_slices_give_the_same_scores(rows, folder, spark, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    whole = {r.doc_id: r.score for r in lm.language_scores(docs).collect()}
    monkeypatch.setattr(lm, "SLICE_BYTES", 30_000)
    cut = {r.doc_id: r.score for r in lm.language_scores(docs).collect()}
    assert len(whole) == len(cut) and max(abs(whole[k] - cut[k]) for k in whole) < 0.02 * max(abs(x) for x in whole.values())


def test_language_scores_of_nothing(rows):
    assert lm.language_scores(rows()).count() == 0


def test_filter_stays_with_the_workers(spark, rows, folder, monkeypatch):
    """Nothing is broadcast and nothing binary collected, however many slices the filter has."""
    monkeypatch.setattr(lm, "SLICE_BYTES", 30_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def refused(*_):
        raise AssertionError("a broadcast")

    collected, collect = [], type(docs).collect

    def seen(df):
        collected.extend(f.dataType.typeName() for f in df.schema)
        return collect(df)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    monkeypatch.setattr(type(docs), "collect", seen)
    scores = lm.language_scores(docs)
    assert collected and "binary" not in collected
    assert scores.count() == docs.count()


def test_powers_are_not_sent(spark):
    """What the driver has hashed does not make the functions that tasks get any larger, up to a broadcast."""
    import pyarrow as pa
    from pyspark import cloudpickle
    from somnia.llm import common
    column = pa.array(["a b " * 50_000, "B c"], pa.large_string())
    here = [h.tolist() for _, _, h, _ in common.hashed_words(column)]
    assert len(common._POWERS[0]) >= 1 << 16
    sent = cloudpickle.dumps(common.hashed_words)
    assert len(sent) < 100_000 and [h.tolist() for _, _, h, _ in cloudpickle.loads(sent)(column)] == here


def test_blocks_give_the_same_scores(spark, rows, folder, monkeypatch):
    """Blocks of some hundred tokens, with copies in several of them, NULL and repeated ids and texts longer than a block."""
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    pairs = [*pairs, *pairs, (9003, "A a\tb\x0bB c"), (9003, "A a\tb\x0bB c"), (9003, None), (None, "lost words"), (None, ""), (9004, "long " * 2_000)]
    whole = sorted(lm.language_scores(rows(*pairs)).collect(), key=str)
    monkeypatch.setattr(lm, "BLOCK", 300)
    cut = sorted(lm.language_scores(rows(*pairs)).collect(), key=str)
    assert [r[:5] for r in cut] == [r[:5] for r in whole]
    assert np.allclose([r[5:] for r in cut], [r[5:] for r in whole], rtol=1e-9)
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in cut]
    assert sorted(mine, key=str) == sorted(expected(pairs), key=str)


def test_a_block_without_an_answer_is_an_error(rows, monkeypatch):
    answers = lm.answers
    monkeypatch.setattr(lm, "answers", lambda sent: answers(sent).filter(f"kind <> {lm.PAIR} or place <> 0"))
    with pytest.raises(Exception, match="lacks answers"):
        lm.language_scores(rows(*[(i, f"some words and a {i}") for i in range(50)])).count()

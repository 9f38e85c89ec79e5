"""Merkle manifest: SQL, a plain tree in Python, and cases the tables do not hold."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from somnia.llm import merkle, queries

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """Root of a list of digests and, for each, what stands left and right of its path at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, at):
            run = nodes[p // 3 * 3:p // 3 * 3 + 3]
            path.append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        nodes = [h(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def brute(docs):
    """Rows of the contract for (doc_id, source, lang, n_chars, text)."""
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for d in docs:
        leaf = h(*map(field, d))
        text = d[4] if d[4] is None or zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 2 else d[4].replace("\n", "")
        groups.setdefault(d[1], []).append((first(d[0]), leaf, h(*map(field, (*d[:4], text)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (key, leaf, now), path in zip(sorted(groups[s]), trees[s][1]):
            folded = now
            for a, b in path + top:
                folded = h(a, folded, b)
            out.append((key[1] if key[0] else None, leaf, trees[s][0], root, h(*(a + b for a, b in path + top)), folded, folded == root))
    return out


def found(spark, tmp_path, docs):
    from somnia.llm.queries import op11_manifest
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in op11_manifest(spark, str(tmp_path)).select(*COLUMNS).collect()]


def key(row):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in row)


def test_sql(spark, folder):
    got = queries.op11_manifest(spark, folder).toPandas()
    assert compare(got, connect(folder).sql(merkle.SQL).df()) is None
    assert 0 < got.verified.sum() < len(got)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1])  # 1: four and more tiers of blocks
def test_brute(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs = [(k, None if k % 5 == 0 else f"s{k % 3 * 10}", "en", 3, f"a\nb{k}") for k in range(60)]
    docs += [(k, "é" if k % 2 else "z", None, None, None if k % 4 else "no break") for k in range(100, 110)]
    docs += [(7, "one", "en", 1, "x\ny"), (None, "two", "en", 1, ""), (None, "two", None, 1, "x" * 100_000 + "\n")]
    docs += [(500, "same", "en", 2, "p\nq")] * 7 + [(500, "same", "en", 2, "other")]
    got = found(spark, tmp_path, spark.createDataFrame(docs, DOCS).repartition(5))
    assert sorted(got, key=key) == sorted(brute(docs), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source(spark, tmp_path, n):
    docs = [(k, "s", "en", 1, "t\n") for k in range(n)]
    assert sorted(found(spark, tmp_path, spark.createDataFrame(docs, DOCS))) == sorted(brute(docs))


def test_empty_and_clashing(spark, tmp_path):
    assert found(spark, tmp_path / "a", spark.createDataFrame([], DOCS)) == []
    docs = spark.createDataFrame([(1, "s", "en", 1, "t"), (2, None, "en", 1, "u")], DOCS)
    extra = docs.withColumns({c: F.lit(5) for c in ("pos", "hash", "n", "root", "kid", "id", "_at", "block")})
    assert sorted(found(spark, tmp_path / "b", extra)) == sorted(brute([tuple(r) for r in docs.collect()]))

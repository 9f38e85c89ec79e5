"""Repair of conversations: least cost and least audit against a search over all edits, rows against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from somnia.llm import queries, turns

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def prefix(roles):
    """Whether more turns can make it fit."""
    return bool(re.fullmatch(r"s?(ua)*u?", roles))


def search(rows):
    """(cost, audit, repaired) of (role, text, fault): a plain best-first search over whole edit strings, no states."""
    heap = [(0, "", 0, "", ())]
    seen = {}
    best = None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        key = (i, roles[:1] == "s", len(roles) == 0, roles[-1:])
        if seen.get(key, (cost, audit)) < (cost, audit) and seen[key][0] < cost:
            continue
        seen.setdefault(key, (cost, audit))
        if i == len(rows) and GRAMMAR.match(roles):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
        edits = [("I", i, r[0], INS, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            more = fault == "truncated"
            edits.append(("D", i + 1, "", 3, None))
            if fault not in ("blank", "duplicate"):
                edits.append(("K", i + 1, role[:1] or "?", more, f"{role}:{text}"))
                edits += [("R", i + 1, r[0], 2 + more, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, j, initial, price, line in edits:
            if prefix(roles + initial) and len(audit) < 3 * len(rows) + 4:
                heapq.heappush(heap, (cost + price, audit + letter, j, roles + initial, out + ((line,) if line is not None else ())))
    return best


INS = 2


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), text[:64].encode(), hashlib.md5(text.encode()).hexdigest()


def brute(conversations):
    """Contract rows of {conv: [(turn, role, text)]} after damage."""
    out = []
    for conv, rows in conversations.items():
        rows = sorted(rows, key=order)
        found = faults([r[1:] for r in rows])
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[1][:1] for r in rows]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = search([(r[1], r[2], f) for r, f in zip(rows, found)])
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, df):
    pieces = turns.repair(turns.damaged(df), F.col("kept"))
    return sorted((tuple(r) for r in turns.summary(pieces).select(*COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(rng, n, most):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            text = rng.choice(["Yes.", "No", " \n", "What?", "ok.\t", "x" * 5, f"t{turn}.", f"t{turn}", "", "é!"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, text))
    return rows


def odd():
    out = [(None, 1, "user", "hi."), (None, None, None, None), (None, 2, "assistant", "yes.")]
    out += [(900, k, "user", "x.") for k in range(6)] + [(901, None, None, "x.")] * 4 + [(902, 3, "system", "only.")]
    out += [(903, 0, "user", "long " * 30_000 + "."), (903, 1, "assistant", "w" * 100_000)]
    dropped = next(k for k in range(1000) if zlib.crc32(f"904:{k}".encode()) % 20 == 0)
    return out + [(904, dropped, "user", "gone.")]


@pytest.mark.parametrize("segment", [turns.SEGMENT, 3, 1])  # 3, 1: chained segments
def test_brute(spark, monkeypatch, segment):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    monkeypatch.setattr(turns, "PIECE", 6)
    rows = conversations(random.Random(segment), 60, 9) + odd()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("q") for c in ("conv", "kept", "symbol", "block", "pos", "c", "p")})
    want = brute(damage(rows))
    assert found(spark, df) == want
    con = connect("/none")
    con.register("conversations", pa.table(dict(zip(["conv_id", "turn", "role", "text"], map(list, zip(*rows)))), pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    assert sorted(con.sql(turns.SQL).fetchall(), key=lambda r: (r[0] is not None, r[0] or 0)) == want


def test_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_turn_repair(spark, folder)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(damage(rows))
    assert compare(got.toPandas(), connect(folder).sql(turns.SQL).df()) is None


def test_empty(spark):
    assert found(spark, spark.createDataFrame([], SCHEMA)) == []
    assert found(spark, spark.createDataFrame(odd()[-1:], SCHEMA)) == [(904, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_runs_match_single_steps():
    rng = random.Random(5)
    for _ in range(300):
        symbols = [s for _ in range(rng.randint(0, 6)) for s in [turns.symbol(rng.randrange(4), rng.randrange(4))] * rng.choice([1, 1, 2, 3, 20])]
        v = end = turns._ahead(turns._inserts(), turns.END)
        for s in reversed(symbols):
            v = turns._ahead(turns.power(s, 0), v)
        runs = turns.runs(symbols)
        assert turns._ahead(turns.transition(runs), end) == v
        audit, state = turns.unroll(runs, turns.START, end)
        audit += turns.closing(state)
        text = ["blank" if s % 4 == 1 else "duplicate" if s % 4 == 2 else "truncated" if s % 4 == 3 else "" for s in symbols]
        price = {"K": 0, "R": 2, "D": 3, "I": 2}
        rows, total, i = [], 0, 0
        for letter in audit:
            total += price[letter] + (letter in "KR" and text[i] == "truncated")
            i += letter != "I"
        assert total == v[0] and i == len(symbols)
        roles = "".join(line[0] for line in turns.lines(audit, ((s, "sua?"[s // 4], "") for s in symbols)))
        assert GRAMMAR.match(roles), rows


def test_long_run_is_linear():
    symbols = [turns.symbol(1, 0)] * 200_000
    audit, _ = turns.unroll(turns.runs(symbols), turns.START, turns._ahead(turns._inserts(), turns.END))
    assert len(audit) >= 200_000

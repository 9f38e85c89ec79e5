"""Repair of conversation structure at least cost: runs of equal symbols, min-plus powers of their transitions, unrolled edits."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somnia.operators.ordered import ranked

from .common import CRC_TABLE, crc_sql, written

# Fixed values of the task.
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
LEGAL = {"su", "ua", "au"}

#: Rows and bytes of text up to which one task repairs a conversation in one piece; longer ones go by segments of as many rows.
SEGMENT = 1000
SEGMENT_BYTES = 16 << 20
#: Bytes of repaired text in a piece of a long conversation.
PIECE = 4 << 20

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = "sua?"  # initials that can be kept, then all others
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
END = (0, FAR, FAR, 0)
#: The role that an inserted or renamed turn takes in each state.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}

Vector = tuple[int, int, int, int]


def symbol(role: int, fault: int) -> int:
    return role * 4 + fault


def kept_state(sym: int, state: int) -> int | None:
    """State after keeping a turn, None if its role cannot stand there."""
    role = sym // 4
    if sym % 4 in (BLANK, DUPLICATE) or role == 3:
        return None
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if NEXT[state] == role + 1 else None


def _moves(sym: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of one turn, by letter."""
    yield "D", state, DELETE
    if sym % 4 in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED_KEPT if sym % 4 == TRUNCATED else 0
    after = kept_state(sym, state)
    if after is not None:
        yield "K", after, extra
    yield "R", NEXT[state], REROLE + extra


def _times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two transitions."""
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def _ahead(a: tuple, v: Vector) -> Vector:
    return tuple(min(FAR, *(a[i][k] + v[k] for k in range(4))) for i in range(4))


@functools.cache
def _inserts() -> tuple:
    """Least cost from state to state by inserted turns alone."""
    step = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else FAR for j in range(4)) for i in range(4))
    return _times(_times(step, step), step)


@functools.cache
def power(sym: int, k: int) -> tuple:
    """Transition of 2 ** k turns of one symbol, inserts before each of them included."""
    if k:
        half = power(sym, k - 1)
        return _times(half, half)
    own = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, after, cost in _moves(sym, state):
            own[state][after] = min(own[state][after], cost)
    return _times(_inserts(), tuple(map(tuple, own)))


def runs(symbols: Iterable[int]) -> list[tuple[int, int]]:
    """Equal consecutive symbols as (symbol, length)."""
    return [(s, sum(1 for _ in same)) for s, same in itertools.groupby(symbols)]


def before_run(sym: int, length: int, v: Vector) -> Vector:
    """Least costs to the end by state before a run, from those after it."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            v = _ahead(power(sym, k), v)
    return v


def transition(found: list[tuple[int, int]]) -> tuple:
    """Transition of a whole segment."""
    columns = []
    for j in range(4):
        v = tuple(0 if i == j else FAR for i in range(4))
        for sym, length in reversed(found):
            v = before_run(sym, length, v)
        columns.append(v)
    return tuple(zip(*columns))


@functools.lru_cache(maxsize=1 << 16)
def _shifted(sym: int, v: Vector) -> tuple[Vector, int]:
    """Costs before one turn, with the least of them taken out."""
    v = _ahead(power(sym, 0), v)
    return tuple(x - min(v) if x < FAR else FAR for x in v), min(v)


@functools.lru_cache(maxsize=1 << 16)
def _edit(sym: int, state: int, v: Vector) -> tuple[str, int]:
    """Letters up to and with the edit of one turn, and the state after it, given the costs after it: the least string."""
    here = _ahead(power(sym, 0), v)
    letters = ""
    while True:
        choices = [(letter, after) for letter, after, cost in _moves(sym, state) if cost + v[after] == here[state]]
        insert = INSERT + here[NEXT[state]] == here[state]
        if insert and (not choices or choices[0][0] > "I"):
            letters, state = letters + "I", NEXT[state]
            continue
        letter, after = choices[0]
        return letters + letter, after


def unroll(found: list[tuple[int, int]], state: int, v: Vector) -> tuple[str, int]:
    """The cheapest edits of a segment from ``state``, given the costs after it; of equal costs the least string.

    Costs after each run come from powers, those inside a run from single steps that are remembered without their level.
    """
    after = [v]
    for sym, length in reversed(found):
        after.append(before_run(sym, length, after[-1]))
    letters = []
    for (sym, length), end in zip(found, reversed(after[:-1])):
        least = min(end)
        costs = [tuple(x - least if x < FAR else FAR for x in end)]
        for _ in range(length - 1):
            costs.append(_shifted(sym, costs[-1])[0])
        for v in reversed(costs):
            part, state = _edit(sym, state, v)
            letters.append(part)
    return "".join(letters), state


def closing(state: int) -> str:
    """Inserts at the end of a conversation."""
    return "" if END[state] == 0 else "I" * (_ahead(_inserts(), END)[state] // INSERT)


def lines(audit: str, turns: Iterable[tuple[int, str, str]], state: int = START) -> Iterator[str]:
    """Repaired ``role:text`` from edits and turns (symbol, role, text)."""
    turns = iter(turns)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{NAMES[state]}:"
            continue
        sym, role, text = next(turns)
        if letter == "K":
            state = kept_state(sym, state)
            yield f"{role}:{text}"
        elif letter == "R":
            state = NEXT[state]
            yield f"{NAMES[state]}:{text}"


def illegal(symbols: list[int]) -> int:
    initials = [ROLES[s // 4] for s in symbols]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 500, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows and about ``most`` characters."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(len(x) for x in row if isinstance(x, str))
        if len(part) >= size or held >= most:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _stream(df: DataFrame, rows, names: list[str], schema: str) -> DataFrame:
    """``rows(iterator of tuples of names)`` over every task's rows in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(*names).mapInArrow(lambda batches: _batches(rows(_rows(batches, *names)), arrow), schema)


def _marks(role: Column, text: Column) -> tuple[Column, Column]:
    """Symbol of the role and the fault that the text alone shows."""
    stripped = F.rtrim(text, F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(~F.substring(stripped, -1, 1).isin(*STOPS), TRUNCATED).otherwise(NONE)
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return kind, fault


def _symbols(fault: Column, again: Column) -> Column:
    """Blank before duplicate before truncated."""
    return (F.col("kind") * 4 + F.when((fault != BLANK) & again, DUPLICATE).otherwise(fault)).cast("int")


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = "block long, part long, " + FOUND + ", repaired string"
#: Turns of a conversation in their order; ties by role, by the start of the text, by its digest.
ORDER = ["turn", "role", "start", "mark"]


def _counts(symbols: list[int]) -> list[int]:
    return [sum(s % 4 == f for s in symbols) for f in (BLANK, DUPLICATE, TRUNCATED)]


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of at most a segment, each repaired where its rows meet."""
    again = F.row_number().over(Window.partitionBy("conv", "role", "mark").orderBy("turn")) > 1
    rows = rows.repartition("conv").withColumn("symbol", _symbols(F.col("fault"), again)).sortWithinPartitions("conv", *ORDER)

    def repair(stream):
        for conv, group in itertools.groupby(stream, key=lambda r: r[0]):
            own = [r[1:] for r in group if r[1]]
            symbols, turns = [r[1] for r in own], {r[4] for r in own if r[4] is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            found, last = runs(symbols), _ahead(_inserts(), END)
            audit, state = unroll(found, START, last)
            audit += closing(state)
            cost = functools.reduce(lambda v, run: before_run(*run, v), reversed(found), last)[START]
            repaired = "\n".join(lines(audit, (r[1:4] for r in own)))
            yield conv, 0, 0, gaps, *_counts(symbols), illegal(symbols), cost, audit, repaired

    return _stream(rows, repair, ["conv", "kept", "symbol", "role", "text", "turn"], f"conv {kind}, {PIECES}").withColumn("whole", F.lit(True))


def _long(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of any length by segments: their transitions and choices are found apart and chained in order.

    A segment's edits depend on the costs after it and on the state before it. Costs go backwards over one row per segment,
    edits are then unrolled from each of the four states, and the states go forwards over one row per segment again.
    """
    rows = ranked(written(rows.filter("kept").drop("kept")), ["conv"], [F.col(c).asc_nulls_first() for c in ORDER], "pos")
    rows = written(rows.withColumn("block", F.floor(F.col("pos") / SEGMENT).cast("long")))
    first = rows.groupBy(F.col("conv").alias("c"), "role", "mark").agg(F.min("pos").alias("p")).select("c", "p", F.lit(False).alias("again"))
    again = F.coalesce("again", F.lit(True))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left").withColumn("symbol", _symbols(F.col("fault"), again))
    rows = written(rows.select("conv", "block", "pos", "symbol", "role", "text", "turn"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    segments = rows.groupBy("conv", "block").agg(in_order["symbol"].alias("symbols"))

    def transitions(stream):
        for conv, block, symbols in stream:
            yield conv, block, symbols, [x for line in transition(runs(symbols)) for x in line]

    def backwards(stream):
        for conv, group in itertools.groupby(stream, key=lambda r: r[0]):
            v, last = _ahead(_inserts(), END), True
            for _, block, symbols, flat in group:
                after, v = v, _ahead(tuple(tuple(flat[k:k + 4]) for k in range(0, 16, 4)), v)
                yield conv, block, symbols, list(after), None if block else v[START], last
                last = False

    def choices(stream):
        for conv, block, symbols, after, cost, last in stream:
            audits, states = zip(*(unroll(runs(symbols), state, tuple(after)) for state in range(4)))
            if last:
                audits = [a + closing(s) for a, s in zip(audits, states)]
            yield (conv, block, list(audits), list(states), cost, *_counts(symbols), illegal(symbols), symbols[0], symbols[-1])

    def forwards(stream):
        for conv, group in itertools.groupby(stream, key=lambda r: r[0]):
            state, before = START, None
            for _, block, audits, states, cost, blank, duplicate, truncated, inside, one, last in group:
                across = illegal([before, one]) if before is not None else 0
                yield conv, block, -1, blank, duplicate, truncated, inside + across, cost, audits[state], state
                state, before = states[state], last

    head = f"conv {kind}, block long, "
    found = _stream(segments, transitions, ["conv", "block", "symbols"], head + "symbols array<int>, costs array<long>")
    found = _stream(found.repartition("conv").sortWithinPartitions("conv", F.desc("block")), backwards, found.columns,
                    head + "symbols array<int>, after array<long>, cost long, last boolean")
    found = _stream(found.repartition("conv", "block"), choices, found.columns, head + "audits array<string>, states array<int>, "
                    "cost long, blank long, duplicate long, truncated long, illegal long, first int, final int")
    found = _stream(found.repartition("conv").sortWithinPartitions("conv", "block"), forwards, found.columns, head + "pos long, "
                    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, state int")

    def pieces(stream):
        for (conv, block), group in itertools.groupby(stream, key=lambda r: r[:2]):
            _, _, *counts, audit, state = next(group)[:9]
            part, texts, held = 0, [], 0
            for line in lines(audit, (r[9:] for r in group), state):
                texts.append(line)
                held += len(line)
                if held >= PIECE:
                    yield conv, block, part, None, *(counts if not part else [None] * 5), None if part else audit, "\n".join(texts)
                    part, texts, held = part + 1, [], 0
            if texts or not part:
                yield conv, block, part, None, *(counts if not part else [None] * 5), None if part else audit, "\n".join(texts) if texts else None

    both = rows.drop("turn").unionByName(found, allowMissingColumns=True).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")
    cut = _stream(both, pieces, ["conv", "block", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "state", "symbol", "role", "text"], f"conv {kind}, {PIECES}")
    spans = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    spans = spans.withColumns({"block": F.lit(-1).cast("long"), "part": F.lit(0).cast("long")})
    return cut.unionByName(spans, allowMissingColumns=True).withColumn("whole", F.lit(False))


def repair(rows: DataFrame, kept: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired conversations in pieces: conv, block, part, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, whole.

    Rows count in the order of ``turn`` (NULL first; ties by role, the first 64 characters of the text and its digest).
    The first fault of a row counts: blank, duplicate (same role and text earlier), truncated (last character that is not
    white space is no stop). ``audit`` lists the cheapest edits that leave system, if any, and then user and assistant in
    turn, or nothing: K(eep), R(erole), D(elete, all blank and duplicate rows), I(nsert an empty turn); of equal costs the
    least string. ``repaired`` holds the turns that are left as ``role:text``, one per line break.

    A conversation of at most SEGMENT rows and SEGMENT_BYTES is one ``whole`` piece. A longer one, which may hold most of
    the table, has a piece for each segment and PIECE of its text, with counts to be added up, and one for ``gaps``; no task
    gets more than a segment of it, or than one row for each of its segments. Rows where ``kept`` is false only name their
    conversation: without any other row it has zeros, an empty audit and no text. NULL is a conversation of its own, a NULL
    role or text counts as one space. An empty table gives no rows; other columns are ignored.
    """
    kind = rows.schema[conv].dataType.simpleString()
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("text"), (kept if kept is not None else F.lit(True)).alias("kept"))
    size = F.sum(F.col("kept").cast("long")), F.sum(F.when(F.col("kept"), F.octet_length("role") + F.octet_length("text")))
    large = written(rows.groupBy(F.col("conv").alias("c")).agg(size[0].alias("n"), size[1].alias("b")).filter((F.col("n") > SEGMENT) | (F.col("b") > SEGMENT_BYTES)).select("c"))
    found, fault = _marks(F.col("role"), F.col("text"))
    rows = rows.withColumns({"kind": found, "fault": fault, "start": F.substring("text", 1, 64), "mark": F.md5("text")})
    if large.isEmpty():
        out = _short(rows, kind)
    else:
        same = F.col("conv").eqNullSafe(F.col("c"))
        out = _short(rows.join(large, same, "left_anti"), kind).unionByName(_long(rows.join(large, same, "left_semi"), kind))
    return out.withColumnRenamed("conv", conv)


def summary(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation from ``repair``: its counts, cost, audit and repaired_sha256, the digest of its repaired text.

    A digest runs over its text in order, so the pieces of a long conversation pass through one task, one at a time.
    """
    kind = pieces.schema[conv].dataType.simpleString()
    names = [c.split()[0] for c in FOUND.split(", ")]
    whole = pieces.filter("whole").select(conv, *names, F.sha2("repaired", 256).alias("repaired_sha256"))

    def add(stream):
        for own, group in itertools.groupby(stream, key=lambda r: r[0]):
            counts, audits, digest, begun = [0] * 6, [], hashlib.sha256(), False
            for _, *numbers, audit, text in group:
                counts = [a + (b or 0) for a, b in zip(counts, numbers)]
                audits.append(audit or "")
                if text is not None:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
            yield own, *counts, "".join(audits), digest.hexdigest()

    rest = pieces.filter("not whole").repartition(conv).sortWithinPartitions(conv, "block", "part")
    return whole.unionByName(_stream(rest, add, [conv, *names, "repaired"], f"{conv} {kind}, {FOUND}, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the remainder modulo 20 of crc32 of ``conv_id:turn``: NULL counts as one space.

    0 drops the row (``kept`` is false), 1 empties its text, 2 takes its stops out, 3 repeats it, 4 makes its role user.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("_fault"))
    out = out.withColumns({
        "text": F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")),
        "role": F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")), "kept": F.col("_fault") != 0,
        "_copy": F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))})
    return out.drop("_fault", "_copy")


#: The contract's columns in DuckDB: one recursion over rows backwards for costs, one over edits forwards for the audit.
SQL = """
WITH RECURSIVE """ + CRC_TABLE + """,
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
plain AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    """ + crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + """ % 20 AS f
  FROM conversations JOIN ids USING (conv_id), crc_table
  UNION ALL
  SELECT c, turn, coalesce(role, ' '), coalesce(text, ' '), """ + crc_sql("' :' || coalesce(CAST(turn AS VARCHAR), ' ')") + """ % 20
  FROM conversations d JOIN ids i ON d.conv_id IS NULL AND i.conv_id IS NULL, crc_table),
kept AS (
  SELECT c, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM plain WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM kept),
marked AS (
  SELECT *, left(role, 1) AS r, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
turns AS (
  SELECT *, fault NOT IN ('b', 'd') AS ok, CAST(fault = 't' AS BIGINT) AS extra,
    lag(r) OVER (PARTITION BY c ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS wrong FROM marked),
sizes AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal FROM turns GROUP BY c),
-- v[q]: least cost from row i on; q: 1 nothing yet, 2 after system, 3 after user, 4 after assistant
back AS (
  SELECT c, n + 1 AS i, [0, 4, 2, 0] AS v FROM sizes
  UNION ALL
  SELECT c, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])] FROM (
    SELECT d.c, d.i, [
      least(3 + v[1], CASE WHEN ok THEN least(2 + extra + v[3], CASE r WHEN 's' THEN extra + v[2] WHEN 'u' THEN extra + v[3] END) END),
      least(3 + v[2], CASE WHEN ok THEN least(2 + extra + v[3], CASE r WHEN 'u' THEN extra + v[3] END) END),
      least(3 + v[3], CASE WHEN ok THEN least(2 + extra + v[4], CASE r WHEN 'a' THEN extra + v[4] END) END),
      least(3 + v[4], CASE WHEN ok THEN least(2 + extra + v[3], CASE r WHEN 'u' THEN extra + v[3] END) END)] AS w
    FROM back b JOIN turns d ON d.c = b.c AND d.i = b.i - 1)),
walk AS (
  SELECT c, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, FALSE AS done FROM sizes
  UNION ALL
  SELECT c, CASE WHEN e IN ('I', '.') THEN i ELSE i + 1 END,
    CASE e WHEN 'D' THEN q WHEN '.' THEN q WHEN 'K' THEN (CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END) ELSE turn_to END,
    CASE e WHEN '.' THEN audit ELSE audit || e END,
    CASE e WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, name || text) WHEN 'I' THEN list_append(lines, name) ELSE lines END,
    e = '.'
  FROM (
    SELECT p.c, p.i, p.q, p.audit, p.lines, d.r, d.role, d.text, CASE q WHEN 3 THEN 4 ELSE 3 END AS turn_to,
      CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END AS name,
      CASE WHEN d.i IS NULL THEN (CASE WHEN b.v[q] = 0 THEN '.' ELSE 'I' END)
        WHEN 3 + a.v[q] = b.v[q] THEN 'D'
        WHEN 2 + b.v[CASE q WHEN 3 THEN 4 ELSE 3 END] = b.v[q] THEN 'I'
        WHEN ok AND (CASE WHEN q = 1 AND r = 's' THEN extra + a.v[2] WHEN q <> 3 AND r = 'u' THEN extra + a.v[3]
          WHEN q = 3 AND r = 'a' THEN extra + a.v[4] END) = b.v[q] THEN 'K' ELSE 'R' END AS e
    FROM walk p JOIN back b ON b.c = p.c AND b.i = p.i LEFT JOIN back a ON a.c = p.c AND a.i = p.i + 1 LEFT JOIN turns d ON d.c = p.c AND d.i = p.i
    WHERE NOT p.done)),
repaired AS (SELECT c, audit, array_to_string(lines, chr(10)) AS body FROM walk WHERE done)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN sizes USING (c) LEFT JOIN repaired USING (c) LEFT JOIN back b ON b.c = ids.c AND b.i = 1
"""

"""Personal data: fixed patterns, and terms whose company in the corpus gives a protected entity away."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]{3,}")
BREAK = re.compile("\n")
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind as in KINDS and then start.

    Each kind alone, leftmost and not overlapping; a match that fails its test is dropped without another try. Addresses
    are sought from each ``@`` outwards, which takes linear time in unbroken texts too.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            floor = m.end()
        else:  # what stands before this sign can belong to no later local part
            floor = at + 1
        at = text.find("@", floor)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _near(text: str, spans: list[tuple[str, int, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each span the places of the words within ``window`` words of it, on its line."""
    if not spans:
        return []
    words, lines = [m.span() for m in WORD.finditer(text)], [m.start() for m in BREAK.finditer(text)]
    starts, ends, out = [a for a, _ in words], [b for _, b in words], []
    for _, a, b in spans:
        k, j = bisect_left(lines, a), bisect_left(lines, b)
        first, last = lines[k - 1] + 1 if k else 0, lines[j] if j < len(lines) else len(text)
        k, j = bisect_right(ends, a), bisect_left(starts, b)
        out.append([w for w in words[max(0, k - window):k] if w[0] >= first] + [w for w in words[j:j + window] if w[1] <= last])
    return out


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text: words of three or more letters and digits, each lower-cased by itself."""
    return {w.lower() for w in set(WORD.findall(text))}


def _entity(text: str, span: tuple[str, int, int]) -> str:
    return f"{span[0]}:{text[span[1]:span[2]].lower()}"


def company(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple[str, str, int]]:
    """(entity, term, hash of the context) for the words within ``window`` words of each span, on its line."""
    out = []
    for span, places in zip(spans, _near(text, spans, window)):
        entity = _entity(text, span)
        near = [w for i, j in places if not (w := text[i:j].lower()).isdigit()]
        context = int.from_bytes(hashlib.blake2b(" ".join(sorted(near)).encode(), digest_size=8).digest(), "little", signed=True)
        out += [(entity, w, context) for w in sorted(set(near))]
    return out


def revealing_terms(docs: DataFrame, text_col: str = "text", window: int = 6, min_contexts: int = 4, share: float = 0.5, bits: float = 6.0) -> DataFrame:
    """Terms (term, entity, disclosed, information) that give a protected entity away, from counts over all documents.

    For each entity the patterns find and each word near it, n(term, entity) counts documents and ``contexts`` the
    different surroundings, so that copies of one text support nothing by themselves. With n(term) and n(entity) over
    the whole corpus, a term is revealing when P(entity | term) >= ``share``, the information
    log2(P(entity | term) / P(entity)) is at least ``bits`` and at least ``min_contexts`` surroundings agree.
    All counts cut and lower-case words by one rule (``terms_of``). Repeated rows count as often as they stand; a NULL
    text is a document without words. An empty table gives an empty one.
    """
    rows = docs.select(F.col(text_col).alias("text"))

    def near(batches):
        for batch in batches:
            out = []
            for x in texts(batch):
                text = x.as_py()
                spans = base_spans(text)
                found = {(_entity(text, span), ""): 0 for span in spans}  # the document has the entity
                for entity, term, context in company(text, spans, window):
                    found.setdefault((entity, term), context)
                    found["", term] = 0  # the document has the term near some entity
                out += [(e, t, c) for (e, t), c in found.items()]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["entity", "term", "context"])

    def words(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([list(terms_of(x.as_py())) for x in texts(batch)], pa.list_(pa.string()))], ["terms"])

    # Copies collapse first: one row per surroundings, with the number of documents that have them.
    seen = written(rows.mapInArrow(near, "entity string, term string, context long").groupBy("entity", "term", "context").agg(F.count("*").alias("n")))
    # n(term) is at least the documents that have it near any entity, so words near many are ruled out before the count.
    least = seen.filter("entity = ''").select("term", F.col("n").alias("least"))
    named = seen.filter("entity <> '' AND term <> ''").groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("joint"))
    pairs = named.filter(F.col("contexts") >= min_contexts).join(least, "term").filter(F.col("joint") >= share * F.col("least")).drop("least")
    pairs = written(pairs)
    if pairs.isEmpty():
        return pairs.select("term", "entity", F.lit(0.0).alias("disclosed"), F.lit(0.0).alias("information"))
    wanted = pairs.select("term").distinct()
    df = rows.mapInArrow(words, "terms array<string>").select(F.explode("terms").alias("term"))
    df = df.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("docs"))
    entities = seen.filter("term = ''").select("entity", F.col("n").alias("of_entity"))
    total = rows.agg(F.count("*").alias("total")).scalar()
    scored = pairs.join(df, "term").join(entities, "entity")
    scored = scored.select("term", "entity", (F.col("joint") / F.col("docs")).alias("disclosed"),
                           F.log2((F.col("joint") / F.col("docs")) / (F.col("of_entity") / total)).alias("information"))
    return written(scored.filter((F.col("disclosed") >= share) & (F.col("information") >= bits)))


def _term_spans(text: str, spans: list[tuple[str, int, int]], terms: dict[str, set[str]], window: int, everywhere: set[str] | None = None) -> set[tuple[int, int]]:
    """Places of the terms ``everywhere``, or without that of the terms that reveal an entity of this text, near it."""
    if everywhere is not None:
        if everywhere.isdisjoint(terms_of(text)):
            return set()
        out = {m.span() for m in WORD.finditer(text) if m[0].lower() in everywhere}
    else:
        found = [(s, terms[e]) for s in spans if (e := _entity(text, s)) in terms]
        near = _near(text, [s for s, _ in found], window)
        out = {(a, b) for (_, own), places in zip(found, near) for a, b in places if text[a:b].lower() in own}
    if not out:
        return out
    order, reach, last = sorted((s, e) for _, s, e in spans), [], 0
    for _, e in order:
        reach.append(last := max(last, e))
    starts = [s for s, _ in order]  # of the spans that begin before a term's end, none may reach over its start
    return {(a, b) for a, b in out if not (k := bisect_left(starts, b)) or reach[k - 1] <= a}


def _clean(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span generalised to its kind; of overlapping ones the first and then the longest counts."""
    out, at = [], 0
    for a, _, b, kind in sorted((a, -b, b, kind) for kind, a, b in spans):
        if a >= at:
            out += [text[at:a], MASK[kind]]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, revealing: DataFrame | None, text_col: str = "text", window: int = 6, block: int = 100_000, everywhere: bool = False) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_sha256, spans and clean (the sanitised text) to every document.

    With ``everywhere``, as the query and ``sanitise`` ask, a revealing term is a span wherever it stands in any document,
    since its counts over the corpus give the entity away; without, only near the entity that it reveals. The terms go to the workers in blocks of
    at most ``block`` pairs (some 10 MB), each block a pass over the documents, so any number is handled. Columns of
    ``docs`` that have a result's name are replaced, others stay, NULL ids too; repeated rows repeat as given, and an empty
    table gives an empty one. NULL and empty texts have no span, and ``clean`` keeps a NULL. Texts of any length are read whole.
    """
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean"]
    rest = [c for c in docs.columns if c not in new]
    df = docs.select(*rest, F.lit("").alias("spans"))
    count = revealing.count() if revealing is not None else 0
    blocks = max(1, -(-count // block))
    numbered = revealing.select("entity", "term", F.pmod(F.xxhash64("entity", "term"), F.lit(blocks)).alias("block")) if count else None
    names = [*rest, "spans"]

    for k in range(blocks):
        terms: dict[str, set[str]] = {}
        for r in numbered.filter(F.col("block") == k).collect() if count else []:
            terms.setdefault(r.entity, set()).add(r.term)
        sent = docs.sparkSession.sparkContext.broadcast((terms, set().union(*terms.values()) if everywhere else None))
        last = k == blocks - 1

        def search(batches, sent=sent, last=last):
            for batch in batches:
                out = []
                for x, raw, sofar in zip(texts(batch, text_col), batch.column(text_col), batch.column("spans").to_pylist(), strict=True):
                    text = x.as_py()
                    base = base_spans(text)
                    found = _term_spans(text, base, sent.value[0], window, sent.value[1]) | {tuple(map(int, p.split(":")[1:])) for p in sofar.split(",") if p}
                    full = base + [("term", a, b) for a, b in sorted(found)]
                    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                    if last:
                        n = [sum(s[0] == kind for s in base) for kind in KINDS[:4]]
                        out.append((*n, hashlib.sha256(say(base).encode()).hexdigest(), say(full), _clean(text, full) if raw.is_valid else None))
                    else:
                        out.append((say(full[len(base):]),))
                columns = list(zip(*out)) or [[]] * (len(new) if last else 1)
                kinds = [pa.int64()] * 4 + [pa.string()] * 3 if last else [pa.string()]
                yield pa.record_batch([*(batch.column(c) for c in rest), *(pa.array(c, t) for c, t in zip(columns, kinds))], [*rest, *(new if last else ["spans"])])

        schema = df.select(*rest).schema
        for c in new if last else ["spans"]:
            schema = schema.add(c, "long" if c.startswith("n_") else "string")
        df = df.select(*names).mapInArrow(search, schema)
        if not last:
            df = written(df)
            sent.destroy()
    return df


def sanitise(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with personal data and revealing terms generalised in the text; same columns, same rows."""
    plain = docs.toDF(*[f"__{k}" for k in range(len(docs.columns))])  # no name meets that of a result
    text = f"__{docs.columns.index(text_col)}"
    found = find(plain, revealing_terms(docs, text_col, **thresholds), text, everywhere=True)
    return found.select(*[F.col("clean" if c == text else c).alias(name) for c, name in zip(plain.columns, docs.columns)])

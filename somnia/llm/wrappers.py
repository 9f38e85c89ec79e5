"""Main text of web pages by wrapper induction: pages of one host are aligned, what stays is template, what varies is content."""

from __future__ import annotations

import functools
import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
SCOPES = frozenset("ul ol dl table td th".split())
DROPPED = frozenset("script style textarea title noscript iframe template xmp noembed noframes head nav aside form button select option dialog menu svg canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsored sponsor promo promotion cookie cookies consent gdpr notice notices alert banner popup modal overlay
newsletter subscribe signup comment comments reply replies respond disqus sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar
footer header masthead topbar related recommended share sharing social widget widgets skip""".split())
KEPT = frozenset("html body article main".split())  # never ruled out by a name
BESIDE = frozenset("has with no without".split())   # as in has-sidebar: says what stands in or beside the element
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACES = re.compile(r"\s+")


class Node:
    """An element: its label (tag and class), block texts and child elements in order, and whether it is ruled out.

    ``named``: 2 if a class or its id is one of NAMES, 1 if a part of one is.
    """

    __slots__ = ("tag", "label", "dropped", "named", "items")

    def __init__(self, tag: str, label: str, dropped: bool, named: int = 0):
        self.tag, self.label, self.dropped, self.named, self.items = tag, label, dropped, named, []


def _open(tag: str, attributes: str, in_article: bool) -> Node:
    named = {}
    if attributes and not attributes.isspace():
        for k, v in ATTRIBUTE.findall(attributes):
            named.setdefault(k.lower(), html.unescape(v.strip("\"'")).lower())
    level = 0
    if tag not in KEPT:
        names = NAMES - {"header"} if in_article else NAMES  # an article's own heading
        for word in f"{named.get('class', '')} {named.get('id', '')}".split():
            parts = set(re.split(r"[^a-z0-9]+", word))
            if not names.isdisjoint(parts) and BESIDE.isdisjoint(parts):
                level = max(level, 1 + (word in names))
    dropped = tag in DROPPED or (tag == "footer") or (tag == "header" and not in_article) or named.get("role") in ROLES \
        or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
    return Node(tag, f"{tag}.{'.'.join(sorted(named.get('class', '').split()))}", dropped, level)


def _rule_out(root: Node) -> None:
    """Rule out the elements with one of NAMES, but none around the main region.

    Main are each article and main with at least half as much text as the largest of them. An element with half of the
    page's text is not ruled out by a part of a name.
    """
    order, parent, size = [root], {}, {}
    for x in order:  # grows
        for y in x.items:
            if isinstance(y, Node) and not y.dropped:
                parent[id(y)] = x
                order.append(y)
    for x in reversed(order):
        size[id(x)] = sum(len(y) if isinstance(y, str) else size.get(id(y), 0) for y in x.items)
    regions = [x for x in order if x.tag in ("article", "main")]
    largest, around = max((size[id(x)] for x in regions), default=0), set()
    for x in regions:
        while 2 * size[id(x)] >= largest and id(x) not in around:
            around.add(id(x))
            x = parent.get(id(x), root)
    for x in order:
        x.dropped = id(x) not in around and (x.named == 2 or x.named == 1 and 2 * size[id(x)] < size[id(root)])


def parse(source: str) -> Node:
    """A tree of block elements. Inline elements only add their text; text between block edges is one block."""
    root = Node("#root", "#root", False)
    stack, text, at, article, named = [root], [], 0, 0, False

    def flush():
        if text:
            block = SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if block:
                stack[-1].items.append(block)

    while at < len(source):
        m = TAG.search(source, at)
        if m is None:
            text.append(source[at:])
            break
        text.append(source[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1] is not None:
            text.append(m[1])
        if not tag:
            continue
        if tag in RAW and not m[2]:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            text.append(" " if tag not in INLINE else "")
            continue
        if tag == "br" or tag in ("td", "th"):
            text.append(" ")
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        flush()
        if m[2]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                article -= sum(n.tag in ("article", "main") for n in stack[depth:])
                del stack[depth:]
            continue
        for k in range(len(stack) - 1, 0, -1):  # ends that the source leaves out
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                del stack[k:]
                break
            if stack[k].tag in SCOPES or stack[k].tag not in CLOSED_BY:
                break
        if tag in VOID:
            continue
        node = _open(tag, m[4], article > 0)
        stack[-1].items.append(node)
        named |= node.named > 0
        article += tag in ("article", "main")
        if not m[4].rstrip().endswith("/") or tag not in ("svg",):
            stack.append(node)
    flush()
    if named:
        _rule_out(root)
    return root


class Slot:
    """A node for alignment: neighbours with one label and no element inside are one repeated slot."""

    __slots__ = ("label", "nodes", "children", "number")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.children, self.number = label, nodes, [], -1


def slots(root: Node) -> list[Slot]:
    """The compressed tree in document order, without what is ruled out by name; the first is the root."""
    out: list[Slot] = []

    def build(node: Node) -> Slot:
        own = Slot(node.label, [node])
        own.number = len(out)
        out.append(own)
        last = None
        for child in (x for x in node.items if isinstance(x, Node) and not x.dropped):
            leaf = not any(isinstance(x, Node) for x in child.items)
            if leaf and last is not None and last.label == child.label + "*":
                last.nodes.append(child)
                continue
            if leaf:
                last = Slot(child.label + "*", [child])
                last.number = len(out)
                out.append(last)
                own.children.append(last)
            else:
                last = None
                own.children.append(build(child) if _depth(child) < 200 else Slot(child.label, [child]))
        return own

    build(root)
    return out


def _depth(node: Node) -> int:
    level, depth = [node], 0
    while level and depth < 200:
        level, depth = [x for n in level for x in n.items if isinstance(x, Node)], depth + 1
    return depth


def match(a: Slot, b: Slot, cache: dict) -> int:
    """Simple tree matching: size of the largest alignment of two trees that keeps order and parents."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in cache:
        row = [0] * (len(b.children) + 1)
        table = [row]
        for x in a.children:
            new = [0]
            for j, y in enumerate(b.children):
                new.append(max(row[j + 1], new[j], row[j] + match(x, y, cache)))
            row = new
            table.append(row)
        cache[key] = (row[-1] + 1, table)
    return cache[key][0]


def aligned(a: Slot, b: Slot, cache: dict) -> list[tuple[Slot, Slot]]:
    """The pairs of an alignment that ``match`` found."""
    if not match(a, b, cache):
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        table = cache[id(x), id(y)][1]
        i, j = len(x.children), len(y.children)
        while i and j:
            w = match(x.children[i - 1], y.children[j - 1], cache)
            if w and table[i][j] == table[i - 1][j - 1] + w:
                todo.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def _texts(slot: Slot) -> list[str]:
    return [x for n in slot.nodes for x in n.items if isinstance(x, str)]


@functools.lru_cache(maxsize=256)
def _reference(source: str) -> tuple[list[Slot], list[list[tuple[int, str]]]]:
    """Slots of a reference page, and the blocks of each slot as (number in the page, text)."""
    base, number = slots(parse(source)), itertools.count()
    return base, [[(next(number), x) for x in _texts(y)] for y in base]


def _collect(root: Node, regions: set[int], without: dict[int, set[str]], varied: set[int]) -> list[str]:
    """Blocks in page order that stand in ``regions`` (all without any) or directly in ``varied`` nodes, less what is ruled out.

    Elements are ruled out by name, blocks by the texts that ``without`` has for their node.
    """
    out, stack = [], [(root, not regions)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.dropped:
            inside = inside or id(x) in regions
            own, gone = inside or id(x) in varied, without.get(id(x), ())
            stack.extend((y, inside) for y in reversed(x.items) if isinstance(y, Node) or own and y not in gone)
    return out


def _regions(root: Node) -> list[Node]:
    """The outermost article and main elements with text, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            out.append(x)
        else:
            stack.extend(y for y in reversed(x.items) if isinstance(y, Node) and not y.dropped)
    return [x for x in out if _collect(x, set(), {}, set())]


def main_text(source: str, reference: str | None, template: frozenset[int], content: frozenset[int]) -> str:
    """Text of a page less what is ruled out by name and what the host's pages share.

    ``template``: blocks of the reference that the host's pages share; ``content``: its slots that vary. Named regions are
    a hint: where a page has some, text outside them is kept only in slots that vary, and text inside is kept whole if
    all of it is shared.
    """
    root = parse(source)
    tops = _regions(root)
    regions, without, varied = {id(x) for x in tops}, {}, set()
    if reference is not None and (template or content):
        base, blocks = _reference(reference)
        for x, y in aligned(slots(root)[0], base[0], {}):
            gone = {text for number, text in blocks[y.number] if number in template}
            if gone:
                without.update((id(n), gone) for n in x.nodes)
            if y.number in content:
                varied.update(id(n) for n in x.nodes)
    if tops and not any(_collect(x, set(), without, set()) for x in tops):
        without = {}
    return "\n".join(_collect(root, regions, without, varied))


def host(column):
    """The host of a URL, '' without one."""
    return F.coalesce(F.lower(F.regexp_extract(column, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """(host, reference, template, content) for each host, from an alignment of every page with the host's reference page.

    The reference is the page whose digest is smallest. For each of its slots, all other pages of the host together say how
    often the slot is met, how often its text differs, and how often each block of it stands there too. A block is template
    when at least ``least`` pages meet its slot and ``share`` of them have it; ``content`` are the slots that at least
    ``least`` pages meet and more than the rest of ``share`` differ in. Copies of the reference say nothing.
    """
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    refs = rows.select("host", F.md5(F.col("html").cast("binary")).alias("digest"), "html").groupBy("host").agg(F.min_by("html", "digest").alias("reference"))
    refs = written(refs)

    def observe(batches):
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for name, source, reference in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("reference").to_pylist()):
                if source == reference:
                    continue
                base, blocks = _reference(reference)
                for x, y in aligned(slots(parse(source))[0], base[0], {}):
                    mine, theirs = _texts(x), blocks[y.number]
                    own = seen.setdefault((name, y.number, -1), [0, 0])
                    own[0] += 1
                    own[1] += mine != [text for _, text in theirs]
                    there = set(mine)
                    for number, text in theirs:
                        if text in there:
                            seen.setdefault((name, y.number, number), [0, 0])[1] += 1
            rows = [(*k, *v) for k, v in seen.items()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["host", "slot", "block", "met", "n"])

    counted = rows.join(refs, "host").select("host", "html", "reference").mapInArrow(observe, "host string, slot int, block int, met long, n long")
    counted = counted.groupBy("host", "slot", "block").agg(F.sum("met").alias("met"), F.sum("n").alias("n"))
    counted = counted.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "block", "met", "n"))).alias("slots"))  # a row for each slot and block of one page

    def induce(batches):
        for batch in batches:
            templates, contents = [], []
            for stats in batch.column("slots").to_pylist():
                met = {s["slot"]: s["met"] for s in stats if s["block"] < 0 and s["met"] >= least}
                templates.append([s["block"] for s in stats if s["block"] >= 0 and s["slot"] in met and s["n"] >= share * met[s["slot"]]])
                contents.append([s["slot"] for s in stats if s["block"] < 0 and s["slot"] in met and s["n"] > (1 - share) * s["met"]])
            yield pa.record_batch([batch.column("host"), batch.column("reference"), *(pa.array(x, pa.list_(pa.int32())) for x in (templates, contents))],
                                  ["host", "reference", "template", "content"])

    return written(refs.join(counted, "host").mapInArrow(induce, "host string, reference string, template array<int>, content array<int>"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the main text, blocks joined by a line break.

    White space inside a block is one space; character references are decoded. NULL, empty and markup-only pages have the
    text ''. Repeated rows give repeated rows, a page without a URL belongs to the host '', other columns are ignored.
    """
    found = wrappers(pages)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).join(found, "host", "left")

    def run(batches):
        for batch in batches:
            out = [main_text(s, r, frozenset(t or ()), frozenset(c or ())) for s, r, t, c in zip(*(batch.column(x).to_pylist() for x in ("html", "reference", "template", "content")))]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.select("page_id", "url", "html", "reference", "template", "content").mapInArrow(run, schema)

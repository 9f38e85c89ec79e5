"""Personal data and pages, and the pipeline as a whole."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from somnia.llm import pii, wrappers
from somnia.llm.common import remainder

DIGITS = lambda s: re.sub(r"[^0-9]", "", s)
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(DIGITS(s)) <= 19 and pii.luhn(DIGITS(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(DIGITS(s)) <= 15),
]


def plain(text):
    return [(k, m.start(), m.end()) for k, r, test in KINDS for m in re.finditer(r, text) if test(m[0])]


CASES = ["", "a@b", "a@b.c@d.e", "x.y+z@mail-1.example.com.", "@a.b c@d..e", "1.2.3.4.5.6.7.8", "1.2.3.256 999.1.1.1 01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
         "41111111111111111111", "+1 (988) 555-2485 or +12 3", "+49-30-1234567 +1+23456789", "é🙂 a@b.co ü 10.0.0.1", "a" * 200_000, "1" * 20_000, "." * 50_000 + "@" * 50_000, "a@b.c" * 2_000, "1." * 10_000]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_base_spans(text):
    if len(text) < 30_000:
        want = plain(text)
    else:  # where plain matching takes quadratic time, what each text holds
        want = {"a" * 200_000: [], "." * 50_000 + "@" * 50_000: []}[text]
    assert pii.base_spans(text) == want


def test_terms_by_plain_count(spark, rows):
    """P and bits equal a plain count, with capitals that change their length, sharp s and final sigma in the terms."""
    fill = "delta echo foxtrot golf hotel india juliet kilo lima mike november oscar".split()
    names = ["İzzettin", "STRASSE9ß", "ΟΔΥΣΣΕΥΣ", "Zebrafish"]
    table = []
    for n, name in enumerate(names):
        for k in range(10):
            around = [fill[(k * (n + 3) + j) % 12] for j in range(3)]
            table.append(f"{around[0]} {name if k % 2 else name.lower()} {around[1]} wrote user{n}@corp.example {around[2]} k{k}n{n}")
        table += [f"{name.upper() if n == 3 else name} alone", f"mail user{n}@corp.example", table[-1]]
    table += [f"{fill[k % 12]} {fill[(k * 5 + 1) % 12]} filler {k} and ıssız" for k in range(700)] + [None, "", "x" * 50_000]
    got = {(r.term, r.entity): (r.disclosed, r.information) for r in pii.revealing_terms(rows(*enumerate(table)), bits=3.0, share=0.5).collect()}
    texts = [t or "" for t in table]
    low = [{w.lower() for w in re.findall(r"[^\W_]{3,}", t)} for t in texts]
    owners = [{f"{k}:{t[a:b].lower()}" for k, a, b in plain(t)} if len(t) < 30_000 else set() for t in texts]
    near = {}
    for i, t in enumerate(texts):
        for k, a, b in plain(t) if len(t) < 30_000 else []:
            before, after = re.findall(r"[^\W_]{3,}", t[:a])[-6:], re.findall(r"[^\W_]{3,}", t[b:])[:6]
            context = tuple(sorted(w.lower() for w in before + after if not w.isdigit()))
            for w in set(context):
                near.setdefault((w, f"{k}:{t[a:b].lower()}"), []).append((i, context))
    want = {}
    for (term, entity), seen in near.items():
        docs, own = sum(term in x for x in low), sum(entity in x for x in owners)
        p = len({i for i, _ in seen}) / docs
        bits = math.log2(p / (own / len(texts)))
        if len({c for _, c in seen}) >= 4 and p >= 0.5 and bits >= 3:
            want[term, entity] = (p, bits)
    assert {n.lower() for n in names} <= {t for t, _ in want} and got.keys() == want.keys()
    assert all(abs(x - y) < 1e-9 for key in want for x, y in zip(got[key], want[key]))


def test_find_and_terms(spark, rows):
    fill = "delta echo foxtrot golf hotel india juliet kilo".split()
    secret = [(k, f"{fill[k % 8]} Zebrafish owner {fill[(k * 3) % 8]} {k}x wrote boss@corp.example today {fill[(k * 5) % 8]}") for k in range(12)]
    others = [(100 + k, f"{fill[k % 8]} {fill[(k * 3 + 1) % 8]} owner wrote someone{k}@mail.example today") for k in range(300)]
    docs = rows(*secret, *others, (900, None), (901, ""), (None, "x@y.zz"), (902, "zebrafish alone")).withColumn("spans", F.lit(1))
    terms = pii.revealing_terms(docs, bits=4.0)
    assert {(r.term, r.entity) for r in terms.collect()} == {("zebrafish", "email:boss@corp.example")}
    for block in (100_000, 1):
        got = {r.doc_id: r for r in pii.find(docs, terms, block=block).collect()}
        assert len(got) == len(secret) + len(others) + 4 and got[900].clean is None and got[901].clean == "" and got[None].n_email == 1
        assert got[902].spans == "" and got[902].base_sha256 == hashlib.sha256(b"").hexdigest()
        for i, text in secret:
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
            at = text.index("Zebrafish")
            assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[i].spans == f"{base},term:{at}:{at + 9}"
            assert "[TERM]" in got[i].clean and "[EMAIL]" in got[i].clean and "boss@" not in got[i].clean
    assert pii.find(docs.limit(0), pii.revealing_terms(docs.limit(0))).count() == 0


def test_terms_are_marked_wherever_they_stand(spark, rows):
    pad, fill = "-" * 200, "delta echo foxtrot golf hotel india juliet kilo".split()
    secret = [(k, f"{fill[k % 8]} {fill[k * 3 % 8]} {k}x Zebrafish {pad} wrote {pad} boss@corp.example today {fill[k * 5 % 8]}\n{fill[k * 7 % 8]}\n and ZEBRAFISH again") for k in range(12)]
    others = [(100 + k, f"{fill[k % 8]} {fill[(k * 3 + 1) % 8]} owner wrote someone{k}@mail.example today") for k in range(300)]
    docs = rows(*secret, *others, (902, "zebrafish alone, zebrafishes too"), (903, None))
    terms = pii.revealing_terms(docs, bits=4.0)
    assert ("zebrafish", "email:boss@corp.example") in {(r.term, r.entity) for r in terms.collect()}  # beyond 144 characters, within six words
    got = {r.doc_id: r for r in pii.find(docs, terms, everywhere=True).collect()}
    assert got[902].spans == "term:0:9" and got[902].clean == "[TERM] alone, zebrafishes too" and got[903].clean is None
    assert all("zebrafish" not in got[i].clean.lower() and got[i].clean.count("[TERM]") >= 2 for i, _ in secret)
    kept = {r.doc_id: r.text for r in pii.sanitise(docs, bits=4.0).collect()}
    assert kept == {i: r.clean for i, r in got.items()}


def test_main_text_named_regions():
    page = ("<html><head><title>t</title><style>p{}</style><script>var x='</p>';</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>"
            "<div class='ad'>Buy</div><article><header><h1>A &amp; B</h1></header><p><b>One<br>two<p>x &lt; y&nbsp;z  \n w<aside>side</aside>"
            "<form>form</form><section class='comments'>c</section><table><tr><td>a<td>b</table></article><footer>&copy;</footer></body></html>")
    assert wrappers.main_text(page, None, frozenset(), 0) == "A & B\nOne two\nx < y z w\na b"
    assert wrappers.main_text("", None, frozenset(), 0) == ""


def test_wrapper_of_pages_without_names(spark):
    page = lambda i: (f"<body><div>Daily Site</div><ul><li>Home</li></ul><div id=x><h2>Title {i}</h2><p>Body {i} of this page</p><p>more {i * 7}</p></div><div>All rights</div></body>")
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(6)] + [(90, None, None), (91, "http://b.example", ""), (92, "http://a.example", "<p>short"), (90, None, None)]
    got = [(r.page_id, r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(0))).collect()]
    want = [(i, f"Title {i}\nBody {i} of this page\nmore {i * 7}") for i in range(6)] + [(90, ""), (91, ""), (92, "short"), (90, "")]
    assert sorted(got) == sorted((i, t, len(t)) for i, t in want)
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, pages):
    rows = [(i, f"http://a.example/{i}", x) for i, x in enumerate(pages)]
    return [r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_every_varying_slot_is_content(spark):
    page = lambda i: f"<body><div>Daily Site</div><h1>Title {i}</h1><div><p>{f'long {i} ' * 6}</p></div><ul><li>Home</ul><section><p>{f'short {i} ' * 4}</p></section></body>"
    assert extracted(spark, map(page, range(6))) == ["\n".join([f"Title {i}", (f"long {i} " * 6).strip(), (f"short {i} " * 4).strip()]) for i in range(6)]


def test_template_inside_named_regions(spark):
    page = lambda i: f"<body><div>Daily Site</div><h1>Title {i}</h1><article><p>Read {i}<p>Text {i * 7}<p>Tell your friends</p><div class=box><p>By our own desk</p></div></article><p>All rights</body>"
    assert extracted(spark, map(page, range(6))) == [f"Title {i}\nRead {i}\nText {i * 7}" for i in range(6)]
    assert extracted(spark, [page(1)] * 6) == ["Read 1\nText 7\nTell your friends\nBy our own desk"] * 6


@pytest.mark.parametrize("page, text", [
    ("<body class='has-sidebar'><div class='layout with-sidebar'><div class='menu'>Menu</div><article>Long story</article></div></body>", "Long story"),
    ("<body id=sidebar><div class='sidebar layout'><main class='post-comments'>Long story</main></div><div class=related><article>More</article></div></body>", "Long story"),
    ("<html class='no-ads'><body><div class='page-menu-left'><div class=menu>Menu</div><p>Long story<p>goes on</div><div class='share-box'>Share</div></body></html>", "Long story\ngoes on"),
    ("<main>On top<div class=sidebar><article>Long story</article></div></main>", "On top\nLong story"),
    ("<div>" * 3_000 + "<article>Long story</article>", "Long story"),
    ("<article>x</article>" * 10_050 + "<div><article>Long story</article></div>", "x\n" * 10_050 + "Long story")], ids=range(6))
def test_names_do_not_rule_out_the_main_region(page, text):
    assert wrappers.main_text(page, None, frozenset(), 0) == text


def test_simple_tree_matching():
    a, b = (wrappers.slots(wrappers.parse(x)) for x in ("<div><h1>a</h1><p>b</p><ul><li>c</li></ul></div>", "<div><p>x</p><p>y</p><ul><li>z</li></ul><hr></div>"))
    assert wrappers.match(a[0], b[0], {}) == 5
    assert [(x.label, y.label) for x, y in wrappers.aligned(a[0], b[0], {})][0] == ("#root", "#root")


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0.5 * sizes[0]
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_on_odd_rows(spark, rows, folder):
    """NULL, empty, repeated and long rows, an empty table and columns with names of the operators' own pass all stages."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
    odd = rows((-1, None), (-2, ""), (-2, ""), (None, "a text that has no id but mails me@corp.example now"), (-3, long), (-3, long))
    for name in ("key", "clean", "class_id", "score", "spans"):
        odd = odd.withColumn(name, F.lit(7))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            given, docs = docs, corpus_pipeline.materialise(stage(spark, docs, folder))
            if name == "packing":
                continue
            assert docs.columns == given.columns
            before, after = ([(r.doc_id, r.key) for r in x.collect()] for x in (given, docs))
            assert set(after) <= set(before) and (None, 7) in after or not before
            if name == "near_copies" and before:
                assert after.count((-3, 7)) == 1
            if name == "pii" and before:
                assert len(after) == len(before) and all("me@" not in (r.text or "") and r.clean == r.spans == 7 for r in docs.collect())
    scored = corpus_pipeline.keep_quality(spark, odd, folder)  # none of its rows has a label
    known = spark.read.parquet(f"{folder}/labels.parquet").filter((remainder("doc_id", 4) != 2) & F.col("quality").isin(0, 1))
    share = known.agg((F.sum("quality") + 0.5) / (F.count("*") + 1)).first()[0]  # without labelled texts each row has the share of the label
    assert scored.columns == odd.columns and scored.count() == (6 if share >= 0.7 else 0)


def test_one_copy_stays_whatever_the_ids(spark, rows):
    text = " ".join(f"word{k}" for k in range(40))
    kept = corpus_pipeline.drop_near_copies(spark, rows((-1, text), (None, text), (7, text), (None, "another text of six words here"), (3, None), (2, "")), "")
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, -1), (False, 2)] and kept.count() == 3

import random
import re

from pyspark.sql import functions as F

from folioframe.operators import blocks, clean, reader, wiki
from folioframe.plans import pipelines


def one(spark, f, text, kind="string"):
    return spark.createDataFrame([(text,)], f"v {kind}").select(f(F.col("v")).alias("o")).first().o


def cleaned(spark, html):
    return clean.clean_documents(spark.createDataFrame([(1, html, "x")], "id int, html string, cleaned string")).first()


def test_cleaning(spark):
    r = cleaned(spark, "H<article a='1'><hr><p>Produced by X</p><p>a shot produced by the artillery</p>\n<P class=\"c\"> b [Illustration: z] <em>c</em></P><p>***</p><p>[illustration]</p></article>T")
    assert r.cleaned == "H<article a='1'>\n<p>a shot produced by the artillery</p>\n<P class=\"c\">b <em>c</em></P>\n</article>T"
    assert (r.dropped, r.scrubbed) == (3, 2)
    again = cleaned(spark, r.cleaned)
    assert again.cleaned == r.cleaned and again.dropped == 0 and again.scrubbed == 0
    assert cleaned(spark, "no article").cleaned == "no article" and cleaned(spark, None).cleaned is None
    assert cleaned(spark, "").dropped == 0


def test_drop_reasons(spark):
    texts = ["", "The Project Gutenberg eBook", "Produced by me", "Title: x", "Transcriber's Note: y", " * * * ", "prose"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.o for r in df.select("i", clean.drop_reason(F.col("t")).alias("o")).orderBy("i").collect()] == ["blank", "phrase", "produced", "header", "transcriber", "ornament", None]


def test_wrapper_and_illustrations(spark):
    start, end = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THE PROJECT GUTENBERG EBOOK X ***"
    assert one(spark, blocks.strip_wrapper, f"a{start}b{end}c") == "b"
    assert one(spark, blocks.strip_wrapper, f"a{end}b{start}cd") == "cd"  # nothing is lost
    for text, want in (("a[Illustration]b", "ab"), ("a[Illustration: x [y] z]b", "ab"), ("a[Illustration: never closed", "a"), ("plain", "plain")):
        assert one(spark, blocks.strip_illustrations, text) == want


def fmt(spark, text):
    return blocks.format_text(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").first()


def test_line_formatter(spark):
    text = "A line of text.\n\n    one\n    two\n    three\n\n* * *\nmore\n---\nstill more\n"
    r = fmt(spark, text)
    assert r.html.split("\n", 1)[0] == "<p>A line of text.</p>"
    assert '<pre class="verse">    one\n    two\n    three</pre>\n<hr class="break" />\n<p>more still more</p>' in r.html
    assert r.wordCount == 14
    assert fmt(spark, None).html is None and fmt(spark, "").html == ""


def test_headings_last_wins_and_toc(spark):
    r = fmt(spark, "CHAPTER I.\n\nfirst\n\nCHAPTER I.\n\nsecond")
    assert r.html == '<h2 class="toc-entry">Chapter I.</h2>\n<p>first</p>\n<h2 id="chapter-i">Chapter I.</h2>\n<p>second</p>'
    toc = one(spark, blocks.extract_toc, r.html)
    assert [(t.id, t.label) for t in toc] == [("chapter-i", "Chapter I.")]


def test_contents(spark):
    body = "\n".join(["PREFACE TEXT", "CONTENTS", "I. a", "II. b", "CHAPTER I", *["prose of the book goes on and on"] * 20])
    df = spark.createDataFrame([(body,), ("I. x\nCONTENTS\nIII.\nshort",), (None,)], "t string")
    got = [r.t for r in blocks.strip_contents(df, "t").collect()]
    assert got[0].startswith("CHAPTER I\n") and got[1].startswith("I. x") and got[2] is None


def test_line_formatter_against_a_scan(spark):
    rnd = random.Random(3)
    kinds = ["* * *", "CHAPTER II", "", "", "    verse line", "    other verse", "---", "some plain words", "x"]
    docs = [(i, "start of it\n" + "\n".join(rnd.choice(kinds) for _ in range(30))) for i in range(25)]
    got = {r.id: r.html for r in blocks.format_text(spark.createDataFrame(docs, "id int, text string"), "id", "text").collect()}
    for i, text in docs:
        lines = text.strip().split("\n")
        first = next((k for k, t in enumerate(lines) if t == "CHAPTER II"), 0)
        lines = lines[first:]
        out, run, kind = [], [], None

        def close():
            nonlocal run, kind
            if kind == "p" and len(" ".join(run)) >= 3:
                out.append(f"<p>{' '.join(run)}</p>")
            if kind == "pre":
                out.append('<pre class="verse">' + "\n".join(run) + "</pre>")
            run, kind = [], None

        for k, t in enumerate(lines):
            near = sum(lines[j].startswith("    ") for j in range(max(0, k - 4), min(len(lines), k + 5)) if j != k)
            if t in ("* * *", "CHAPTER II"):
                close()
                out.append('<hr class="break" />' if t[0] == "*" else "H")
            elif t.startswith("    ") and near >= 2:
                if kind != "pre":
                    close()
                    kind = "pre"
                run.append(t)
            elif not t.strip():
                close()
            else:
                if kind == "pre":
                    close()
                if t != "---":
                    kind = "p"
                    run.append(t.strip())
        close()
        mine = re.sub(r"<h2[^>]*>.*?</h2>", "H", got[i])
        assert mine == "\n".join(out), (text, got[i])


def test_block_formatter(spark):
    df = spark.createDataFrame([(b,) for b in ["Chap. 1", "Vol.2", '"Chapter one," he said', "XIV.", "12", "THE END OF ALL", "Stop. THE END", "Chapter One", ""]], "b string")
    got = [r.h for r in df.select(blocks.block_heading(F.col("b")).alias("h")).collect()]
    assert got == [None, "Vol.2", None, "XIV.", "12", "THE END OF ALL", None, "Chapter One", None]
    text = "Chapter One\n\nshort line\nshort too\nend\n\nA long prose line that surely has more than forty-eight characters\nand goes on _so_.\r\n\r\nII."
    r = blocks.to_html(spark.createDataFrame([("s", text, "T&", None), ("n", None, "", "")], "id string, text string, t string, a string"), "id", "text", "t", "a").orderBy(F.desc("id")).collect()
    assert r[0].n_headings == 2 and r[1].html is None
    assert '<h2 class="toc-entry">Chapter One</h2>\n<h2 class="toc-entry">II.</h2>\n<h2 id="sec-1">Chapter One</h2>\n<p class="verse">short line<br>short too<br>end</p>\n<p>A long prose' in r[0].html
    assert "on <em>so</em>.</p>\n<h2 id=\"sec-2\">II.</h2>\n</article>" in r[0].html and "<title>T&amp; — </title>" in r[0].html


def test_atoms_pages_and_jump(spark):
    html = '<article><h2 class="toc-entry">c</h2><h2 id="s1">One &amp; two</h2><p> </p><p>Hello <em>big</em><br>world</p><pre class="verse">a\nb</pre></article>'
    a = reader.atoms(spark.createDataFrame([(1, html), (2, None)], "d int, h string"), "d", "h").orderBy("ai").collect()
    assert [(r.ai, r.type, r.id, r.text, r.verse) for r in a] == [(0, "h2", "s1", "One & two", False), (1, "p", None, "Hello bigworld", False), (2, "p", None, "ab", True)]
    assert [(s.t, s.em, s.br) for s in a[1].segs] == [("Hello ", False, False), ("big", True, False), ("", False, True), ("world", False, False)]
    assert [(s.t, s.br) for s in a[2].segs] == [("a", False), ("", True), ("b", False)]
    text = " ".join(f"w{i}" for i in range(400))
    rows = spark.createDataFrame([(1, 0, "h2", "Head"), (1, 1, "p", text), (1, 2, "p", "x" * 500)], "d int, ai int, type string, text string")
    pages = reader.paginate(rows, "d", budget=300)
    parts = {}
    for p in sorted(pages.collect(), key=lambda r: (r.page, r.ai, r.start)):
        parts.setdefault(p.ai, []).append((p.start, p.end))
    for ai, n in ((0, 4), (1, len(text)), (2, 500)):
        assert parts[ai][0][0] == 0 and parts[ai][-1][1] == n and all(x[1] == y[0] for x, y in zip(parts[ai], parts[ai][1:]))
    assert reader.jump_page(pages, "d", 0).first().page == 0


def test_paint(spark):
    atoms = spark.createDataFrame([(1, 0, "0123456789")], "d int, ai int, text string")
    hl = spark.createDataFrame([(1, 0, 0, 0, 6, "yellow"), (1, 1, 0, 4, 8, "pink"), (1, 2, 0, 5, 6, None)], "d int, seq int, atomIndex int, start int, end int, color string")
    assert sorted((r.start, r.end, r.color) for r in reader.paint(atoms, hl, "d").collect()) == [(0, 4, "yellow"), (4, 5, "pink"), (6, 8, "pink")]
    rnd = random.Random(1)
    rows = []
    for i in range(40):
        a, b = rnd.randrange(-2, 12), rnd.randrange(-2, 14)
        rows.append((1, i, 0, min(a, b), max(a, b), rnd.choice(["a", "b", None])))
    colors = [None] * 10
    for _, _, _, s, e, c in rows:
        for j in range(max(0, s), min(10, e)):
            colors[j] = c
    got = [None] * 10
    for r in reader.paint(atoms, spark.createDataFrame(rows, hl.schema), "d").collect():
        got[r.start : r.end] = [r.color] * (r.end - r.start)
    assert got == colors


def test_selection_and_color(spark):
    atoms = spark.createDataFrame([(1, i, "abcdef") for i in range(4)], "d int, ai int, text string")
    sel = spark.createDataFrame([(1, 7, 2, 3, 0, 4), (1, 8, 1, 2, 1, 2)], "d int, sel int, a_ai int, a_off int, b_ai int, b_off int")
    got = sorted((r.sel, r.ai, r.start, r.end) for r in reader.split_selection(sel, atoms, "d").collect())
    assert got == [(7, 0, 4, 6), (7, 1, 0, 6), (7, 2, 0, 3)]
    hl = spark.createDataFrame([(1, 0, 0, 1, 3, "x"), (1, 1, 0, 2, 9, "y")], "d int, seq int, atomIndex int, start int, end int, color string")
    rng = spark.createDataFrame([(1, 0, 0, 5, None)], "d int, ai int, start int, end int, color string")
    assert sorted((r.seq, r.start, r.end, r.color) for r in reader.apply_color(hl, rng, "d").collect()) == [(1, 2, 9, "y"), (2, 0, 5, None)]


def test_article_and_highlights_json(spark):
    assert one(spark, reader.article_slice, "x<article>a</article>b</article>y") == "<article>a</article>b</article>" and one(spark, reader.article_slice, "plain") == "plain"
    assert [h.color for h in one(spark, reader.parse_highlights, '[{"atomIndex":1,"start":0,"end":2,"color":"pink"}]')] == ["pink"]
    assert list(one(spark, reader.parse_highlights, "broken")) == [] and list(one(spark, reader.parse_highlights, None)) == []


def test_wiki(spark):
    page = '<table><p>no</p></table><div class="poem">a<br/>b</div><p>prose &amp; more</p><p>x<br>y</p><p> </p>'
    assert [(b.kind, b.text) for b in one(spark, wiki.page_blocks, page)] == [("v", "a\nb"), ("p", "prose & more"), ("v", "x\ny")]
    subs = spark.createDataFrame([("W", "W/भाग २"), ("W", "W/भाग १"), ("S", "S/कथा"), ("S", "S/१- गीत"), ("W", "W/भाग ३"), ("W", "W")], "work string, sub string")
    links = spark.createDataFrame([("W", "W/भाग ३", 0)], "work string, sub string, link int")
    o = wiki.ordered_subpages(subs, links)
    assert [r.sub for r in o.where("work='W'").orderBy("pos").collect()] == ["W/भाग ३", "W/भाग १", "W/भाग २"]
    plan = wiki.plan_books(spark.createDataFrame([("W",), ("S",), ("A",)], "work string"), o)
    got = {(r.work, r.book, r.title, r.pos) for r in plan.collect()}
    assert ("A", 1, "A", 1) in got and ("W", 1, "W", 3) in got and ("S", 1, "गीत", 1) in got and ("S", 2, "कथा", 1) in got
    pages = plan.select("page").distinct().withColumn("blocks", F.expr("array(struct('v' as kind, 'a b\nc' as text), struct('p' as kind, 'd' as text))"))
    b = {(r.work, r.book): r for r in wiki.build_books(plan, pages).collect()}
    assert b["W", 1].words == 12 and b["W", 1].html.count("<h2 id=") == 3 and "a b<br>\nc" in b["A", 1].html and "<h2" not in b["A", 1].html


def test_import_run(spark):
    specs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, id string")
    raw = spark.createDataFrame([("a", "x" * 500), ("b", "short")], "id string, text string")
    have = spark.createDataFrame([("c",)], "id string")
    assert {r.id: r.status for r in pipelines.import_texts(specs, raw, have).collect()} == {"a": "ok", "b": "failed", "c": "skipped"}
    assert {r.id for r in pipelines.import_texts(specs, raw, have, limit=1).collect()} == {"a"}


def test_sync(spark):
    cat = spark.createDataFrame([("a", 1), ("b", 2)], "id string, wordCount int")
    content = spark.createDataFrame([("a", "<p>one two</p>"), ("z", "")], "id string, html string")
    s, missing, orphans = pipelines.sync(cat, content)
    assert [tuple(r) for r in s.collect()] == [("a", 2)] and [r.id for r in missing.collect()] == ["b"] and [r.id for r in orphans.collect()] == ["z"]


def test_convert_gates_and_failures(spark):
    from folioframe.plans import pipelines

    long = "\n\n".join(f"A paragraph of number {i} that goes on for a while." for i in range(40))
    specs = spark.createDataFrame([(1, "a", "A", "X"), (2, "a", "A again", "X"), (3, "b", "B", "Y"), (4, "c", "C", None), (5, "d", None, None)], "ord int, id string, title string, author string")
    raw = spark.createDataFrame([("a", long), ("b", "short"), ("c", "The Complete Works of\n\n" + long), ("e", long)], "id string, text string")
    titles = spark.createDataFrame([("a", "Another A")], "id string, title string")
    got = {(r.id, r.status): r for r in pipelines.convert(specs, raw, "COMPLETE WORKS", 1500, titles).collect()}
    assert set(got) == {("a", "ok"), ("a", "duplicate"), ("b", "short"), ("c", "bundle"), ("d", "no text")}
    assert "<title>Another A — X</title>" in got["a", "ok"].html and got["b", "short"].html is None
    assert {(r.status, r.n) for r in pipelines.tally(pipelines.convert(specs, raw, "COMPLETE WORKS", 1500)).collect()} == {("ok", 1), ("duplicate", 1), ("short", 1), ("bundle", 1), ("no text", 1)}


def test_all_entities_and_the_book_id(spark):
    from folioframe.operators import reader, wiki

    df = spark.createDataFrame([(1, "<article><p>a &mdash; b &#2309; &amp;lt; &lt;i&gt; &copy &eacute;&#60;b&#62;</p></article>")], "k int, html string")
    assert reader.atoms(df, "k", "html").first().text == "a — b अ &lt; <i> &copy é<b>"
    assert df.select(wiki.page_blocks(F.col("html")).alias("b")).first().b[0].text == "a — b अ &lt; <i> &copy é<b>"
    plan = spark.createDataFrame([("w", 1, "T", 1, None, "p", "a-slug")], "work string, book int, title string, pos int, heading string, page string, slug string")
    pages = spark.createDataFrame([("p", [("p", "x")])], "page string, blocks array<struct<kind:string,text:string>>")
    assert '<article lang="hi" data-book-id="a-slug" data-title="T"' in wiki.build_books(plan, pages).first().html

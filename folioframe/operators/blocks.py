"""Raw text to blocks of markup: two formatters, as array columns over a document's lines.

A document stays one row, so nothing is shuffled.  Runs are gaps and islands in an array: the
places where a block opens, and the slices between them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.text import HEADING_WORDS, count_text_words, escape_block, escape_line, heading_slug, pretty_heading, squeeze, strip

_KEYWORDS = "|".join(HEADING_WORDS)

# Markers, headings, scene breaks and dividers of the line formatter.
START = r"(?i)\*\*\*\s*START OF (?:THE|THIS)? PROJECT GUTENBERG EBOOK[^*]+\*\*\*"
END = r"(?i)\*\*\*\s*END OF (?:THE|THIS)? PROJECT GUTENBERG EBOOK[^*]+\*\*\*"
CHAPTER = (
    r"^\s*(?:(?:CHAPTER|BOOK|PART|VOLUME|CANTO|SECTION)\s+(?:[IVXLC]+|[\dOZ]+|[A-Z][A-Z\s\-']+|ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)\.?(?:\s*[—:.\-]?\s*.*)?"
    r"|(?:PREFACE|INTRODUCTION|PROLOGUE|EPILOGUE|FOREWORD|APPENDIX|CONTENTS)\.?\s*$|[IVXLC]{1,5}\.?\s*$)"
)
SCENE = r"^\s*(?:\*\s*\*\s*\*|\*\*\*|—\s*—\s*—|·\s*·\s*·)\s*$"
DIVIDER = r"^[\[\]_*\-=]{1,4}$"
CONTENTS = r"(?iU)^\s*(?:CONTENTS|TABLE OF CONTENTS)\s*$"
CONTENTS_IN_TEXT = r"(?imU)^\s*(?:CONTENTS|TABLE OF CONTENTS)\s*$"
INDENTED = r"(?U)^\s{4,}\S"
# Lengths.
HEADING_MOST, LIKELY_MOST, CONTENTS_LINE_MOST, FRONT_LINES, PROSE_LEAST, PROSE_SURE = 100, 80, 80, 200, 80, 140
CONTENTS_SHARE, CONTENTS_LINES, KEEP_SHARE = 0.3, 50, 0.2
# Markers and headings of the block formatter.
BLOCK_START = r"(?is)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
BLOCK_END = r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
BLOCK_HEADING = (
    r"(?i)^(?:chapter|chap\.|letter|book|part|volume|vol\.|act|scene|canto|stave|section|epilogue|prologue|introduction|preface|prelude|finale"
    r"|foreword|afterword|conclusion|postscript|appendix|argument|sonnet|hymn|ode|psalm)\b"
)
BLOCK_NUMBER = r"^(?:[IVXLCDM]{1,7}|\d{1,3})\.?$"
VERSE_MEAN, BLOCK_HEADING_MOST = 48, 64


def strip_wrapper(raw: Column) -> Column:
    """The text between the first start and end marker, trimmed.

    An end marker that stands only before the start marker cuts nothing.
    """
    return strip(_between(raw, START, END))


def _between(raw: Column, start: str, end: str) -> Column:
    at = F.regexp_instr(raw, F.lit(start))
    head = F.coalesce(F.regexp_substr(raw, F.lit(start)), F.lit(""))
    body = F.when(at > 0, F.substr(raw, at + F.length(head))).otherwise(raw)
    stop = F.regexp_instr(body, F.lit(end))
    return F.when(stop > 0, F.substring(body, 1, stop - 1)).otherwise(body)


@F.arrow_udf(T.StringType())
def strip_illustrations(texts: pa.Array) -> pa.Array:
    """Text without ``[Illustration ...]``, brackets balanced; an unclosed one drops the rest."""
    import re

    opening, bracket = re.compile(r"\[illustration", re.I), re.compile(r"[\[\]]")

    def one(s: str) -> str:
        kept, at = [], 0
        while m := opening.search(s, at):
            kept.append(s[at : m.start()])
            depth, at = 1, len(s)
            for b in bracket.finditer(s, m.end()):
                depth += 1 if b[0] == "[" else -1
                if depth == 0:
                    at = b.end()
                    break
        return "".join([*kept, s[at:]]) if kept else s

    return pa.array([None if s is None else one(s) for s in texts.to_pylist()], pa.string())


def is_likely_heading(trim: Column) -> Column:
    bare = strip(F.regexp_replace(trim, r"[\[\].:,'\-]", ""))
    caps = (bare == F.upper(bare)) & F.regexp_like(bare, F.lit("[A-Z]"))
    like = lambda p: F.regexp_like(trim, F.lit(p))
    return (trim != "") & (F.length(trim) <= LIKELY_MOST) & (caps | like(rf"(?i)^(?:{_KEYWORDS})") | like(r"(?i)^[IVXLC]+\.?$"))


def is_chapter(trim: Column) -> Column:
    return (F.length(trim) < HEADING_MOST) & F.regexp_like(trim, F.lit(CHAPTER)) & is_likely_heading(trim)


def looks_like_prose(line: Column) -> Column:
    n = F.length(line)
    closed = F.regexp_like(line, F.lit(r"""[.!?'"]\s*$"""))
    return (n >= PROSE_LEAST) & (closed | ((n > PROSE_SURE) & ~F.regexp_like(line, F.lit(r"^[A-Z\s.,'\-:]+$"))))


def _first(lines: Column, test) -> Column:
    """The least index whose line passes ``test(line, index)``; null if none does."""
    hits = F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    return F.array_min(hits)


def strip_contents(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` from the first strong heading after a contents line on.

    Only within the first third or so; not if under a fifth of the text would be left.
    Steps are columns of their own, so that nothing is computed again for each line.
    """
    keep = docs.columns
    t = F.col(text)
    has = F.regexp_like(t, F.lit(CONTENTS_IN_TEXT))
    d = docs.withColumn("__l", F.when(has, F.split(t, r"\r?\n")))
    d = d.withColumn("__s", _first(F.col("__l"), lambda x, i: F.regexp_like(x, F.lit(CONTENTS))))
    until = F.ceil(F.size("__l") * CONTENTS_SHARE) + CONTENTS_LINES
    d = d.withColumn("__w", F.when(F.col("__s").isNotNull(), F.slice("__l", F.col("__s") + 2, (until - 1).cast("int"))))
    opens = lambda x: (F.length(x) < CONTENTS_LINE_MOST) & F.regexp_like(x, F.lit(rf"(?i)^\s*(?:{_KEYWORDS})\b")) & is_likely_heading(strip(x))
    d = d.withColumn("__h", _first(F.col("__w"), lambda x, i: opens(x)))
    cut = F.when(F.col("__h").isNotNull(), F.array_join(F.slice("__l", F.col("__s") + F.col("__h") + 2, F.size("__l")), "\n"))
    d = d.withColumn("__c", cut)
    good = F.col("__c").isNotNull() & (F.length("__c") >= F.length(text) * KEEP_SHARE)
    return d.withColumn(text, F.when(good, F.col("__c")).otherwise(t)).select(*keep)


def format_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, html, wordCount)`` by the line formatter: headings, verse, breaks, paragraphs.

    Words are counted before front matter is skipped.  A text without blocks has empty html; null
    text gives null html and no words.  A document stays one row: its lines are arrays, and each
    step is a column of its own.
    """
    d = strip_contents(docs.select(F.col(key).alias("k"), strip_illustrations(strip_wrapper(F.col(text))).alias("body")), "body")
    # Front matter: lines before the first heading or prose among the first lines.
    d = d.withColumn("line", F.split("body", r"\r?\n")).withColumn("t", F.transform("line", strip)).withColumn("ch", F.transform("t", is_chapter))
    front = F.coalesce(_first(F.slice("t", 1, FRONT_LINES), lambda t, i: F.get("ch", i) | looks_like_prose(t)), F.lit(0))
    d = d.withColumn("from", front)
    for c in ("line", "t", "ch"):
        d = d.withColumn(c, F.slice(c, F.col("from") + 1, F.greatest(F.size(c), F.lit(1))))
    d = d.withColumn("ind", F.transform("line", lambda x: F.regexp_like(x, F.lit(INDENTED)).cast("int")))
    near = lambda i: F.aggregate(F.slice("ind", F.greatest(i - 3, F.lit(1)), i + 5 - F.greatest(i - 4, F.lit(0))), F.lit(0), lambda s, x: s + x) - F.get("ind", i)
    d = d.withColumn(
        "kind",
        F.transform(
            "t",
            lambda t, i: F.when(F.regexp_like(t, F.lit(SCENE)), "hr").when(F.get("ch", i), "h2").when((F.get("ind", i) == 1) & (near(i) >= 2), "pre")
            .when(t == "", "blank").when(F.regexp_like(t, F.lit(DIVIDER)), "divider").otherwise("p"),
        ),
    )
    # A divider parts verse but not a paragraph.
    before = lambda xs, i: F.when(i > 0, F.get(xs, i - 1))
    rows = F.transform("kind", lambda k, i: F.struct(k.alias("kind"), F.get("line", i).alias("line"), F.get("t", i).alias("t"), ((k == "pre") & ~before("kind", i).eqNullSafe(F.lit("pre"))).alias("stanza")))
    d = d.withColumn("x", F.filter(rows, lambda x: x["kind"] != "divider"))
    opens = lambda x, i: F.when(x["kind"] == "p", ~before("x", i)["kind"].eqNullSafe(F.lit("p"))).otherwise(x["stanza"] | x["kind"].isin("hr", "h2"))
    d = d.withColumn("at", F.filter(F.transform("x", lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull()))
    lines = lambda s, m: F.filter(F.slice("x", s + 1, F.coalesce(F.get("at", m + 1), F.size("x")) - s), lambda x: x["kind"] != "blank")
    d = d.withColumn("b", F.transform("at", lines))
    joined = lambda b: F.struct(
        b[0]["kind"].alias("kind"), b[0]["t"].alias("t"), strip(F.array_join(F.transform(b, lambda x: x["t"]), " ")).alias("para"),
        F.regexp_replace(F.array_join(F.transform(b, lambda x: x["line"]), "\n"), r"(?U)\s+$", "").alias("verse"),
    )
    d = d.withColumn("b", F.transform("b", joined))
    d = d.withColumn("b", F.filter("b", lambda b: ((b["kind"] != "p") | (F.length(b["para"]) >= 3)) & ((b["kind"] != "pre") | (strip(b["verse"]) != ""))))
    # The last heading of a name keeps the id.
    d = d.withColumn("ids", F.transform("b", lambda b: F.when(b["kind"] == "h2", heading_slug(b["t"])))).withColumn("back", F.reverse("ids"))

    def markup(b: Column, i: Column) -> Column:
        id_ = F.get("ids", i)
        last = F.size("ids") - F.array_position("back", id_) == i
        head = F.when(last, F.concat(F.lit('<h2 id="'), id_, F.lit('">'))).otherwise(F.when(id_ == "", F.lit('<h2 id="">')).otherwise(F.lit('<h2 class="toc-entry">')))
        return (
            F.when(b["kind"] == "hr", '<hr class="break" />').when(b["kind"] == "h2", F.concat(head, escape_line(pretty_heading(b["t"])), F.lit("</h2>")))
            .when(b["kind"] == "pre", F.concat(F.lit('<pre class="verse">'), escape_line(b["verse"]), F.lit("</pre>")))
            .otherwise(F.concat(F.lit("<p>"), escape_line(b["para"]), F.lit("</p>")))
        )

    html = F.array_join(F.transform("b", markup), "\n")
    return d.select(F.col("k").alias(key), F.when(F.col("body").isNotNull(), F.coalesce(html, F.lit(""))).alias("html"), F.coalesce(count_text_words(F.col("body")), F.lit(0)).alias("wordCount"))


def extract_toc(html: Column) -> Column:
    """``array<struct<id, label>>`` of the headings with an id and plain text."""
    p = r'<h2 id="([^"]+)">([^<]+)</h2>'
    return F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(0)), lambda h: F.struct(F.regexp_extract(h, p, 1).alias("id"), F.regexp_extract(h, p, 2).alias("label")))


def strip_boilerplate(text: Column) -> Column:
    """Markers and the first leading credit line removed, trimmed."""
    return strip(F.regexp_replace(_between(text, BLOCK_START, BLOCK_END), r"(?iU)\A\s*Produced by[^\n]*\n", ""))


def block_heading(block: Column) -> Column:
    """The block's text if it is a heading, else null."""
    lines = F.split(block, "\n")
    t = strip(F.array_join(F.transform(lines, strip), " "))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    caps = (t == F.upper(t)) & (t != F.lower(t)) & words.between(2, 8) & ~F.regexp_like(t, F.lit(r"[.?!],?\s+\S"))
    ok = (F.size(lines) <= 2) & (t != "") & (F.length(t) <= BLOCK_HEADING_MOST) & ~F.regexp_like(t, F.lit("^[\"'“‘]"))
    return F.when(ok & (F.regexp_like(t, F.lit(BLOCK_HEADING)) | F.regexp_like(t, F.lit(BLOCK_NUMBER)) | caps), t)


def is_verse_block(block: Column) -> Column:
    """Two lines or more, all but the last short on average (blank ones aside)."""
    lines = F.split(block, "\n")
    most = F.filter(F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    total = F.aggregate(most, F.lit(0), lambda a, x: a + F.length(x))
    return (F.size(lines) >= 2) & (F.size(most) > 0) & (total < F.size(most) * VERSE_MEAN)


def to_html(docs: DataFrame, key: str, text: str, title: str, author: str, verse: str | None = None) -> DataFrame:
    """``(key, html, n_headings)`` by the block formatter.

    ``verse`` names a boolean column for whole books in verse.  Text without blocks gives an
    empty article; null text gives null html.
    """
    plain = strip_boilerplate(F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    d = docs.select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(author).alias("a"), (F.col(verse) if verse else F.lit(False)).alias("v"), plain.alias("body"))
    # A document stays one row: its blocks, what each is as a heading, and where headings stand.
    d = d.withColumn("b", F.filter(F.split("body", r"\n[ \t]*\n"), lambda b: strip(b) != ""))
    d = d.withColumn("h", F.transform("b", lambda b: squeeze(block_heading(b))))
    d = d.withColumn("p", F.filter(F.transform("h", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()))
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: escape_block(F.regexp_replace(strip(x), r"[ \t]+", " "))), lambda x: x != "")

    def markup(b: Column, i: Column) -> Column:
        h = F.get("h", i)
        return (
            F.when(h.isNotNull(), F.concat(F.lit('<h2 id="sec-'), F.array_position("p", i).cast("string"), F.lit('">'), escape_block(h), F.lit("</h2>")))
            .when(F.coalesce("v", F.lit(False)) | is_verse_block(b), F.concat(F.lit('<p class="verse">'), F.array_join(lines(b), "<br>"), F.lit("</p>")))
            .otherwise(F.concat(F.lit("<p>"), escape_block(squeeze(F.array_join(F.transform(F.split(b, "\n"), strip), " "))), F.lit("</p>")))
        )

    toc = F.transform(F.filter("h", lambda h: h.isNotNull()), lambda h: F.concat(F.lit('<h2 class="toc-entry">'), escape_block(h), F.lit("</h2>")))
    c, m = F.array_join(toc, "\n"), F.array_join(F.transform("b", markup), "\n")
    e_t, e_a = escape_block(F.coalesce("t", F.lit(""))), escape_block(F.coalesce("a", F.lit("")))
    page = F.concat(
        F.lit('<!doctype html>\n<meta charset="utf-8" />\n<title>'), e_t, F.lit(" — "), e_a, F.lit('</title>\n<article data-book-id="'), F.col("k").cast("string"), F.lit('" data-title="'), e_t,
        F.lit('" data-author="'), e_a, F.lit('">\n'), F.when(F.size("p") > 0, F.concat(c, F.lit("\n"))).otherwise(""), m, F.lit("\n</article>\n"),
    )
    return d.select(F.col("k").alias(key), F.when(F.col("body").isNotNull(), page).alias("html"), F.coalesce(F.size("p"), F.lit(0)).cast("bigint").alias("n_headings"))


def markup_counts(html: Column) -> Column:
    """``struct<breaks, headings>`` of a document."""
    return F.struct(F.regexp_count(html, F.lit("<br>")).alias("breaks"), F.regexp_count(html, F.lit(r'<h2 id=')).alias("headings"))

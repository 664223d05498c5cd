"""Reader documents: atoms, contents, pages, highlights."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioframe.functions.text import strip, strip_tags
from folioframe.operators.clean import html_blocks
from folioframe.operators.wiki import plain_markup, unescape_text
from folioframe.schema import HIGHLIGHTS



def article_slice(html: Column) -> Column:
    """The article with its tags, or the whole text where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(html, "(?s)<article.*</article>", 0), F.lit("")), html)


def _segments(inner: Column, is_pre: Column) -> Column:
    """``array<struct<t, em, br>>`` of a block's children; line feeds break a ``pre``."""
    child = r"(?is)<br\s*/?>|<(\w+)[^>]*>.*?</\1>|<[^>]*>|[^<]+"
    of = lambda s: F.struct(
        F.when(F.regexp_like(s, F.lit(r"(?i)^<br")), F.lit("")).otherwise(unescape_text(strip_tags(s))).alias("t"),
        (F.startswith(s, F.lit("<")) & ~F.regexp_like(s, F.lit(r"(?i)^<br"))).alias("em"), F.regexp_like(s, F.lit(r"(?i)^<br")).alias("br"),
    )
    plain = F.transform(F.regexp_extract_all(inner, F.lit(child), F.lit(0)), of)
    line = lambda s, i: F.array(F.struct(F.lit("").alias("t"), F.lit(False).alias("em"), F.lit(True).alias("br")), F.struct(unescape_text(strip_tags(s)).alias("t"), F.lit(False).alias("em"), F.lit(False).alias("br")))
    lines = F.flatten(F.transform(F.split(inner, "\n"), line))
    return F.when(is_pre, F.slice(lines, 2, F.size(lines))).otherwise(plain)


def atom_array(html: Column) -> Column:
    """``array<struct<type, id, text, verse, segs>>`` of a document's atoms in order.

    Contents entries and blank paragraphs are left out, headings are kept; null gives null.
    """

    def atom(b: Column) -> Column:
        tag, attrs = F.lower(b["tag"]), b["attrs"]
        cls = F.split(F.regexp_extract(attrs, r"""(?i)class\s*=\s*["']([^"']*)["']""", 1), r"\s+")
        return F.struct(
            F.when(tag == "h2", "h2").otherwise("p").alias("type"), F.nullif(F.regexp_extract(attrs, r"""(?i)(?:^|\s)id\s*=\s*["']([^"']*)["']""", 1), F.lit("")).alias("id"),
            ((tag == "pre") | ((tag == "p") & F.array_contains(cls, "verse"))).alias("verse"), F.array_contains(cls, "toc-entry").alias("toc"), _segments(b["inner"], tag == "pre").alias("segs"),
        )

    parts = F.filter(F.transform(html_blocks(plain_markup(html)), atom), lambda a: ~((a["type"] == "h2") & a["toc"]))
    whole = F.transform(parts, lambda a: F.struct(a["type"].alias("type"), a["id"].alias("id"), F.array_join(F.transform(a["segs"], lambda x: x["t"]), "").alias("text"), a["verse"].alias("verse"), a["segs"].alias("segs")))
    return F.filter(whole, lambda a: (a["type"] == "h2") | (strip(a["text"]) != ""))


def atoms(docs: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, ai, type, id, text, verse, segs)``: headings and paragraphs in order, from 0.

    A document is one row until its atoms are laid out, so nothing is shuffled or sorted.
    """
    return docs.select(F.col(key), F.posexplode(atom_array(F.col(html))).alias("ai", "a")).select(key, "ai", "a.type", "a.id", "a.text", "a.verse", "a.segs")


def contents(atom_rows: DataFrame, key: str) -> DataFrame:
    """Headings with an id: ``(key, ai, id, label)``."""
    return atom_rows.where((F.col("type") == "h2") & F.col("id").isNotNull()).select(key, "ai", "id", strip(F.col("text")).alias("label"))


def word_ends(text: str, start: int) -> list[int]:
    """End offsets of the words from ``start`` on; the text's end is the last."""
    ends = [m.end() for m in re.finditer(r"\s*\S+", text[start:])]
    ends = [start + e for e in ends]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


def fill_pages(sizes: list[tuple[str, str]], budget: int, atom_cost: int = 40) -> Iterator[list[tuple[int, int, int]]]:
    """Pages of ``(atom, start, end)``; an atom costs its characters and ``atom_cost``.

    A page takes atoms whole while they fit, then the most words of the next; a heading alone
    on a page is forced, and so is one word where not even that fits.  Each page takes something,
    so it ends without a guard on the number of pages.
    """
    ai = off = 0
    while ai < len(sizes):
        page, room = [], budget
        while ai < len(sizes):
            kind, text = sizes[ai]
            if len(text) - off + atom_cost <= room or (not page and kind == "h2"):
                page.append((ai, off, len(text)))
                room -= len(text) - off + atom_cost
                forced = room < 0
                ai, off = ai + 1, 0
                if forced:
                    break
                continue
            ends = word_ends(text, off)
            fit = bisect.bisect_right(ends, off + room - atom_cost) - 1
            if fit < 0 and not page:
                fit = 0
            if fit >= 0:
                page.append((ai, off, ends[fit]))
                off = ends[fit]
                if off >= len(text):
                    ai, off = ai + 1, 0
            break
        if page:
            yield page


def paginate(atom_rows: DataFrame, key: str, budget: int = 1800) -> DataFrame:
    """``(key, page, ai, start, end)``: pages of a character budget, from 0.

    The measure of a page is characters, where the original measures drawn height.  A
    document's atoms meet in one row (the size of the document), no more.  See
    ``paginate_documents`` for documents whose atoms aren't laid out yet.
    """
    return _pages(atom_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ai", "type", "text"))).alias("a")), key, budget)


def paginate_documents(docs: DataFrame, key: str, html: str, budget: int = 1800) -> DataFrame:
    """As ``paginate`` of the documents' atoms, in one narrow pass."""
    a = F.transform(atom_array(F.col(html)), lambda x, i: F.struct(i.alias("ai"), x["type"].alias("type"), x["text"].alias("text")))
    return _pages(docs.select(key, F.coalesce(a, F.array().cast("array<struct<ai:int,type:string,text:string>>")).alias("a")), key, budget)


def _pages(docs: DataFrame, key: str, budget: int) -> DataFrame:
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("page", "ai", "start", "end"))])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], []
            for i, a in enumerate(batch.column(1).to_pylist()):
                for no, page in enumerate(fill_pages([(x["type"], x["text"]) for x in a], budget)):
                    for at, s, e in page:
                        rows.append(i)
                        cols.append((no, a[at]["ai"], s, e))
            c = list(zip(*cols)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c[j], pa.int32()) for j in range(4))], [f.name for f in schema])

    return docs.mapInArrow(pages, schema)


def jump_page(pages: DataFrame, key: str, ai: int, spread: bool = False) -> DataFrame:
    """The first page of each document that holds the atom; even in a spread."""
    p = pages.where(F.col("ai") == ai).groupBy(key).agg(F.min("page").alias("page"))
    return p.withColumn("page", F.col("page") - F.col("page") % 2) if spread else p


def parse_highlights(raw: Column) -> Column:
    """Stored highlights; an empty array for null or broken text."""
    return F.coalesce(F.from_json(raw, HIGHLIGHTS), F.array().cast(HIGHLIGHTS))


def paint(atom_rows: DataFrame, highlights: DataFrame, key: str) -> DataFrame:
    """``(key, ai, start, end, color)``: coloured stretches of each atom, the last paint on top.

    An interval sweep: an atom is cut at the ends of its highlights, and each stretch takes
    the colour of the latest one over it; a null colour erases.  Neighbours of one colour merge.
    """
    h = highlights.join(atom_rows.select(key, F.col("ai").alias("atomIndex"), F.length("text").alias("n")), [key, "atomIndex"])
    h = h.select(key, F.col("atomIndex").alias("ai"), "seq", "color", F.greatest("start", F.lit(0)).alias("s"), F.least("end", F.col("n")).alias("e")).where("s < e")
    cuts = h.select(key, "ai", F.explode(F.array("s", "e")).alias("x")).distinct()
    w = W.partitionBy(key, "ai").orderBy("x")
    parts = cuts.withColumn("y", F.lead("x").over(w)).where("y is not null")
    top = (
        parts.join(h, [key, "ai"]).where((F.col("s") <= F.col("x")) & (F.col("e") >= F.col("y"))).groupBy(key, "ai", "x", "y")
        .agg(F.max_by(F.struct("color"), "seq").alias("c")).select(key, "ai", "x", "y", F.col("c.color").alias("color")).where("color is not null")
    )
    same = (F.lag("y").over(w) == F.col("x")) & (F.lag("color").over(w) == F.col("color"))
    runs = top.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "ai", "run", "color").agg(F.min("x").alias("start"), F.max("y").alias("end")).select(key, "ai", "start", "end", "color")


def split_selection(selections: DataFrame, atom_rows: DataFrame, key: str) -> DataFrame:
    """Selections ``(sel, a_ai, a_off, b_ai, b_off)`` as ranges ``(sel, ai, start, end)`` per atom.

    A reversed selection is turned; empty ranges are dropped.
    """
    a, b = F.struct("a_ai", "a_off"), F.struct(F.col("b_ai").alias("a_ai"), F.col("b_off").alias("a_off"))
    s = selections.select(key, "sel", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    each = s.select(key, "sel", "lo", "hi", F.explode(F.sequence("lo.a_ai", "hi.a_ai")).alias("ai")).join(atom_rows.select(key, "ai", F.length("text").alias("n")), [key, "ai"])
    start = F.when(F.col("ai") == F.col("lo.a_ai"), F.col("lo.a_off")).otherwise(0)
    end = F.when(F.col("ai") == F.col("hi.a_ai"), F.least("hi.a_off", "n")).otherwise(F.col("n"))
    return each.select(key, "sel", "ai", start.alias("start"), end.alias("end")).where("start < end")


def apply_color(highlights: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Highlights after painting ``ranges (ai, start, end, color)``: those inside a range go,
    the ranges are appended, also with a null colour."""
    r = ranges.select(key, F.col("ai").alias("atomIndex"), F.col("start").alias("rs"), F.col("end").alias("re"))
    inside = [key, "atomIndex"]
    gone = highlights.join(r, inside).where((F.col("start") >= F.col("rs")) & (F.col("end") <= F.col("re"))).select(key, "seq")
    kept = highlights.join(gone.distinct(), [key, "seq"], "left_anti")
    base = kept.groupBy(key).agg(F.max("seq").alias("m"))
    new = ranges.join(base, key, "left").select(
        key, F.col("ai").alias("atomIndex"), (F.coalesce("m", F.lit(-1)) + F.row_number().over(W.partitionBy(key).orderBy("ai", "start", "end", "color"))).cast("int").alias("seq"), "start", "end", "color"
    )
    cols = [key, "seq", "atomIndex", "start", "end", "color"]
    return kept.select(*cols).unionByName(new.select(*cols))

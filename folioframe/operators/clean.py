"""Cleaning of stored documents: drop boilerplate blocks, scrub the rest, count both.

Blocks are an array column cut by one pattern; rules are ordered conditions that name the
reason of a drop.  All of it is one narrow stage in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import strip, strip_tags

BLOCK = r"(?is)<(h2|p|pre)((?:\s[^>]*)?)>(.*?)</\1>"
ARTICLE = r"(?is)(<article[^>]*>)(.*)(</article>)"

# Phrases and forms of boilerplate, ornaments and headers.
PHRASES = (
    r"(?i)project gutenberg|gutenberg\.org|gutenberg-?tm|gutenberg literary archive|distributed proofread|www\.pgdp|online distributed proofreading"
    r"|this e-?book is for the use|\*\*\*\s*(?:start|end) of|end of (?:the|this) project|updated editions will replace|holder of the project|set forth in the general terms"
)
PRODUCED = r"(?i)^\s*produced by\b"
HEADER = (
    r"(?i)^\s*(?:title|author|illustrator|editor|translator|release date|posting date|last updated|most recently updated|language|credits"
    r"|character set encoding|first published|original publication|ebook no\.?|e-?text)\s*:"
)
TRANSCRIBER = r"(?i)transcriber['’]?s?\s*note"
ORNAMENT = r"(?U)^[\s|+_=*.\-—–~#]+$"
ILLUSTRATION = r"(?i)\[\s*illustration[^\]]*\]"
TRANSCRIBER_ASIDE = r"(?i)\(\s*transcriber['’]?s?\s*note[^)]*\)"


def drop_reason(text: Column) -> Column:
    """Why a block of this tagless text is dropped; null if it is kept."""
    t = strip(text)
    like = lambda p: F.regexp_like(t, F.lit(p))
    boxed = like(r"\||\+-{3,}") | F.startswith(F.ltrim(F.lower(t), F.lit("*")), F.lit("transcriber"))
    return (
        F.when(t == "", "blank").when(like(PHRASES), "phrase").when(like(PRODUCED) & (F.length(t) < 240), "produced")
        .when(like(HEADER) & (F.length(t) < 160), "header").when(like(TRANSCRIBER) & ((F.length(t) < 260) | boxed), "transcriber")
        .when(like(ORNAMENT), "ornament")
    )


def scrub(inner: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(inner, ILLUSTRATION, ""), TRANSCRIBER_ASIDE, "")
    return strip(F.regexp_replace(F.replace(x, F.lit("​"), F.lit("")), r"[ \t]{2,}", " "))


def html_blocks(html: Column) -> Column:
    """``array<struct<tag, attrs, inner>>`` of the blocks of the article (or of all of it)."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, ARTICLE, 2), F.lit("")), html)
    return F.transform(
        F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0)),
        lambda b: F.struct(
            F.regexp_extract(b, BLOCK, 1).alias("tag"), F.regexp_extract(b, BLOCK, 2).alias("attrs"), F.regexp_extract(b, BLOCK, 3).alias("inner")
        ),
    )


def clean_documents(docs: DataFrame, html: str = "html") -> DataFrame:
    """``docs`` with ``cleaned``, ``dropped`` and ``scrubbed``.

    Everything in the article that isn't a block is discarded.  Without an article the text
    stays as it is and both counts are 0; null stays null.
    """
    h = F.col(f"`{html}`")
    has = F.regexp_like(h, F.lit(ARTICLE))
    judged = F.transform(
        html_blocks(h),
        lambda b: F.struct(b["tag"].alias("tag"), b["attrs"].alias("attrs"), b["inner"].alias("inner"), drop_reason(strip_tags(b["inner"])).alias("why"), scrub(b["inner"]).alias("new")),
    )
    names = [c for c in docs.columns if c not in ("cleaned", "dropped", "scrubbed", "__b")]
    d = docs.select(*[F.col(f"`{c}`") for c in names], F.when(has, judged).alias("__b"))
    kept = F.filter("__b", lambda b: b["why"].isNull())
    full = F.filter(kept, lambda b: strip(strip_tags(b["new"])) != "")
    text = F.array_join(F.transform(full, lambda b: F.concat(F.lit("<"), b["tag"], b["attrs"], F.lit(">"), b["new"], F.lit("</"), b["tag"], F.lit(">"))), "\n")
    around = lambda g: F.regexp_extract(h, r"(?is)^(.*?)(<article[^>]*>).*(</article>)(.*)$", g)
    return d.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col("__b").isNull(), h).otherwise(F.concat(around(1), around(2), F.lit("\n"), text, F.lit("\n"), around(3), around(4))).alias("cleaned"),
        F.coalesce(F.size("__b") - F.size(full), F.lit(0)).cast("bigint").alias("dropped"),
        F.coalesce(F.size(F.filter(kept, lambda b: b["new"] != strip(b["inner"]))), F.lit(0)).cast("bigint").alias("scrubbed"),
    )


def dropped_blocks(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, block, reason)`` of every dropped block, numbered from 0."""
    h = F.when(F.regexp_like(html, F.lit(ARTICLE)), F.col(html))
    return (
        docs.select(key, F.posexplode(html_blocks(h)).alias("block", "b"))
        .select(key, "block", F.coalesce(drop_reason(strip_tags(F.col("b.inner"))), F.when(strip(strip_tags(scrub(F.col("b.inner")))) == "", "emptied")).alias("reason"))
        .where("reason is not null")
    )


def clean_report(cleaned: DataFrame, html: str = "html") -> DataFrame:
    """One row: documents, documents changed, blocks dropped and scrubbed."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("cleaned").eqNullSafe(F.col(html))).alias("changed"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.coalesce(F.sum("scrubbed"), F.lit(0)).alias("scrubbed"),
    )

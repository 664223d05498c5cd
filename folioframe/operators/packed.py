"""Several values packed in one field: split them into one value per row.

The text is cut at its quote characters.  Pieces between an opening and a closing
quote are literals; the pieces outside are cut at delimiters; array folds then put
the values together again with their ordinals.  Everything is a column expression,
so the operator is one narrow, code-generated stage without a shuffle.

Defined results: null, empty or delimiter-only text gives no rows; empty values are
skipped and take no place; repeats are kept; an unclosed quote makes the rest of the
text a literal; a quote inside a value stays part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters that stand for protected text while it is being cut.
CUT, QUOTE, COMMA, SEMICOLON, SLASH, PIPE, BACKSLASH, ESCAPE = MARKS = tuple(chr(0xE000 + i) for i in range(8))

#: Delimiters that outrank the comma, as a Java pattern: semicolon, bar, tab, line
#: feed, bullet, ideographic comma, and a slash between spaces.
STRONG = r"[;|\t\n\r•、；｜]|(?<=\s)/(?=\s)"
_EDGE = r"[,;|/•、\t\n\r]"


def _protect(text: Column) -> Column:
    """Hide escaped characters and the semicolons that end character entities."""
    t = F.when(F.regexp_like(text, F.lit(f"[{CUT}-{ESCAPE}]")), _escape(text)).otherwise(text)
    t = F.replace(t, F.lit("\\\\"), F.lit(BACKSLASH))
    t = F.replace(t, F.lit('\\"'), F.lit(QUOTE))
    t = F.replace(t, F.lit("\\'"), F.lit("'"))
    t = F.replace(t, F.lit("\\,"), F.lit(COMMA))
    t = F.replace(t, F.lit("\\;"), F.lit(SEMICOLON))
    t = F.replace(t, F.lit("\\/"), F.lit(SLASH))
    t = F.replace(t, F.lit("\\|"), F.lit(PIPE))
    return F.regexp_replace(t, r"(&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+));", "$1" + SEMICOLON)


def _escape(text: Column) -> Column:
    """The marks that the text itself holds, written as the last mark and a digit."""
    for i in reversed(range(len(MARKS))):
        text = F.replace(text, F.lit(MARKS[i]), F.lit(f"{ESCAPE}{i}"))
    return text


def _unescape(text: Column) -> Column:
    plain = text
    for i, mark in enumerate(MARKS):
        plain = F.replace(plain, F.lit(f"{ESCAPE}{i}"), F.lit(mark))
    return F.when(F.contains(text, F.lit(ESCAPE)), plain).otherwise(text)


def _reveal(text: Column) -> Column:
    for mark, plain in ((QUOTE, '"'), (COMMA, ","), (SEMICOLON, ";"), (SLASH, "/"), (PIPE, "|"), (BACKSLASH, "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def unpack_values(text: Column) -> Column:
    """``array<string>`` of the non-empty values of ``text`` in order; empty for null."""
    t = _protect(F.coalesce(text, F.lit("")))
    # A list in square brackets, as JSON and similar notations write it.
    t = F.regexp_replace(t, r"(?s)^\s*\[\s*(?=[\"'])(.*)\]\s*$", "$1")
    # Single quotes pack values only where there are no double ones and every one of
    # them that opens a value has one that closes it; elsewhere they are apostrophes.
    opened = F.regexp_count(t, F.lit(r"(?:^|" + _EDGE + r")\s*'"))
    closed = F.regexp_count(t, F.lit(r"'\s*(?:$|" + _EDGE + ")"))
    single = ~F.contains(t, F.lit('"')) & (opened > 0) & (opened == closed)
    as_double = F.regexp_replace(
        F.regexp_replace(t, r"(^|" + _EDGE + r")(\s*)'", '$1$2"'), r"'(\s*)($|" + _EDGE + ")", '"$1$2'
    )
    t = F.when(single, as_double).otherwise(t)
    pieces = F.split(t, '"')
    last = F.size(pieces) - 1
    outside = F.array_join(F.filter(pieces, lambda p, i: i % 2 == 0), " x ")
    strong = F.regexp_like(outside, F.lit(STRONG))
    cut = lambda p: F.when(strong, F.regexp_replace(p, STRONG, CUT)).otherwise(F.replace(p, F.lit(","), F.lit(CUT)))
    # A quote packs when a delimiter or the start stands before it; two quotes in a row
    # inside a literal are one quote; any other quote belongs to the value.
    whole = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 1, p)
        .when((p == "") & (i > 0) & (i < last), F.lit(QUOTE))
        .otherwise(
            F.concat(
                F.when((i > 0) & ~F.regexp_like(p, F.lit(r"^\s*(?:$|" + _EDGE + ")")), QUOTE).otherwise(""),
                cut(p),
                F.when((i < last) & ~F.regexp_like(p, F.lit(r"(?:^|" + _EDGE + r")\s*$")), QUOTE).otherwise(""),
            )
        ),
    )
    parts = F.split(F.array_join(whole, ""), CUT)
    values = F.transform(parts, lambda v: F.regexp_replace(_unescape(_reveal(v)), r"(?U)^\s+|\s+$", ""))
    return F.filter(values, lambda v: ~F.regexp_like(v, F.lit(r"(?U)^[\s,;|]*$")))


def explode_packed(df: DataFrame, column: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per packed value: the other columns of ``df``, ``pos`` from 1, ``value``.

    Columns of ``df`` that are already named ``value`` or ``pos`` are replaced.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (column, value, pos)]
    return df.select(*keep, F.posexplode(unpack_values(F.col(f"`{column}`"))).alias("__p", "__v")).select(
        *keep, (F.col("__p") + 1).cast("bigint").alias(pos), F.col("__v").alias(value)
    )

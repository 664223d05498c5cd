"""Catalogue queries: scan with defaults, filter, search, sort, top-k, grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import call_number, falsy, reading_hours, reading_minutes

# The popular list, in its order.
POPULAR = (
    "pride-and-prejudice", "alice-wonderland", "frankenstein", "dracula", "moby-dick", "odyssey", "hamlet", "walden",
    "meditations", "crime-punishment", "treasure-island", "origin-of-species",
)
TITLE_ORDER = "title COLLATE UNICODE"


def catalog(raw: DataFrame, ord_: Column) -> DataFrame:
    """The typed catalogue: defaults filled in and the catalogue position ``ord`` added.

    Empty and null text take the default, but ``summary`` and ``coverUrl`` stay as they are
    when empty.  Columns that ``raw`` doesn't have are left out, so a query reads only what it
    names; further columns are kept.  ``ord`` must order the rows totally.
    """
    lit = F.lit
    fixed = {
        "title": falsy(F.col("title"), lit("Untitled")),
        "author": falsy(F.col("author"), lit("Unknown")),
        "language": falsy(F.col("language"), lit("en")),
        "category": falsy(F.col("category"), lit("Fiction")),
        "subjectsCsv": falsy(F.col("subjectsCsv"), lit("")),
        "contentPath": falsy(F.col("contentPath"), F.concat(F.col("id"), lit("/content.html"))),
        "wordCount": F.coalesce("wordCount", lit(0)),
        "isFeatured": F.coalesce("isFeatured", lit(False)),
        "source": falsy(F.col("source"), lit("gutenberg")),
        "sourceId": F.coalesce("sourceId", F.col("gutenbergId").cast("string")),
    }
    return raw.withColumns({"ord": ord_}).withColumns({c: e for c, e in fixed.items() if c in raw.columns})


def current_entries(books: DataFrame, key: str = "rec_no", columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per entry: the one with the latest ``updatedAt`` (repeats collapse).

    A map-side ``max_by`` aggregate, so a hot key never gathers its rows.  ``columns`` names
    what to keep (all by default); the others are neither read nor shuffled.
    """
    names = [c for c in books.columns if c != key and (not columns or c in columns)]
    latest = books.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("updatedAt", "wordCount")).alias("r"))
    return latest.select(key, *[F.col(f"r.{c}").alias(c) for c in names])


def all_books(cat: DataFrame, title_order: str = TITLE_ORDER) -> DataFrame:
    """Featured first, then by title (an SQL expression), then by position."""
    return cat.orderBy(F.desc("isFeatured"), F.expr(title_order), "ord")


def featured_books(cat: DataFrame, limit: int = 12, title_order: str = TITLE_ORDER) -> DataFrame:
    return cat.where("isFeatured").orderBy(F.expr(title_order), "ord").limit(limit)


def popular_books(cat: DataFrame, slugs: tuple[str, ...] = POPULAR, limit: int = 12) -> DataFrame:
    """The books of a stated list, in the list's order; the last of equal ids counts."""
    wanted = F.array(*[F.lit(s) for s in slugs])
    found = cat.where(F.col("id").isin(*slugs))
    last = found.groupBy("id").agg(F.max_by(F.struct(*[c for c in cat.columns if c != "id"]), "ord").alias("r"))
    return (
        last.select("id", "r.*", F.array_position(wanted, F.col("id")).alias("rank")).orderBy("rank").limit(limit)
    )


def books_by_category(cat: DataFrame, label: str) -> DataFrame:
    return all_books(cat.where(F.col("category") == label))


def get_book(cat: DataFrame, id_: str) -> DataFrame:
    """The first row with the id, or none."""
    return cat.where(F.col("id") == id_).orderBy("ord").limit(1)


def catalog_card(cat: DataFrame) -> DataFrame:
    w = F.col("wordCount")
    return cat.select(
        "id", "title", "author", "category", F.upper("language").alias("language"), "source", w.cast("bigint").alias("words"),
        reading_minutes(w).alias("minutes"), reading_hours(w).alias("hours"), call_number(F.col("category"), F.col("id")).alias("callNumber"), "summary",
    )


def search_books(cat: DataFrame, needle: str, fields: tuple[str, ...] = ("title", "author", "category", "subjectsCsv")) -> DataFrame:
    """Rows with the needle in a field, case-insensitive and literal; a blank needle finds none."""
    q = needle.strip().lower()
    if not q:
        return cat.where(F.lit(False))
    hit: Column = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(f), F.lit(q))
    return cat.where(hit)


def search_response(cat: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    return search_books(cat, needle).orderBy("ord").limit(limit).select("id", "title", "author", "category")


def find_category(dim: DataFrame, label: str) -> DataFrame:
    return dim.where(F.lower("label") == label.lower()).orderBy("ord").limit(1)


def find_category_by_id(dim: DataFrame, id_: str) -> DataFrame:
    return dim.where(F.col("id") == id_).orderBy("ord").limit(1)


def category_counts(cat: DataFrame) -> DataFrame:
    return cat.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def category_tiles(cat: DataFrame, dim: DataFrame) -> DataFrame:
    """Categories of the dimension that have books, in the dimension's order."""
    counts = category_counts(cat).select(F.col("category").alias("label"), "n")
    return dim.join(counts, "label").select("ord", "id", "label", "blurb", "accent", "emoji", "n").orderBy("ord")


def unmatched_categories(cat: DataFrame, dim: DataFrame) -> DataFrame:
    """Categories of books that the dimension doesn't have: a data-quality report."""
    return category_counts(cat).select("category", "n").join(dim.select(F.col("label").alias("category")), "category", "left_anti")


def with_category(cat: DataFrame, dim: DataFrame) -> DataFrame:
    """Books with the accent and emoji of their category, label case ignored; left join."""
    d = dim.groupBy(F.lower("label").alias("__l")).agg(F.min_by(F.struct("accent", "emoji"), "ord").alias("__d"))
    return cat.join(d, F.lower("category") == F.col("__l"), "left").select(*[cat[c] for c in cat.columns], F.col("__d.accent").alias("accent"), F.col("__d.emoji").alias("emoji"))


def totals(cat: DataFrame) -> DataFrame:
    """Counts, distinct categories and authors, words and hours; one row, also for no books."""
    return cat.agg(
        F.count(F.lit(1)).alias("books"), F.count_distinct("category").alias("categories"), F.count_distinct("author").alias("authors"),
        F.count_if("isFeatured").alias("featured"), F.coalesce(F.sum(F.col("wordCount").cast("bigint")), F.lit(0).cast("bigint")).alias("words"),
    ).withColumn("hours", F.floor(F.col("words") / 220.0 / 60.0 + 0.5).cast("bigint"))


def only_ids(df: DataFrame, ids: str) -> DataFrame:
    """Rows whose id is in a comma-separated list; all rows for a blank list."""
    wanted = [i.strip() for i in ids.split(",") if i.strip()]
    return df.where(F.col("id").isin(*wanted)) if wanted else df


def is_english(languages: Column) -> Column:
    return F.coalesce(F.array_contains(languages, "en"), F.lit(False))


def with_summaries(df: DataFrame, summaries: DataFrame) -> DataFrame:
    """``df`` with the summary of its id where there is one."""
    return df.drop("summary").join(summaries.select("id", "summary"), "id", "left")


def duplicate_metrics(cat: DataFrame) -> DataFrame:
    """Rows less distinct values of ``gutenbergId`` and ``id``; null is one value."""
    def extra(c: str) -> Column:
        return (F.count(F.lit(1)) - F.count_distinct(c) - F.max(F.col(c).isNull().cast("bigint"))).cast("bigint")

    return cat.agg(F.coalesce(extra("gutenbergId"), F.lit(0)).alias("dupNumbers"), F.coalesce(extra("id"), F.lit(0)).alias("dupSlugs"))



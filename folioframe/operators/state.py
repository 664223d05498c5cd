"""Reader state from events: latest progress, recents, shelf, and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Where reading counts as done, and how many rows the views show.
DONE, SHOWN, FALLBACK = 99.0, 8, 6


def latest_progress(events: DataFrame) -> DataFrame:
    """``(userId, bookId, percent, updatedAt)``: the last write wins, by ``updatedAt``.

    Rows without user, book or percent are ignored; of equal times the larger percent
    counts.  Late and repeated rows change nothing.  Combined on the map side.
    """
    ok = events.where(F.col("bookId").isNotNull() & F.col("percent").isNotNull() & F.col("userId").isNotNull())
    return ok.groupBy("userId", "bookId").agg(F.max(F.struct("updatedAt", "percent")).alias("s")).select("userId", "bookId", "s.percent", "s.updatedAt")


def recents(events: DataFrame) -> DataFrame:
    """``(userId, bookId, ord)``: books by last opening, the newest first, from 0."""
    last = events.where(F.col("bookId").isNotNull() & F.col("userId").isNotNull()).groupBy("userId", "bookId").agg(F.max("updatedAt").alias("at"))
    w = W.partitionBy("userId").orderBy(F.desc("at"), "bookId")
    return last.withColumn("ord", F.row_number().over(w) - 1).select("userId", "bookId", "ord")


def shelf(toggles: DataFrame) -> DataFrame:
    """``(userId, bookId, ord)`` of books whose latest toggle is an addition, in the order
    of addition.  ``toggles``: ``(userId, bookId, at, added)``."""
    last = toggles.groupBy("userId", "bookId").agg(F.max_by("added", F.struct("at", "added")).alias("on"), F.max(F.when(F.col("added"), F.col("at"))).alias("at"))
    w = W.partitionBy("userId").orderBy("at", "bookId")
    return last.where("on").withColumn("ord", F.row_number().over(w) - 1).select("userId", "bookId", "ord")


def bucket(percent: Column) -> Column:
    """reading, done or unread; null for a negative percent, which is in no bucket."""
    return F.when(percent >= DONE, "done").when(percent > 0, "reading").when(percent.isNull() | (percent == 0), "unread")


def my_shelf(shelf_rows: DataFrame, progress: DataFrame, books: DataFrame) -> DataFrame:
    """Shelf rows with known books and their bucket, in shelf order."""
    known = shelf_rows.join(books.select(F.col("id").alias("bookId"), "title").dropDuplicates(["bookId"]), "bookId")
    return known.join(progress.select("userId", "bookId", "percent"), ["userId", "bookId"], "left").select(
        "userId", "ord", "bookId", "title", "percent", bucket(F.col("percent")).alias("bucket")
    )


def continue_reading(progress: DataFrame, recent: DataFrame, shelf_rows: DataFrame, books: DataFrame) -> DataFrame:
    """``(userId, pos, bookId, percent)``: what each reader may go on with.

    First all books in progress, the latest first; then recently opened ones while there
    are fewer than eight rows; if there is nothing, the first six of the shelf.  Unknown
    books are left out (the six are counted before).
    """
    known = books.select(F.col("id").alias("bookId")).distinct()
    active = progress.where((F.col("percent") > 0) & (F.col("percent") < DONE)).join(known, "bookId", "left_semi")
    first = active.select("userId", "bookId", "percent", F.lit(0).alias("tier"), (-F.col("updatedAt")).alias("key"))
    n = first.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    now = progress.select("userId", "bookId", "percent")
    more = (
        recent.join(known, "bookId", "left_semi").join(first.select("userId", "bookId"), ["userId", "bookId"], "left_anti").join(now, ["userId", "bookId"], "left")
        .withColumn("r", F.row_number().over(W.partitionBy("userId").orderBy("ord", "bookId")))
        .join(n, "userId", "left").where(F.col("r") <= F.lit(SHOWN) - F.coalesce("n", F.lit(0)))
        .select("userId", "bookId", F.coalesce("percent", F.lit(0.0)).alias("percent"), F.lit(1).alias("tier"), F.col("ord").cast("bigint").alias("key"))
    )
    some = first.unionByName(more)
    rest = (
        shelf_rows.where(F.col("ord") < FALLBACK).join(some.select("userId").distinct(), "userId", "left_anti").join(known, "bookId", "left_semi")
        .join(now, ["userId", "bookId"], "left")
        .select("userId", "bookId", F.coalesce("percent", F.lit(0.0)).alias("percent"), F.lit(2).alias("tier"), F.col("ord").cast("bigint").alias("key"))
    )
    w = W.partitionBy("userId").orderBy("tier", "key", "bookId")
    return some.unionByName(rest).withColumn("pos", F.row_number().over(w)).select("userId", "pos", "bookId", "percent")


def progress_percent(cursor: Column, total: Column, spread: Column) -> Column:
    """Percent read after the page (or spread) at ``cursor``; null without pages."""
    step = F.when(spread, 2).otherwise(1)
    return F.when(total > 0, F.floor(F.least(F.lit(1.0), (cursor + step) / total) * 100 + 0.5).cast("int"))


def resume_page(percent: Column, total: Column, spread: Column) -> Column:
    """The page to open for a stored percent; even in a spread."""
    page = F.least(total - 1, F.greatest(F.lit(0), F.floor(percent / 100.0 * total + 0.5))).cast("int")
    return F.when(total > 0, F.when(spread, page - page % 2).otherwise(page))


def bookmarks_of_books(bookmarks: DataFrame, books: DataFrame) -> DataFrame:
    """Bookmarks whose book still exists (what a cascading delete would leave)."""
    return bookmarks.join(books.select(F.col("id").alias("bookId")).distinct(), "bookId", "left_semi")

"""Composite jobs: merge fragments, import raw texts, sync content, resolve a wanted list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import count_html_words, is_bundle_body, norm_title, size_gate, work_key
from folioframe.operators.blocks import format_text, to_html
from folioframe.operators.catalog import only_ids
from folioframe.operators.dedup import first_per_group, greedy_dedup, missing_from


def work_key_text(title: Column, author: Column) -> Column:
    """The work key as text; null for the empty key, which identifies nothing."""
    k = work_key(title, author)
    text = F.concat_ws("|", k["surname"], F.array_join(k["kws"], " "))
    return F.when((k["surname"] == "") & (F.size(k["kws"]) == 0), None).otherwise(text)


def merge_keys() -> dict[str, Column]:
    """Number (if not null or 0), work and slug: the kinds in which a merge rejects."""
    return {"sameId": F.nullif("gutenbergId", F.lit(0)), "sameWork": work_key_text(F.col("title"), F.col("author")), "sameSlug": F.col("id")}


def import_keys() -> dict[str, Column]:
    """Number, normalised title and work: the kinds in which an import rejects."""
    return {"sameId": F.nullif("gutenbergId", F.lit(0)), "sameTitle": F.nullif(norm_title(F.col("title")), F.lit("")), "sameWork": work_key_text(F.col("title"), F.col("author"))}


def merge(fragments: DataFrame, ord_: str, existing: DataFrame | None = None) -> DataFrame:
    """Fragments judged for a merge into ``existing``: ``kept`` and ``reason``."""
    return greedy_dedup(fragments, ord_, merge_keys(), existing)


def import_with_quota(rows: DataFrame, ord_: str, existing: DataFrame | None, group: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each group that an import keeps."""
    judged = greedy_dedup(rows, ord_, import_keys(), existing)
    return first_per_group(judged.where("kept").drop("kept", "reason"), group, ord_, quota)


def import_texts(specs: DataFrame, raw: DataFrame, existing: DataFrame, only: str = "", limit: int = 0, least: int = 400) -> DataFrame:
    """``(id, status, html, wordCount)`` of an import run: ok, skipped or failed.

    Ids with a row already are skipped before any text is formatted; texts whose markup is
    shorter than ``least`` fail, as do ids without text.
    """
    wanted = only_ids(specs, only)
    if limit > 0:
        wanted = wanted.orderBy("ord").limit(limit)
    todo = missing_from(wanted, existing)
    done = wanted.join(existing.select("id").distinct(), "id", "left_semi").select("id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("html"), F.lit(0).cast("bigint").alias("wordCount"))
    text = format_text(raw.join(todo.select("id"), "id", "left_semi"), "id", "text")
    ok = size_gate(F.col("html"), least)
    new = todo.select("id").join(text, "id", "left").select(
        "id", F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, F.col("html")).alias("html"), F.when(ok, F.col("wordCount")).otherwise(0).cast("bigint").alias("wordCount")
    )
    return done.unionByName(new)


def sync(catalog: DataFrame, content: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books with content (their words counted anew), books without, content without a book."""
    counted = content.select("id", count_html_words(F.col(html)).cast("int").alias("__w"))
    synced = catalog.join(counted, "id").withColumn("wordCount", F.col("__w")).drop("__w")
    return synced, missing_from(catalog, content), missing_from(content, catalog)


def tally(rows: DataFrame, status: str = "status") -> DataFrame:
    """``(status, n)``: how many rows ended in which way."""
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def convert(specs: DataFrame, raw: DataFrame, marker: str, least: int = 6000, titles: DataFrame | None = None) -> DataFrame:
    """``(id, status, title, html, n_headings)`` of a conversion run over ``specs (ord, id, title, author)``.

    Of equal ids the first counts and the others are ``duplicate``.  Ids without text are
    ``no text``, texts with ``marker`` near their head are a ``bundle``, documents of under
    ``least`` characters are ``short``; all others are ``ok`` and carry their document.
    ``titles (id, title)`` override the title.  The rows that aren't ok are the failure list.
    """
    first = specs.groupBy("id").agg(F.min_by(F.struct("ord", "title", "author"), "ord").alias("s")).select("id", "s.*")
    if titles is not None:
        first = first.join(titles.select("id", F.col("title").alias("__t")), "id", "left").withColumn("title", F.coalesce("__t", "title")).drop("__t")
    again = specs.join(first.select("id", "ord"), ["id", "ord"], "left_anti").select("id", F.lit("duplicate").alias("status"), "title")
    texts = first.join(raw.select("id", "text"), "id", "left")
    done = to_html(texts, "id", "text", "title", "author").join(texts.select("id", "title", is_bundle_body(F.col("text"), marker).alias("bundle"), F.col("text").isNull().alias("none")), "id")
    status = F.when(F.col("none"), "no text").when(F.col("bundle"), "bundle").when(~size_gate(F.col("html"), least), "short").otherwise("ok")
    done = done.select("id", status.alias("status"), "title", "html", "n_headings")
    kept = F.col("status") == "ok"
    done = done.select("id", "status", "title", F.when(kept, F.col("html")).alias("html"), F.when(kept, F.col("n_headings")).alias("n_headings"))
    return done.unionByName(again, allowMissingColumns=True)

"""Queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.session import table, widen


def sourced_documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents with their source: the row's own, else the book's, else ``gutenberg``.

    Only the rows without a source of their own go through the join.
    """
    docs = widen(table(spark, d, "documents")).select("doc_id", "bookId", *columns, F.nullif("source", F.lit("")).alias("source"))
    books = table(spark, d, "books").groupBy(F.col("id").alias("bookId")).agg(F.max(F.nullif("source", F.lit(""))).alias("of_book"))
    bare = docs.where(F.col("source").isNull()).drop("source").join(books, "bookId", "left")
    filled = bare.select("doc_id", "bookId", *columns, F.coalesce("of_book", F.lit("gutenberg")).alias("source"))
    return docs.where(F.col("source").isNotNull()).unionByName(filled)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that repeated blocks (of one line or more) cover."""
    from folioframe.llm.lines import repeated_lines

    return repeated_lines(sourced_documents(spark, d, "text")).select("doc_id", "line_no")


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines that stand in blocks of two lines or more, with the length of their block."""
    from folioframe.llm.lines import repeated_lines

    return repeated_lines(sourced_documents(spark, d, "text"), min_lines=2).select("doc_id", "source", "line_no", "block")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each document without the lines of its source's repeated blocks."""
    from folioframe.llm.lines import repeated_lines, without_repeated_lines

    docs = sourced_documents(spark, d, "text")
    return without_repeated_lines(docs, repeated_lines(docs)).select("doc_id", "source", "text", "n_cut")


def catalogue_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the three catalogues in one shape."""
    one = lambda name, side: table(spark, d, name).select(F.lit(side).alias("side"), F.col("rec_no").alias("rec"), "title", F.array("author").alias("authors"))
    hits = table(spark, d, "search_hits").select(F.lit(2).alias("side"), F.col("rec_no").alias("rec"), "title", F.col("authors.name").alias("authors"))
    return one("books", 0).unionByName(one("wanted_list", 1)).unionByName(hits)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_links(spark, d).select("rec_a", "rec_b")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their confidence."""
    from folioframe.llm.linkage import link_sources

    return link_sources(catalogue_entries(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from folioframe.llm.langid import detect_languages, fit_language_model, relabelled
    from folioframe.llm.lines import repeated_lines, without_repeated_lines

    docs = sourced_documents(spark, d, "text", "lang")
    model = fit_language_model(widen(table(spark, d, "documents")).select("doc_id", "text", "lang"), "doc_id", "text", "lang")
    clean = without_repeated_lines(docs, repeated_lines(docs))
    return relabelled(detect_languages(clean, model, keep=("lang",)), "lang")


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's languages and segments with their confidence."""
    from folioframe.llm.langid import detect_languages, fit_language_model

    docs = widen(table(spark, d, "documents")).select("doc_id", "text", "lang")
    return detect_languages(docs, fit_language_model(docs, "doc_id", "text", "lang"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Title and author of each entry in the consistent form."""
    from folioframe.llm.fold import fold_text

    entries = table(spark, d, "books").select("rec_no", "title", "author").dropDuplicates()
    return entries.select("rec_no", fold_text("title").alias("title"), fold_text("author").alias("author"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from folioframe.llm.fold import disguised_fields

    return disguised_fields(table(spark, d, "books"), "rec_no", ["title", "author"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from folioframe.llm.names import variant_pairs

    entries = table(spark, d, "books").select("rec_no", "author").dropDuplicates()
    return variant_pairs(entries, "author")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """The passage line of each evaluation item (the second of its four lines)."""
    return table(spark, d, "eval_items").select("item_id", F.get(F.split("text", "\n"), F.lit(1)).alias("passage"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from folioframe.llm.leaks import leaked_items

    return leaked_items(widen(table(spark, d, "documents")), passages(spark, d)).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: a row per document and copy."""
    from folioframe.llm.mix import mix, source_rates

    sizes = _document_sizes(spark, d)
    return mix(sizes, source_rates(sizes, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source really got."""
    from folioframe.llm.mix import mix, mixture_report, source_rates

    sizes = _document_sizes(spark, d)
    rates = source_rates(sizes, table(spark, d, "mix_targets"))
    return mixture_report(mix(sizes, rates), rates)


def _document_sizes(spark: SparkSession, d: str) -> DataFrame:
    from folioframe.llm.tokens import with_token_counts
    from folioframe.session import materialise

    return materialise(with_token_counts(sourced_documents(spark, d, "text")).drop("bookId"), "document-sizes")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents of more than 1,200 words."""
    return _pieces(spark, d, above_words=1200).select("doc_id").dropDuplicates()


def p9_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The documents of more than 1,200 words put together again from their pieces, without white space.

    ``fits``: no piece is over the limit; ``overlaps``: each piece begins inside the one before.
    """
    from pyspark.sql import Window as W

    before = F.lag("end").over(W.partitionBy("doc_id").orderBy("piece"))
    p = _pieces(spark, d, above_words=1200).withColumn("before", F.coalesce(before, F.lit(0)))
    fresh = F.substr("text", (F.greatest("before", "start") - F.col("start") + 1).cast("int"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", fresh.alias("t")))), lambda x: x["t"]), "")
    bare = F.regexp_replace(whole, r"(?U)\s+", "")
    return p.groupBy("doc_id").agg(F.md5(bare).alias("digest"), F.length(bare).cast("bigint").alias("n"), F.max(F.col("n_tokens")).alias("most"), F.min((F.col("piece") == 1) | (F.col("start") < F.col("before"))).alias("overlaps")).select(
        "doc_id", "digest", "n", (F.col("most") <= 1024).alias("fits"), "overlaps"
    )


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document over the token limit."""
    return _pieces(spark, d)


def _pieces(spark: SparkSession, d: str, above_words: int | None = None) -> DataFrame:
    from folioframe.llm.pieces import split_oversized

    return split_oversized(widen(table(spark, d, "documents")), max_tokens=1024, overlap=64, above_words=above_words)


QUERIES = {f.__name__: f for f in (p1_found, p1_blocks, p1_clean, p2_found, p2_links, p4_found, p4_languages, p5_found, p5_forms, p6_found, p7_found, p8_mixture, p8_shares, p9_found, p9_pieces, p9_rebuilt)}
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0b]+"
_LONG = f"len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '')) > 1200"
SQL: dict[str, str] = {
    "p9_found": f"SELECT doc_id FROM documents WHERE {_LONG}",
    "p9_rebuilt": f"SELECT doc_id, md5(regexp_replace(text, '{_WS}', '', 'g')) AS digest, CAST(length(regexp_replace(text, '{_WS}', '', 'g')) AS BIGINT) AS n, true AS fits, true AS overlaps FROM documents WHERE {_LONG}",
}

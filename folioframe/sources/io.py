"""Sources and sinks: catalogues, fragments, documents, result pages; upserts and rewrites."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.arrow import by_size
from folioframe.schema import CATALOG, IMPORT_SPEC, SEARCH_PAGE
from folioframe.session import materialise

# -- sources


def _positions(df: DataFrame, key: Column) -> DataFrame:
    """``ord``: the order of whole files by ``key`` and of rows within them."""
    return df.withColumn("ord", F.struct(key.alias("file"), F.monotonically_increasing_id().alias("row")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of books, typed by the schema; ``ord`` is the place in the file.

    One file is one array and so one task; catalogues that big belong in Parquet.
    """
    return spark.read.schema(CATALOG).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORT_SPEC).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())


def read_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.json`` fragments of a folder; ``ord`` sorts by file name, then position."""
    df = spark.read.schema(CATALOG).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return _positions(df, F.col("_metadata.file_name"))


def read_documents(spark: SparkSession, root: str, name: str = "content.html") -> DataFrame:
    """``(id, html)`` of ``<root>/<id>/<name>``, whole files."""
    df = spark.read.text(os.path.join(root, "*", name), wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name}$", 1).alias("id"), F.col("value").alias("html"))


def list_documents(spark: SparkSession, root: str, name: str = "content.html") -> DataFrame:
    """``(id, length, modified)`` of the stored documents, without reading them; empty ones aren't listed."""
    df = spark.read.format("binaryFile").load(os.path.join(root, "*", name))
    return df.select(F.regexp_extract("path", rf"([^/]+)/{name}$", 1).alias("id"), "length", F.col("modificationTime").alias("modified"))


def keys_of_listing(listing: DataFrame, path: str = "path", prefix: str = "books", name: str = "content.html") -> DataFrame:
    """Ids in an object-store listing."""
    return listing.select(F.regexp_extract(path, rf"^{prefix}/(.+)/{name}$", 1).alias("id")).where("id <> ''").distinct()


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Result pages (one JSON object a file) as rows in page and result order."""
    df = spark.read.schema(SEARCH_PAGE).option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_name").alias("page"), F.posexplode("results").alias("pos", "r"), "next").select("page", "pos", "r.*", "next")


def parse_search_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """As ``read_search_pages`` for a column of JSON text; broken pages give no rows."""
    return pages.select(*[c for c in pages.columns if c != body], F.posexplode(F.from_json(body, SEARCH_PAGE)["results"]).alias("pos", "r")).select("*", "r.*").drop("r")


def page_source(fetch: Callable[[str], tuple[list[tuple], str | None]], schema: str, name: str = "pages"):
    """A Python data source that follows ``next`` links: ``fetch(token) -> (rows, next)``.

    Register the result with ``spark.dataSource.register`` and load it with an option
    ``start``.  A partition is one chain of pages, read lazily.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.starts = [s for s in options.get("start", "").split(",") if s]

        def partitions(self):
            return [InputPartition(s) for s in self.starts]

        def read(self, partition):
            token = partition.value
            while token:
                rows, token = fetch(token)
                yield from rows

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Pages


# -- sinks


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table that may be one of the inputs: staged first, then written."""
    staged = materialise(df, "staged")
    staged.write.mode("overwrite").format(fmt).save(path)


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", touched: str | None = "updatedAt", at: Column | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their key.

    ``createdAt`` of a replaced row stays; ``touched`` is set on every new row.  ``new`` has
    one row a key.
    """
    n = new.withColumn(touched, at if at is not None else F.current_timestamp()) if touched else new
    if "createdAt" in existing.columns and touched:
        old = existing.select(key, F.col("createdAt").alias("__c"))
        n = n.drop("createdAt").join(old, key, "left").withColumn("createdAt", F.coalesce("__c", F.col(touched))).drop("__c")
    return existing.join(new.select(key), key, "left_anti").unionByName(n, allowMissingColumns=True).select(*existing.columns)


def changed_only(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows that a conditional rewrite would write."""
    return df.where(~F.col(old).eqNullSafe(F.col(new)))


def _each_document(df: DataFrame, act: Callable[[str, str], None], key: str, html: str, workers: int | None) -> DataFrame:
    """``(id, ok, error)`` of ``act`` on every document, done once: the outcome is written before it is returned."""

    def run(batches):
        import pyarrow as pa

        for batch in by_size(batches, 1):
            keys, fine, why = batch.column(0).to_pylist(), [], []
            for k, h in zip(keys, batch.column(1).to_pylist()):
                try:
                    act(str(k), h or "")
                    fine.append(True), why.append(None)
                except Exception as e:  # noqa: BLE001 - reported per document
                    fine.append(False), why.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.bool_()), pa.array(why, pa.string())], ["id", "ok", "error"])

    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])
    rows = df.select(key, html)
    return materialise((rows.repartition(workers) if workers else rows).mapInArrow(run, schema), "outcome")


def write_documents(df: DataFrame, root: str, key: str = "id", html: str = "html", name: str = "content.html", workers: int | None = None) -> DataFrame:
    """Write ``<root>/<key>/<name>``; ``(id, ok, error)``, a row per document.

    ``root`` is a folder every executor can reach, of any file system that pyarrow knows (a plain
    path is a shared mount).  Files are written beside their place and moved there, so a task that
    runs again does no harm.  Failures are rows, not errors.  The work is done once, on the call;
    partitions stay as they are unless ``workers`` says how many write at a time.
    """

    def put(k: str, h: str) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        folder = f"{base}/{k}"
        system.create_dir(folder, recursive=True)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(h.encode("utf-8"))
        system.move(part, f"{folder}/{name}")

    return _each_document(df, put, key, html, workers)


def write_raw(df: DataFrame, root: str, key: str = "id", text: str = "text", workers: int | None = None) -> DataFrame:
    """Keep raw texts as ``<root>/<key>/raw.txt``, a cache for later imports; as ``write_documents``."""
    return write_documents(df, root, key, text, "raw.txt", workers)


def upload_all(df: DataFrame, send: Callable[[str, str], None], key: str = "id", html: str = "html", workers: int | None = 24) -> DataFrame:
    """``send`` every document, ``workers`` partitions at a time; ``(id, ok, error)`` per document.

    Done once, on the call; a task that runs again sends again, so ``send`` must replace.
    """
    return _each_document(df, send, key, html, workers)


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON object per row, as an API would answer."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))

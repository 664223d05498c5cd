"""Session helpers: shared-folder materialisation and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where it is set.

    Where neither the setting nor a checkpoint folder exists, a temporary folder is made on a
    local master (tests, the bench); on a cluster that would be each machine's own, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system; one that isn't there is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession) -> list[str]:
    """Folders to delete when the session's Python ends."""
    sc = spark.sparkContext
    if not hasattr(sc, "_folioframe_folders"):
        sc._folioframe_folders = []

        def clean() -> None:
            try:
                for path in sc._folioframe_folders:
                    remove_folder(spark, path)
            except Exception:  # noqa: BLE001 - the JVM is gone already
                pass

        atexit.register(clean)
    return sc._folioframe_folders


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike ``localCheckpoint`` the copy outlives the executors that wrote it, and
    unlike ``checkpoint`` later reads prune columns.  It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _at_exit(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Materialised steps of one operator, deleted once its result is written.

    ``with Workspace(spark) as work: ... return work.result(df)``.  The result is written too,
    so nothing reads the steps any more, also not when an executor is lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.steps = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        known = _at_exit(self.spark)
        for path in self.steps:
            remove_folder(self.spark, path)
            known.remove(path)

    def materialise(self, df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        self.steps.append(_at_exit(self.spark)[-1])
        return out

    def small(self, df: DataFrame, name: str, max_rows: int = 50_000, max_bytes: int = 16 << 20) -> tuple[DataFrame, int | None]:
        """``df`` for a broadcast, with its number of rows, if it has at most ``max_rows`` rows of ``max_bytes``.

        One job instead of a write, a count and a read; at most the bound comes to the driver.
        Beyond it ``df`` is materialised and not hinted, and the number is None.
        """
        rows = df.limit(max_rows + 1).toArrow()
        if rows.num_rows <= max_rows and rows.nbytes <= max_bytes:
            return F.broadcast(self.spark.createDataFrame(rows, df.schema)), rows.num_rows
        return self.materialise(df, name), None

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        return materialise(df, name)


def is_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 16 << 20) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of ``max_bytes`` in all; counted, not estimated.

    ``df`` must be cheap to read (a materialised or tiny table); no more than the bound is looked at.
    """
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, b = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and b <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only when ``df`` is proven to be small (see ``is_small``).

    Beyond the bounds the frame comes back unhinted and the planner shuffles.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Redistribute few but costly rows (Python work ahead) over all cores.

    Adaptive execution sizes partitions by bytes and would leave such rows in a handful.
    """
    sc = df.sparkSession.sparkContext
    n = max(sc.defaultParallelism * per_core, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer partitions than cores (one small file) over all cores.

    For scans with costly work ahead.  A table of many files is left as it is; filters and
    column pruning pass through.  ``df`` must be a plain scan, as its partitions are asked for.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers import the functions they run; on a cluster nothing else puts the package
    on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_folioframe_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="folioframe-code-"), "folioframe_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("folioframe", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._folioframe_shipped = True

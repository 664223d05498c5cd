"""Deduplication by several keys, slug allocation, quotas, and what is missing on a side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioframe.session import materialise


def greedy_dedup(rows: DataFrame, ord_: str, keys: dict[str, Column], seeds: DataFrame | None = None, sticky: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``kept`` and ``reason``, as a scan in ``ord_`` order would decide.

    A row is rejected if one of its keys was registered before; only kept rows (and the
    rows of ``seeds``) register theirs.  The reason is the first kind, in the order of
    ``keys``, that hit.  Null keys are no keys.  A kind in ``sticky`` is registered by
    rejected rows too.  ``ord_`` must be unique.

    Rounds: an undecided row that is the first of every one of its keys is kept, and the
    undecided rows that share a key with a kept one are rejected.  The first undecided row
    is always decided, so it ends.  A round is a map-side combined minimum per key and
    joins on keys; no group of equal keys is gathered.
    """
    kinds = list(keys)
    pairs = F.array(*[F.struct(F.lit(i).alias("kind"), k.cast("string").alias("key")) for i, k in enumerate(keys.values())])
    names = [c for c in rows.columns if c not in ("kept", "reason")]
    entries = rows.select(F.col(f"`{ord_}`").alias("o"), F.filter(pairs, lambda p: p["key"].isNotNull()).alias("ks"))
    exploded = materialise(entries.select("o", F.explode("ks").alias("k")).select("o", "k.kind", "k.key"), "dedup-keys")
    everyone = materialise(entries.select("o"), "dedup-rows")
    reasons: list[DataFrame] = []
    blocked: list[DataFrame] = []
    if seeds is not None:
        seeded = seeds.select(F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("k")).select("k.kind", "k.key").distinct()
        reasons.append(exploded.join(seeded, ["kind", "key"], "left_semi").select("o", "kind"))
        blocked.append(reasons[-1].select("o"))
    for s in sticky:
        of = exploded.where(F.col("kind") == kinds.index(s))
        first = of.groupBy("key").agg(F.min("o").alias("m"))
        reasons.append(of.join(first, "key").where(F.col("o") > F.col("m")).select("o", "kind"))
        blocked.append(reasons[-1].select("o"))
    open_keys = exploded
    if blocked:
        open_keys = materialise(exploded.join(reduce(DataFrame.unionByName, blocked).distinct(), "o", "left_anti"), "dedup-open")
    kept: list[DataFrame] = []
    while True:
        first = open_keys.groupBy("kind", "key").agg(F.min("o").alias("m"))
        winners = materialise(
            open_keys.join(first, ["kind", "key"]).groupBy("o").agg(F.min(F.col("o") == F.col("m")).alias("w")).where("w").select("o"), "dedup-kept"
        )
        if winners.limit(1).count() == 0:
            break
        kept.append(winners)
        taken = open_keys.join(winners, "o", "left_semi").select("kind", "key").distinct()
        lost = open_keys.join(taken, ["kind", "key"], "left_semi").select("o").distinct()
        open_keys = materialise(open_keys.join(lost, "o", "left_anti"), "dedup-open")
    bare = everyone.join(exploded.select("o").distinct(), "o", "left_anti")
    good = materialise(reduce(DataFrame.unionByName, kept, bare).distinct(), "dedup-result")
    registered = exploded.join(good, "o", "left_semi").groupBy("kind", "key").agg(F.min("o").alias("by"))
    hit = exploded.join(good, "o", "left_anti").join(registered, ["kind", "key"]).where(F.col("by") < F.col("o")).select("o", "kind")
    why = reduce(DataFrame.unionByName, reasons, hit).groupBy("o").agg(F.min("kind").alias("kind"))
    reason = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("kind") + 1)
    return (
        rows.select(*[F.col(f"`{c}`") for c in names]).join(good.withColumn("__good", F.lit(True)), F.col(f"`{ord_}`") == F.col("o"), "left").drop("o")
        .join(why, F.col(f"`{ord_}`") == F.col("o"), "left")
        .select(*[F.col(f"`{c}`") for c in names], F.coalesce("__good", F.lit(False)).alias("kept"), F.when(F.col("__good").isNull(), reason).alias("reason"))
    )


def first_per_group(rows: DataFrame, group: str, ord_: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group (a quota); ranks are cut before the shuffle."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(ord_))).where(F.col("__r") <= n).drop("__r")


def rank_in_group(rows: DataFrame, group: str, ord_: str, width: int = 1_000_000, name: str = "rank") -> DataFrame:
    """Rank from 1 within ``group`` by the whole number ``ord_``, with no task per group.

    Rows are ranked within stretches of ``width`` order numbers; stretches are counted and
    summed up.  A group of any size is spread over its stretches.
    """
    part = rows.withColumn("__b", F.floor(F.col(ord_) / width))
    sizes = part.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = part.withColumn("__r", F.row_number().over(W.partitionBy(group, "__b").orderBy(ord_)))
    same = inner[group].eqNullSafe(before[group]) & (inner["__b"] == before["__b"])
    return inner.join(before, same).select(*[inner[c] for c in rows.columns], (F.col("__r") + F.col("__before")).alias(name))


def allocate_slugs(rows: DataFrame, ord_: str, base: str, slug: str = "slug") -> DataFrame:
    """``rows`` with a unique ``slug``: the base, or the base with the first free ``-2``, ``-3`` ...

    Rows choose in ``ord_`` order.  Where all rows of a stem share one base, the suffix is
    the rank.  Stems with several bases (one of them looks like another with a suffix) are
    streamed in order through one pass that remembers the stem's slugs only.
    """
    r = rows.withColumn("__stem", F.regexp_replace(F.coalesce(base, F.lit("")), r"(-\d+)+$", ""))
    stems = r.groupBy("__stem").agg(F.min(F.coalesce(base, F.lit(""))).alias("__lo"), F.max(F.coalesce(base, F.lit(""))).alias("__hi"))
    r = r.join(stems, "__stem")
    plain = rank_in_group(r.where("__lo = __hi"), "__stem", ord_, name="__k")
    b = F.coalesce(base, F.lit(""))
    done = plain.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("__k") == 1, b).otherwise(F.concat(b, F.lit("-"), F.col("__k").cast("string"))).alias(slug))
    mixed = r.where("__lo <> __hi").select(ord_, F.col("__stem"), b.alias("__base"))
    schema = T.StructType([T.StructField("__o", rows.schema[ord_].dataType), T.StructField(slug, T.StringType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, used, last = None, set(), {}
        for batch in batches:
            out = []
            for s, base_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s != stem:
                    stem, used, last = s, set(), {}
                got, n = base_, last.get(base_, 1)
                while got in used:
                    n += 1
                    got = f"{base_}-{n}"
                last[base_] = n
                used.add(got)
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [f.name for f in schema])

    chosen = mixed.repartition("__stem").sortWithinPartitions("__stem", ord_).mapInArrow(choose, schema)
    rest = rows.join(chosen, F.col(f"`{ord_}`") == F.col("__o")).select(*[rows[c] for c in rows.columns], slug)
    return done.unionByName(rest)


def missing_from(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``: orphans, missing content, new uploads."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def merge_report(existing: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: existing, added, and the rejected by reason."""
    n = existing.agg(F.count(F.lit(1)).alias("existing"))
    counts = judged.agg(
        F.count_if("kept").alias("added"), F.count_if(F.col("reason") == "sameId").alias("sameId"),
        F.count_if(F.col("reason") == "sameWork").alias("sameWork"), F.count_if(F.col("reason") == "sameSlug").alias("sameSlug"),
    )
    return n.join(counts, F.lit(True)).withColumn("total", F.col("existing") + F.col("added"))

"""Mixing sources to target weights.

Sizes are summed per source, repetition rates follow from the sums and the targets, and
each document is emitted ``floor(rate)`` times plus one copy with a probability equal to
the fraction, decided by a hash of its key and a seed.  A source that can't fill its share
within its repeat cap gives the rest to the others in proportion to their shares, so the
mixture keeps the wanted total; the report shows the share each source really got.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import broadcast_if_small, materialise


def source_rates(
    docs: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens", share: str = "targetShare", repeats: str = "maxRepeats", total: float | None = None
) -> DataFrame:
    """``(source, target_share, max_repeats, n_docs, size, rate)``, one row per source of either side.

    The rate is ``min(max_repeats, level * share / size)`` with the level at which all rates
    give ``total`` (by default the size of all documents).  Sources without a target, without
    documents or with size 0 have rate 0.  The level is found by rounds of one aggregate over
    the sources; no list of sources is collected.
    """
    sums = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.col(f"`{size}`"), F.lit(0))).cast("double").alias("size"))
    wanted = (
        targets.where(F.col(f"`{source}`").isNotNull())
        .groupBy(F.col(f"`{source}`").alias("source"))
        .agg(F.sum(F.col(f"`{share}`")).cast("double").alias("target_share"), F.max(F.col(f"`{repeats}`")).cast("int").alias("max_repeats"))
    )
    both = materialise(
        sums.join(wanted, "source", "full").select(
            "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), F.coalesce("size", F.lit(0.0)).alias("size"),
        ),
        "mix-sources",
    )
    cap = F.col("max_repeats") * F.col("size")
    usable = both.where((F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    goal = total if total is not None else (both.agg(F.sum("size")).first()[0] or 0.0)
    level = 0.0
    while True:  # each round caps at least one more source, so it ends
        full = F.col("target_share") * level >= cap
        r = usable.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("target_share"))).alias("open")
        ).first()
        if not r.open:
            level = math.inf if r.capped else 0.0
            break
        new = (goal - r.capped) / r.open
        if new <= level * (1 + 1e-12):
            break
        level = new
    rate: Column = F.col("max_repeats").cast("double")
    if math.isfinite(level):
        rate = F.least(rate, F.lit(level) * F.col("target_share") / F.col("size"))
    return both.withColumn("rate", F.when((F.col("size") > 0) & (F.col("target_share") > 0), rate).otherwise(0.0))


def mix(docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """The mixture: the rows of ``docs``, each once per copy, with ``copy`` from 1.

    Documents of a null or untargeted source aren't emitted.  The same key and seed always
    give the same copies; rows of one key share their fate.
    """
    r = broadcast_if_small(materialise(rates.where(F.col("rate") > 0).select(F.col("source").alias("__s"), F.col("rate").alias("__rate")), "mix-rates"))
    names = [c for c in docs.columns if c != "copy"]
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), 11) / F.lit(float(1 << 53))
    times = (F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    return (
        docs.select(*[F.col(f"`{c}`") for c in names])
        .join(r, F.col(f"`{source}`") == F.col("__s"))
        .withColumn("__n", times)
        .where(F.col("__n") > 0)
        .select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    )


def mixture_report(mixed: DataFrame, rates: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per source: target and actual share, rate, documents and sizes before and after."""
    got = mixed.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n_emitted"), F.sum(F.col(f"`{size}`")).cast("double").alias("emitted"))
    got = materialise(got, "mix-emitted")
    whole = got.agg(F.sum("emitted")).first()[0] or 1.0
    return rates.join(got, "source", "left").select(
        "source", "target_share", (F.coalesce("emitted", F.lit(0.0)) / F.lit(whole)).alias("actual_share"), "max_repeats", "rate", "n_docs",
        F.coalesce("n_emitted", F.lit(0)).cast("bigint").alias("n_emitted"), F.col("size").cast("bigint").alias("size"), F.coalesce("emitted", F.lit(0.0)).cast("bigint").alias("emitted"),
    )

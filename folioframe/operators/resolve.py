"""Resolve wanted works against search candidates: the first genuine match decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import is_bundle_title, words
from folioframe.operators.catalog import is_english

# Authors that stand for nobody here, words of a title that count.
NOBODY = ("anonymous", "unknown", "various", "traditional")


def wanted_features(wanted: DataFrame, key: str) -> DataFrame:
    """``(key, surname, kws)``: surname null for nobody; up to five title words over two letters."""
    author = F.trim(F.coalesce("author", F.lit("")))
    nobody = (author == "") | F.lower(author).isin(*NOBODY)
    last = F.element_at(F.concat(F.array(F.lit("")), words(author)), -1)
    kws = F.slice(F.filter(words(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9 ]", " ")), lambda w: F.length(w) > 2), 1, 5)
    surname = F.when(~nobody, F.regexp_replace(F.lower(last), "[^a-z]", ""))
    return wanted.select(F.col(key).alias("want"), F.when(surname != "", surname).alias("surname"), kws.alias("kws"))


def resolve(features: DataFrame, candidates: DataFrame, used: DataFrame, linked: bool = True) -> DataFrame:
    """``(want, id)``: per wanted work its first fitting candidate, unless that is in use.

    ``candidates``: ``(want, cand_ord, id, title, authors, languages)``, authors an array of
    names.  A candidate fits if it is English, no bundle, its author text holds the surname
    (if there is one) and at least half of the title words occur in its title.  If the
    first one is in ``used`` the work stays unresolved; no other candidate replaces it.
    """
    c = candidates.join(features, "want")
    title = F.lower(F.coalesce("title", F.lit("")))
    names = F.regexp_replace(F.lower(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " ")), "[^a-z ]", "")
    hits = F.size(F.filter("kws", lambda w: F.contains(title, w)))
    k = F.size("kws")
    fits = (
        is_english(F.col("languages")) & ~is_bundle_title(title, linked) & (F.col("surname").isNull() | F.contains(names, F.col("surname")))
        & ((k == 0) | (hits >= F.greatest(F.lit(1), F.floor((k + 1) / 2))))
    )
    first = c.where(fits).groupBy("want").agg(F.min_by("id", F.struct("cand_ord", "id")).alias("id"))
    return first.join(used.select("id").distinct(), "id", "left_anti").select("want", "id")


def search_candidates(features: DataFrame, hits: DataFrame) -> DataFrame:
    """``(want, *hits)``: the hits a catalogue search would give for each wanted work.

    ``hits``: ``(cand_ord, id, title, authors, ...)``, one row a hit.  A hit shares the surname and
    a title word, or for works by nobody the first title word and another one.  Works without
    title words find nothing.
    """
    names = F.array_distinct(words(F.regexp_replace(F.lower(F.array_join("authors", " ")), "[^a-z ]", "")))
    title = F.array_distinct(words(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", " ")))
    named = features.where("surname is not null").select("want", F.col("surname").alias("a"), F.explode("kws").alias("k"))
    pairs = F.transform(F.slice("kws", 2, 4), lambda x: F.concat(F.get("kws", F.lit(0)), F.lit(" "), x))
    bare = features.where("surname is null").select("want", F.explode(pairs).alias("k"))
    by_name = hits.select("*", F.explode(names).alias("a")).select("*", F.explode(title).alias("k"))
    by_title = hits.select("*", F.explode(title).alias("k1")).select("*", F.explode(title).alias("k2")).select(*hits.columns, F.concat("k1", F.lit(" "), "k2").alias("k"))
    cols = ["want", *hits.columns]
    return named.join(by_name, ["a", "k"]).select(*cols).unionByName(bare.join(by_title, "k").select(*cols)).dropDuplicates(["want", "cand_ord"])

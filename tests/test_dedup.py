import random

from pyspark.sql import functions as F

from folioframe.operators import dedup, resolve
from folioframe.plans import pipelines

def scan(rows, seeds=(), sticky=()):
    """Brute force: the rows one after the other."""
    seen = {k: {getattr_(r, k) for r in seeds} for k in ("sameId", "sameWork", "sameSlug")}
    out = {}
    for r in sorted(rows):
        hit = next((k for k in seen if getattr_(r, k) is not None and getattr_(r, k) in seen[k]), None)
        out[r[0]] = (hit is None, hit)
        for k in seen:
            if hit is None or k in sticky:
                seen[k].add(getattr_(r, k))
    return out


def getattr_(r, kind):
    return r[{"sameId": 1, "sameWork": 2, "sameSlug": 3}[kind]]


SCHEMA = "ord int, g string, w string, s string"


def run(spark, rows, seeds=(), sticky=()):
    df = spark.createDataFrame(rows, SCHEMA)
    sd = spark.createDataFrame(list(seeds), SCHEMA) if seeds else None
    return {r.ord: (r.kept, r.reason) for r in dedup.greedy_dedup(df, "ord", {"sameId": F.col("g"), "sameWork": F.col("w"), "sameSlug": F.col("s")}, sd, sticky).collect()}


def test_chain(spark):
    rows = [(1, "1", "x", "a"), (2, "1", "y", "b"), (3, "2", "z", "b")]
    assert run(spark, rows) == {1: (True, None), 2: (False, "sameId"), 3: (True, None)}


def test_reason_order_and_nulls(spark):
    rows = [(1, "1", None, "a"), (2, "1", None, "a"), (3, None, None, None), (4, None, None, None)]
    assert run(spark, rows) == {1: (True, None), 2: (False, "sameId"), 3: (True, None), 4: (True, None)}


def test_same_as_scan(spark):
    rnd = random.Random(4)
    pick = lambda p, n: f"{p}{rnd.randrange(n)}" if rnd.random() < 0.8 else None
    rows = [(i, pick("g", 25), pick("w", 30), pick("s", 40)) for i in range(90)]
    seeds = [(-1, "g1", "w2", None)]
    assert run(spark, rows) == scan(rows)
    assert run(spark, rows, seeds) == scan(rows, seeds)
    assert run(spark, rows, (), ("sameId",)) == {k: (v[0], v[1]) for k, v in scan(rows, (), ("sameId",)).items()}


def test_empty(spark):
    assert run(spark, []) == {}


def slugs(bases):
    used, out = set(), []
    for b in bases:
        s, n = b, 2
        while s in used:
            s, n = f"{b}-{n}", n + 1
        used.add(s)
        out.append(s)
    return out


def test_slug_allocation(spark):
    for bases in (["a", "a", "a-2"], ["a-2", "a", "a", "a-2-2", "a"], ["", "", "b"], [random.Random(7).choice(["a", "a-2", "a-3", "b"]) for _ in range(40)]):
        df = spark.createDataFrame(list(enumerate(bases)), "ord int, base string")
        got = [r.slug for r in dedup.allocate_slugs(df, "ord", "base").orderBy("ord").collect()]
        assert got == slugs(bases)


def test_rank_in_group_over_stretches(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(50)], "ord int, g string")
    got = {r.ord: r["rank"] for r in dedup.rank_in_group(df, "g", "ord", width=7).collect()}
    seen = {}
    for i in range(50):
        g = "x" if i % 3 else None
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


def test_quota(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "ord int, g string")
    assert sorted(r.ord for r in dedup.first_per_group(df, "g", "ord", 2).collect()) == [0, 1, 5, 6]


def test_merge_and_report(spark):
    cols = "ord int, id string, title string, author string, gutenbergId long"
    rows = spark.createDataFrame([(1, "a", "कबीर", "x", None), (2, "b", "रहीम", "y", None), (3, "c", "The Republic", "Plato", 5), (4, "d", "Republic", "Plato", 6), (5, "a", "T", "U", 9)], cols)
    old = spark.createDataFrame([(0, "z", "Old Tales", "Q", 7)], cols)
    j = pipelines.merge(rows, "ord", old)
    assert {r.ord: r.reason for r in j.collect()} == {1: None, 2: None, 3: None, 4: "sameWork", 5: "sameSlug"}
    assert dedup.merge_report(old, j).first().asDict() == {"existing": 1, "added": 3, "sameId": 0, "sameWork": 1, "sameSlug": 1, "total": 4}


def test_resolve_does_not_fall_through(spark):
    want = spark.createDataFrame([(1, "The Lost World", "Conan Doyle"), (2, "Lost World", None), (3, "Nothing like it", "Nobody")], "k int, title string, author string")
    cand = "want int, cand_ord int, id long, title string, authors array<string>, languages array<string>"
    rows = [(1, 0, 9, "The Lost World: complete works", ["Doyle"], ["en"]), (1, 1, 10, "The Lost World", ["Doyle, Arthur Conan"], ["en"]), (1, 2, 11, "Lost World", ["Doyle"], ["en"]),
            (2, 0, 12, "Lost World", [], None), (2, 1, 13, "lost world", [], ["en"]), (3, 0, 14, "x", ["Nobody"], ["en"])]
    c = spark.createDataFrame(rows, cand)
    f = resolve.wanted_features(want, "k")
    free = spark.createDataFrame([], "id long")
    used = spark.createDataFrame([(10,)], "id long")
    assert {r.want: r.id for r in resolve.resolve(f, c, free).collect()} == {1: 10, 2: 13}
    assert {r.want: r.id for r in resolve.resolve(f, c, used).collect()} == {2: 13}

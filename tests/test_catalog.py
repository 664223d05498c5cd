from pyspark.sql import functions as F

from folioframe.operators import catalog, state
from folioframe.schema import CATALOG


def make(spark, rows):
    base = dict.fromkeys(["id", "title", "author", "language", "category", "subjectsCsv", "summary", "coverUrl", "contentPath", "wordCount", "isFeatured", "source", "sourceId", "gutenbergId"])
    raw = spark.createDataFrame([tuple((base | r).values()) for r in rows], CATALOG)
    return catalog.catalog(raw.withColumn("n", F.monotonically_increasing_id()), F.col("n"))


def test_defaults(spark):
    r = make(spark, [{"id": "x", "title": "", "summary": "", "gutenbergId": 7}, {"id": "y", "title": "T", "sourceId": "s", "isFeatured": True, "wordCount": 3}]).orderBy("ord").collect()
    assert (r[0].title, r[0].author, r[0].language, r[0].category, r[0].contentPath, r[0].summary, r[0].coverUrl, r[0].wordCount, r[0].source, r[0].sourceId) == ("Untitled", "Unknown", "en", "Fiction", "x/content.html", "", None, 0, "gutenberg", "7")
    assert (r[1].title, r[1].sourceId, r[1].isFeatured) == ("T", "s", True)


def test_orders_and_lookups(spark):
    titles = ["Zoo", "apple", "émile", "Apple", "zebra", "ab", "a-b"]
    c = make(spark, [{"id": f"b{i}", "title": t, "isFeatured": i == 4} for i, t in enumerate(titles)])
    assert [r.title for r in catalog.all_books(c).collect()] == ["zebra", "a-b", "ab", "apple", "Apple", "émile", "Zoo"]
    assert [r.title for r in catalog.featured_books(c).collect()] == ["zebra"]
    assert [r.id for r in catalog.popular_books(c, ("b3", "none", "b1")).collect()] == ["b3", "b1"]
    assert catalog.get_book(c, "b2").first().title == "émile"
    assert catalog.get_book(c, "none").count() == 0
    assert catalog.only_ids(c, " b1 , b2").count() == 2 and catalog.only_ids(c, " ").count() == 7


def test_search(spark):
    c = make(spark, [{"id": "1", "title": "Moby-Dick"}, {"id": "2", "title": "100% pure"}, {"id": "3", "title": "1000 things", "subjectsCsv": "mobY"}])
    ids = lambda q: [r.id for r in catalog.search_books(c, q).orderBy("ord").collect()]
    assert ids("  ") == [] and ids("100%") == ["2"] and ids("MOBY ") == ["1", "3"] and ids("_") == []


def test_categories(spark):
    c = make(spark, [{"id": "1", "category": "Global"}, {"id": "2", "category": "Poetry"}, {"id": "3", "category": "Poetry"}])
    dim = spark.createDataFrame([(0, "poetry", "Poetry", "", "#1", None), (1, "global", "Global Classics", "", "#2", "x")], "ord int, id string, label string, blurb string, accent string, emoji string")
    assert [(r.id, r.n) for r in catalog.category_tiles(c, dim).collect()] == [("poetry", 2)]
    assert [r.category for r in catalog.unmatched_categories(c, dim).collect()] == ["Global"]
    assert catalog.find_category(dim, "pOETRY").first().id == "poetry"
    assert catalog.totals(c.where("false")).first().asDict() == {"books": 0, "categories": 0, "authors": 0, "featured": 0, "words": 0, "hours": 0}


def test_duplicate_metrics_count_null_once(spark):
    c = make(spark, [{"id": str(i), "gutenbergId": g} for i, g in enumerate([1, 1, None, None, None])])
    assert catalog.duplicate_metrics(c).first().dupNumbers == 3


def test_current_entries(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 4), (1, "a", 2, 4), (2, "b", 1, None)], "rec_no int, id string, updatedAt int, wordCount int")
    assert sorted((r.rec_no, r.wordCount) for r in catalog.current_entries(df).collect()) == [(1, 4), (2, None)]


PROG = "userId int, bookId string, percent double, updatedAt long"


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, None, 50.0, 98.9, 99.0, 100.0, -1.0]], "p double")
    assert [r.b for r in df.select(state.bucket(F.col("p")).alias("b")).collect()] == ["unread", "unread", "reading", "reading", "done", "done", None]


def test_continue_reading(spark):
    known = spark.createDataFrame([(f"b{i}",) for i in range(30)], "id string")
    rows = lambda n: spark.createDataFrame([(1, f"b{i}", 50.0, 100 - i) for i in range(n)] + [(9, "b0", 0.0, 1)], PROG)
    rec = spark.createDataFrame([(1, f"b{i}", i) for i in range(12, 21)], "userId int, bookId string, ord int")
    none = spark.createDataFrame([], "userId int, bookId string, ord int")
    got = lambda *a: [r.bookId for r in state.continue_reading(*a, known).where("userId = 1").orderBy("pos").collect()]
    assert got(rows(10), rec, none) == [f"b{i}" for i in range(10)]
    assert got(rows(3), rec, none) == ["b0", "b1", "b2", "b12", "b13", "b14", "b15", "b16"]
    shelf = spark.createDataFrame([(1, f"b{i}", i) for i in range(7)], "userId int, bookId string, ord int")
    assert got(rows(0), none, shelf) == [f"b{i}" for i in range(6)]


def test_latest_progress_and_shelf(spark):
    p = spark.createDataFrame([(1, "a", 5.0, 2), (1, "a", 9.0, 1), (1, "a", 5.0, 2), (1, None, 1.0, 1), (1, "b", None, 1)], PROG)
    assert [(r.bookId, r.percent) for r in state.latest_progress(p).collect()] == [("a", 5.0)]
    t = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (1, "a", 3, False), (1, "c", 4, True)], "userId int, bookId string, at int, added boolean")
    assert [(r.bookId, r.ord) for r in state.shelf(t).orderBy("ord").collect()] == [("b", 0), ("c", 1)]


def test_page_math(spark):
    df = spark.createDataFrame([(98, 100, True, 50.0), (0, 0, False, 10.0), (4, 10, False, 100.0)], "c int, t int, s boolean, p double")
    got = df.select(state.progress_percent(F.col("c"), F.col("t"), F.col("s")).alias("a"), state.resume_page(F.col("p"), F.col("t"), F.col("s")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(100, 50), (None, None), (50, 9)]

"""Core queries and their SQL, for ``__spark_entry__``.

Each query runs over its whole tables.  Where SQL can't say an operator (rounds, state
machines, Unicode decomposition) it has none and is held against brute force in ``tests``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import blocks, catalog, clean, dedup, reader, resolve, state, wiki
from folioframe.operators.packed import explode_packed
from folioframe.plans import pipelines
from folioframe.session import spread, table, widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The entries of the catalogue as the SQL of every query sees them.
CAT = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_no ORDER BY updatedAt DESC NULLS LAST, wordCount DESC NULLS LAST) AS rn FROM books) WHERE rn = 1),
cat AS (SELECT rec_no AS ord, id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(author, ''), 'Unknown') AS author,
 coalesce(nullif(language, ''), 'en') AS language, coalesce(nullif(category, ''), 'Fiction') AS category, coalesce(nullif(subjectsCsv, ''), '') AS subjectsCsv,
 summary, coverUrl, coalesce(nullif(contentPath, ''), id || '/content.html') AS contentPath, coalesce(wordCount, 0) AS wordCount, coalesce(isFeatured, false) AS isFeatured,
 coalesce(nullif(source, ''), 'gutenberg') AS source, coalesce(sourceId, CAST(gutenbergId AS VARCHAR)) AS sourceId, gutenbergId FROM cur)"""
LATEST = """ok AS (SELECT * FROM client_progress WHERE userId IS NOT NULL AND bookId IS NOT NULL AND percent IS NOT NULL),
lp AS (SELECT userId, bookId, percent, updatedAt FROM (SELECT *, row_number() OVER (PARTITION BY userId, bookId ORDER BY updatedAt DESC NULLS LAST, percent DESC) AS rn FROM ok) WHERE rn = 1),
rc AS (SELECT userId, bookId, row_number() OVER (PARTITION BY userId ORDER BY seen DESC NULLS LAST, bookId) - 1 AS ord FROM (SELECT userId, bookId, max(updatedAt) AS seen FROM client_progress WHERE userId IS NOT NULL AND bookId IS NOT NULL GROUP BY 1, 2))"""
SHELF = """tg AS (SELECT user_id AS userId, id AS bookId, ts, event_type = 'signup' AS added FROM events JOIN cat ON cat.ord = 500000001 + (event_id * 7919) % (SELECT count(*) FROM cat) WHERE event_type IN ('signup', 'error')),
sl AS (SELECT userId, bookId, max(CASE WHEN added THEN ts END) AS since, arg_max(added, (ts, added)) AS is_on FROM tg GROUP BY 1, 2),
sh AS (SELECT userId, bookId, row_number() OVER (PARTITION BY userId ORDER BY since, bookId) - 1 AS ord FROM sl WHERE is_on)"""


# A greedy scan as SQL: one step of the recursion for each row in order, with the keys registered so far.
WORK = """CASE WHEN regexp_matches(lower(coalesce(author, '')), 'anon|unknown|various|traditional') OR len(list_filter(str_split(regexp_replace(lower(coalesce(author, '')), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '')) = 0 THEN '' ELSE list_filter(str_split(regexp_replace(lower(coalesce(author, '')), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '')[-1] END || '|' ||
 array_to_string(list_slice(list_sort(list_filter(str_split(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 3 AND x NOT IN ('the','a','an','of','and','or','in','to','on','with','for','de','la','le','vol','part','book','volume','complete','selected'))), 1, 3), ' ')"""


def greedy_sql(third: str, rows: str, seeds: str, kinds: tuple[str, str, str], order: tuple[int, int, int] = (0, 1, 2)) -> str:
    """CTEs up to ``judged (ord, id, reason)``: rows of the catalogue judged by number, work and a third key."""
    keys = ["g", "w", "t"]
    case = " ".join(f"WHEN {keys[k]} IS NOT NULL AND list_contains({keys[k]}s, {keys[k]}) THEN '{kinds[k]}'" for k in order)
    seen = ", ".join(f"CASE WHEN reason IS NULL AND {k} IS NOT NULL THEN list_append({k}s, {k}) ELSE {k}s END AS {k}s" for k in keys)
    first = ", ".join(f"(SELECT coalesce(list({k}) FILTER (WHERE {k} IS NOT NULL), []) FROM keyed WHERE {seeds}) AS {k}s" for k in keys)
    return (
        f"keyed AS (SELECT *, CAST(nullif(gutenbergId, 0) AS VARCHAR) AS g, nullif({WORK}, '|') AS w, {third} AS t FROM cat), todo AS (SELECT row_number() OVER (ORDER BY ord) AS i, ord, id, g, w, t FROM keyed WHERE {rows}), "
        f"scan AS (SELECT 0::BIGINT AS i, {first}, NULL::BIGINT AS ord, NULL::VARCHAR AS id, NULL::VARCHAR AS reason UNION ALL "
        f"SELECT i, {seen}, ord, id, reason FROM (SELECT todo.i, gs, ws, ts, todo.ord, todo.id, g, w, t, CASE {case} END AS reason FROM scan JOIN todo ON todo.i = scan.i + 1)), judged AS (SELECT ord, id, reason FROM scan WHERE i > 0)"
    )


MERGE_KINDS = ("sameId", "sameWork", "sameSlug")


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def books(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The catalogue: one row per entry, typed, with its position; only ``columns`` are read."""
    needs = {"contentPath": "id", "sourceId": "gutenbergId"}
    wanted = (*columns, *(needs[c] for c in columns if c in needs))
    return catalog.catalog(catalog.current_entries(table(spark, d, "books"), columns=wanted), F.col("rec_no"))


def documents_html(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stored markup: their lines are the blocks of an article."""
    text = F.replace("text", F.lit("\r"), F.lit(""))
    line = lambda x: F.when(F.startswith(x, F.lit("<")), x).otherwise(F.concat(F.lit("<p>"), X.escape_markup(x), F.lit("</p>")))
    body = F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), line), "\n")
    return widen(table(spark, d, "documents")).select("doc_id", F.concat(F.lit("<article>\n"), body, F.lit("\n</article>")).alias("html"))


def shelf_rows(spark: SparkSession, d: str) -> DataFrame:
    """Shelves made of the event stream, over all books: sign-ups add a book, errors remove it."""
    ids = books(spark, d, "id").select("ord", F.col("id").alias("bookId"))
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    n = ids.agg(F.count(F.lit(1))).scalar()
    t = e.withColumn("ord", F.lit(500000001) + F.col("event_id") * 7919 % n).join(ids, "ord")
    return state.shelf(t.select(F.col("user_id").alias("userId"), "bookId", F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("added")))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries = spread(table(spark, d, "books").select("rec_no", "subjectsCsv").dropDuplicates())
    return explode_packed(entries, "subjectsCsv", "subject").select("rec_no", "pos", "subject").dropDuplicates()


# -- catalogue


@query(f"WITH {CAT} SELECT ord, id, title, author, language, category, subjectsCsv, summary, coverUrl, contentPath, wordCount, isFeatured, source, sourceId, gutenbergId FROM cat")
def q_catalog(spark, d):
    return books(spark, d).select("ord", "id", "title", "author", "language", "category", "subjectsCsv", "summary", "coverUrl", "contentPath", "wordCount", "isFeatured", "source", "sourceId", "gutenbergId")


@query(f"WITH {CAT} SELECT id, title, author, isFeatured FROM cat ORDER BY isFeatured DESC, lower(title), ord")
def q_all_books(spark, d):
    return catalog.all_books(books(spark, d, "id", "title", "author", "isFeatured"), "lower(title)").select("id", "title", "author", "isFeatured")


@query(f"WITH {CAT} SELECT id, title, author FROM cat WHERE isFeatured ORDER BY lower(title), ord LIMIT 12")
def q_featured(spark, d):
    return catalog.featured_books(books(spark, d, "id", "title", "author", "isFeatured"), 12, "lower(title)").select("id", "title", "author")


@query(f"WITH {CAT}, p AS (SELECT * FROM (VALUES ('the-evening-miscellany', 1), ('hindi-1', 2), ('no-such-book', 3), ('hindi-5', 4), ('hindi-a', 5), ('hindi-d', 6)) v(id, rank)) SELECT id, title, rank FROM (SELECT id, title, rank, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS n FROM cat JOIN p USING (id)) WHERE n = 1 ORDER BY rank LIMIT 4")
def q_popular(spark, d):
    slugs = ("the-evening-miscellany", "hindi-1", "no-such-book", "hindi-5", "hindi-a", "hindi-d")
    return catalog.popular_books(books(spark, d, "id", "title"), slugs, 4).select("id", "title", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {CAT} SELECT id, title, author FROM cat WHERE category = 'Poetry'")
def q_by_category(spark, d):
    return catalog.books_by_category(books(spark, d, "id", "title", "author", "isFeatured", "category"), "Poetry").select("id", "title", "author")


@query(
    f"WITH {CAT}, h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(str_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 999) AS f, "
    "list_reduce(list_prepend(0::BIGINT, list_transform(str_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 8) AS palette FROM cat) "
    "SELECT id, title, author, category, upper(language) AS language, source, CAST(wordCount AS BIGINT) AS words, greatest(1, CAST(floor(wordCount / 220.0::DOUBLE + 0.5) AS BIGINT)) AS minutes, "
    "round(greatest(1, CAST(floor(wordCount / 220.0::DOUBLE + 0.5) AS BIGINT)) / 60.0::DOUBLE, 1) AS hours, upper(substr(category, 1, 3)) || '-' || CASE WHEN f + 100 > 999 THEN CAST(f + 100 AS VARCHAR) ELSE lpad(CAST(f + 100 AS VARCHAR), 3, '0') END AS callNumber, summary, palette FROM h"
)
def q_cards(spark, d):
    cat = books(spark, d, "id", "title", "author", "category", "language", "source", "wordCount", "summary")
    return catalog.catalog_card(cat).join(cat.select("id", X.palette_index(F.col("id")).alias("palette")), "id")


@query(f"WITH {CAT} SELECT * EXCLUDE (ord) FROM (SELECT ord, id, title, author, category FROM cat WHERE contains(lower(title), 'the ra') OR contains(lower(author), 'the ra') OR contains(lower(category), 'the ra') OR contains(lower(subjectsCsv), 'the ra') ORDER BY ord LIMIT 20)")
def q_search(spark, d):
    return catalog.search_response(books(spark, d, "id", "title", "author", "category", "subjectsCsv"), "  The Ra ")


@query(f"WITH {CAT} SELECT d.ord, d.id, d.label, d.blurb, d.accent, d.emoji, n FROM category_dim d JOIN (SELECT category, count(*) AS n FROM cat GROUP BY 1) c ON c.category = d.label")
def q_category_tiles(spark, d):
    return catalog.category_tiles(books(spark, d, "category"), table(spark, d, "category_dim"))


@query(f"WITH {CAT} SELECT category, count(*) AS n FROM cat WHERE category NOT IN (SELECT label FROM category_dim) GROUP BY 1")
def q_unmatched_categories(spark, d):
    return catalog.unmatched_categories(books(spark, d, "category"), table(spark, d, "category_dim"))


@query(f"WITH {CAT} SELECT category, count(*) AS n FROM cat GROUP BY 1 ORDER BY n DESC, min(ord)")
def q_category_counts(spark, d):
    return catalog.category_counts(books(spark, d, "category")).orderBy(F.desc("n"), "first").select("category", "n")


@query(f"WITH {CAT} SELECT id, category, accent, emoji FROM cat LEFT JOIN category_dim d ON lower(cat.category) = lower(d.label)".replace("SELECT id,", "SELECT cat.id,"))
def q_with_category(spark, d):
    return catalog.with_category(books(spark, d, "id", "category"), table(spark, d, "category_dim")).select("id", "category", "accent", "emoji")


@query("SELECT ord, id, label FROM category_dim WHERE lower(label) = 'poetry' UNION ALL SELECT ord, id, label FROM category_dim WHERE id = 'drama'")
def q_find_category(spark, d):
    dim = table(spark, d, "category_dim")
    return catalog.find_category(dim, "pOETRY").unionByName(catalog.find_category_by_id(dim, "drama")).select("ord", "id", "label")


@query(f"WITH {CAT} SELECT count(*) AS books, count(DISTINCT category) AS categories, count(DISTINCT author) AS authors, count(*) FILTER (WHERE isFeatured) AS featured, CAST(coalesce(sum(wordCount), 0) AS BIGINT) AS words, CAST(floor(coalesce(sum(wordCount), 0) / 220.0::DOUBLE / 60.0::DOUBLE + 0.5) AS BIGINT) AS hours FROM cat")
def q_totals(spark, d):
    return catalog.totals(books(spark, d, "category", "author", "isFeatured", "wordCount"))


@query(f"WITH {CAT} SELECT count(*) - count(DISTINCT gutenbergId) - CAST(bool_or(gutenbergId IS NULL) AS BIGINT) AS dupNumbers, count(*) - count(DISTINCT id) - CAST(bool_or(id IS NULL) AS BIGINT) AS dupSlugs FROM cat")
def q_duplicate_metrics(spark, d):
    return catalog.duplicate_metrics(books(spark, d, "id", "gutenbergId"))


# -- text functions

_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0b]"


@query(
    "WITH b AS (SELECT DISTINCT title, author FROM books WHERE title IS NOT NULL) SELECT DISTINCT title, author, "
    rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\b(the|a|an|of|and|or|in|to)\b', ' ', 'g'), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS norm, "
    "array_to_string(list_slice(str_split(title, ' '), 1, 3), ' ') AS head FROM b"
)
def q_norm_title(spark, d):
    b = table(spark, d, "books").where("title is not null").select("title", "author").distinct()
    return b.select("title", "author", X.norm_title(F.col("title")).alias("norm"), X.first_words(F.col("title")).alias("head"))


@query(
    "WITH b AS (SELECT DISTINCT title, author FROM books), w AS (SELECT *, list_filter(str_split(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: length(x) > 3 AND x NOT IN ('the','a','an','of','and','or','in','to','on','with','for','de','la','le','vol','part','book','volume','complete','selected')) AS kw, "
    "list_filter(str_split(regexp_replace(lower(coalesce(author, '')), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '') AS parts FROM b) "
    "SELECT title, author, CASE WHEN regexp_matches(lower(coalesce(author, '')), 'anon|unknown|various|traditional') OR len(parts) = 0 THEN '' ELSE parts[-1] END AS surname, array_to_string(list_slice(list_sort(kw), 1, 3), ' ') AS kws FROM w"
)
def q_work_key(spark, d):
    b = table(spark, d, "books").select("title", "author").distinct()
    k = X.work_key(F.col("title"), F.col("author"))
    return b.select("title", "author", k["surname"].alias("surname"), F.array_join(k["kws"], " ").alias("kws"))


_TRIM = rf"^{_WS}+|{_WS}+$"


@query(
    rf"WITH b AS (SELECT DISTINCT author, regexp_replace(regexp_replace(author, '\([^)]*\)', '', 'g'), '{_TRIM}', '', 'g') AS bare FROM books WHERE author IS NOT NULL), "
    rf"p AS (SELECT *, list_filter(list_transform(str_split(bare, ','), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '') AS parts FROM b) "
    rf"SELECT author, regexp_replace(regexp_replace(CASE WHEN contains(bare, ',') THEN CASE WHEN len(parts) >= 2 THEN parts[2] || ' ' || parts[1] ELSE coalesce(parts[1], '') END ELSE bare END, '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS cleaned FROM p"
)
def q_clean_author(spark, d):
    a = table(spark, d, "books").where("author is not null").select("author").distinct()
    return a.select("author", X.clean_author(F.col("author")).alias("cleaned"))


@query(
    "SELECT rec_no, title, CASE WHEN contains(s, 'poetry') THEN CASE WHEN regexp_matches(c, 'drama|play|theatre|theater|tragedy|comedy') THEN 'Drama' ELSE 'Poetry' END WHEN contains(s, 'young readers') THEN 'Children' "
    "WHEN contains(s, 'life writing') THEN CASE WHEN regexp_matches(c, 'memoir|auto|biograph|diary|letters|life') THEN 'Memoir' ELSE 'Essays' END WHEN contains(s, 'science, mind') THEN 'Science' "
    "WHEN contains(s, 'ideas, belief') THEN CASE WHEN contains(c, 'histor') THEN 'History' ELSE 'Philosophy' END WHEN contains(s, 'arts, culture') THEN 'Essays' "
    "WHEN contains(s, 'foundational') THEN CASE WHEN regexp_matches(c, 'epic|myth|premodern') THEN 'Global' ELSE 'Fiction' END "
    "WHEN contains(s, 'literary & genre') THEN CASE WHEN regexp_matches(c, 'myster|crime|detective') THEN 'Mystery' WHEN regexp_matches(c, 'science fiction|sci-fi|dystop') THEN 'Sci-Fi' WHEN contains(c, 'adventure') THEN 'Adventure' ELSE 'Fiction' END ELSE 'Fiction' END AS mapped "
    "FROM (SELECT *, lower(coalesce(shelf, '')) AS s, lower(coalesce(cat, '')) AS c FROM wanted_list)"
)
def q_map_category(spark, d):
    return table(spark, d, "wanted_list").select("rec_no", "title", X.map_category(F.col("shelf"), F.col("cat")).alias("mapped"))


@query("SELECT rec_no, array_to_string(list_slice(list_filter(subjects, lambda x: x <> ''), 1, 6), ', ') AS subjectsCsv, coalesce(list_contains(languages, 'en'), false) AS english, regexp_matches(lower(title), 'index of|complete works|collected works|^works of|linked') AS bundle FROM search_hits")
def q_hit_features(spark, d):
    h = table(spark, d, "search_hits")
    return h.select("rec_no", X.subjects_csv(F.col("subjects"), 6).alias("subjectsCsv"), catalog.is_english(F.col("languages")).alias("english"), X.is_bundle_title(F.col("title"), True).alias("bundle"))


@query(
    rf"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')) AS BIGINT) AS text_words, "
    rf"CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '{_WS}+'), lambda w: w <> '')) AS BIGINT) AS html_words, CAST(length(text) AS BIGINT) AS n FROM documents"
)
def q_word_counts(spark, d):
    t = F.col("text")
    return widen(table(spark, d, "documents")).select("doc_id", X.count_text_words(t).alias("text_words"), X.count_html_words(t).alias("html_words"), F.length(t).cast("bigint").alias("n"))


@query(
    r"SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '_([^_\n]{1,120}?)_', '<em>\1</em>', 'g') AS escaped, regexp_replace(text, '<[^>]+>', '', 'g') AS bare FROM documents"
)
def q_escape(spark, d):
    return widen(table(spark, d, "documents")).select("doc_id", X.escape_block(F.col("text")).alias("escaped"), X.strip_tags(F.col("text")).alias("bare"))


@query("SELECT rec_no, CAST(nullif(regexp_extract(translate(coalesce(title, ''), '०१२३४५६७८९', '0123456789'), '([0-9]+)', 1), '') AS INTEGER) AS number, substr(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS heading FROM wanted_list")
def q_heading_slug(spark, d):
    t = F.coalesce("title", F.lit(""))
    return table(spark, d, "wanted_list").select("rec_no", X.devanagari_int(t).alias("number"), X.heading_slug(t).alias("heading"))


@query()
def q_slugs(spark, d):
    b = books(spark, d, "title").select("ord", "title", X.slug_base(F.col("title")).alias("latin"), X.hindi_slug_base(F.col("title")).alias("romanised"))
    b = b.withColumn("base", F.when(F.col("latin") != "", F.col("latin")).otherwise(F.col("romanised")))
    return dedup.allocate_slugs(b.select("ord", "base"), "ord", "base")


_BASE = "CASE WHEN ord % 7 = 0 THEN lower(substr(title, 1, 5)) || '-2' ELSE lower(substr(title, 1, 5)) END"


@query(
    f"WITH RECURSIVE {CAT}, b AS (SELECT row_number() OVER (ORDER BY ord) AS i, ord, {_BASE} AS base FROM cat), "
    "s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::BIGINT AS ord, NULL::VARCHAR AS base, NULL::VARCHAR AS slug UNION ALL SELECT i, list_append(used, slug), ord, base, slug FROM "
    "(SELECT b.i, used, b.ord, b.base, list_filter(list_transform(range(1, len(used) + 2), lambda n: CASE WHEN n = 1 THEN b.base ELSE b.base || '-' || n END), lambda x: NOT list_contains(used, x))[1] AS slug FROM s JOIN b ON b.i = s.i + 1)) "
    "SELECT ord, base, slug FROM s WHERE i > 0"
)
def q_allocate(spark, d):
    """Slugs from the first letters of titles; some bases look like another one with a suffix."""
    five = F.lower(F.substring("title", 1, 5))
    b = books(spark, d, "title").select("ord", F.when(F.col("ord") % 7 == 0, F.concat(five, F.lit("-2"))).otherwise(five).alias("base"))
    return dedup.allocate_slugs(b, "ord", "base")


# -- sets and joins


@query(f"WITH {CAT} SELECT 'book without document' AS what, id FROM cat WHERE id NOT IN (SELECT bookId FROM documents WHERE bookId IS NOT NULL) UNION ALL SELECT 'document without book', b FROM (SELECT DISTINCT bookId AS b FROM documents) WHERE b NOT IN (SELECT id FROM cat)")
def q_orphans(spark, d):
    b, docs = books(spark, d, "id").select("id"), table(spark, d, "documents").select(F.col("bookId").alias("id")).distinct()
    one = dedup.missing_from(b, docs).select(F.lit("book without document").alias("what"), "id")
    return one.unionByName(dedup.missing_from(docs, b).select(F.lit("document without book").alias("what"), "id"))


@query(f"WITH {CAT} SELECT bookId, progressPercent, lastLocation FROM reading_progress WHERE bookId IN (SELECT id FROM cat)")
def q_bookmarks(spark, d):
    return state.bookmarks_of_books(table(spark, d, "reading_progress"), books(spark, d, "id")).select("bookId", "progressPercent", "lastLocation")


@query(
    "WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_no ORDER BY updatedAt DESC NULLS LAST, wordCount DESC NULLS LAST) AS rn FROM books) WHERE rn = 1), "
    "k AS (SELECT DISTINCT rec_no FROM cur WHERE contains(lower(title), 'lantern')) SELECT rec_no, CASE WHEN rec_no IN (SELECT rec_no FROM k) THEN 'new' ELSE 'old' END AS origin, createdAt, "
    "CASE WHEN rec_no IN (SELECT rec_no FROM k) THEN TIMESTAMP '2030-01-01 00:00:00' ELSE updatedAt END AS updatedAt FROM cur"
)
def q_upsert(spark, d):
    from folioframe.sources.io import upsert

    b = catalog.current_entries(table(spark, d, "books"), columns=("title", "createdAt", "updatedAt")).withColumn("origin", F.lit("old"))
    new = b.where(F.contains(F.lower("title"), F.lit("lantern"))).drop("createdAt", "updatedAt").withColumn("origin", F.lit("new"))
    return upsert(b, new, "rec_no", at=F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).select("rec_no", "origin", "createdAt", "updatedAt")


@query(f"WITH RECURSIVE {CAT}, {greedy_sql('id', 'true', 'false', MERGE_KINDS)} SELECT ord, id, reason IS NULL AS kept, reason FROM judged")
def q_merge(spark, d):
    return pipelines.merge(books(spark, d, "id", "title", "author", "gutenbergId"), "ord").select("ord", "id", "kept", "reason")


_NORM = rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\b(the|a|an|of|and|or|in|to)\b', ' ', 'g'), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g'), '')"


@query(
    f"WITH RECURSIVE {CAT}, {greedy_sql(_NORM, 'ord % 2 = 1', 'ord % 2 = 0', ('sameId', 'sameWork', 'sameTitle'), (0, 2, 1))} "
    "SELECT ord, id, category FROM (SELECT j.ord, j.id, category, row_number() OVER (PARTITION BY category ORDER BY j.ord) AS r FROM judged j JOIN cat USING (ord) WHERE reason IS NULL) WHERE r <= 20"
)
def q_import_quota(spark, d):
    """The first twenty new books of each category that an import would keep."""
    b = books(spark, d, "id", "title", "author", "category", "gutenbergId")
    old = F.col("ord") % 2 == 0
    return pipelines.import_with_quota(b.where(~old), "ord", b.where(old), "category", 20).select("ord", "id", "category")


@query(
    r"""WITH w AS (SELECT rec_no AS want, any_value(title) AS title, any_value(author) AS author FROM wanted_list GROUP BY 1),
f AS (SELECT want, CASE WHEN trim(coalesce(author, ''), ' ') <> '' AND lower(trim(author, ' ')) NOT IN ('anonymous', 'unknown', 'various', 'traditional') THEN nullif(regexp_replace(lower(coalesce(list_filter(regexp_split_to_array(trim(author, ' '), 'WS+'), lambda x: x <> '')[-1], '')), '[^a-z]', '', 'g'), '') END AS surname,
 list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), 'WS+'), lambda x: length(x) > 2), 1, 5) AS kws FROM w),
h AS (SELECT rec_no AS cand_ord, any_value(id) AS id, lower(coalesce(any_value(title), '')) AS title, any_value(languages) AS languages, regexp_replace(lower(array_to_string(list_transform(any_value(authors), lambda x: x.name), ' ')), '[^a-z ]', '', 'g') AS names FROM search_hits GROUP BY 1),
g AS (SELECT *, list_filter(regexp_split_to_array(names, 'WS+'), lambda x: x <> '') AS who, list_filter(regexp_split_to_array(regexp_replace(title, '[^a-z0-9 ]', ' ', 'g'), 'WS+'), lambda x: x <> '') AS words FROM h),
c AS (SELECT f.*, g.* FROM f JOIN g ON CASE WHEN surname IS NOT NULL THEN list_contains(who, surname) AND len(list_intersect(kws, words)) > 0 ELSE list_contains(words, kws[1]) AND len(list_intersect(list_slice(kws, 2, 5), words)) > 0 END),
t AS (SELECT *, len(list_filter(kws, lambda k: contains(title, k))) AS hits FROM c WHERE coalesce(list_contains(languages, 'en'), false) AND NOT regexp_matches(title, 'index of|complete works|collected works|^works of|linked') AND (surname IS NULL OR contains(names, surname))),
r AS (SELECT want, arg_min(id, (cand_ord, id)) AS id FROM t WHERE len(kws) = 0 OR hits >= greatest(1, (len(kws) + 1) // 2) GROUP BY 1)
SELECT want, id FROM r WHERE id NOT IN (SELECT gutenbergId FROM books WHERE gutenbergId IS NOT NULL)""".replace("WS", _WS)
)
def q_resolve(spark, d):
    want = table(spark, d, "wanted_list").select("rec_no", "title", "author").dropDuplicates(["rec_no"])
    f = resolve.wanted_features(want, "rec_no")
    hits = table(spark, d, "search_hits").dropDuplicates(["rec_no"]).select("id", "title", F.col("authors.name").alias("authors"), "languages", F.col("rec_no").alias("cand_ord"))
    cand = resolve.search_candidates(f, hits)
    used = table(spark, d, "books").where("gutenbergId is not null").select(F.col("gutenbergId").alias("id"))
    return resolve.resolve(f, cand, used)


# -- documents


# Stored markup made of documents, and its blocks judged, as SQL sees them.  RE2 has no back
# references, so the three tags are spelled out.
HTML = r"""h AS (SELECT doc_id, '<article>' || chr(10) || array_to_string(list_transform(list_filter(str_split(replace(text, chr(13), ''), chr(10)), lambda x: x <> ''),
 lambda x: CASE WHEN starts_with(x, '<') THEN x ELSE '<p>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' END), chr(10)) || chr(10) || '</article>' AS html FROM documents),
b AS (SELECT doc_id, regexp_extract_all(html, '(?is)<h2(?:\s[^>]*)?>.*?</h2>|<p(?:\s[^>]*)?>.*?</p>|<pre(?:\s[^>]*)?>.*?</pre>') AS bs FROM h),
u AS (SELECT doc_id, generate_subscripts(bs, 1) AS i, unnest(bs) AS x FROM b),
v AS (SELECT doc_id, i, regexp_extract(x, '^(<[^>]*>)', 1) AS tag, regexp_extract(x, '(</[^>]*>)$', 1) AS close, regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '</[^>]*>$', '') AS inn FROM u),
t AS (SELECT *, regexp_replace(regexp_replace(inn, '<[^>]+>', '', 'g'), 'TRIM', '', 'g') AS t, regexp_replace(inn, 'TRIM', '', 'g') AS bare,
 regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(inn, '(?i)\[\s*illustration[^\]]*\]', '', 'g'), '(?i)\(\s*transcriber[''’]?s?\s*note[^)]*\)', '', 'g'), chr(8203), ''), '[ \t]{2,}', ' ', 'g'), 'TRIM', '', 'g') AS new FROM v),
j AS (SELECT *, t = '' OR regexp_matches(t, 'PHRASES') OR (regexp_matches(t, 'PRODUCED') AND length(t) < 240) OR (regexp_matches(t, 'HEADER') AND length(t) < 160)
 OR (regexp_matches(t, 'TRANSCRIBER') AND (length(t) < 260 OR regexp_matches(t, '\||\+-{3,}') OR starts_with(ltrim(lower(t), '*'), 'transcriber'))) OR regexp_matches(t, 'ORNAMENT') AS gone,
 regexp_replace(regexp_replace(new, '<[^>]+>', '', 'g'), 'TRIM', '', 'g') = '' AS emptied FROM t),
c AS (SELECT h.doc_id, CASE WHEN true THEN '<article>' || chr(10) || coalesce(string_agg(tag || new || close, chr(10) ORDER BY i) FILTER (WHERE NOT gone AND NOT emptied), '') || chr(10) || '</article>' END AS cleaned,
 count(*) FILTER (WHERE gone OR emptied) AS dropped, count(*) FILTER (WHERE NOT gone AND new <> bare) AS scrubbed, any_value(html) AS html FROM h LEFT JOIN j USING (doc_id) GROUP BY 1)"""
for _name in ("PHRASES", "PRODUCED", "HEADER", "TRANSCRIBER"):
    HTML = HTML.replace(f"'{_name}'", "'" + getattr(clean, _name).replace("'", "''") + "'")
HTML = HTML.replace("'ORNAMENT'", r"'^[\s|+_=*.\-—–~#]+$'").replace("TRIM", _TRIM)


@query(f"WITH {HTML} SELECT doc_id, cleaned, dropped, scrubbed FROM c")
def q_clean(spark, d):
    return clean.clean_documents(documents_html(spark, d)).drop("html")


@query(f"WITH {HTML} SELECT count(*) AS documents, count(*) FILTER (WHERE cleaned <> html) AS changed, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(scrubbed) AS BIGINT) AS scrubbed FROM c")
def q_clean_report(spark, d):
    return clean.clean_report(clean.clean_documents(documents_html(spark, d)))


@query()
def q_format_text(spark, d):
    return blocks.format_text(widen(table(spark, d, "documents")), "doc_id", "text")


@query()
def q_to_html(spark, d):
    docs = widen(table(spark, d, "documents")).select("doc_id", "text", F.col("bookId").alias("title"), F.coalesce("source", F.lit("")).alias("author"))
    return blocks.to_html(docs, "doc_id", "text", "title", "author")


_BARE = r"regexp_replace(inn, '<[^>]+>', '', 'g')"
for _entity, _char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#160;", "chr(160)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
    _BARE = f"replace({_BARE}, '{_entity}', {_char})"


@query(
    rf"""WITH {HTML}, a AS (SELECT doc_id, i, CASE WHEN regexp_matches(tag, '(?i)^<h2') THEN 'h2' ELSE 'p' END AS type, nullif(regexp_extract(tag, '(?i)\sid\s*=\s*"([^"]*)"', 1), '') AS id, {_BARE} AS text,
 regexp_matches(tag, '(?i)^<pre|^<p\s[^>]*class\s*=\s*"[^"]*\bverse\b') AS verse, contains(tag, 'toc-entry') AS toc FROM v)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ai, type, id, text, verse FROM a WHERE NOT (type = 'h2' AND toc) AND (type = 'h2' OR regexp_replace(text, '{_TRIM}', '', 'g') <> '')"""
)
def q_atoms(spark, d):
    return reader.atoms(documents_html(spark, d), "doc_id", "html").select("doc_id", "ai", "type", "id", "text", "verse")


@query()
def q_pages(spark, d):
    return reader.paginate_documents(documents_html(spark, d), "doc_id", "html")


@query()
def q_toc(spark, d):
    docs = widen(table(spark, d, "documents")).select("doc_id", "text", F.col("bookId").alias("title"), F.lit("").alias("author"))
    return reader.contents(reader.atoms(blocks.to_html(docs, "doc_id", "text", "title", "author"), "doc_id", "html"), "doc_id")


ATOMS = rf"""{HTML}, a AS (SELECT doc_id, i, CASE WHEN regexp_matches(tag, '(?i)^<h2') THEN 'h2' ELSE 'p' END AS type, nullif(regexp_extract(tag, '(?i)\sid\s*=\s*"([^"]*)"', 1), '') AS id, {_BARE} AS text, contains(tag, 'toc-entry') AS toc FROM v),
atoms AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ai, type, id, text FROM a WHERE NOT (type = 'h2' AND toc) AND (type = 'h2' OR regexp_replace(text, '{_TRIM}', '', 'g') <> ''))"""
MARKS = "1 + (event_id * 7919) % (SELECT count(*) FROM documents) AS doc_id, event_id AS seq, CAST(event_id % 7 AS INTEGER) AS ai"


def highlight_rows(spark: SparkSession, d: str) -> DataFrame:
    """Highlights made of the event stream, over all documents; some of them erase."""
    n, docs = F.col("event_id"), table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()
    return table(spark, d, "events").select(
        (n * 7919 % docs + 1).alias("doc_id"), n.alias("seq"), (n % 7).cast("int").alias("atomIndex"), (n % 40).cast("int").alias("start"), (n % 40 + 5 + n % 17).cast("int").alias("end"),
        F.when(n % 5 > 0, F.element_at(F.array(F.lit("yellow"), F.lit("pink")), (n % 2 + 1).cast("int"))).alias("color"),
    )


@query(
    f"""WITH {ATOMS}, e AS (SELECT {MARKS}, event_id % 40 AS s, event_id % 40 + 5 + event_id % 17 AS e, CASE WHEN event_id % 5 > 0 THEN CASE event_id % 2 WHEN 0 THEN 'yellow' ELSE 'pink' END ELSE '' END AS color FROM events),
l AS (SELECT e.doc_id, e.ai, seq, color, unnest(range(s, least(e, CAST(length(text) AS BIGINT)))) AS x FROM e JOIN atoms USING (doc_id, ai)),
p AS (SELECT doc_id, ai, x, arg_max(color, seq) AS color FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, ai, color ORDER BY x) AS run FROM p WHERE color <> '')
SELECT doc_id, ai, CAST(min(x) AS INTEGER) AS start, CAST(max(x) + 1 AS INTEGER) AS "end", color FROM r GROUP BY doc_id, ai, color, run"""
)
def q_paint(spark, d):
    return reader.paint(reader.atoms(documents_html(spark, d), "doc_id", "html"), highlight_rows(spark, d), "doc_id")


@query(
    f"""WITH {ATOMS}, e AS (SELECT {MARKS}, CAST(event_id % 3 AS INTEGER) AS more, CAST(event_id % 11 AS INTEGER) AS a_off, CAST(event_id % 13 AS INTEGER) AS b_off FROM events),
sel0 AS (SELECT doc_id, seq AS sel, ai + more AS a_ai, a_off, ai AS b_ai, b_off FROM e),
sel1 AS (SELECT doc_id, sel, CASE WHEN (a_ai, a_off) <= (b_ai, b_off) THEN a_ai ELSE b_ai END AS l_ai, CASE WHEN (a_ai, a_off) <= (b_ai, b_off) THEN a_off ELSE b_off END AS l_off,
 CASE WHEN (a_ai, a_off) <= (b_ai, b_off) THEN b_ai ELSE a_ai END AS h_ai, CASE WHEN (a_ai, a_off) <= (b_ai, b_off) THEN b_off ELSE a_off END AS h_off FROM sel0),
sel2 AS (SELECT u.doc_id, sel, ai, CASE WHEN ai = l_ai THEN l_off ELSE 0 END AS start, CASE WHEN ai = h_ai THEN least(h_off, CAST(length(text) AS INTEGER)) ELSE CAST(length(text) AS INTEGER) END AS "end" FROM sel1 u JOIN atoms a ON a.doc_id = u.doc_id AND ai BETWEEN l_ai AND h_ai)
SELECT * FROM sel2 WHERE "end" > start"""
)
def q_selections(spark, d):
    """Selections over up to three atoms, all of them turned, as ranges of single atoms."""
    n, h = F.col("seq"), highlight_rows(spark, d)
    s = h.select("doc_id", n.alias("sel"), (F.col("atomIndex") + (n % 3).cast("int")).alias("a_ai"), (n % 11).cast("int").alias("a_off"), F.col("atomIndex").alias("b_ai"), (n % 13).cast("int").alias("b_off"))
    return reader.split_selection(s, reader.atoms(documents_html(spark, d), "doc_id", "html"), "doc_id")


@query(
    f"""WITH e AS (SELECT {MARKS}, CAST(event_id % 40 AS INTEGER) AS s, CAST(event_id % 40 + 5 + event_id % 17 AS INTEGER) AS e, CASE WHEN event_id % 5 > 0 THEN CASE event_id % 2 WHEN 0 THEN 'yellow' ELSE 'pink' END END AS color FROM events),
r AS (SELECT doc_id, ai, s, e, seq FROM e WHERE seq % 10 = 0), h AS (SELECT * FROM e WHERE seq % 10 > 0),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = h.doc_id AND r.ai = h.ai AND h.s >= r.s AND h.e <= r.e)), m AS (SELECT doc_id, max(seq) AS m FROM k GROUP BY 1)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, ai AS "atomIndex", s AS start, e AS "end", color FROM k UNION ALL
SELECT r.doc_id, coalesce(m, -1) + row_number() OVER (PARTITION BY r.doc_id ORDER BY ai, s, e, r.seq), ai, s, e, 'green' FROM r LEFT JOIN m USING (doc_id)"""
)
def q_apply_color(spark, d):
    """A tenth of the highlights, painted green over the others."""
    h = highlight_rows(spark, d)
    ranges = h.where(F.col("seq") % 10 == 0).select("doc_id", F.col("atomIndex").alias("ai"), "start", "end", F.lit("green").alias("color"))
    return reader.apply_color(h.where(F.col("seq") % 10 > 0), ranges, "doc_id").withColumn("seq", F.col("seq").cast("bigint"))


_TAIL = "substr(sub, length(work) + 2)"


@query(
    f"""WITH s AS (SELECT DISTINCT bookId AS work, bookId || '/' || CAST(partNo AS VARCHAR) AS sub FROM documents WHERE bookId IS NOT NULL),
l AS (SELECT bookId AS work, bookId || '/' || CAST(partNo AS VARCHAR) AS sub, min(doc_id) AS link FROM documents WHERE bookId IS NOT NULL AND partNo % 3 > 0 GROUP BY 1, 2),
o AS (SELECT work, sub, CAST(row_number() OVER (PARTITION BY work ORDER BY link NULLS LAST, coalesce(TRY_CAST(nullif(regexp_extract({_TAIL}, '([0-9]+)', 1), '') AS INTEGER), 9999), sub) AS INTEGER) AS pos, {_TAIL} AS tail FROM s LEFT JOIN l USING (work, sub)),
k AS (SELECT work, count(*) AS n, count(*) FILTER (WHERE regexp_matches(tail, '[0-9]') AND length(regexp_replace(tail, '[0-9 .-]', '', 'g')) <= 2) AS numbers FROM o GROUP BY 1)
SELECT work, CASE WHEN numbers >= greatest(2, n * 0.5) THEN 1 ELSE pos END AS book, CASE WHEN numbers >= greatest(2, n * 0.5) THEN work ELSE coalesce(nullif(tail, ''), work) END AS title,
 CASE WHEN numbers >= greatest(2, n * 0.5) THEN pos ELSE 1 END AS pos, CASE WHEN numbers >= greatest(2, n * 0.5) THEN tail END AS heading, sub AS page FROM o JOIN k USING (work)"""
)
def q_wiki_plan(spark, d):
    """Parts of books as subpages; a third of them isn't linked and follows by number."""
    docs = table(spark, d, "documents").where("bookId is not null").select("doc_id", "partNo", F.col("bookId").alias("work"), F.concat("bookId", F.lit("/"), F.col("partNo").cast("string")).alias("sub"))
    ordered = wiki.ordered_subpages(docs.select("work", "sub"), docs.where(F.col("partNo") % 3 > 0).select("work", "sub", F.col("doc_id").alias("link")))
    return wiki.plan_books(docs.select("work"), ordered)


@query(
    rf"""WITH {HTML}, w AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS x FROM (SELECT doc_id, regexp_extract_all(html, '(?s)<p>.*?</p>') AS ps FROM h)),
y AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^<p>', ''), '</p>$', '') AS inn FROM w),
z AS (SELECT doc_id, i, regexp_replace(replace({_BARE}, chr(8203), ''), '{_TRIM}', '', 'g') AS text FROM y)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, 'p' AS kind, text FROM z WHERE text <> ''"""
)
def q_wiki_blocks(spark, d):
    return documents_html(spark, d).select("doc_id", F.posexplode(wiki.page_blocks(F.col("html"))).alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.text")


# -- reader state


@query(f"WITH {LATEST} SELECT * FROM lp")
def q_latest_progress(spark, d):
    return state.latest_progress(table(spark, d, "client_progress"))


@query(f"WITH {LATEST} SELECT userId, bookId, CAST(ord AS INTEGER) AS ord FROM rc")
def q_recents(spark, d):
    return state.recents(table(spark, d, "client_progress"))


@query(f"WITH {CAT}, {LATEST}, {SHELF} SELECT sh.userId, CAST(sh.ord AS INTEGER) AS ord, sh.bookId, title, percent, CASE WHEN percent >= 99 THEN 'done' WHEN percent > 0 THEN 'reading' WHEN percent IS NULL OR percent = 0 THEN 'unread' END AS bucket FROM sh JOIN cat ON cat.id = sh.bookId LEFT JOIN lp USING (userId, bookId)")
def q_my_shelf(spark, d):
    return state.my_shelf(shelf_rows(spark, d), state.latest_progress(table(spark, d, "client_progress")), books(spark, d, "id", "title"))


@query(
    f"WITH {CAT}, {LATEST}, {SHELF}, a AS (SELECT userId, bookId, percent, 0 AS tier, -updatedAt AS k FROM lp WHERE percent > 0 AND percent < 99 AND bookId IN (SELECT id FROM cat)), n AS (SELECT userId, count(*) AS n FROM a GROUP BY 1), "
    "m0 AS (SELECT rc.userId, rc.bookId, rc.ord, row_number() OVER (PARTITION BY rc.userId ORDER BY rc.ord, rc.bookId) AS r FROM rc WHERE bookId IN (SELECT id FROM cat) AND NOT EXISTS (SELECT 1 FROM a WHERE a.userId = rc.userId AND a.bookId = rc.bookId)), "
    "m AS (SELECT m0.userId, m0.bookId, coalesce(lp.percent, 0.0) AS percent, 1 AS tier, m0.ord AS k FROM m0 LEFT JOIN n ON n.userId = m0.userId LEFT JOIN lp ON lp.userId = m0.userId AND lp.bookId = m0.bookId WHERE m0.r <= 8 - coalesce(n.n, 0)), "
    "s AS (SELECT * FROM a UNION ALL SELECT * FROM m), z AS (SELECT sh.userId, sh.bookId, coalesce(lp.percent, 0.0) AS percent, 2 AS tier, sh.ord AS k FROM sh LEFT JOIN lp ON lp.userId = sh.userId AND lp.bookId = sh.bookId WHERE sh.ord < 6 AND sh.userId NOT IN (SELECT userId FROM s) AND sh.bookId IN (SELECT id FROM cat)) "
    "SELECT userId, CAST(row_number() OVER (PARTITION BY userId ORDER BY tier, k, bookId) AS INTEGER) AS pos, bookId, percent FROM (SELECT * FROM s UNION ALL SELECT * FROM z)"
)
def q_continue_reading(spark, d):
    p = table(spark, d, "client_progress")
    return state.continue_reading(state.latest_progress(p), state.recents(p), shelf_rows(spark, d), books(spark, d, "id"))


@query("SELECT bookId, date_trunc('day', make_timestamp(updatedAt * 1000)) AS day, count(*) AS n, max(percent) AS furthest FROM client_progress WHERE bookId IS NOT NULL GROUP BY 1, 2")
def q_reading_activity(spark, d):
    from folioframe.streaming.progress import reading_activity

    e = table(spark, d, "client_progress").withColumn("at", F.timestamp_millis("updatedAt"))
    return reading_activity(e).select("bookId", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "furthest")


@query("SELECT bookId, progressPercent, CAST(floor(least(1.0::DOUBLE, (CAST(floor(progressPercent) AS INTEGER) + 2) / 100.0::DOUBLE) * 100 + 0.5) AS INTEGER) AS after, CAST(CASE WHEN floor(progressPercent / 100.0::DOUBLE * 100 + 0.5) > 99 THEN 98 ELSE floor(progressPercent + 0.5) - floor(progressPercent + 0.5) % 2 END AS INTEGER) AS resume FROM reading_progress WHERE progressPercent >= 0")
def q_page_math(spark, d):
    p, total, spread = F.col("progressPercent"), F.lit(100), F.lit(True)
    return table(spark, d, "reading_progress").where("progressPercent >= 0").select(
        "bookId", p, state.progress_percent(F.floor(p).cast("int"), total, spread).alias("after"), state.resume_page(p, total, spread).alias("resume")
    )


from folioframe.plans import composites  # noqa: E402,F401 - registers its queries here

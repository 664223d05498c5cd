"""Composite jobs as queries, and queries of operators that no other query runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators import blocks, catalog, clean, dedup, reader, resolve, state, wiki
from folioframe.plans import pipelines
from folioframe.plans.queries import _TRIM, _WS, ATOMS, CAT, HTML, LATEST, MERGE_KINDS, SHELF, books, documents_html, greedy_sql, highlight_rows, query, shelf_rows
from folioframe.session import table, widen
from folioframe.sources import io

POPULAR = ("the-evening-miscellany", "hindi-1", "no-such-book", "hindi-5", "hindi-a", "hindi-d")
TILES = "tiles AS (SELECT d.id, d.ord, count(*) AS n FROM category_dim d JOIN cat ON cat.category = d.label GROUP BY 1, 2)"
FEATURED = "featured AS (SELECT id, row_number() OVER (ORDER BY lower(title), ord) AS pos FROM cat WHERE isFeatured)"
LIKED = "liked AS (SELECT id, row_number() OVER (ORDER BY rank) AS pos FROM (SELECT DISTINCT id, rank FROM cat JOIN (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(POPULAR, 1)) + ") v(id, rank) USING (id)))"


def _shelf(df, section: str, n=None):
    """``(section, pos, id, n)`` of rows in their order."""
    return df.select(F.lit(section).alias("section"), F.col("pos").cast("bigint").alias("pos"), "id", (n if n is not None else F.lit(0)).cast("bigint").alias("n"))


# -- pages


@query(
    f"WITH {CAT}, {TILES}, {FEATURED}, {LIKED} SELECT 'total' AS section, 0::BIGINT AS pos, NULL AS id, count(*) AS n FROM cat UNION ALL SELECT 'featured', pos, id, 0 FROM featured WHERE pos <= 12 "
    "UNION ALL SELECT 'popular', pos, id, 0 FROM liked WHERE pos <= 12 UNION ALL SELECT 'category', ord, id, n FROM tiles"
)
def q_lobby(spark, d):
    """The lobby: the number of books, the featured and the popular shelf, and the category tiles."""
    cat = books(spark, d, "id", "title", "isFeatured", "category")
    total = cat.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("id"), "n")
    place = F.row_number().over(_by("lower(title)", "ord"))
    featured = catalog.featured_books(cat, 12, "lower(title)").withColumn("pos", place)
    popular = catalog.popular_books(cat, POPULAR, 12)
    popular = popular.withColumn("pos", F.row_number().over(_by("rank")))
    tiles = catalog.category_tiles(cat, table(spark, d, "category_dim")).withColumn("pos", F.col("ord"))
    return total.unionByName(_shelf(featured, "featured")).unionByName(_shelf(popular, "popular")).unionByName(_shelf(tiles, "category", F.col("n")))


def _by(*order: str):
    """A window over the few rows of a shelf."""
    from pyspark.sql import Window as W

    return W.partitionBy(F.lit(0)).orderBy(*[F.expr(o) for o in order])


@query(
    f"WITH {CAT}, {TILES} SELECT 'total' AS section, NULL AS id, NULL AS title, count(*) AS n FROM cat UNION ALL SELECT 'categories', NULL, NULL, count(DISTINCT category) FROM cat "
    "UNION ALL SELECT 'category', id, NULL, n FROM tiles UNION ALL SELECT 'book', id, title, 0 FROM cat"
)
def q_browse(spark, d):
    """The browse page: totals, the category tiles and all books, featured first."""
    cat = books(spark, d, "id", "title", "isFeatured", "category")
    row = lambda df, section, id_, title, n: df.select(F.lit(section).alias("section"), id_.cast("string").alias("id"), title.cast("string").alias("title"), n.cast("bigint").alias("n"))
    none = F.lit(None)
    sums = cat.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("c"))
    tiles = catalog.category_tiles(cat, table(spark, d, "category_dim"))
    out = row(sums, "total", none, none, F.col("n")).unionByName(row(sums, "categories", none, none, F.col("c")))
    return out.unionByName(row(tiles, "category", F.col("id"), none, F.col("n"))).unionByName(row(catalog.all_books(cat, "lower(title)"), "book", F.col("id"), F.col("title"), F.lit(0)))


@query(
    f"WITH {CAT} SELECT d.id AS shelf, d.label, (SELECT count(*) FROM cat WHERE category = d.label) AS n, cat.id, cat.title FROM category_dim d LEFT JOIN cat ON cat.category = d.label WHERE d.id IN ('poetry', 'global', 'drama')"
)
def q_category_page(spark, d):
    """Three category pages: the shelf, its number of books and each book; an empty shelf has one row without a book."""
    dim, cat = table(spark, d, "category_dim"), books(spark, d, "id", "title", "category")
    out = None
    for id_ in ("poetry", "global", "drama"):
        head = catalog.find_category_by_id(dim, id_).select(F.col("id").alias("shelf"), "label")
        own = cat.join(F.broadcast(head), F.col("category") == F.col("label"), "left_semi")
        n = catalog.category_counts(own).select(F.col("category").alias("label"), "n")
        page = head.join(n, "label", "left").join(own.select(F.col("category").alias("label"), "id", "title"), "label", "left").select("shelf", "label", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "id", "title")
        out = page if out is None else out.unionByName(page)
    return out


@query(
    f"WITH {CAT}, t AS (SELECT sum(wordCount) AS w FROM cat) SELECT 'books' AS what, NULL AS category, count(*) AS n, NULL AS shown FROM cat UNION ALL SELECT 'featured', NULL, count(*) FILTER (WHERE isFeatured), NULL FROM cat "
    "UNION ALL SELECT 'words', NULL, CAST(w AS BIGINT), format('{:,}', CAST(w AS BIGINT)) FROM t UNION ALL SELECT 'hours', NULL, CAST(floor(w / 220.0::DOUBLE / 60.0::DOUBLE + 0.5) AS BIGINT), format('{:,}', CAST(floor(w / 220.0::DOUBLE / 60.0::DOUBLE + 0.5) AS BIGINT)) FROM t "
    "UNION ALL SELECT 'category', category, count(*), NULL FROM cat GROUP BY category"
)
def q_stats(spark, d):
    """The statistics report: totals, then categories in ascending order of their names."""
    cat = books(spark, d, "category", "author", "isFeatured", "wordCount")
    t = catalog.totals(cat)
    row = lambda df, what, category, n, shown: df.select(F.lit(what).alias("what"), category.cast("string").alias("category"), n.cast("bigint").alias("n"), shown.cast("string").alias("shown"))
    none = F.lit(None)
    parts = [row(t, "books", none, F.col("books"), none), row(t, "featured", none, F.col("featured"), none)]
    parts += [row(t, w, none, F.col(w), X.grouped_number(F.col(w))) for w in ("words", "hours")]
    parts.append(row(catalog.category_counts(cat).orderBy("category"), "category", F.col("category"), F.col("n"), none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"WITH {CAT}, {LATEST}, {SHELF}, b AS (SELECT sh.userId, sh.bookId, CASE WHEN percent >= 99 THEN 'done' WHEN percent > 0 THEN 'reading' WHEN percent IS NULL OR percent = 0 THEN 'unread' END AS part, sh.ord FROM sh LEFT JOIN lp USING (userId, bookId) WHERE sh.bookId IN (SELECT id FROM cat)), "
    "r AS (SELECT userId, bookId, 'recent' AS part, rc.ord FROM rc WHERE bookId IN (SELECT id FROM cat)) SELECT u.userId, u.bookId, u.part, CAST(u.ord AS INTEGER) AS ord, cat.title FROM (SELECT * FROM b UNION ALL SELECT * FROM r) u JOIN cat ON cat.id = u.bookId"
)
def q_shelf_page(spark, d):
    """My shelf: the buckets and the recently opened books, with titles."""
    p, cat = table(spark, d, "client_progress"), books(spark, d, "id", "title")
    own = state.my_shelf(shelf_rows(spark, d), state.latest_progress(p), cat).select("userId", "bookId", F.col("bucket").alias("part"), "ord", "title")
    titles = cat.select(F.col("id").alias("bookId"), "title").dropDuplicates(["bookId"])
    return own.unionByName(state.recents(p).join(titles, "bookId").select("userId", "bookId", F.lit("recent").alias("part"), "ord", "title"))


CARD = "SELECT id, title, author, category, upper(language) AS language, source, CAST(wordCount AS BIGINT) AS words, greatest(1, CAST(floor(wordCount / 220.0::DOUBLE + 0.5) AS BIGINT)) AS minutes, format('{:,}', CAST(wordCount AS BIGINT)) AS shown"


@query(f"WITH {CAT} {CARD} FROM (SELECT * FROM cat WHERE id = 'the-evening-miscellany' ORDER BY ord LIMIT 1)")
def q_book(spark, d):
    """One book by its id, as a catalogue card."""
    cat = books(spark, d, "id", "title", "author", "category", "language", "source", "wordCount", "summary")
    card = catalog.catalog_card(catalog.get_book(cat, "the-evening-miscellany"))
    return card.select("id", "title", "author", "category", "language", "source", "words", "minutes", X.grouped_number(F.col("words")).alias("shown"))


@query(f"WITH {CAT} SELECT id, title FROM cat WHERE id IN ('hindi-1', 'hindi-5', 'the-evening-miscellany')")
def q_only_ids(spark, d):
    return catalog.only_ids(books(spark, d, "id", "title"), " hindi-1, hindi-5,,the-evening-miscellany,no-such-book ").select("id", "title")


@query(f"WITH {CAT}, s AS (SELECT bookId AS id, min(substr(text, 1, 40)) AS summary FROM documents GROUP BY 1) SELECT cat.id, title, s.summary, CASE WHEN gutenbergId IS NOT NULL THEN 'covers/' || gutenbergId || '.jpg' END AS cover FROM cat LEFT JOIN s USING (id)")
def q_summaries(spark, d):
    """Books with a summary made of their first document, and the address of a cover."""
    cat = books(spark, d, "id", "title", "summary", "gutenbergId")
    s = table(spark, d, "documents").groupBy(F.col("bookId").alias("id")).agg(F.min(F.substring("text", 1, 40)).alias("summary"))
    return catalog.with_summaries(cat, s).select("id", "title", "summary", X.cover_url("covers/%d.jpg", F.col("gutenbergId")).alias("cover"))


# -- text


@query(rf"SELECT DISTINCT title, regexp_replace(split_part(split_part(title, ' : ', 1), ' — ', 1), '{_TRIM}', '', 'g') AS head, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[\x{{2060}}\x{{200B}}]', '', 'g'), '{_TRIM}', '', 'g'), '^[०-९0-9]+\s*[-–—.)]\s*', ''), '{_TRIM}', '', 'g') AS part FROM books WHERE title IS NOT NULL")
def q_title_parts(spark, d):
    t = F.col("title")
    return table(spark, d, "books").where("title is not null").select("title").distinct().select("title", X.title_head(t).alias("head"), X.clean_part(t).alias("part"))


@query(
    "SELECT doc_id, length(text) > 1500 AND (contains(lower(text), 'golden gate') OR (length(text) > 4000 AND contains(substr(lower(text), 1, 400), 'chapter'))) AS accepted, contains(upper(substr(text, 1, 600)), 'CHAPTER') AS bundled, "
    "CASE WHEN length(text) > 1500 AND (contains(lower(text), 'golden gate') OR (length(text) > 4000 AND contains(substr(lower(text), 1, 400), 'chapter'))) THEN 'text' WHEN length(text || text) > 1500 AND (contains(lower(text || text), 'golden gate') OR (length(text || text) > 4000 AND contains(substr(lower(text || text), 1, 400), 'chapter'))) THEN 'twice' END AS source FROM documents"
)
def q_accept(spark, d):
    """Raw texts judged, and the first accepted one of two candidates."""
    ok = lambda t: X.accepts_text(t, "golden gate", "chapter", 1500, 4000, 400)
    t, twice = F.col("text"), F.concat("text", "text")
    first = X.first_accepted([t, twice], ok)
    return widen(table(spark, d, "documents")).select("doc_id", ok(t).alias("accepted"), X.is_bundle_body(t, "CHAPTER", 600).alias("bundled"), F.when(first == t, "text").when(first.isNotNull(), "twice").alias("source"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS attribute, regexp_replace(upper(substr(text, 1, 1)), '[^A-Z]', '') AS first FROM documents")
def q_escape_attribute(spark, d):
    t = F.col("text")
    return widen(table(spark, d, "documents")).select("doc_id", X.escape_attribute(t).alias("attribute"), F.regexp_replace(F.upper(F.substring("text", 1, 1)), "[^A-Z]", "").alias("first"))


# -- documents


@query(f"WITH {HTML} SELECT doc_id, len(regexp_extract_all(html, '<br>')) AS breaks, len(regexp_extract_all(html, '<h2 id=')) AS headings FROM h")
def q_markup_counts(spark, d):
    return documents_html(spark, d).select("doc_id", blocks.markup_counts(F.col("html")).alias("c")).select("doc_id", F.col("c.breaks").cast("bigint").alias("breaks"), F.col("c.headings").cast("bigint").alias("headings"))


def _reasons() -> str:
    """SQL: why a block with the tagless text ``t`` is dropped, as ``HTML`` has it."""
    q = lambda name: "'" + getattr(clean, name).replace("'", "''") + "'"
    return (
        f"CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, {q('PHRASES')}) THEN 'phrase' WHEN regexp_matches(t, {q('PRODUCED')}) AND length(t) < 240 THEN 'produced' WHEN regexp_matches(t, {q('HEADER')}) AND length(t) < 160 THEN 'header' "
        f"WHEN regexp_matches(t, {q('TRANSCRIBER')}) AND (length(t) < 260 OR regexp_matches(t, '\\||\\+-{{3,}}') OR starts_with(ltrim(lower(t), '*'), 'transcriber')) THEN 'transcriber' WHEN gone THEN 'ornament' ELSE 'emptied' END"
    )


@query(f"WITH {HTML} SELECT doc_id, CAST(i - 1 AS INTEGER) AS block, {_reasons()} AS reason FROM j WHERE gone OR emptied")
def q_dropped_blocks(spark, d):
    return clean.dropped_blocks(documents_html(spark, d), "doc_id")


@query(f"WITH {HTML} SELECT doc_id, cleaned FROM c WHERE cleaned <> html")
def q_changed(spark, d):
    """The documents that a conditional rewrite would write."""
    return io.changed_only(clean.clean_documents(documents_html(spark, d)), "html", "cleaned").select("doc_id", "cleaned")


_FIRST = "trim(replace(replace(replace(substr(text, 1, 30), chr(10), ' '), chr(13), ' '), '<', '('), ' ')"


@query(f"""SELECT doc_id, 0 AS ai, 's' || doc_id AS id, regexp_replace(replace({_FIRST}, '&', '+'), '{_TRIM}', '', 'g') AS label FROM documents""")
def q_contents(spark, d):
    """The contents of documents that open with a heading."""
    docs = documents_html(spark, d).join(table(spark, d, "documents").select("doc_id", _opening()), "doc_id")
    head = F.concat(F.lit('<article>\n<h2 class="x" id="s'), F.col("doc_id").cast("string"), F.lit('">'), F.replace("opening", F.lit("&"), F.lit("+")), F.lit("</h2>"))
    html = docs.select("doc_id", F.concat(head, F.substr("html", F.lit(len("<article>") + 1))).alias("html"))
    return reader.contents(reader.atoms(html, "doc_id", "html"), "doc_id")


def _opening():
    """The first thirty characters of a text, in one line."""
    t = F.substring("text", 1, 30)
    for a, b in (("\n", " "), ("\r", " "), ("<", "(")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t).alias("opening")


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all('<h2 id="c' || doc_id || '">' || {_FIRST} || '</h2>' || text, '<h2 id="[^"]+">[^<]+</h2>') AS hs FROM documents)
SELECT doc_id, len(hs) AS n, regexp_extract(hs[1], '<h2 id="([^"]+)">', 1) AS first_id, regexp_extract(hs[1], '>([^<]+)<', 1) AS label FROM w"""
)
def q_extract_toc(spark, d):
    html = F.concat(F.lit('<h2 id="c'), F.col("doc_id").cast("string"), F.lit('">'), "opening", F.lit("</h2>"), F.col("text"))
    t = widen(table(spark, d, "documents")).select("doc_id", "text", _opening()).select("doc_id", blocks.extract_toc(html).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.get("t", F.lit(0))["id"].alias("first_id"), F.get("t", F.lit(0))["label"].alias("label"))


# -- wiki


@query(
    "WITH l AS (SELECT source AS work, CASE WHEN partNo % 4 = 0 THEN 1 ELSE 0 END AS ns, CASE WHEN partNo % 3 = 0 THEN bookId || '/2' ELSE bookId END AS title, doc_id AS ord FROM documents WHERE bookId IS NOT NULL), "
    "m AS (SELECT work, title, min(ord) AS ord FROM l WHERE ns = 0 AND NOT contains(title, '/') AND NOT contains(title, ':') GROUP BY 1, 2), r AS (SELECT DISTINCT title FROM m) "
    "SELECT m.work, m.title, m.ord, CASE WHEN length(m.title) % 2 = 0 THEN 'seen ' || m.title ELSE m.title END AS canon FROM m"
)
def q_main_pages(spark, d):
    """Links of authors' pages: the works among them, and where their redirects lead."""
    docs = table(spark, d, "documents").where("bookId is not null")
    links = docs.select(
        F.col("source").alias("work"), F.when(F.col("partNo") % 4 == 0, 1).otherwise(0).alias("ns"), F.when(F.col("partNo") % 3 == 0, F.concat("bookId", F.lit("/2"))).otherwise(F.col("bookId")).alias("title"), F.col("doc_id").alias("ord")
    )
    main = wiki.main_pages(links)
    titles = main.select("title").distinct()
    hops = titles.where(F.length("title") % 2 == 0).select("title", F.array(F.lit("by the way"), F.concat(F.lit("seen "), "title")).alias("hops"))
    return main.join(wiki.resolve_redirects(titles, hops), "title").select("work", "title", "ord", "canon")


# -- sources and jobs


@query("SELECT DISTINCT bookId AS id FROM documents WHERE bookId <> ''")
def q_listing(spark, d):
    """Ids in an object-store listing of stored documents."""
    paths = table(spark, d, "documents").select(F.concat(F.lit("books/"), "bookId", F.lit("/content.html")).alias("path"))
    return io.keys_of_listing(paths)


@query("SELECT page_token AS page, id, title, list_transform(authors, lambda x: x.name) AS authors, languages, subjects FROM search_hits")
def q_search_pages(spark, d):
    """Result pages as JSON text, read back into rows."""
    h = table(spark, d, "search_hits")
    page = h.select("page_token", F.struct(F.array(F.struct("id", "title", "authors", "languages", "subjects")).alias("results"), F.lit(None).cast("string").alias("next")).alias("p"))
    rows = io.parse_search_pages(page.select(F.col("page_token").alias("page"), F.to_json("p").alias("body")))
    return rows.select("page", "id", "title", F.col("authors.name").alias("authors"), "languages", "subjects")


@query(
    f"WITH {CAT}, {HTML}, w AS (SELECT bookId AS id, CAST(sum(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(cleaned, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '{_WS}+'), lambda x: x <> ''))) AS INTEGER) AS n FROM c JOIN documents USING (doc_id) GROUP BY 1) "
    "SELECT id, 'synced' AS status, category, n AS words FROM cat JOIN w USING (id) UNION ALL SELECT id, 'missing content', category, 0 FROM cat WHERE id NOT IN (SELECT id FROM w WHERE id IS NOT NULL) UNION ALL SELECT id, 'pruned', NULL, 0 FROM w WHERE id NOT IN (SELECT id FROM cat)"
)
def q_sync(spark, d):
    """Content cleaned and counted, books without content, and content that no book has any more."""
    docs = documents_html(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("bookId").alias("id")), "doc_id")
    words = clean.clean_documents(docs).groupBy("id").agg(F.sum(X.count_html_words(F.col("cleaned"))).cast("int").alias("words"))
    cat = books(spark, d, "id", "category")
    synced = cat.join(words, "id").select("id", F.lit("synced").alias("status"), "category", "words")
    none = F.lit(None)
    missing = dedup.missing_from(cat, words).select("id", F.lit("missing content").alias("status"), "category", F.lit(0).alias("words"))
    pruned = dedup.missing_from(words, cat).select("id", F.lit("pruned").alias("status"), none.cast("string").alias("category"), F.lit(0).alias("words"))
    return synced.unionByName(missing).unionByName(pruned)


@query(
    "WITH p AS (SELECT bookId || '/' || CAST(partNo AS VARCHAR) || CASE WHEN partNo % 2 = 0 THEN '/notes' ELSE '' END AS title FROM documents WHERE bookId IS NOT NULL UNION SELECT bookId FROM documents WHERE bookId IS NOT NULL) "
    "SELECT DISTINCT b.id AS work, p.title AS sub FROM p JOIN (SELECT DISTINCT id FROM books) b ON starts_with(p.title, b.id || '/') AND length(p.title) > length(b.id) + 1"
)
def q_subpages(spark, d):
    """Pages below each work by the beginning of their titles, at any depth."""
    docs = table(spark, d, "documents").where("bookId is not null")
    part = F.concat("bookId", F.lit("/"), F.col("partNo").cast("string"), F.when(F.col("partNo") % 2 == 0, "/notes").otherwise(""))
    pages = docs.select(part.alias("title")).unionByName(docs.select(F.col("bookId").alias("title"))).distinct()
    return wiki.subpages_of(table(spark, d, "books").select(F.col("id").alias("work")), pages)


@query(
    rf"SELECT doc_id, length(text) >= 400 AS least_400, length(text) >= 2500 AS least_2500, length(text) >= 4000 AS least_4000, length(text) >= 6000 AS least_6000, length(text) >= 400 AND len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')) >= 60 AS with_words, "
    "CASE WHEN length(substr(text, 1, 900)) >= 1000 THEN 'head' WHEN length(text) >= 1000 THEN 'whole' END AS candidate FROM documents"
)
def q_gates(spark, d):
    """The size gates of the jobs, and the first candidate text that is long enough."""
    t, head = F.col("text"), F.substring("text", 1, 900)
    first = X.first_long([head, t])
    gates = [X.size_gate(t, n).alias(f"least_{n}") for n in (400, 2500, 4000, 6000)]
    return widen(table(spark, d, "documents")).select("doc_id", *gates, X.size_gate(t, 400, X.count_text_words(t), 60).alias("with_words"), F.when(first.isNotNull(), F.when(first == head, "head").otherwise("whole")).alias("candidate"))


@query()
def q_convert(spark, d):
    """The converter over all books: how each ended, with its headings."""
    specs = table(spark, d, "books").select(F.struct("rec_no", "updatedAt", "wordCount").alias("ord"), "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"))
    raw = table(spark, d, "documents").groupBy(F.col("bookId").alias("id")).agg(F.min_by("text", "doc_id").alias("text"))
    out = pipelines.convert(specs, raw, "COMPLETE WORKS", 1500)
    return out.select("id", "status", "title", F.length("html").alias("length"), "n_headings")


@query(
    f"WITH RECURSIVE {CAT}, {greedy_sql('id', 'ord % 2 = 1', 'ord % 2 = 0', MERGE_KINDS)}, "
    "m AS (SELECT id, gutenbergId FROM cat WHERE ord % 2 = 0 UNION ALL SELECT id, gutenbergId FROM cat WHERE ord IN (SELECT ord FROM judged WHERE reason IS NULL)), d AS (SELECT DISTINCT bookId AS id FROM documents) "
    "SELECT (SELECT count(*) FROM cat WHERE ord % 2 = 0) AS existing, (SELECT count(*) FROM judged WHERE reason IS NULL) AS added, (SELECT count(*) FROM judged WHERE reason = 'sameId') AS \"sameId\", (SELECT count(*) FROM judged WHERE reason = 'sameWork') AS \"sameWork\", "
    "(SELECT count(*) FROM judged WHERE reason = 'sameSlug') AS \"sameSlug\", (SELECT count(*) FROM m) AS total, (SELECT count(*) - count(DISTINCT gutenbergId) - CAST(bool_or(gutenbergId IS NULL) AS BIGINT) FROM m) AS \"dupNumbers\", "
    "(SELECT count(*) - count(DISTINCT id) - CAST(bool_or(id IS NULL) AS BIGINT) FROM m) AS \"dupSlugs\", (SELECT count(*) FROM m WHERE id NOT IN (SELECT id FROM d WHERE id IS NOT NULL)) AS \"missingContent\", (SELECT count(*) FROM d WHERE id NOT IN (SELECT id FROM m)) AS orphans"
)
def q_merge_report(spark, d):
    """The merge job: the second half of the catalogue as fragments merged into the first, with its counts and checks."""
    cat = books(spark, d, "id", "title", "author", "category", "gutenbergId")
    first = cat.where(F.col("ord") % 2 == 0)
    judged = pipelines.merge(cat.where(F.col("ord") % 2 == 1), "ord", first)
    merged = first.select("id", "gutenbergId").unionByName(judged.where("kept").select("id", "gutenbergId"))
    content = table(spark, d, "documents").select(F.col("bookId").alias("id")).distinct()
    missing = dedup.missing_from(merged, content).agg(F.count(F.lit(1)).alias("missingContent"))
    orphans = dedup.missing_from(content, merged).agg(F.count(F.lit(1)).alias("orphans"))
    one = F.lit(True)
    return dedup.merge_report(first, judged).join(catalog.duplicate_metrics(merged), one).join(missing, one).join(orphans, one)


@query()
def q_import_run(spark, d):
    """The import job over all books: formatted texts of books without a row yet, in the catalogue's order, with status and tally."""
    cat = books(spark, d, "id", "title")
    raw = table(spark, d, "documents").groupBy(F.col("bookId").alias("id")).agg(F.min_by("text", "doc_id").alias("text"))
    done = cat.where(F.col("ord") % 4 == 0)
    run = pipelines.import_texts(cat.dropDuplicates(["id"]).select("id", "ord"), raw, done)
    return pipelines.tally(run)


@query()
def q_wanted(spark, d):
    """The wanted list resolved: the category of each work that a fitting hit was found for, one work a hit."""
    want = table(spark, d, "wanted_list").dropDuplicates(["rec_no"])
    hits = table(spark, d, "search_hits").dropDuplicates(["rec_no"]).select("id", "title", F.col("authors.name").alias("authors"), "languages", F.col("rec_no").alias("cand_ord"))
    f = resolve.wanted_features(want, "rec_no")
    cand = resolve.search_candidates(f, hits)
    used = table(spark, d, "books").where("gutenbergId is not null").select(F.col("gutenbergId").alias("id"))
    found = resolve.resolve(f, cand, used).join(want.select(F.col("rec_no").alias("want"), "title", X.map_category(F.col("shelf"), F.col("cat")).alias("category")), "want")
    return dedup.greedy_dedup(found, "want", {"sameId": F.col("id")}, sticky=("sameId",)).where("kept").select("want", "id", "title", "category")


@query()
def q_wiki_import(spark, d):
    """The wiki job: documents as pages, subpages in order, planned, assembled and named."""
    docs = documents_html(spark, d).join(table(spark, d, "documents").where("bookId is not null").select("doc_id", F.col("bookId").alias("work"), F.concat("bookId", F.lit("/"), F.col("partNo").cast("string")).alias("sub")), "doc_id")
    plan = wiki.plan_books(docs.select("work"), wiki.ordered_subpages(docs.select("work", "sub"), docs.select("work", "sub", F.col("doc_id").alias("link"))))
    pages = docs.groupBy(F.col("sub").alias("page")).agg(F.min_by("html", "doc_id").alias("html")).select("page", wiki.page_blocks(F.col("html")).alias("blocks"))
    return wiki.build_books(plan, pages).select("work", "book", "title", "words", F.length("html").alias("length"), X.hindi_slug_base(F.col("title")).alias("slug"))


@query()
def q_reader(spark, d):
    """The reader's documents: atoms, contents, pages, the page to resume at, and painted stretches."""
    a = reader.atoms(documents_html(spark, d), "doc_id", "html")
    n = a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("atoms"), F.count_if((F.col("type") == "h2") & F.col("id").isNotNull()).alias("contents"))
    pages = reader.paginate_documents(documents_html(spark, d), "doc_id", "html").groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    painted = reader.paint(a, highlight_rows(spark, d), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("painted"))
    mark = table(spark, d, "documents").select("doc_id", "bookId").join(table(spark, d, "reading_progress").select("bookId", "progressPercent"), "bookId", "left").select("doc_id", "progressPercent")
    out = n.join(pages, "doc_id", "left").join(painted, "doc_id", "left").join(mark, "doc_id", "left")
    return out.select("doc_id", "atoms", "contents", "pages", F.coalesce("painted", F.lit(0)).alias("painted"), state.resume_page(F.col("progressPercent"), F.col("pages"), F.lit(True)).alias("resume"))

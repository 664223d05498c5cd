"""Lines repeated across one source's documents: find them and take them out.

Each line gets an identifier that ignores case, spacing, tags, surrounding marks and filled-in
names, dates and numbers; a line that begins with capitalised words has a second reading in which
they are a name too.  The identifiers of a source's documents, one document after the other, are
the text of a suffix array; a suffix ends with its document, and after a line that can't be in a
block.

The array is built by prefix doubling.  A block spans a least number of documents, and so does
every part of it: identifiers in fewer documents leave first, and in each round the groups of
suffixes that share too few documents.  What is left of an array are its groups in order: a
group's rank is its place in the sorted prefixes of its source.  Of each suffix the common prefix
is then found: the longest one it shares with enough documents.  A block begins at each suffix
with a common prefix and has its length; the lines that blocks cover are the repeated ones.

Documents with the same repeated lines in the same order are one text (a layout) with a weight,
so a site's notice in a million documents is a few rows.  No step gathers a source in one task.
The surviving identifiers of a source are few by definition: with a share of a tenth at most ten
times the lines of its average document; that bounds the ranks that are sorted for each source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioframe.functions.arrow import by_size
from folioframe.session import Workspace, broadcast_if_small, is_small

# Names of months that are filled in beside a number.
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec|"
    "januar|februar|märz|mai|juni|juli|oktober|dezember|"
    "janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|"
    "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|"
    "janeiro|fevereiro|março|maio|junho|julho|setembro|outubro|novembro|dezembro"
)
NAME, NUMBER = "§", "#"
#: Fixed words that a line must have besides a name at its start.
LEAST_FIXED = 3

_TAG = re.compile(r"<[^>\n]*>")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"\d")
_HANDLE = re.compile(r"\S*_\S*")
_NUMBER = re.compile(r"(?<!\S)\S*\d\S*(?: \S*\d\S*)*")
_MONTH = re.compile(rf"(?:(?<!\S)(?:{MONTHS}) )?#(?: (?:(?:{MONTHS})(?!\S)|#))*", re.I)
_CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я§"
_NAMES = re.compile(rf"(?<= )[{_CAPITAL}]\S*(?: [{_CAPITAL}]\S*)*")
_FIRST = re.compile(rf"[{_CAPITAL}]\S*(?: §)?(?= )")


class _Spaces(dict):
    """For ``str.translate``: all but letters, marks, digits, underscores and line feeds."""

    def __missing__(self, c: int) -> int:
        self[c] = c if c in (10, 95) or unicodedata.category(chr(c))[0] in "LMN" else 32
        return self[c]


_SPACES = _Spaces()


def line_readings(text: str) -> Iterator[tuple[int, str, str | None, bool]]:
    """``(line_no, template, template with a name at its start or None, in capitals)`` of each line with letters.

    Names are runs of capitalised words after the first word, and words with an underscore; a
    line without small letters keeps its words, as its case says nothing.  Patterns that don't go
    beyond a line run over the whole text at once.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    plain = [" ".join(line.split()) for line in text.translate(_SPACES).split("\n")]
    whole = "\n".join(plain)
    if "_" in whole:
        whole = _HANDLE.sub(NAME, whole)
    if _DIGIT.search(whole):
        whole = "\n".join(_MONTH.sub(NUMBER, _NUMBER.sub(NUMBER, line)) if _DIGIT.search(line) else line for line in whole.split("\n"))
    named = _NAMES.sub(NAME, whole)
    counted, small, named = whole.split("\n"), named.lower().split("\n"), named.split("\n")
    for no, words in enumerate(plain):
        if not words or not (words[0].isalpha() or _LETTER.search(words)):
            continue
        if words.isupper():
            yield no + 1, counted[no].lower(), None, True
            continue
        begin = _FIRST.match(named[no])
        second = None
        if begin:
            rest = small[no][begin.end() :]
            if rest.count(" ") - rest.count(NAME) - rest.count(NUMBER) >= LEAST_FIXED:
                second = NAME + rest
        yield no + 1, small[no], second, False


def line_template(words: str) -> str:
    """The template of a single line."""
    return next((t for _, t, _, _ in line_readings(words)), "")


def identifier(template: str) -> int:
    return xxhash.xxh64_intdigest(template.encode()) - (1 << 63)


def head(template: str) -> str:
    """The first word of a template."""
    return template.split(" ", 1)[0]


def text_lines(text: str | None) -> list[tuple[int, int, int, bool, int | None, bool | None, str | None, bool, str]]:
    """``(seq, line_no, line_id, first of its id in the text, id of the second reading, first of that, template or None, in capitals, first word)``.

    ``seq`` numbers the lines with letters.  The template is given where it has or may have a
    name or is in capitals.
    """
    out: list[tuple[int, int, int, bool, int | None, bool | None, str | None, bool, str]] = []
    seen: set[int] = set()
    for seq, (no, tpl, second, capitals) in enumerate(line_readings(text or "")):
        h = identifier(tpl)
        h2 = first2 = None
        first = h not in seen
        seen.add(h)
        if second is not None:
            h2 = identifier(second)
            first2 = h2 not in seen
            seen.add(h2)
        out.append((seq, no, h, first, h2, first2, tpl if capitals or second is not None or NAME in tpl else None, capitals, head(tpl)))
    return out


def document_lines(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(key, source, seq, line_no, line_id, first, second_id, second_first, tpl, capitals, head)`` of each line with letters."""
    fields = (
        ("seq", T.IntegerType()), ("line_no", T.LongType()), ("line_id", T.LongType()), ("first", T.BooleanType()),
        ("second_id", T.LongType()), ("second_first", T.BooleanType()), ("tpl", T.StringType()), ("capitals", T.BooleanType()), ("head", T.StringType()),
    )
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("source", T.StringType()), *(T.StructField(n, t) for n, t in fields)])
    arrow = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            found = [text_lines(t) for t in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            cols = list(zip(*(x for f in found for x in f))) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *map(pa.array, cols, arrow)], [f.name for f in schema])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source")).mapInArrow(lines, schema)


def _readings(lines: DataFrame, *columns: str) -> DataFrame:
    """``(*columns, reading, line_id, first)``: a row for each reading of a line."""
    one = F.struct(F.lit(0).alias("reading"), F.col("line_id"), F.col("first"))
    two = F.struct(F.lit(1).alias("reading"), F.col("second_id").alias("line_id"), F.col("second_first").alias("first"))
    each = lines.select(*columns, F.explode(F.when(F.col("second_id").isNull(), F.array(one)).otherwise(F.array(one, two))).alias("x"))
    return each.select(*[c for c in each.columns if c != "x"], "x.*")


def _capital_lines(work: Workspace, lines: DataFrame, counts: DataFrame, need: DataFrame, key: str) -> DataFrame:
    """``(source, key, seq, line_no, line_id, own, head, reading)``: lines in capitals with the templates that they fill.

    A line in capitals doesn't show its names, so it is held against templates of its source.  A
    template can't be in more documents than its own and those where its words stand in capitals;
    if both are enough together, one of them is at least half.  So the templates are those of the
    frequent identifiers, and those all of whose words are frequent in capitals.  Lines look under
    the word of the template that is rarest in capitals.
    """
    caps = work.materialise(lines.where("capitals").select(key, "source", "seq", "line_no", "line_id", "tpl", "head"), "capital-lines")
    word = caps.select(key, "source", F.explode(F.array_distinct(F.split("tpl", " "))).alias("w"))
    words = work.materialise(word.distinct().groupBy("source", "w").agg(F.count(F.lit(1)).alias("c")).join(need, "source"), "capital-words")
    often = words.where(F.col("c") >= F.col("need") / 2).groupBy("source").agg(F.collect_set("w").alias("ws"))  # few: see the module text
    half = work.materialise(counts.where(F.col("n") >= F.col("need") / 2).select("source", "line_id", F.lit(True).alias("half")), "frequent-ids")
    # The last word is looked at first, as most lines go by it.
    last = F.substring_index("tpl", " ", -1)
    slots = _readings(lines.where("tpl is not null and not capitals"), "source", "tpl")
    slots = slots.join(broadcast_if_small(half, 200_000), ["source", "line_id"], "left").join(work.small(often, "capital-often")[0], "source", "left")
    slots = slots.where(F.col("half") | last.isin(NAME, NUMBER) | F.array_contains("ws", last))
    slots = slots.withColumn("tpl", F.when(F.col("reading") == 1, F.regexp_replace("tpl", rf"^\S+(?: {NAME})?(?= )", NAME)).otherwise(F.col("tpl"))).where(F.contains("tpl", F.lit(NAME)))
    fixed = F.filter(F.array_distinct(F.split("tpl", " ")), lambda x: ~x.isin(NAME, NUMBER))
    slots = slots.where(F.col("half") | (F.size(F.array_except(fixed, F.coalesce("ws", F.array().cast("array<string>")))) == 0))
    templates = slots.groupBy("source", "line_id", "reading").agg(F.count_if("first").alias("n"), F.max("tpl").alias("tpl"))
    of = templates.select("source", "line_id", "reading", "n", "tpl", F.size(fixed).alias("size"), F.explode(fixed).alias("w")).join(words, ["source", "w"])
    rarest = of.groupBy("source", "line_id", "reading", "n", "tpl", "size").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("c", "w")).alias("r"), F.max("need").alias("need"))
    rarest = rarest.where((F.col("k") == F.col("size")) & (F.col("n") + F.col("r.c") >= F.col("need")))
    pattern = F.concat(F.lit("^"), F.replace("tpl", F.lit(NAME), F.lit(r"\S+(?: \S+)*")), F.lit("$"))
    patterns = work.small(rarest.select("source", F.col("r.w").alias("w"), "reading", F.col("line_id").alias("to_id"), pattern.alias("pattern")), "capital-templates")[0]
    return (
        caps.select("*", F.explode(F.array_distinct(F.split("tpl", " "))).alias("w"))
        .join(patterns, ["source", "w"])
        .where(F.expr("tpl rlike pattern"))
        .select("source", key, "seq", "line_no", F.col("to_id").alias("line_id"), F.col("line_id").alias("own"), "head", "reading")
    )


def _surviving_lines(work: Workspace, lines: DataFrame, need: DataFrame, key: str) -> DataFrame:
    """``(key, source, seq, line_no, line_id, own, head, rank)``: lines whose identifier stands in enough documents.

    ``own`` is the identifier that the line's text gives, ``line_id`` that of a reading; the reading
    of the least ``rank`` counts: the one in most documents, so that all lines of a group choose it.
    """
    counts = _readings(lines, "source").groupBy("source", "line_id").agg(F.count_if("first").alias("n")).where(F.col("n") >= 2).join(need, "source")
    counts = work.materialise(counts.where(F.col("n") >= F.col("need") / 2), "line-counts")
    plain = counts.where(F.col("n") >= F.col("need")).select("source", "line_id", "n")
    moved = work.materialise(_capital_lines(work, lines, counts, need, key), "filled-capitals")
    # Documents of the templates that lines in capitals fill, each counted once.
    touched = work.small(moved.select("source", "line_id").distinct(), "filled-templates")[0]
    holders = _readings(lines.where("tpl is not null"), key, "source").where("first").join(touched, ["source", "line_id"]).select("source", "line_id", key)
    filled = holders.unionByName(moved.select("source", "line_id", key)).distinct().groupBy("source", "line_id").agg(F.count(F.lit(1)).alias("n"))
    both = plain.unionByName(filled.join(need, "source").where(F.col("n") >= F.col("need")).select("source", "line_id", "n"))
    alive = broadcast_if_small(work.materialise(both.groupBy("source", "line_id").agg(F.max("n").alias("n")), "surviving-ids"), 200_000)
    own = _readings(lines, key, "source", "seq", "line_no", "capitals", F.col("head").alias("h0")).withColumn("own", F.col("line_id")).withColumn("head", F.when(F.col("reading") == 1, NAME).otherwise(F.col("h0"))).withColumn("rank", F.when(F.col("capitals"), 3).otherwise(F.col("reading")))
    moved = moved.withColumn("rank", F.when(F.col("reading") == 0, 2).otherwise(4))
    cols = [key, "source", "seq", "line_no", "line_id", "own", "head", "rank"]
    found = own.select(*cols).unionByName(moved.select(*cols)).join(alive, ["source", "line_id"])
    return found.select(*cols[:-1], (F.col("rank") - F.col("n") * 8).alias("rank"))


def _live(pairs: DataFrame, *by: str) -> DataFrame:
    """Groups ``(source, *by)`` of layouts that hold enough documents, with their ``order`` within the source."""
    once = pairs.select("source", "lid", "docs", "need", *by).distinct()
    alive = once.groupBy("source", *by).agg(F.sum("docs").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need"))
    # Few for each source: see the module text.
    return alive.select("source", *by, F.row_number().over(W.partitionBy("source").orderBy(*by)).alias("order"))


def suffix_array(work: Workspace, places: DataFrame) -> DataFrame:
    """``(source, lid, at, line_id, rank, common)``: the suffixes that begin a block.

    ``places``: ``(source, lid, at, line_id, docs, need)``, the identifiers of each layout by their
    place, its documents and how many make a block.  ``rank`` is the order of the suffix by its
    longest live prefix of a power of two, ``common`` the number of identifiers that it shares
    with enough documents.
    """
    w = W.partitionBy("lid").orderBy("at")
    first = work.small(_live(places, "line_id"), "suffix-groups")[0]
    at = work.materialise(places.join(first, ["source", "line_id"]).withColumnRenamed("order", "r0"), "suffix-ranks")
    k = 0
    while True:
        step = 2**k
        near = at.withColumn("next", F.max(f"r{k}").over(w.rangeBetween(step, step)))
        groups, n = work.small(_live(near.where(f"r{k} is not null and next is not null"), f"r{k}", "next"), "suffix-groups")
        if n == 0:
            break
        at = work.materialise(near.join(groups, ["source", f"r{k}", "next"], "left").withColumnRenamed("order", f"r{k + 1}").drop("next"), "suffix-ranks")
        k += 1
    tops = [(i, F.col(f"r{i}")) for i in range(k, -1, -1)]
    at = at.withColumn("common", F.coalesce(*[F.when(r.isNotNull(), 2**i) for i, r in tops]))
    at = at.withColumn("rank", F.coalesce(*[r for _, r in tops])).withColumn("group", F.xxhash64("common", "rank"))
    # The rest of the common prefix, from its largest power of two down.
    for j in range(k - 1, -1, -1):
        after = at.select("lid", F.col("at").alias("to"), F.col(f"r{j}").alias("next")).where("next is not null")
        near = at.withColumn("to", F.when(F.col("common") >= 2 ** (j + 1), F.col("at") + F.col("common"))).join(after, ["lid", "to"], "left")
        groups, n = work.small(_live(near.where("next is not null"), "group", "next"), "suffix-groups")
        if n == 0:
            continue
        grown = near.join(groups, ["source", "group", "next"], "left")
        longer = F.col("order").isNotNull()
        at = work.materialise(
            grown.withColumn("common", F.when(longer, F.col("common") + 2**j).otherwise(F.col("common")))
            .withColumn("group", F.when(longer, F.xxhash64("group", "next")).otherwise(F.col("group"))).drop("to", "next", "order"),
            "suffix-ranks",
        )
    return at.select("source", "lid", "at", "line_id", "rank", "common")


def repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", min_docs: int = 3, min_share: float = 0.1, min_lines: int = 1
) -> DataFrame:
    """``(key, source, line_no, line_id, own, head, block)``: the lines that repeated blocks cover.

    A block is a row of lines that stands in at least ``min_docs`` documents and in at least
    ``min_share`` of the source's documents; it has ``min_lines`` lines or more.  ``block`` is the
    length of the block that covers the line and reaches farthest.  Lines without letters never
    count and don't part a block.  Each row of ``docs`` is a document with its own key, also with
    null or empty text; a null source is the source ''.  A block that stands twice in a document
    counts once and is returned twice.  Other columns are ignored.
    """
    per_source = docs.groupBy(F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    with Workspace(docs.sparkSession) as work:
        need = work.small(per_source.select("source", F.greatest(F.lit(float(min_docs)), F.col("n") * min_share).alias("need")), "block-needs")[0]
        lines = work.materialise(document_lines(docs, key, text, source), "lines")
        alive = _surviving_lines(work, lines, need, key)
        # A document's surviving lines, one reading each, with a 0 where others stand between them.
        best = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["seq"] != x["seq"]))
        sites = alive.groupBy(key, "source").agg(best(F.array_sort(F.collect_list(F.struct("seq", "rank", "line_no", "line_id", "own", "head")))).alias("xs"))
        gap = F.struct(F.lit(0).alias("seq"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("line_id"), F.lit(0).cast("bigint").alias("own"), F.lit("").alias("head"))
        parted = F.flatten(F.transform("xs", lambda x, i: F.when((i > 0) & (F.get("xs", i - 1)["seq"] + 1 < x["seq"]), F.array(gap, x)).otherwise(F.array(x))))
        sites = sites.select(key, "source", parted.alias("xs")).select(key, "source", F.col("xs.line_no").alias("nos"), F.col("xs.own").alias("own"), F.col("xs.head").alias("head"), F.col("xs.line_id").alias("layout"))
        sites = work.materialise(sites.withColumn("lid", F.xxhash64("source", "layout")), "sites")
        layouts = sites.groupBy("lid", "source").agg(F.count(F.lit(1)).alias("docs"), F.any_value("layout").alias("layout")).join(need, "source")
        places = layouts.select("lid", "source", "docs", "need", F.posexplode("layout").alias("at", "line_id")).where("line_id <> 0")
        found = suffix_array(work, work.materialise(places, "places"))
        # Blocks cover from where they begin; the one that reaches farthest decides.
        reach = F.max(F.when(F.col("common") >= min_lines, F.struct((F.col("at") + F.col("common")).alias("end"), F.col("common").alias("block"))))
        reach = reach.over(W.partitionBy("lid").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
        covered = found.withColumn("b", reach).where(F.col("b.end") > F.col("at")).groupBy("lid").agg(F.collect_list(F.struct("at", "line_id", "b.block")).alias("c"))
        covered = work.small(covered, "covered")[0]
        rows = sites.join(covered, "lid").select(key, "source", "nos", "own", "head", F.explode("c").alias("c"))
        return work.result(rows.select(key, "source", F.get("nos", F.col("c.at")).alias("line_no"), F.col("c.line_id").alias("line_id"), F.get("own", F.col("c.at")).alias("own"), F.get("head", F.col("c.at")).alias("head"), F.col("c.block").alias("block")), "repeated-lines")


def without_repeated_lines(docs: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: int = 200_000) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text`` and their number in ``n_cut``.

    ``lines`` is a result of ``repeated_lines`` with ``min_lines=1`` over the same documents.  The
    identifiers of the lines to cut are few for each source, so they go to the documents, which
    stay where they are; over ``most`` identifiers the line numbers are joined by the key instead.
    Documents without any keep their text unchanged; null text stays null.
    """
    ids = lines.select("source", "own", "head").distinct()
    if not is_small(ids, most, 64 << 20):
        return cut_line_numbers(docs, lines, key, text)
    by_source: dict[str, tuple[set[int], set[str]]] = {}
    for r in ids.collect():  # at most ``most`` rows
        known, heads = by_source.setdefault(r.source, (set(), set()))
        known.add(r.own)
        heads.add(r.head)
    shared = docs.sparkSession.sparkContext.broadcast(by_source)
    names = [c for c in docs.columns if c != "n_cut"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_cut", T.IntegerType())])
    t, s = names.index(text), names.index(source)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, t):
            texts, n_cut = [], []
            for value, of in zip(batch.column(t).to_pylist(), batch.column(s).to_pylist()):
                gone = lines_to_cut(value, *shared.value.get(of or "", (set(), set()))) if value else set()
                texts.append("\n".join(x for i, x in enumerate(value.split("\n"), 1) if i not in gone) if gone else value)
                n_cut.append(len(gone))
            cols = [pa.array(texts, pa.string()) if i == t else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_cut, pa.int32())], [f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(cut, schema)


def lines_to_cut(text: str, known: set[int], heads: set[str]) -> set[int]:
    """Numbers of the lines with a known identifier; only those with a known first word are read in full."""
    if not known:
        return set()
    plain = _TAG.sub(" ", text) if "<" in text else text
    numbers, candidates = [], []
    any_name, any_number = NAME in heads, NUMBER in heads
    for no, line in enumerate(plain.translate(_SPACES).split("\n"), 1):
        words = line.split(None, 1)
        if words:
            first = words[0]
            # A name, a number, or a month before a number: what a slot may hide at the start.
            if first.lower() in heads or any_name and ("_" in first or first[0].isupper()) or any_number and (_DIGIT.search(line) is not None):
                numbers.append(no)
                candidates.append(line)
    if not candidates:
        return set()
    found = line_readings("\n".join(candidates))
    return {numbers[at - 1] for at, tpl, second, _ in found if identifier(tpl) in known or second is not None and identifier(second) in known}


def cut_line_numbers(docs: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines ``(key, line_no)`` cut from ``text`` and their number in ``n_cut``, by a join on the key."""
    cut = lines.groupBy(key).agg(F.collect_set("line_no").alias("__cut"))
    kept = F.array_join(
        F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda line, i: ~F.array_contains("__cut", (i + 1).cast("bigint"))), "\n"
    )
    names = [c for c in docs.columns if c not in ("n_cut", "__cut")]
    return docs.select(*[F.col(f"`{c}`") for c in names]).join(cut, key, "left").select(
        *[F.when(F.col("__cut").isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size("__cut"), F.lit(0)).alias("n_cut"),
    )

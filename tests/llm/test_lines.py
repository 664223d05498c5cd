from pyspark.sql import functions as F

from folioframe.llm import lines


def test_templates_ignore_what_is_filled_in():
    t = lambda s: lines.text_lines(s)[0][2]
    assert t("Last corrected: 20 February 2013") == t("* LAST CORRECTED: 2010-01-02.") == t("<p>Last corrected: July 2, 2009</p>\r")
    assert t("By Henry C., guest of the reading room") == t("By  ban_93, guest of the reading room") == t("By\xa0Zoë Wuthorpe, guest of the reading room")
    assert t("It may be read") != t("It may be sold") and t("Page 3 of 35") == t("page 1,203 of 4")
    assert lines.text_lines("12 34\n***\n\n") == [] and lines.text_lines(None) == [] and lines.text_lines("") == []


def corpus(spark):
    rows = []
    for i in range(40):
        note = ["Shared by Henry C. for the site", "SHARED BY OLIVER DUNN FOR THE SITE", f"Shared by ab_{i} for the site"][i % 3] if i % 2 else "nothing here"
        two = f"Runs on gifts.\nGive {i} at the desk." if i < 8 else "other words stand"
        rows.append((i, f"own line {'x' * i}\n{note}\n{two}", "a" if i < 30 else None, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, line_no string")


def test_repeated_lines(spark):
    docs = corpus(spark)
    got = {(r.doc_id, r.line_no) for r in lines.repeated_lines(docs).collect()}
    want = {(i, 2) for i in range(40) if i % 2} | {(i, 2) for i in range(40) if not i % 2} | {(i, n) for i in range(8) for n in (3, 4)} | {(i, 3) for i in range(8, 40)}
    assert got == want


def test_threshold_per_source_and_edges(spark):
    rows = [(i, "ad line" if i < 3 else "unique " + "y" * i, "s") for i in range(40)] + [(100 + i, "ad line", "t") for i in range(3)] + [(200, None, "t"), (201, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in lines.repeated_lines(docs).collect()}
    assert got == {100, 101, 102}  # 3 of 40 are under a tenth
    assert lines.repeated_lines(docs.where("false")).count() == 0


def test_cut_and_blocks(spark):
    docs = corpus(spark)
    found = lines.repeated_lines(docs)
    cut = {r.doc_id: r for r in lines.without_repeated_lines(docs, found).collect()}
    assert cut[0].text == "own line " and cut[0].n_cut == 3 and cut[3].line_no == "clash"
    rows = {(r.doc_id, r.line_no): r.block for r in found.collect()}
    assert {rows[i, n] for i in range(0, 8) for n in (3, 4)} == {3} and rows[20, 2] == 2
    joined = {r.doc_id: (r.text, r.n_cut) for r in lines.cut_line_numbers(docs, found).collect()}
    assert joined == {k: (r.text, r.n_cut) for k, r in cut.items()}
    many = {r.doc_id: (r.text, r.n_cut) for r in lines.without_repeated_lines(docs, found, most=1).collect()}
    assert many == joined
    plain = spark.createDataFrame([(1, None, "s"), (2, "a\r\nb", "s")], "doc_id long, text string, source string")
    same = {r.doc_id: r.text for r in lines.without_repeated_lines(plain, found.where("false")).collect()}
    assert same == {1: None, 2: "a\r\nb"}


def test_blocks_against_all_substrings(spark):
    import random

    rnd = random.Random(6)
    docs = []
    for i in range(12):
        parts = [[("alpha", "beta", "gamma", "delta")[: rnd.randrange(1, 5)], ("own", f"own{i}{k}")][rnd.random() < 0.4] for k in range(5)]
        docs.append((i, "\n".join(f"line {w} {'x' * (i if 'own' in w else 0)}" for p in parts for w in p), "s"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for least in (1, 2, 3):
        found = lines.repeated_lines(df, min_share=0.3, min_lines=least)
        need = max(3.0, 12 * 0.3)
        ids = {d: [lines.text_lines(x)[0][2] for x in text.split("\n")] for d, text, _ in docs}
        spans = {}
        for d, line in ids.items():
            for at in range(len(line)):
                for end in range(at + 1, len(line) + 1):
                    spans.setdefault(tuple(line[at:end]), set()).add(d)
        best = {}
        for d, line in ids.items():
            for at in range(len(line)):
                common = max((n for n in range(1, len(line) - at + 1) if len(spans[tuple(line[at : at + n])]) >= need), default=0)
                for k in range(common if common >= least else 0):
                    best[d, at + k + 1] = max(best.get((d, at + k + 1), (0, 0)), (at + common, common))
        got = {(r.doc_id, r.line_no): r.block for r in found.collect()}
        assert got == {k: v[1] for k, v in best.items()} and max(got.values()) >= 2


def rows_of(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    return {(r.doc_id, r.line_no): r.block for r in lines.repeated_lines(df, **options).collect()}


def test_long_blocks_and_what_finds_them(spark, monkeypatch):
    notice = [f"notice line {'i' * (k + 1)}" for k in range(23)]
    texts = [f"own {'z' * i}\n" + "\n".join(notice) + f"\nend {'q' * i}" for i in range(6)]
    got = rows_of(spark, texts, min_lines=20)
    assert got == {(d, n): 23 for d in range(6) for n in range(2, 25)}
    alone = [f"own {'z' * i}\nnotice line i\nend {'q' * i}" for i in range(6)]
    assert len(rows_of(spark, alone)) == 6 and rows_of(spark, alone, min_lines=2) == {}
    # Without the array no line is found, and with one that sees single lines only no block is.
    array = lines.suffix_array
    monkeypatch.setattr(lines, "suffix_array", lambda work, places: array(work, places).withColumn("common", F.lit(0)))
    assert rows_of(spark, texts) == {}
    monkeypatch.setattr(lines, "suffix_array", lambda work, places: array(work, places).withColumn("common", F.lit(1)))
    assert rows_of(spark, texts, min_lines=2) == {}


def test_capitals_and_names_at_the_start(spark):
    town = ["Mill", "Lane", "Hill", "Ford", "Dale"]
    text = lambda i: f"Given by the readers of {town[i % 5]}{'abcdefghij'[i // 10]} to all"
    texts = [text(i) if i < 4 else text(i).upper() if i < 20 else f"own {'x' * i}" for i in range(100)]
    assert set(rows_of(spark, texts)) == {(i, 1) for i in range(20)}
    few = [t if i < 2 or 4 <= i < 11 else f"own {'y' * i}" for i, t in enumerate(texts)]
    assert rows_of(spark, few) == {}  # nine of ten
    names = [f"{town[i % 5]} {'QRSTUV'[i % 6]}{'abcde'[i % 5]} shared this page with friends" if i < 30 else f"own {'x' * i}" for i in range(100)]
    assert set(rows_of(spark, names)) == {(i, 1) for i in range(30)}
    long = lambda i: f"Given by {town[i % 5]}{'abcdefghij'[i // 10]} " + "and many other words " * 9 + "to all"
    assert len(rows_of(spark, [long(i) if i < 6 else long(i).upper() if i < 12 else f"own {'x' * i}" for i in range(100)])) == 12

import json
import os

from pyspark.sql import functions as F

from folioframe.operators.packed import explode_packed, unpack_values
from folioframe.sources import io
from folioframe.streaming import progress


def values(spark, text):
    return spark.createDataFrame([(text,)], "v string").select(unpack_values(F.col("v")).alias("o")).first().o


def test_packed_values(spark):
    cases = {
        'Ethics, "Ships, wooden"': ["Ethics", "Ships, wooden"], "a;b, c": ["a", "b, c"], "a|b||c | ": ["a", "b", "c"], "x / y/z": ["x", "y/z"], "a\tb\nc": ["a", "b", "c"],
        "a • b, c": ["a", "b, c"], "a、b": ["a", "b"], '["The \\"grey\\" verse", "b"]': ['The "grey" verse', "b"], '"Plays called ""mill""", x': ['Plays called "mill"', "x"],
        "'a', 'b, c'": ["a", "b, c"], "Women's clubs, Don't": ["Women's clubs", "Don't"], "Ships\\, wooden, b": ["Ships, wooden", "b"], "Arts &amp; crafts, b": ["Arts &amp; crafts", "b"],
        "Arts &amp; crafts; b, c": ["Arts &amp; crafts", "b, c"], ", a,,": ["a"], "  ": [], "": [], None: [], ",;,": [], '"open, never': ["open, never"], 'The "grey" verse, b': ['The "grey" verse', "b"],
        "a, a": ["a", "a"], '"a"; b, c; "d"': ["a", "b, c", "d"], '""': [], "one": ["one"], "a -- b, c": ["a -- b", "c"],
    }
    for text, want in cases.items():
        assert values(spark, text) == want, text
    assert len(values(spark, "word, " * 5000)) == 5000


def test_round_trip(spark):
    import random

    rnd = random.Random(4)
    pool = ["Fables", "Ships, wooden", 'The "grey" verse', "Women's clubs", "a/b", "x -- y", "Arts &amp; crafts", "लोक कथा"]
    rows = []
    for i in range(60):
        v = [rnd.choice(pool) for _ in range(rnd.randrange(1, 6))]
        packed = ", ".join('"' + x.replace('"', '""') + '"' for x in v) if i % 2 else json.dumps(v, ensure_ascii=False)
        rows.append((i, packed, v))
    df = spark.createDataFrame(rows, "i int, s string, v array<string>")
    assert df.where(unpack_values(F.col("s")) != F.col("v")).count() == 0


def test_explode_positions_and_clashes(spark):
    df = spark.createDataFrame([(1, "a, b", 9), (2, None, 9)], "rec_no int, s string, pos int")
    assert [tuple(r) for r in explode_packed(df, "s", "subject").orderBy("pos").collect()] == [(1, 1, "a"), (1, 2, "b")]
    assert explode_packed(df.where("false"), "s").count() == 0


def test_catalogue_files(spark, tmp_path):
    for name, rows in (("b.json", [{"id": "2", "title": "T"}]), ("a.json", [{"id": "0"}, {"id": "1", "wordCount": 5}]), ("skip.txt", [{"id": "9"}])):
        (tmp_path / name).write_text(json.dumps(rows))
    assert [r.id for r in io.read_fragments(spark, str(tmp_path)).orderBy("ord").collect()] == ["0", "1", "2"]
    assert [r.id for r in io.read_catalog(spark, str(tmp_path / "a.json")).orderBy("ord").collect()] == ["0", "1"]


def test_documents_and_listing(spark, tmp_path):
    df = spark.createDataFrame([("x", "<p>one</p>\n<p>two</p>"), ("y", "b")], "id string, html string")
    assert all(r.ok for r in io.write_documents(df, str(tmp_path), workers=2).collect())
    assert {r.id: r.html for r in io.read_documents(spark, str(tmp_path)).collect()}["x"] == "<p>one</p>\n<p>two</p>"
    assert {r.id for r in io.list_documents(spark, str(tmp_path)).collect()} == {"x", "y"}
    listing = spark.createDataFrame([("books/a/content.html",), ("books/a/cover.jpg",), ("other/b/content.html",)], "path string")
    assert [r.id for r in io.keys_of_listing(listing).collect()] == ["a"]


def test_search_pages(spark, tmp_path):
    page = {"results": [{"id": 1, "title": "A", "authors": [{"name": "X"}], "languages": ["en"]}, {"id": 2, "title": "B"}], "next": "p2"}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    assert [(r.pos, r.id) for r in io.read_search_pages(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, 1), (1, 2)]
    df = spark.createDataFrame([("q", json.dumps(page)), ("r", "broken")], "q string, body string")
    assert sorted((r.q, r.id) for r in io.parse_search_pages(df).collect()) == [("q", 1), ("q", 2)]


def test_page_source_follows_links(spark):
    pages = {"1": ([(1, "a"), (2, "b")], "2"), "2": ([(3, "c")], None)}
    spark.dataSource.register(io.page_source(lambda t: pages[t], "id int, title string", "test_pages"))
    got = spark.read.format("test_pages").option("start", "1").load()
    assert sorted((r.id, r.title) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_upsert_and_overwrite(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 10, 10), ("b", 2, 10, 10)], "id string, n int, createdAt int, updatedAt int")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "id string, n int")
    got = {r.id: (r.n, r.createdAt, r.updatedAt) for r in io.upsert(old, new, at=F.lit(20)).collect()}
    assert got == {"a": (1, 10, 10), "b": (5, 10, 20), "c": (6, 20, 20)}
    path = os.path.join(str(tmp_path), "t")
    old.write.parquet(path)
    io.overwrite(spark.read.parquet(path).where("id = 'a'"), path)
    assert spark.read.parquet(path).count() == 1
    changed = io.changed_only(spark.createDataFrame([("a", "a"), ("a", "b"), (None, "x")], "o string, n string"), "o", "n")
    assert changed.count() == 2
    assert json.loads(io.json_rows(old.limit(1), "id", "n").first().json) == {"id": "a", "n": 1}


def test_upload_reports_failures(spark):
    def send(key, html):
        if key == "bad":
            raise ValueError("no")

    df = spark.createDataFrame([("ok", ""), ("bad", "")], "id string, html string")
    assert {r.id: (r.ok, r.error) for r in io.upload_all(df, send, workers=2).collect()} == {"ok": (True, None), "bad": (False, "no")}


def test_progress_stream(spark, tmp_path):
    schema = "userId long, bookId string, percent double, updatedAt long, receivedAt timestamp_ntz"
    ms = 1_735_700_000_000
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    for rows in ([(1, "a", 5.0, ms, None), (1, "a", 9.0, ms + 1000, None), (2, "b", 50.0, ms, None)], [(1, "a", 7.0, ms + 500, None), (2, "b", 60.0, ms + 2000, None), (2, "b", 60.0, ms + 2000, None), (1, None, 1.0, ms, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = progress.read_progress(spark, src, files_per_trigger=1)
    q = stream.writeStream.foreachBatch(progress.latest_state_writer(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(d[1:]) for d in os.listdir(out))
    assert sorted((r.userId, r.bookId, r.percent) for r in spark.read.parquet(f"{out}/v{last}").collect()) == [(1, "a", 9.0), (2, "b", 60.0)]
    act = progress.reading_activity(progress.distinct_events(progress.with_event_time(stream)))
    q = act.writeStream.outputMode("update").format("memory").queryName("act").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(n) n from act where bookId = 'b'").first().n == 2


def test_private_use_characters_stay(spark):
    import random

    marks = [chr(0xE000 + i) for i in range(9)]
    assert values(spark, f'a{marks[0]}b, "c{marks[1]}, d{marks[7]}0"') == [f"a{marks[0]}b", f"c{marks[1]}, d{marks[7]}0"]
    rnd = random.Random(2)
    for _ in range(5):
        v = ["x" + "".join(rnd.choice([*marks, "0", "7", "a"]) for _ in range(6)) for _ in range(3)]
        assert values(spark, ", ".join(f'"{x}"' for x in v)) == v


def test_sinks_act_once(spark, tmp_path):
    seen = tmp_path / "sent"
    seen.mkdir()

    def send(key, html):
        (seen / f"{key}-{os.urandom(4).hex()}").write_text(html)

    out = io.upload_all(spark.createDataFrame([("a", "1"), ("b", None)], "id string, html string"), send, workers=2)
    assert out.count() == 2 and out.where("ok").count() == 2 and len(list(seen.iterdir())) == 2
    raw = io.write_raw(spark.createDataFrame([("k", "text"), ("k", "text")], "id string, text string"), f"file://{tmp_path}/raw")
    assert raw.where("ok").count() == 2 and (tmp_path / "raw" / "k" / "raw.txt").read_text() == "text"


def test_state_versions(spark, tmp_path):
    import pytest

    out = str(tmp_path / "state")
    write = progress.latest_state_writer(out)
    rows = lambda p, t: spark.createDataFrame([(1, "a", p, t, None)], "userId long, bookId string, percent double, updatedAt long, receivedAt timestamp_ntz")
    for n in range(4):
        write(rows(float(n), n), n)
    write(rows(3.0, 3), 3)
    assert sorted(d for d in os.listdir(out)) == ["v2", "v3"] and [r.percent for r in progress.read_state(spark, out, 3).collect()] == [3.0]
    with pytest.raises(RuntimeError):
        write(rows(9.0, 9), 9)
    assert not os.path.exists(f"{out}/v9")


def test_workspace_and_shared_folder(spark, monkeypatch):
    from folioframe import session

    with session.Workspace(spark) as work:
        step = work.materialise(spark.range(5), "step")
        path = step.inputFiles()[0].split("/part-")[0].replace("file://", "")
        assert os.path.isdir(path)
        out = work.result(step.where("id > 2"))
    assert not os.path.exists(path) and out.count() == 2
    assert session.is_small(spark.range(10), 10) and not session.is_small(spark.range(11), 10) and not session.is_small(spark.range(10), 10, 20)


def test_view_is_refreshed(spark, tmp_path):
    schema = "userId long, bookId string, percent double, updatedAt long, receivedAt timestamp_ntz"
    log, out = str(tmp_path / "log"), str(tmp_path / "view")
    progress.append_events(spark.createDataFrame([(1, "a", 5.0, 10, None)], schema), log)
    q = progress.refresh_view(progress.read_progress(spark, log), progress.latest_state_writer(out), str(tmp_path / "ck3"), "1 second")
    q.processAllAvailable()
    progress.append_events(spark.createDataFrame([(1, "a", 8.0, 20, None), (2, "b", 1.0, 5, None)], schema), log)
    q.processAllAvailable()
    q.stop()
    last = max(int(d[1:]) for d in os.listdir(out))
    assert sorted((r.userId, r.percent) for r in progress.read_state(spark, out, last).collect()) == [(1, 8.0), (2, 1.0)]

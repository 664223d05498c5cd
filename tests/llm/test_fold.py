import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import fold


def fold_one(*texts):
    return fold.fold_array(pa.array(list(texts), pa.string())).to_pylist()


def test_compatibility_composition_matches_unicode():
    rnd = random.Random(5)
    pool = [chr(c) for c in range(0x20, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co", "Cf", "Zl", "Zp", "Cc")]
    marks = [c for c in pool if unicodedata.combining(c)]
    texts = ["".join(rnd.choice(pool if rnd.random() < 0.5 else marks) for _ in range(rnd.randrange(9))) for _ in range(5000)]
    t = fold.tables()
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    cp, row = fold._expand(cp, row, t)
    cp, row = fold._compose(fold._order_marks(cp, row, t), row, t)
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))]
    whole = cp.astype("<u4").tobytes().decode("utf-32-le")
    assert [whole[a:b] for a, b in zip(ends, ends[1:])] == [unicodedata.normalize("NFKC", x) for x in texts]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｉｓａ\xa0x", "Isa x"), (None, None), ("", ""), ("Ζoë Funtοrbar", "Zoë Funtorbar"), ("Зимний фонарь / A Tower", "Зимний фонарь / A Tower"),
        ("क्‍ष", "क्‍ष"), ("क‍स﻿", "कस"), ("B. С.", "B. C."), ("é​̂", "é̂"), ("Jɑmеs", "James"), ("ﬁn Ⅲ", "fin III"), ("क़", "क़"), ("фoнарь", "фонарь"),
    ],
)
def test_cases(text, want):
    assert fold_one(text) == [want]
    assert fold_one("before", text, None, "after") == ["before", want, None, "after"]


def test_idempotent_and_long():
    x = fold_one("Ａé" * 50_000)[0]
    assert x == "Aé" * 50_000 and fold_one(x) == [x]


def test_sliced_arrays():
    arr = pa.array(["a", "Ｂ", None, "Ｃ"])[1:]
    assert fold.fold_array(arr).to_pylist() == ["B", None, "C"]
    assert fold.fold_array(pa.array([], pa.string())).to_pylist() == []


def test_disguised_fields(spark):
    df = spark.createDataFrame([(1, "Ａ", "b", 0), (1, "Ａ", "b", 0), (2, None, "", 0), (3, "x", "y­z", 0)], "rec_no int, title string, author string, field int")
    got = fold.disguised_fields(df, "rec_no", ["title", "author"]).collect()
    assert sorted((r.rec_no, r.field) for r in got) == [(1, "title"), (3, "author")]
    assert fold.disguised_fields(df.where("false"), "rec_no", ["title"]).count() == 0
    assert df.where("rec_no = 1").select(fold.fold_text(F.col("title")).alias("t")).first().t == "A"

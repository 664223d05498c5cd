import random

from pyspark.sql import functions as F

from folioframe.llm import langid

WORDS = {
    "en": "the a of house river night king letter found never there was old and but some".split(),
    "fr": "le la de maison fleuve nuit roi lettre trouvait jamais il y avait vieux et mais quelque".split(),
    "de": "der die von haus fluss nacht könig brief fand nie es war alte und aber manche".split(),
    "hi": "घर नदी रात राजा चिट्ठी को कभी पाया यह वह का की था और लेकिन कोई".split(),
}
LANGS = ("en", "fr", "de", "hi")


def text(lang, n, rnd):
    out = []
    for i in range(n):
        out.append(rnd.choice(WORDS[lang]) + (". " if i % 10 == 9 else " "))
    return "".join(out)


def corpus(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(240):
        lang = LANGS[i % 4]
        rows.append((i, text(lang, 100, rnd), lang if i % 12 else LANGS[(i + 1) % 4]))  # one label in twelve is wrong
    rows.append((1000, text("en", 120, rnd) + "\n\n" + text("de", 60, rnd), "en"))
    rows.append((1001, text("en", 120, rnd) + "\n\n" + text("de", 20, rnd), "EN-gb"))
    rows += [(1002, text("fr", 80, rnd), "unknown"), (1003, "roi lettre", None), (1004, None, "en"), (1005, "", None), (1006, "12 -- 3", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_labels(spark):
    labels = ["en", " EN", "en-GB", "pt_BR", "Hindi", "fra", "ger", "n/a", "??", "", None, "und", "unknown", "xx"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string")
    got = [r.o for r in df.select("i", langid.label_language(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == ["en", "en", "en", "pt", "hi", "fr", "de", None, None, None, None, None, None, None]


def test_documents_and_segments(spark):
    docs = corpus(spark)
    model = langid.fit_language_model(docs, "doc_id", "text", "lang", LANGS, per_language=50)
    found = langid.detect_languages(docs, model, keep=("lang",))
    r = {x.doc_id: x for x in found.collect()}
    right = sum(r[i].languages[0].lang == LANGS[i % 4] for i in range(240))
    assert right == 240
    assert [(s.lang) for s in r[1000].segments] == ["en", "de"] and {s.lang for s in r[1000].languages} == {"en", "de"}
    assert sum(s.n_words for s in r[1000].segments) == 180 and all(0 < s.confidence <= 1 for s in r[1000].segments)
    assert [s.lang for s in r[1001].languages] == ["en"] and [s.lang for s in r[1003].languages] == ["fr"]
    assert all(r[i].languages == [] and r[i].segments == [] for i in (1004, 1005, 1006))
    cases = {(x.doc_id, x.lang) for x in langid.relabelled(found, "lang").collect()}
    assert cases >= {(1000, "en"), (1000, "de"), (1002, "fr"), (1003, "fr")} and not any(d == 1001 for d, _ in cases)
    assert {d for d, _ in cases if d < 240} == {i for i in range(240) if i % 12 == 0}
    assert langid.detect_languages(docs.where("false"), model).count() == 0


def test_unseen_words_back_off():
    import numpy as np

    m = langid.LanguageModel(("a", "b")).fit({"sching": np.array([0.0, 9.0]), "tion": np.array([9.0, 0.0]), "station": np.array([5.0, 0.0])})
    assert m.score("nation").argmax() == 0 and m.score("tisching").argmax() == 1
    assert m.score("क").tolist() == [0.0, 0.0]

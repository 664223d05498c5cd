"""Missing or wrong document language labels: a language for each document and segment.

Word-first backoff.  A word the model knows scores its log frequency in each language; an
unknown word backs off to its character n-grams, the longest length of which any is known
(five down to one).  Scores are summed over sentences (long ones are cut), each sentence
takes the best language, neighbours of one language form a segment, and a document is
written in every language that has enough words.  Each distinct word of a batch is scored
once; the rest is array arithmetic.

The model is trained from the labels themselves, on a bounded sample: ``per_language``
labelled rows of each language (chosen by hash) of at most ``max_chars`` characters.  Some
of these labels are wrong, so sentences are relabelled by the model and it is fitted
again.  All rows are then scored, whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioframe.functions.arrow import by_size

LANGUAGES = ("en", "hi", "fr", "de", "es", "pt")

# What a language is called (two letters, three letters, English name).
LABELS = {
    "en": ("en", "eng", "english"),
    "hi": ("hi", "hin", "hindi"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
    "es": ("es", "spa", "spanish", "castilian"),
    "pt": ("pt", "por", "portuguese"),
}

END, BREAK = "\x01", "\x02"
_TAG = re.compile(r"<[^>\n]*>")


class _Marks(dict):
    """For ``str.translate``: words stay, sentence ends and line feeds become tokens."""

    def __missing__(self, c: int) -> int | str:
        ch = chr(c)
        if ch in ".!?।॥…":
            self[c] = f" {END} "
        elif ch == "\n":
            self[c] = f" {BREAK} "
        else:
            self[c] = c if unicodedata.category(ch)[0] in "LM" else 32
        return self[c]


_MARKS = _Marks()


def label_language(label: Column) -> Column:
    """The code a label names in any usual way, else null (unknown words, null, empty)."""
    head = F.regexp_extract(F.lower(F.coalesce(label, F.lit(""))), r"^\s*([a-z]+)(?:[-_ ].*)?\s*$", 1)
    pairs = [F.lit(x) for code, names in LABELS.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), head)


def words_of(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text.lower().translate(_MARKS).split()


def _grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked by spaces."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class LanguageModel:
    """Word and n-gram scores of each language; pickled to the executors."""

    def __init__(self, languages: Iterable[str], top_n: int = 5, least_word: int = 2, least_gram: int = 3, floor: float = -7.0):
        self.languages = tuple(languages)
        self.top_n, self.least_word, self.least_gram, self.floor = top_n, least_word, least_gram, floor
        self.words: dict[str, np.ndarray] = {}
        self.grams: list[dict[str, np.ndarray]] = []

    def _scores(self, counts: dict[str, np.ndarray], least: int) -> dict[str, np.ndarray]:
        if not counts:
            return {}
        keys = [k for k, v in counts.items() if v.sum() >= least]
        if not keys:
            return {}
        m = np.stack([counts[k] for k in keys]).astype(np.float64)
        total = np.maximum(np.stack(list(counts.values())).sum(0), 1.0)
        rate = np.log((m + 0.1) / (total + 0.1 * len(counts)))
        rate = np.maximum(rate - rate.max(1, keepdims=True), self.floor).astype(np.float32)
        return dict(zip(keys, rate))

    def fit(self, counts: dict[str, np.ndarray]) -> LanguageModel:
        """``counts``: word to its number in each language."""
        self.words = self._scores(counts, self.least_word)
        self.grams = []
        for n in range(1, self.top_n + 1):
            tally: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
            for w, c in counts.items():
                for g in _grams(w, n):
                    tally[g] += c
            self.grams.append(self._scores(tally, self.least_gram))
        return self

    def score(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(self.top_n, 0, -1):
            found = [s for g in _grams(word, n) if (s := self.grams[n - 1].get(g)) is not None]
            if found:
                return np.mean(found, axis=0, dtype=np.float32)
        return np.zeros(len(self.languages), np.float32)


class _Vocabulary(dict):
    """Word to row of the score matrix; scores a new word when it is first met."""

    def __init__(self, model: LanguageModel):
        zero = np.zeros(len(model.languages), np.float32)
        super().__init__({END: 0, BREAK: 1})
        self.model, self.rows = model, [zero, zero]
        self._matrix = np.stack(self.rows)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self.rows)
        self.rows.append(self.model.score(word))
        return at

    def matrix(self) -> np.ndarray:
        if len(self._matrix) < len(self.rows):
            self._matrix = np.concatenate([self._matrix, np.stack(self.rows[len(self._matrix) :])])
        return self._matrix


def sentence_bounds(ids: np.ndarray, doc: np.ndarray, longest: int = 20) -> np.ndarray:
    """The sentence number of each token: cut at ends, blank lines, documents, and lengths."""
    n = len(ids)
    blank = np.r_[False, (ids[1:] == 1) & (ids[:-1] == 1)]
    cut = np.r_[True, doc[1:] != doc[:-1]] | (ids == 0) | blank
    sent = np.cumsum(cut) - 1
    is_word = ids > 1
    upto = np.cumsum(is_word)
    first = np.flatnonzero(cut)
    within = upto - np.r_[0, upto][first][sent] - 1
    size = np.bincount(sent, weights=is_word)
    pieces = np.maximum(1, np.ceil(size / (1.5 * longest))).astype(np.int64)
    piece = np.where(pieces[sent] > 1, np.maximum(within, 0) * pieces[sent] // np.maximum(size[sent], 1).astype(np.int64), 0)
    base = np.cumsum(pieces) - pieces
    assert len(piece) == n
    return base[sent] + piece


def classify(texts: list[str | None], vocab: _Vocabulary, longest: int = 20, least_unit: int = 4):
    """Per sentence: ``(document, words, best language, its log-odds scores)`` as arrays."""
    tokens = [words_of(t) if t else [] for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    ids = np.fromiter(map(vocab.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
    k = len(vocab.model.languages)
    if not len(ids):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros((0, k), np.float32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    unit = sentence_bounds(ids, doc, longest)
    n = int(unit[-1]) + 1
    is_word = ids > 1
    m = vocab.matrix()
    scores = np.stack([np.bincount(unit, weights=m[ids, j], minlength=n) for j in range(k)], 1)
    words = np.bincount(unit, weights=is_word, minlength=n).astype(np.int64)
    at = np.zeros(n, np.int64)
    at[unit] = doc
    # A unit of few words leans on the whole of its document.
    whole = np.stack([np.bincount(at, weights=scores[:, j], minlength=len(texts)) for j in range(k)], 1)
    short = words < least_unit
    used = np.where(short[:, None], whole[at], scores)
    keep = words > 0
    return at[keep], words[keep], used.argmax(1)[keep], used[keep]


def fit_language_model(
    docs: DataFrame, key: str, text: str, label: str, languages: tuple[str, ...] = LANGUAGES, per_language: int = 400, max_chars: int = 20_000, rounds: int = 3
) -> LanguageModel:
    """A model from at most ``per_language`` labelled rows of each language.

    Rows with unusable labels, null text or more than ``max_chars`` characters aren't in
    the sample.  A language without labelled rows is never given.
    """
    code = label_language(F.col(f"`{label}`"))
    named = docs.select(F.col(f"`{key}`").alias("k"), code.alias("code")).where(F.col("code").isin(*languages))
    # Ranks are cut in each partition before the shuffle, so a group has few rows.
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("k"), "k"))
    chosen = named.withColumn("r", rank).where(F.col("r") <= per_language).drop("r")
    sample = (
        docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
        .join(F.broadcast(chosen), "k")  # at most per_language rows of each language
        .where(F.length("t") <= max_chars)
        .select("code", "t")
        .limit(per_language * len(languages))
        .collect()
    )
    index = {lang: i for i, lang in enumerate(languages)}
    tallies: list[Counter] = [Counter() for _ in languages]
    tokens = [(index[r.code], words_of(r.t)) for r in sorted(sample, key=lambda r: (r.code, r.t))]
    for i, t in tokens:
        tallies[i].update(t)
    model = LanguageModel(languages).fit(_merged(tallies))
    for _ in range(rounds - 1):
        vocab = _Vocabulary(model)
        tallies = [Counter() for _ in languages]
        for _, t in tokens:
            ids = np.fromiter((vocab[w] for w in t), np.int64, len(t))
            if not len(ids):
                continue
            unit = sentence_bounds(ids, np.zeros(len(ids), np.int64))
            m = vocab.matrix()
            n = int(unit[-1]) + 1
            s = np.stack([np.bincount(unit, weights=m[ids, j], minlength=n) for j in range(len(languages))], 1)
            top = np.sort(s, 1)
            best = np.where(top[:, -1] - top[:, -2] > 3.0, s.argmax(1), -1) if len(languages) > 1 else s.argmax(1)
            for w, u in zip(t, best[unit]):
                if u >= 0:
                    tallies[u][w] += 1
        model = LanguageModel(languages).fit(_merged(tallies))
    return model


def _merged(tallies: list[Counter]) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for i, c in enumerate(tallies):
        for w, n in c.items():
            if w not in (END, BREAK):
                out.setdefault(w, np.zeros(len(tallies)))[i] += n
    return out


_SPAN = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("confidence", T.DoubleType())]
)


def detect_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", least_words: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, languages, segments)``: arrays of ``(lang, n_words, confidence)``.

    ``languages`` has each language with at least ``least_words`` words of the document,
    or the one with most words if none has; the most used first.  ``segments`` is the
    document in order.  Null, empty or wordless text has two empty arrays.
    """
    names = np.array(model.languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(c, docs.schema[c].dataType) for c in (key, *keep)]
    schema = T.StructType([*fields, T.StructField("languages", T.ArrayType(_SPAN)), T.StructField("segments", T.ArrayType(_SPAN))])

    def spans(counts: np.ndarray, lang: np.ndarray, words: np.ndarray, sure: np.ndarray) -> pa.Array:
        body = pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(words, pa.int64()), pa.array(sure, pa.float64())], ["lang", "n_words", "confidence"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), body)

    def softmax(scores: np.ndarray, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
        s = scores / np.sqrt(np.maximum(words, 1))[:, None]
        e = np.exp(s - s.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[np.arange(len(lang)), lang]

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _Vocabulary(shared.value)
        k = len(names)
        for batch in by_size(batches, 1):
            if len(vocab) > 2_000_000:
                vocab = _Vocabulary(shared.value)
            n = batch.num_rows
            at, words, lang, scores = classify(batch.column(1).to_pylist(), vocab)
            new = np.r_[True, (at[1:] != at[:-1]) | (lang[1:] != lang[:-1])] if len(at) else np.zeros(0, bool)
            seg = np.cumsum(new) - 1
            m = int(seg[-1]) + 1 if len(seg) else 0
            s_at, s_lang = at[new], lang[new]
            s_words = np.bincount(seg, weights=words, minlength=m).astype(np.int64)
            s_scores = np.stack([np.bincount(seg, weights=scores[:, j], minlength=m) for j in range(k)], 1) if m else np.zeros((0, k))
            segments = spans(np.bincount(s_at, minlength=n), s_lang, s_words, softmax(s_scores, s_lang, s_words))
            # By document and language.
            cell = s_at * k + s_lang
            total = np.bincount(cell, weights=s_words, minlength=n * k).reshape(n, k)
            by = np.stack([np.bincount(cell, weights=s_scores[:, j], minlength=n * k) for j in range(k)], 1) if m else np.zeros((n * k, k))
            enough = (total >= least_words) | ((total == total.max(1, keepdims=True)) & (total.max(1, keepdims=True) < least_words) & (total > 0))
            order = np.argsort(-total, 1, kind="stable")
            d_at, pos = np.nonzero(np.take_along_axis(enough, order, 1))
            d_lang = order[d_at, pos]
            d_words = total[d_at, d_lang].astype(np.int64)
            languages = spans(np.bincount(d_at, minlength=n), d_lang, d_words, softmax(by[d_at * k + d_lang], d_lang, d_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(keep))), languages, segments], [f.name for f in schema])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(detect, schema)


def relabelled(detected: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``(key, lang)`` of the documents whose label is missing or wrong or not enough.

    One row per language of a document that has several, or whose label doesn't name its
    only one.
    """
    wrong = (F.size("languages") > 1) | ~label_language(F.col(label)).eqNullSafe(F.get("languages", F.lit(0))["lang"])
    return detected.where(wrong).select(key, F.explode("languages.lang").alias("lang"))

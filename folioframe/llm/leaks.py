"""Evaluation texts leaking into training text: which documents hold which test items.

A prefix-filtered set join over windows of ``window`` item words.  A window that stands in a
document may have lost one word in ten, and lines or sentences may have been put between its
words.  What is put in ends where a line or a sentence ends (a unit), or, where the marks are lost, eight
known words go on after it: so a pair of neighbouring words of the item either stands side by side
in the document, or its second word begins such a piece there.
Shingles of five words would lose pieces of fewer words, so words and runs of three are counted,
in a cascade in which no step can lose a window:

* prefix: words are ordered by rarity over all documents; of the ``window`` words at most
  ``changed`` may be absent, so one of the ``changed + 1`` rarest must stand in the document;
* length: ``window - changed`` words of the window stand in it;
* position: a changed word spoils three runs of three words at most; each other run stands in the
  document side by side, or with the beginning of a piece between its words;
* exact check: approximate matching of all windows of the item at once, with ``changed`` words
  replaced, left out or put in, and free continuation at the start of any later piece.

There is no cap on the number, length or distance of the pieces.  Both steps over the corpus are
narrow: the texts stay where they are, and only word counts and the found pairs are shuffled.

The items are a stated query set: they are taken in blocks of at most ``block_words`` words,
so that what is sent to the executors has a fixed bound whatever the number of items, and
every block is held against the whole corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioframe.functions.arrow import by_size

MARK = "\x01"
SURE = 8  # words of an item that may go on after anything, also where no unit ends before them
_TAG = re.compile(r"<[^>\n]*>")


class _Words(dict):
    """For ``str.translate``: letters, marks and digits stay, ends of lines and sentences become tokens."""

    def __missing__(self, c: int) -> int | str:
        ch = chr(c)
        if ch in ".!?।॥…\n\r":
            self[c] = f" {MARK} "
        else:
            self[c] = c if unicodedata.category(ch)[0] in "LMN" else 32
        return self[c]


_WORDS = _Words()


def tokens_of(text: str | None) -> list[str]:
    """Words in lower case, with a mark where a line, a sentence or a tag ends."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(".", text)
    return text.lower().translate(_WORDS).split()


def words_of(text: str | None) -> list[str]:
    return [w for w in tokens_of(text) if w != MARK]


class ItemBlock:
    """A block of items as the executors need it: all their words as numbers, one after the other."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, share: float):
        self.window = window
        self.changed = window - int(np.ceil(window * share - 1e-9))
        self.keys = [k for k, _ in items]
        self.vocabulary: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.mark = len(self.vocabulary) + 1
        self.words = np.array([self.vocabulary[w] for _, words in items for w in words], np.int64)
        sizes = np.array([len(words) for _, words in items], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.last = np.cumsum(sizes)
        self.item = np.repeat(np.arange(len(items)), sizes)
        within = np.arange(len(self.words)) - self.first[self.item]
        self.starts = np.flatnonzero(within + window <= sizes[self.item])
        self.span = [np.arange(a, b) for a, b in zip(self.first, self.last)]
        self.base = self.mark + 1
        self.second, self.third = np.r_[self.words[1:], 0], np.r_[self.words[2:], 0, 0][: len(self.words)]
        self.pairs, self.pair = np.unique(self.words * self.base + self.second, return_inverse=True)
        self.runs, self.run = np.unique(self.pair * self.base + self.third, return_inverse=True)
        self.by_prefix: dict[int, np.ndarray] = {}

    def set_rarity(self, count: np.ndarray) -> None:
        """Lists each item under the ``changed + 1`` rarest words of its windows; ``count`` is by word number."""
        lists: dict[int, set[int]] = defaultdict(set)
        rare = count[self.words]
        for s in self.starts:
            span = slice(s, s + self.window)
            for j in np.lexsort((self.words[span], rare[span]))[: self.changed + 1]:
                lists[int(self.words[s + j])].add(int(self.item[s]))
        self.by_prefix = {w: np.array(sorted(x), np.int64) for w, x in lists.items()}


def _numbered(texts: list[str | None], vocabulary: dict[str, int], mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts (0: in no item), whether a word begins a unit, and each text's first place."""
    tokens = [tokens_of(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    get = vocabulary.get
    ids = np.fromiter((get(w, 0) for w in chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(tokens)), sizes)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (ids[:-1] == mark)][: len(ids)]
    keep = ids != mark
    ids, fresh, doc = ids[keep], fresh[keep], doc[keep]
    return ids, fresh, np.searchsorted(doc, np.arange(len(tokens) + 1))


def word_counts(docs: DataFrame, block: ItemBlock, text: str) -> np.ndarray:
    """The number of documents that hold each word of the block, over all documents.

    At most one row for each word of the block comes back, which ``block_words`` bounds.
    """
    vocabulary, mark = block.vocabulary | {MARK: block.mark}, block.mark
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(mark + 1, np.int64)
        for batch in by_size(batches, 0):
            ids, _, at = _numbered(batch.column(0).to_pylist(), shared.value, mark)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            total += np.bincount(np.unique(doc * (mark + 1) + ids) % (mark + 1), minlength=mark + 1)
        word = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(total[word], pa.int64())], ["word", "n"])

    out = np.zeros(mark + 1, np.int64)
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


def _places(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The place of each code among the sorted known ones; past the end where it is unknown."""
    at = np.searchsorted(known, codes)
    at[at == len(known)] = 0
    return np.where(known[at] == codes, at, len(known))


class Matcher:
    """Finds the items of a block in numbered texts; one per Python task."""

    def __init__(self, block: ItemBlock):
        self.b = block
        self.present, self.begins = np.zeros(block.base + 1, bool), np.zeros(block.base + 1, bool)
        self.beside, self.opens = np.zeros(len(block.pairs) + 1, bool), np.zeros(len(block.pairs) + 1, bool)
        self.triple = np.zeros(len(block.runs) + 1, bool)
        self.listed = np.zeros(block.base + 1, bool)
        self.listed[list(block.by_prefix)] = True

    def runs(self, ids: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of a batch: its known pair with the next, its known run of three, and whether it begins a piece.

        A piece begins with a unit, or with ``SURE`` words in known runs of three, wherever that is.
        """
        if len(ids) < 3:
            return np.full(len(ids), len(self.b.pairs)), np.full(len(ids), len(self.b.runs)), fresh
        pair = np.r_[_places(self.b.pairs, ids[:-1] * self.b.base + ids[1:]), len(self.b.pairs)]
        run = np.r_[_places(self.b.runs, pair[:-2] * self.b.base + ids[2:]), [len(self.b.runs)] * 2]
        total = np.r_[0, np.cumsum(run < len(self.b.runs))]
        upto = np.minimum(np.arange(len(ids)) + SURE - 2, len(ids))
        return pair, run, fresh | (total[upto] - total[:-1] == SURE - 2)

    def _holding(self, items: np.ndarray, good, width: int, least: int) -> np.ndarray:
        """The first places of the windows of ``items`` with ``least`` good ones among their first ``width`` places."""
        b = self.b
        at = slice(None) if 2 * len(items) > len(b.span) else np.concatenate([b.span[i] for i in items])
        item = b.item[at]
        if len(item) < b.window:
            return items[:0]
        total = np.r_[0, np.cumsum(good(at))]
        n = len(item) - b.window + 1
        whole = item[:n] == item[b.window - 1 :]
        found = np.flatnonzero(whole & (total[width : width + n] - total[:n] >= least))
        return found if isinstance(at, slice) else at[found]

    def candidates(self, ids: np.ndarray, fresh: np.ndarray, pair: np.ndarray, run: np.ndarray) -> np.ndarray:
        """First places of the windows that pass the prefix, the length and the position bound."""
        b, w = self.b, self.b.window
        prefix = np.unique(ids[self.listed[ids]])
        if not len(prefix) or len(ids) < w - b.changed:
            return prefix[:0]
        items = np.unique(np.concatenate([b.by_prefix[p] for p in prefix.tolist()]))
        self.present[ids] = True
        starts = self._holding(items, lambda at: self.present[b.words[at]], w, w - b.changed)
        self.present[ids] = False
        if not len(starts):
            return starts
        pair, run, first = pair[:-1], run[:-2], ids[fresh]
        opening = pair[fresh[:-1]]
        self.begins[first] = self.beside[pair] = self.opens[opening] = self.triple[run] = True

        def follows(at):
            third = self.begins[b.third[at]]
            return self.triple[b.run[at]] | self.opens[np.r_[b.pair[at][1:], 0]] | third & (self.beside[b.pair[at]] | self.begins[b.second[at]])

        self.opens[-1] = self.beside[-1] = self.triple[-1] = False
        starts = np.intersect1d(starts, self._holding(np.unique(b.item[starts]), follows, w - 2, w - 2 - 3 * b.changed), assume_unique=True)
        self.begins[first] = self.beside[pair] = self.opens[opening] = self.triple[run] = False
        return starts

    def contained(self, ids: np.ndarray, fresh: np.ndarray, starts: np.ndarray) -> dict[int, int]:
        """Item to the words of its best window, of those at ``starts``, that stand in the text in order.

        Bit-parallel approximate matching of all windows at once, each a field of ``window`` bits:
        bit ``j`` of a field in ``state[d]`` says that the first ``j + 1`` words of its window end
        here with ``d`` changes.  States of any earlier place go on where a piece begins.
        """
        b, w, most = self.b, self.b.window, self.b.changed
        words, code = np.unique(b.words[starts[:, None] + np.arange(w)].ravel(), return_inverse=True)
        bits = np.zeros((len(words), len(code)), np.uint8)
        bits[code, np.arange(len(code))] = 1
        number = lambda row: int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
        by_word = {x: number(row) for x, row in zip(words.tolist(), bits)}
        edge = np.arange(len(code)) % w
        low, high = number((edge == 0).astype(np.uint8)), edge == w - 1
        state = [0] * (most + 1)
        for d in range(1, most + 1):
            state[d] = (state[d - 1] << 1) | low
        ever = list(state)
        for x, new in zip(ids.tolist(), fresh.tolist()):
            if new:
                state = ever.copy()
            m = by_word.get(x, 0)
            before = state[0]
            now = ((before << 1) | low) & m
            state[0] = now
            ever[0] |= now
            for d in range(1, most + 1):
                old = state[d]
                now = (((old << 1) | low) & m) | ((before | now) << 1) | before | low
                before = old
                state[d] = now
                ever[d] |= now
        out: dict[int, int] = {}
        size = (len(code) + 8) // 8 + most + 1
        for d in range(most, -1, -1):
            row = np.unpackbits(np.frombuffer(ever[d].to_bytes(size, "little"), np.uint8), bitorder="little")[: len(code)]
            for f in np.flatnonzero(row.astype(bool) & high) // w:
                out[int(b.item[starts[f]])] = w - d
        return out


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "passage",
    window: int = 25,
    share: float = 0.9,
    block_words: int = 500_000,
) -> DataFrame:
    """``(key, item_key, n_words)``: documents that hold ``window`` words in a row of an item.

    Case, punctuation, tags and line breaks don't matter; one word in ten may be replaced, left
    out or put in; whole lines and sentences may be put in anywhere, of any number and length, and
    other words where eight words of the item at least go on after them.
    Items under ``window`` words never match; null or empty texts never match; equal items each
    count; repeated document rows give one row.  Item tables of any size are taken block by block.
    """
    spark = docs.sparkSession
    out = None
    rows = items.select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").alias("t")).dropDuplicates()
    block: list[tuple[int, list[str]]] = []
    n = 0
    for r in chain(rows.toLocalIterator(), [None]):
        if r is not None:
            words = words_of(r.t)
            if len(words) >= window:
                block.append((r.k, words))
                n += len(words)
        if block and (r is None or n >= block_words):
            part = _leaked_block(docs, ItemBlock(sorted(block, key=lambda x: str(x[0])), window, share), key, text, item_key, items.schema[item_key].dataType)
            out = part if out is None else out.unionByName(part)
            block, n = [], 0
    if out is None:
        return spark.createDataFrame([], T.StructType([docs.schema[key], items.schema[item_key], T.StructField("n_words", T.IntegerType())]))
    return out


def _leaked_block(docs: DataFrame, block: ItemBlock, key: str, text: str, item_key: str, item_type: T.DataType) -> DataFrame:
    block.set_rarity(word_counts(docs, block, text))
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, item_type), T.StructField("n_words", T.IntegerType())])
    item_arrow = to_arrow_type(item_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        vocabulary, matcher = b.vocabulary | {MARK: b.mark}, Matcher(b)
        for batch in by_size(batches, 1):
            ids, fresh, at = _numbered(batch.column(1).to_pylist(), vocabulary, b.mark)
            pair, run, fresh = matcher.runs(ids, fresh)
            rows, found, words = [], [], []
            for i in range(batch.num_rows):
                here = slice(at[i], at[i + 1])
                starts = matcher.candidates(ids[here], fresh[here], pair[here], run[here])
                if not len(starts):
                    continue
                for item, m in matcher.contained(ids[here], fresh[here], starts).items():
                    rows.append(i)
                    found.append(b.keys[item])
                    words.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, item_arrow), pa.array(words, pa.int32())], [f.name for f in schema])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(search, schema).dropDuplicates([key, item_key])

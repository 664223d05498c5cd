"""Splitting oversized items at natural boundaries.

Dynamic programming over boundary positions: the cost of a division is the sum of the
penalties of its cuts (paragraph end, line end, sentence end, then between words, then
within one) and of the pieces' squared distance from even size; pieces hold at most
``max_tokens`` tokens and start ``overlap`` tokens before the end of the piece before.
Word boundaries are positions only where no natural boundary is near, so the work grows
with the text's length and not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.functions.arrow import by_size
from folioframe.llm.tokens import VOCABULARY, encoding

PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 0.0, 0.6, 1.0, 6.0, 30.0
BALANCE = 4.0
_WORD = re.compile(r"\S+")
_STOP = re.compile(r"[.!?।॥…][\"'’”»)\]]*(?:</\w+>)*$")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and the penalty of a cut after each word."""
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([s for s, _ in spans], np.int64)
    ends = np.array([e for _, e in spans], np.int64)
    cost = np.full(len(spans), WORD)
    for i, (s, e) in enumerate(spans[:-1]):
        gap = text[e : spans[i + 1][0]]
        feeds = gap.count("\n")
        if feeds > 1:
            cost[i] = PARAGRAPH
        elif feeds:
            cost[i] = LINE
        elif _STOP.search(text, max(s, e - 24), e):
            cost[i] = SENTENCE
    return starts, ends, cost


def _units(text: str, tokens: list[int], lengths: np.ndarray, most: int):
    """Cuttable units: words, and parts of words that have over ``most`` tokens.

    Returns starts, ends (code points), cut penalties and the tokens up to each end.
    """
    starts, ends, cost = boundaries(text)
    wide = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    to_byte = np.r_[0, np.cumsum(np.select([wide < 0x80, wide < 0x800, wide < 0x10000], [1, 2, 3], 4))]
    token_ends = np.cumsum(lengths[np.array(tokens, np.int64)])
    upto = np.searchsorted(token_ends, to_byte[ends], "right")
    sizes = np.diff(np.r_[0, upto])
    if len(sizes) and sizes.max() > most:
        s2, e2, c2 = [], [], []
        to_char = {int(b): i for i, b in enumerate(to_byte)}
        for i, n in enumerate(sizes):
            at = int(starts[i])
            if n > most:
                first = int(upto[i] - n)
                for k in range(first + most - 1, int(upto[i]) - 1, most):
                    j = k
                    while j > first and int(token_ends[j]) not in to_char:
                        j -= 1
                    e = to_char.get(int(token_ends[j]), at)
                    if at < e < ends[i]:
                        s2.append(at), e2.append(e), c2.append(INSIDE)
                        at = e
            s2.append(at), e2.append(int(ends[i])), c2.append(cost[i])
        starts, ends, cost = np.array(s2), np.array(e2), np.array(c2)
        upto = np.searchsorted(token_ends, to_byte[ends], "right")
    return starts, ends, cost, upto


def _divide(cost: np.ndarray, upto: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as ``(first unit, last unit)``, last included, of least cost."""
    n = len(upto)
    total = int(upto[-1])
    if total <= limit:
        return [(0, n - 1)]
    before = np.r_[0, upto]  # tokens before each unit
    natural = cost <= SENTENCE
    natural[-1] = True
    at = np.flatnonzero(natural)
    # Where natural boundaries lie too far apart, every unit end between them is a position.
    reach = max(1, (limit - overlap) // 3)
    left = np.r_[-1, at[:-1]]
    wide = (upto[at] - before[left + 1]) > reach
    extra = [np.arange(a + 1, b) for a, b in zip(left[wide], at[wide])]
    nodes = np.unique(np.concatenate([at, *extra])) if extra else at
    # The unit a piece starts with after a cut at each node: at least ``overlap`` tokens back.
    back = np.searchsorted(before, upto[nodes] - overlap, "right") - 1
    back = np.clip(back, 0, nodes + 1) if overlap else nodes + 1
    pieces = max(1, int(np.ceil((total - overlap) / max(1, limit - overlap))))
    even = (total + (pieces - 1) * overlap) / pieces
    m = len(nodes)
    best = np.full(m, np.inf)
    prev = np.full(m, -1)
    from_start = before[back]  # tokens before the piece that follows node i
    ends = upto[nodes]
    penalty = cost[nodes].copy()
    penalty[-1] = 0
    lo = 0
    for j in range(m):
        if ends[j] <= limit:
            best[j] = penalty[j] + BALANCE * ((ends[j] - even) / limit) ** 2
        while lo < j and ends[j] - from_start[lo] > limit:
            lo += 1
        if lo < j:
            size = ends[j] - from_start[lo:j]
            c = best[lo:j] + BALANCE * ((size - even) / limit) ** 2
            c[(size > limit) | (back[lo:j] <= np.r_[0, back][prev[lo:j] + 1]) & (prev[lo:j] >= 0)] = np.inf
            k = int(c.argmin())
            if c[k] + penalty[j] < best[j]:
                best[j], prev[j] = c[k] + penalty[j], lo + k
    out: list[tuple[int, int]] = []
    j = m - 1
    while j >= 0:
        i = int(prev[j])
        out.append((int(back[i]) if i >= 0 else 0, int(nodes[j])))
        j = i
    return out[::-1]


def split_text(text: str, enc, lengths: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of each piece; start and end in code points of ``text``.

    A piece is ``text[start:end]``, has at most ``max_tokens`` tokens by itself, and starts at
    the last boundary that keeps at least ``overlap`` tokens of the piece before.  Limits that leave
    no room for a unit besides the overlap are an error; no piece is ever over the limit.
    """
    tokens = enc.encode_ordinary(text)
    if not text.strip():
        return []
    limit = max_tokens
    starts, ends, cost, upto = _units(text, tokens, lengths, max(1, (max_tokens - overlap) // 4))
    while True:
        cuts = _divide(cost.copy(), upto, limit, overlap)
        out = [(int(starts[a]), int(ends[b]), 0) for a, b in cuts]
        sizes = [len(enc.encode_ordinary(text[s:e])) for s, e, _ in out]
        over = max(sizes) - max_tokens
        if over <= 0:
            return [(s, e, n) for (s, e, _), n in zip(out, sizes)]
        if limit <= overlap + 2:
            raise ValueError(f"pieces of {max_tokens} tokens with {overlap} of overlap can't hold this text's units")
        limit = max(overlap + 2, limit - over)  # a piece by itself may have a token or two more


def split_oversized(
    docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = 1024, overlap: int = 64, above_words: int | None = None, path: str = VOCABULARY
) -> DataFrame:
    """``(key, piece, start, end, n_tokens, text)``: the pieces of the oversized documents.

    Oversized are documents with more than ``above_words`` words between white space, or by
    default more than ``max_tokens`` tokens; others give no row.  Pieces are numbered from 1
    and cover the text but for white space at their edges.  A word over the limit is cut
    inside.  Null, empty and white text give no row; each row of ``docs`` is cut by itself.
    """
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("overlap must be under half of max_tokens")
    schema = T.StructType(
        [docs.schema[key] if key == docs.schema[key].name else T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("text", T.StringType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        lengths = np.zeros(enc.max_token_value + 1, np.int64)
        for i in range(enc.max_token_value + 1):
            try:
                lengths[i] = len(enc.decode_single_token_bytes(i))
            except KeyError:
                pass
        for batch in by_size(batches, 1):
            rows, cols = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if above_words is not None:
                    if len(t.split()) <= above_words:
                        continue
                elif len(t.encode()) <= max_tokens or len(enc.encode_ordinary(t)) <= max_tokens:
                    continue
                for no, (s, e, n) in enumerate(split_text(t, enc, lengths, max_tokens, overlap), 1):
                    rows.append(i)
                    cols.append((no, s, e, n, t[s:e]))
            c = list(zip(*cols)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c[j], pa.int64()) for j in range(4)), pa.array(c[4], pa.string())], [f.name for f in schema]
            )

    # A text over n words has over 2 n characters; only such rows go to Python.
    least = 2 * above_words if above_words is not None else max_tokens // 4
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).where(F.length(text) > least).mapInArrow(cut, schema)

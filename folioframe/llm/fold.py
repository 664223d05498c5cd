"""Visually identical text with different characters: bring text to one form.

Arrow text is copied to numpy arrays of code points.  Compatibility and canonical
decompositions are lookup-table gathers with expansion offsets, marks are ordered and
composed with array operations over all rows of a batch at once, and look-alike letters
are decided per word from per-script counts.  No Python string call is made per row.

The form: compatibility composition, no invisible characters except the joiners
Devanagari spelling needs, ordinary spaces only, and no letter of another alphabet (or
look-alike of the same one) in place of a plain one.  Words really written in another
alphabet keep their letters.  Null stays null, empty stays empty; length is unbounded.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 3, 4

# Letters that look like the letter under them, by alphabet.
LATIN_LOOKALIKES = ("ɑɡıɩȷʀɴɪʟʏᴀᴄᴏᴠᴡᴢᴋᴍᴘᴛᴜᴊᴅᴇ", "agiijRNILYacovwzKMPTUJDE")
CYRILLIC_TO_LATIN = ("АВЕЅІЈКМНОРСТХҮԚԜҺаеѕіјорсухһԁԛԝӏүԍѵ", "ABESIJKMHOPCTXYQWHaesijopcyxhdqwlyGv")
GREEK_TO_LATIN = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοναικρυχγητϲ", "ABEZHIKMNOPTYXCjovaikpuxyntc")
CYRILLIC_FROM_LATIN = ("ABESIJKMHOPCTXYaesijopcyxhk", "АВЕЅІЈКМНОРСТХУаеѕіјорсухһк")
GREEK_FROM_LATIN = ("ABEZHIKMNOPTYXovaikpuxy", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρυχγ")

_SIZE = 0x110000
_L_BASE, _V_BASE, _T_BASE, _S_BASE = 0x1100, 0x1161, 0x11A7, 0xAC00


@cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built once per Python process."""
    exp_len = np.ones(_SIZE, np.uint8)
    exp_off = np.full(_SIZE, -1, np.int32)  # -1: doesn't decompose
    data: list[int] = []
    ccc = np.zeros(_SIZE, np.uint8)
    kind = np.zeros(_SIZE, np.uint8)  # 1 letter or mark, 2 invisible, 3 space
    pairs: dict[int, int] = {}
    for c in range(_SIZE):
        if 0xD800 <= c <= 0xDFFF or 0xE000 <= c <= 0xF8FF or c >= 0x30000 and not 0xE0000 <= c <= 0xE0FFF:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if cat[0] in "LM":
            kind[c] = 1
        elif cat == "Cf":
            kind[c] = 2
        elif cat in ("Zs", "Zl", "Zp") or c in (9, 10, 11, 12, 13, 0x85):
            kind[c] = 3 if c != 32 else 0
        if cat[0] == "M":
            ccc[c] = unicodedata.combining(ch)
        if 0xAC00 <= c <= 0xD7A3 or unicodedata.decomposition(ch):
            d = unicodedata.normalize("NFKD", ch)
            if d != ch:
                exp_len[c], exp_off[c] = len(d), len(data)
                data.extend(map(ord, d))
            two = unicodedata.decomposition(ch)
            if two and two[0] != "<" and " " in two and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in two.split())
                pairs[a << 21 | b] = c
    for c in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E, 0x034F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)):
        kind[c] = 2  # fillers, joiner mark, variation selectors
    keys = np.array(sorted(pairs), np.int64)
    script = np.zeros(_SIZE, np.uint8)
    script[kind == 1] = OTHER
    for lo, hi, s in ((0x41, 0x24F, LATIN), (0x250, 0x2AF, LATIN), (0x1D00, 0x1DBF, LATIN), (0x1E00, 0x1EFF, LATIN), (0x2C60, 0x2C7F, LATIN), (0xA720, 0xA7FF, LATIN), (0x400, 0x52F, CYRILLIC), (0x370, 0x3FF, GREEK), (0x1F00, 0x1FFF, GREEK)):
        part = slice(lo, hi + 1)
        script[part] = np.where(kind[part] == 1, s, 0)
    script[ccc > 0] = 0  # marks belong to any alphabet
    same = np.arange(_SIZE, dtype=np.uint32)
    to = {LATIN: same.copy(), CYRILLIC: same.copy(), GREEK: same.copy()}
    own = same.copy()
    for a, b in zip(*LATIN_LOOKALIKES):
        own[ord(a)] = ord(b)
    for (src, dst), k in ((CYRILLIC_TO_LATIN, LATIN), (GREEK_TO_LATIN, LATIN), (CYRILLIC_FROM_LATIN, CYRILLIC), (GREEK_FROM_LATIN, GREEK)):
        for a, b in zip(src, dst):
            to[k][ord(a)] = ord(b)
    return {
        "exp_len": exp_len, "exp_off": exp_off, "exp_data": np.array(data, np.uint32), "ccc": ccc, "kind": kind, "own": own,
        "pair_keys": keys, "pair_vals": np.array([pairs[int(k)] for k in keys], np.uint32), "script": script,
        "to_latin": to[LATIN], "to_cyrillic": to[CYRILLIC], "to_greek": to[GREEK],
    }


def _compose_pair(a: np.ndarray, b: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """The composed code point of each pair, 0 where there is none."""
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(t["pair_keys"], key), len(t["pair_keys"]) - 1)
    out = np.where(t["pair_keys"][at] == key, t["pair_vals"][at], 0)
    li, vi = a.astype(np.int64) - _L_BASE, b.astype(np.int64) - _V_BASE
    lv = (li >= 0) & (li < 19) & (vi >= 0) & (vi < 21)
    si, ti = a.astype(np.int64) - _S_BASE, b.astype(np.int64) - _T_BASE
    lvt = (si >= 0) & (si < 11172) & (si % 28 == 0) & (ti > 0) & (ti < 28)
    return np.where(lv, _S_BASE + (li * 21 + vi) * 28, np.where(lvt, a + ti, out)).astype(np.uint32)


def _expand(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not _decomposing()[cp].any():
        return cp, row
    n = t["exp_len"][cp].astype(np.int64)
    src = np.repeat(np.arange(len(cp)), n)
    within = np.arange(len(src)) - (np.cumsum(n) - n)[src]
    out = cp[src]
    hit = _decomposing()[out]
    out[hit] = t["exp_data"][t["exp_off"][out[hit]] + within[hit]]
    return out, row[src]


@cache
def _decomposing() -> np.ndarray:
    return tables()["exp_off"] >= 0


def _order_marks(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    c = t["ccc"][cp]
    wrong = (c[1:] > 0) & (c[:-1] > c[1:]) & (row[1:] == row[:-1])
    if not wrong.any():
        return cp
    seg = np.cumsum((c == 0) | np.r_[True, row[1:] != row[:-1]])
    return cp[np.lexsort((np.arange(len(cp)), c, seg))]


def _compose(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    while len(cp) > 1:
        c = t["ccc"][cp]
        starter = np.where(c == 0, np.arange(len(cp)), -1)
        last = np.r_[-1, np.maximum.accumulate(starter)[:-1]]  # last starter before each place
        i = np.arange(1, len(cp))
        s = last[1:]
        near = (s == i - 1) | ((c[i - 1] > 0) & (c[i] > c[i - 1]))
        ok = (s >= 0) & near
        ok &= row[np.maximum(s, 0)] == row[i]
        i, s = i[ok], s[ok]
        made = _compose_pair(cp[s], cp[i], t)
        hit = made > 0
        i, s, made = i[hit], s[hit], made[hit]
        if not len(i):
            break
        _, first = np.unique(s, return_index=True)
        # A starter that is itself swallowed in this pass waits for the next one.
        gone = np.zeros(len(cp), bool)
        gone[i[first]] = True
        keep = first[~gone[s[first]]]
        gone[:] = False
        gone[i[keep]] = True
        cp = cp.copy()
        cp[s[keep]] = made[keep]
        cp, row = cp[~gone], row[~gone]
    return cp, row


def _plain_letters(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Replace look-alike letters word by word."""
    cp = t["own"][cp]
    script = t["script"][cp]
    foreign = (script == CYRILLIC) | (script == GREEK)
    if not foreign.any():
        return cp
    in_word = t["kind"][cp] == 1
    start = in_word & ~(np.r_[False, in_word[:-1]] & np.r_[False, row[1:] == row[:-1]])
    word = np.cumsum(start) - 1
    n_words = int(word[-1]) + 1 if start.any() else 0
    if not n_words:
        return cp
    w = np.where(in_word, word, n_words)
    tally = lambda flag: np.bincount(w[flag], minlength=n_words + 1)[:n_words]
    swaps = foreign & (t["to_latin"][cp] != cp)
    latin, cyr, grk = tally(script == LATIN), tally(script == CYRILLIC), tally(script == GREEK)
    cyr_fix, grk_fix = tally(foreign & ~swaps & (script == CYRILLIC)), tally(foreign & ~swaps & (script == GREEK))
    latin_fix_c = tally((script == LATIN) & (t["to_cyrillic"][cp] == cp))
    latin_fix_g = tally((script == LATIN) & (t["to_greek"][cp] == cp))
    word_row = row[np.flatnonzero(start)]
    n_rows = int(row[-1]) + 1
    # Rows that hold a word that can only be of the other alphabet.
    true_cyr = np.bincount(word_row[(cyr_fix > 0) & (latin_fix_c == 0)], minlength=n_rows)[word_row] > 0
    true_grk = np.bincount(word_row[(grk_fix > 0) & (latin_fix_g == 0)], minlength=n_rows)[word_row] > 0
    mixed = latin > 0
    c2l = (cyr > 0) & (cyr_fix == 0) & (mixed | ~true_cyr)
    g2l = (grk > 0) & (grk_fix == 0) & (mixed | ~true_grk)
    l2c = mixed & (cyr_fix > 0) & (latin_fix_c == 0)
    l2g = mixed & (grk_fix > 0) & (latin_fix_g == 0) & (cyr_fix == 0)
    pick = lambda flag: np.r_[flag, False][w]
    out = cp.copy()
    for flag, s, table in ((c2l, CYRILLIC, "to_latin"), (g2l, GREEK, "to_latin"), (l2c, LATIN, "to_cyrillic"), (l2g, LATIN, "to_greek")):
        at = pick(flag) & (script == s)
        out[at] = t[table][cp[at]]
    return out


def fold_codepoints(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of code points ``cp``; ``row`` says whose they are (ascending)."""
    t = tables()
    for _ in range(2):  # a second time, as removed characters may have kept marks apart
        kind = t["kind"][cp]
        gone = kind == 2
        if gone.any():
            joiner = (cp == 0x200C) | (cp == 0x200D)
            before = np.r_[0, cp[:-1]]
            after = np.r_[cp[1:], 0]
            same = np.r_[False, row[1:] == row[:-1]] & np.r_[row[1:] == row[:-1], False]
            needed = joiner & same & (before == 0x94D) & (after >= 0x904) & (after <= 0x97F)
            keep = ~gone | needed
            cp, row, kind = cp[keep], row[keep], kind[keep]
        cp = np.where(kind == 3, np.uint32(32), cp)
        if len(cp) == 0:
            return cp, row
        if not _decomposing()[cp].any() and not (t["ccc"][cp] > 0).any():
            break
        cp, row = _expand(cp, row, t)
        cp = _order_marks(cp, row, t)
        cp, row = _compose(cp, row, t)
    return _plain_letters(cp, row, t), row


def fold_array(arr: pa.Array) -> pa.Array:
    """``fold_codepoints`` over an Arrow string array."""
    arr = arr.cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return pa.array([], pa.string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = arr.buffers()[2].to_pybytes()[lo:hi] if arr.buffers()[2] is not None else b""
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    chars = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
    counts = np.diff(chars[offsets - lo])
    row = np.repeat(np.arange(n), counts)
    out, row = fold_codepoints(cp, row)
    blob = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = np.select([out < 0x80, out < 0x800, out < 0x10000], [1, 2, 3], 4)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    valid = None
    if arr.null_count:
        mask = np.packbits(~np.asarray(arr.is_null()), bitorder="little")
        valid = pa.py_buffer(mask.tobytes())
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.tobytes()), pa.py_buffer(blob), valid)
    return made.cast(pa.string())


@F.arrow_udf(T.StringType())
def _fold_udf(arr: pa.Array) -> pa.Array:
    return fold_array(arr)


def fold_text(column: Column | str) -> Column:
    """The consistent form of a text column."""
    return _fold_udf(column)


def disguised_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field)`` of every named field whose text isn't in the consistent form."""
    folded = df.select(
        F.col(f"`{key}`").alias(key), *[F.col(f"`{f}`").alias(f"__raw_{i}") for i, f in enumerate(fields)]
    ).dropDuplicates()
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"__raw_{i}").alias("raw"), fold_text(f"__raw_{i}").alias("form")) for i, f in enumerate(fields)]
    )
    return (
        folded.select(key, F.explode(pairs).alias("p"))
        .where(F.col("p.raw") != F.col("p.form"))
        .select(key, F.col("p.field").alias("field"))
        .dropDuplicates()
    )

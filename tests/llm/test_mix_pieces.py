import random

import numpy as np
import pytest

from folioframe.llm import mix, pieces, tokens

ENC = tokens.encoding()
LENGTHS = np.array([len(ENC.decode_single_token_bytes(i)) for i in range(ENC.max_token_value + 1)])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, "नदी", 9)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in tokens.with_token_counts(df).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: len(ENC.encode_ordinary("नदी"))}


def water(sizes, share, cap, goal):
    """Brute force level by bisection."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap[s] * sizes[s], mid * share[s]) for s in sizes) < goal else (lo, mid)
    return {s: min(cap[s], hi * share[s] / sizes[s]) for s in sizes}


def test_rates_meet_targets_and_caps(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choices(["a", "b", "c", None], [60, 30, 9, 1])[0], rnd.randrange(1, 200)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 2), ("none", 0.1, 3)], "source string, targetShare double, maxRepeats int")
    rates = mix.source_rates(docs, t)
    got = {r.source: r.rate for r in rates.collect()}
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    want = water(sizes, dict.fromkeys("abc", 0.3), {"a": 1, "b": 2, "c": 2}, sum(n for *_, n in rows))
    assert all(abs(got[s] - want[s]) < 1e-6 for s in "abc") and got["none"] == 0.0
    mixed = mix.mix(docs, rates)
    copies = {}
    for r in mixed.collect():
        copies.setdefault(r.doc_id, []).append(r.copy)
    by = {i: s for i, s, _ in rows}
    for i, c in copies.items():
        assert sorted(c) == list(range(1, len(c) + 1)) and len(c) in (int(got[by[i]]), int(got[by[i]]) + 1) and len(c) <= {"a": 1, "b": 2, "c": 2}[by[i]]
    rep = {r.source: r for r in mix.mixture_report(mixed, rates).collect()}
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert abs(rep["a"].actual_share - want["a"] * sizes["a"] / sum(want[s] * sizes[s] for s in "abc")) < 0.03
    assert mix.mix(docs, rates).exceptAll(mixed).count() == 0


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long, copy int")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, targetShare double, maxRepeats int")
    r = mix.source_rates(empty, t)
    assert [x.rate for x in r.collect()] == [0.0] and mix.mix(empty, r).count() == 0
    zero = spark.createDataFrame([(1, "a", 0, 5), (2, "a", None, 5)], empty.schema)
    assert mix.mix(zero, mix.source_rates(zero, t)).count() == 0
    small = spark.createDataFrame([(1, "a", 10, 5), (2, "z", 90, 5)], empty.schema)
    assert sorted((x.doc_id, x.copy) for x in mix.mix(small, mix.source_rates(small, t)).collect()) == [(1, 1), (1, 2)]


def check(text, limit, overlap):
    cut = pieces.split_text(text, ENC, LENGTHS, limit, overlap)
    if not text.strip():
        assert cut == []
        return cut
    assert cut[0][0] == len(text) - len(text.lstrip()) and cut[-1][1] == len(text.rstrip())
    for (s, e, n), nxt in zip(cut, cut[1:] + [None]):
        assert n == len(ENC.encode_ordinary(text[s:e])) <= limit and s < e
        if nxt:
            assert s < nxt[0] and e < nxt[1] and (nxt[0] <= e if overlap else not text[e : nxt[0]].strip())  # they overlap and move on
    return cut


@pytest.mark.parametrize("text", ["", " \n ", "a" * 3000, "word " * 900, "हिन्दी" * 400, "x\n" * 700, "😀" * 500, "a b c", "One two. " * 300 + "\n\n" + "Three four five. " * 200])
def test_pieces_hold(text):
    for limit, overlap in ((128, 16), (64, 0), (200, 40)):
        check(text, limit, overlap)


def test_natural_cuts_and_overlap():
    rnd = random.Random(3)
    sentence = lambda: " ".join(rnd.choice(["river", "stone", "lantern", "wolf"]) for _ in range(9)) + "."
    text = "\n\n".join(" ".join(sentence() for _ in range(5)) for _ in range(20))
    cut = check(text, 256, 24)
    ends = [text[e : e + 2] for _, e, _ in cut[:-1]]
    assert sum(x == "\n\n" for x in ends) >= len(ends) * 0.8 and all(text[e - 1] == "." for _, e, _ in cut)
    for (_, e, _), (s, _, _) in zip(cut, cut[1:]):
        assert 24 <= len(ENC.encode_ordinary(text[s:e])) <= 40


def test_no_division_is_cheaper():
    """The table of the dynamic programme against all divisions of a small text."""
    rnd = random.Random(8)
    for _ in range(20):
        n = 12
        size = np.array([rnd.randrange(3, 9) for _ in range(n)])
        upto, cost = np.cumsum(size), np.array([rnd.choice([0.0, 0.6, 1.0]) for _ in range(n)])
        limit, total = 25, int(size.sum())
        k = int(np.ceil(total / limit))
        even = total / max(1, k)

        def price(cuts):
            at, c = 0, 0.0
            for x in [*cuts, n]:
                w = int(size[at:x].sum())
                if w > limit:
                    return None
                c += pieces.BALANCE * ((w - even) / limit) ** 2 + (cost[x - 1] if x < n else 0)
                at = x
            return c

        best = min(p for m in range(2 ** (n - 1)) if (p := price([i + 1 for i in range(n - 1) if m >> i & 1])) is not None)
        got = pieces._divide(cost.copy(), upto, limit, 0)
        assert abs(price([e + 1 for _, e in got[:-1]]) - best) < 1e-9


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, "w " * 1300, 0), (2, "w " * 1200, 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, piece int")
    got = pieces.split_oversized(df, max_tokens=512, overlap=32, above_words=1200)
    assert {r.doc_id for r in got.collect()} == {1} and sorted(r.piece for r in got.collect()) == list(range(1, got.count() + 1))
    assert {r.doc_id for r in pieces.split_oversized(df, max_tokens=512, overlap=32).collect()} == {1, 2}
    with pytest.raises(ValueError):
        pieces.split_oversized(df, max_tokens=64, overlap=40)


def test_pieces_query_cuts_all_over_the_token_limit(spark, tmp_path):
    from folioframe.llm import queries

    texts = {1: "हिन्दी पुस्तक " * 500, 2: "w " * 1300, 3: "word " * 900, 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    over = {i for i, t in texts.items() if t and len(ENC.encode_ordinary(t)) > 1024}
    got = queries.p9_pieces(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == over == {1, 2} and all(r.n_tokens <= 1024 for r in got)
    assert {r.doc_id for r in queries.p9_found(spark, str(tmp_path)).collect()} == {2}


def test_limits_without_room_are_an_error():
    import numpy as np
    import pytest

    from folioframe.llm import pieces

    class Characters:
        """Text as one token a character, but alone two more."""

        def encode_ordinary(self, text):
            return [0] * (len(text) + (2 if len(text) < 50 else 0))

    with pytest.raises(ValueError):
        pieces.split_text("word " * 40, Characters(), np.array([1]), 4, 1)

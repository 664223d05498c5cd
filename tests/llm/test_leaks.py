import random

from folioframe.llm import leaks

VOCAB = [f"w{i}" for i in range(400)]


def brute(doc, item, window=25, share=0.9):
    """Longest common subsequence of every item window with the document."""
    for s in range(len(item) - window + 1):
        part = item[s : s + window]
        row = [0] * (len(part) + 1)
        for x in doc:
            old = 0
            for j, y in enumerate(part, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        if row[-1] >= window * share:
            return True
    return False


def make(spark):
    rnd = random.Random(9)
    item = [[rnd.choice(VOCAB) for _ in range(60)] for _ in range(6)]
    noise = lambda n: [rnd.choice(VOCAB) for _ in range(n)]
    docs = []
    for i in range(60):
        it = item[i % 6]
        kind = i % 5
        if kind == 0:
            body = it
        elif kind == 1:
            body = [w if k % 12 else "changed" for k, w in enumerate(it[10:50])]
        elif kind == 2:
            body = it[5:18] + noise(12) + it[18:34]
        elif kind == 3:
            body = it[:12]
        else:
            body = noise(40)
        docs.append((i, noise(30), body, noise(30)))
    return item, docs


def test_against_brute_force(spark):
    item, docs = make(spark)
    items = spark.createDataFrame([(100 + k, " ".join(w)) for k, w in enumerate(item)] + [(200, " ".join(item[0])), (300, "too short"), (301, None)], "item_id long, passage string")
    rows = [(i, (" ".join(a) + ".\r\n<p>" + " ".join(b).upper() + "</p>, " + " ".join(c)), 0) for i, a, b, c in docs] + [(900, None, 0), (901, "", 0), (0, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, items).collect()}
    want = {(i, 100 + k) for i, a, b, c in docs for k in range(6) if brute(a + b + c, item[k])}
    want |= {(i, 200) for i, k in want if k == 100}
    assert got == want and len({i for i, _ in want}) >= 30
    blocks = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, items, block_words=100).collect()}
    assert blocks == want
    assert leaks.leaked_items(d, items.where("false")).count() == 0 and leaks.leaked_items(d.where("false"), items).count() == 0


def found(spark, doc, item):
    d = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    i = spark.createDataFrame([(7, item)], "item_id long, passage string")
    return [r.n_words for r in leaks.leaked_items(d, i).collect()]


def test_pieces_gaps_and_changes_have_no_cap(spark):
    item = [f"v{i}" for i in range(40)]
    text = " ".join(item)
    lines = "\n".join(" ".join(item[i : i + 4]) + f"\nshare this page {i}" for i in range(0, 28, 4))
    assert found(spark, lines, text) == [25]
    assert found(spark, " ".join(item[:13]) + "\n" + "much text put in " * 2000 + ".\n" + " ".join(item[13:26]), text) == [25]
    assert found(spark, " ".join(item[:13]) + " Support us today! " + " ".join(item[13:26]), text) == [25]
    assert found(spark, " ".join(w for i, w in enumerate(item[:27]) if i not in (9, 18)), text) == [23]
    assert found(spark, " ".join(w + (" oh" if i in (18, 22) else "") for i, w in enumerate(item[:25])), text) == [23]
    assert found(spark, " ".join(w if i not in (6, 13) else "x" for i, w in enumerate(item[:25])), text) == [23]
    # Three changes, too few words, other order, or words put in that end no line and before too few words.
    assert found(spark, " ".join(w if i not in (6, 13, 20) else "x" for i, w in enumerate(item[:25])), text) == []
    assert found(spark, " ".join(item[:22]), text) == []
    assert found(spark, " ".join(item[13:26] + item[:12]), text) == []
    assert found(spark, " ".join(item[:9]) + " one two three four " + " ".join(item[9:13]) + " five six seven eight " + " ".join(item[13:20]), text) == []
    assert found(spark, " ".join(item[:13]) + " one two three four " + " ".join(item[13:26]), text) == [25]


def test_bounds_lose_no_window(spark):
    """Every pair that the exact check accepts passes the bounds before it."""
    rnd = random.Random(4)
    import numpy as np

    items = [(k, [rnd.choice(VOCAB[:60]) for _ in range(45)]) for k in range(8)]
    block = leaks.ItemBlock(items, 25, 0.9)
    block.set_rarity(np.array([rnd.randrange(9) for _ in range(block.mark + 1)]))
    m, hits = leaks.Matcher(block), 0
    for n in range(400):
        words = list(items[n % 8][1][rnd.randrange(10) : 38])
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randrange(2)] = [rnd.choice(VOCAB[:80])] * rnd.randrange(2)
        for _ in range(rnd.randrange(12)):
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(VOCAB) for _ in range(rnd.randrange(9))] + ["."]
        ids, fresh, at = leaks._numbered([" ".join(words)], block.vocabulary | {leaks.MARK: block.mark}, block.mark)
        pair, run, fresh = m.runs(ids, fresh)
        passed = set(m.candidates(ids, fresh, pair, run).tolist())
        for s in block.starts:
            if m.contained(ids, fresh, np.array([s])):
                hits += 1
                assert int(s) in passed
    assert hits > 500

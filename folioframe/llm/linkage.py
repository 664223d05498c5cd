"""Matching entities across sources without keys: works in two or more catalogues.

Label-model linkage.  Entries are reduced to distinct wordings.  Candidates share a blocking key
made of most of a title's words (one word left out), with the author where few words remain.
Keys are made of the words as they stand and of the words as they were meant: a word of four
letters or more stands for the most frequent word of the vocabulary that is an edit away from it, so
that any number of words may be mistyped.

Several matching functions vote on each candidate: same words but for typing errors, same
subtitle, letter pairs in common, the longest words, same volume and year, same surname, fitting
given names, shared author words.  A generative model explains the votes: a pair is one work if its title, its number and its
author are the same, three hidden facts with a joint distribution of their own, and each function
votes on one of them or abstains.  Expectation maximisation over the counts of vote patterns learns
how often each function votes which way under each state of its fact (its accuracy), and how much
functions of a field repeat each other beyond the fact (their correlation), for which they count
less.  The posterior of all three facts is the confidence of a pair.  That functions are better than
chance is a prior worth twenty votes; the counts outweigh it.

No group is compared with itself: wordings are joined by hashed keys with those of other sources
only, and entries come back by a join on their wording.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.fold import fold_array
from folioframe.llm.names import bare, given_likelihood, near, parse_name
from folioframe.session import Workspace, broadcast_if_small, spread

# Words of a title that carry no identity.
SMALL = frozenset("the a an and or of in on to by at for with from de la le les un une des du et d l der die das den dem ein eine einen und von vom zu el los las una unos y en o os as um uma e do da dos das em no na और व का की के में से".split())
# What catalogues add to a title.
ADDED = re.compile(
    r"\s*(?:[-–—:,;]\s*)?(?:\b(?:complete (?:text|edition|works?)|unabridged|illustrated(?: edition)?|annotated|abridged|a novel|a tale|"
    r"(?:\d+(?:st|nd|rd|th)|first|second|third|revised|new|large print) ed(?:ition|n)?|with (?:an? )?(?:preface|introduction|notes|illustrations|foreword)[^,;:]*)\b)\s*\.?\s*$"
)
VOLUME = re.compile(r"\b(?:volume|vol|v|part|pt|book|bk|band|bd|tome|tomo|teil|no|भाग)\b\.?\s*([0-9]{1,4}|[ivxlc]{1,7})\b")
YEAR = re.compile(r"\b(1[0-9]{3}|20[0-9]{2})\b")
_WORDS = re.compile(r"[^\s!-&(-@\[-`{-~।॥«»“”„‘’…–—¿¡]+")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _number(text: str) -> int:
    if text.isdigit():
        return int(text)
    values = [_ROMAN[c] for c in text]
    return sum(-v if any(v < w for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def _script(part: str) -> int:
    c = next((ord(c) for c in part if c.isalpha()), 0)
    return c // 0x80 if c >= 0x370 else 0


def parse_title(title: str | None) -> dict | None:
    """Words of the main and of the whole title (sorted sets), and its numbers."""
    if not title:
        return None
    s = re.sub(r",\s*(?:the|an?|le|la|les|der|die|das|el|los|las|o|os|as|um|uma|une?)\s*$", "", title.lower())
    if " / " in s:  # the same title in two alphabets: the last one's own
        parts = [p for p in s.split(" / ") if p.strip()]
        if len({_script(p) for p in parts}) > 1:
            s = parts[-1]
    kept = re.sub(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ", s)
    s = kept if re.search(r"\w", kept) else s
    for _ in range(3):
        cut = ADDED.sub("", s)
        if cut == s or not re.search(r"\w", cut):
            break
        s = cut
    numbers = [f"v{_number(m[1])}" for m in VOLUME.finditer(s)]
    s = VOLUME.sub(" ", s)
    numbers += [f"y{m[1]}" for m in YEAR.finditer(s)]
    s = YEAR.sub(" ", s)
    words = lambda t: [b for w in _WORDS.findall(t) if (b := bare(w).replace("'", "")) and b not in SMALL]
    main, whole = words(re.split(r"[:;]|, (?:or|ou|oder|o)\b", s, maxsplit=1)[0]), words(s)
    whole = whole or _WORDS.findall(s)
    main = main or whole
    if not whole:
        return None
    return {"main": sorted(set(main)), "whole": sorted(set(whole)), "numbers": sorted(set(numbers))}


def author_reading(authors: list[str] | None) -> dict:
    """The first of ``authors`` that names somebody and isn't a helper (translator and so on)."""
    out = {"sur": None, "given": [], "words": []}
    for a in authors or []:
        if not a or re.search(r"\((?:translat|edit|illustrat|introduc|compil|transl?\.|ed\.|tr\.|ill\.)[^)]*\)", a.lower()):
            continue
        if (r := parse_name(a)) is not None:
            if "org" in r:
                return {"sur": " ".join(r["org"]), "given": [], "words": r["org"]}
            return {"sur": r["sur"], "given": r["given"], "words": sorted({r["sur"], *r["given"]})}
    return out


_PARTS = ("main", "whole", "numbers", "given", "words")
_NODE = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in _PARTS] + [T.StructField("sur", T.StringType())])
_NODE_ARROW = pa.struct([*((c, pa.list_(pa.string())) for c in _PARTS), ("sur", pa.string())])


@F.arrow_udf(_NODE)
def _read_udf(titles: pa.Array, authors: pa.Array) -> pa.Array:
    names = fold_array(authors.flatten()).to_pylist() if len(authors.flatten()) else []
    reading = lru_cache(100_000)(lambda *given: author_reading(list(given)))
    out, at = [], 0
    for title, given in zip(fold_array(titles).to_pylist(), authors.to_pylist()):
        k = len(given or [])
        a = reading(*names[at : at + k])
        at += k
        t = parse_title(title)
        out.append(None if t is None else t | a)
    return pa.array(out, _NODE_ARROW)


# Else a filter on the result would run the function a second time, before the rows are spread.
_read_udf = _read_udf.asNondeterministic()


def meant_words(words: DataFrame, least: int = 4) -> DataFrame:
    """``(word, meant)`` for words that an edit may have made of a more frequent one.

    ``words``: one row per use of a ``word``.  Words of ``least`` letters and the words they become
    by leaving out one letter share a place if they are an edit (or a swap) apart; the most
    frequent word of a place is what the others stand for, if it is twice as frequent or they
    are rare.  The vocabulary is never compared with itself.
    """
    vocabulary = words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = F.length("word")
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    places = vocabulary.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), shorter))).alias("place"))
    top = places.groupBy("place").agg(F.max(F.struct("n", "word")).alias("top"))
    best = places.join(top, "place").groupBy("word").agg(F.max("top").alias("top"), F.max("n").alias("n"))
    better = (F.col("top.word") != F.col("word")) & ((F.col("top.n") >= 2 * F.col("n")) | (F.col("n") <= 3))
    return best.where(better).select("word", F.col("top.word").alias("meant"))


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def blocking_keys(main: Column, whole: Column, numbers: Column, author: Column, given: Column) -> Column:
    """``array<bigint>`` of the keys under which a wording looks for its like; see the module text."""
    n = F.size(main)
    rests = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.slice(main, 1, i), F.slice(main, i + 2, n)))  # the last leaves out none
    first = F.transform(F.array_distinct(F.filter(F.array(author, F.get(given, F.lit(0))), lambda x: x.isNotNull())), lambda x: F.substring(x, 1, 1))
    all_ = F.transform(F.sequence(F.lit(0), F.size(whole)), lambda i: F.concat(F.slice(whole, 1, i), F.slice(whole, i + 2, F.size(whole))))
    many = F.transform(F.filter(F.concat(rests, all_), lambda r: F.size(r) >= 3), lambda r: _key("l", r))
    few = F.filter(rests, lambda r: F.size(r).between(1, 2))
    named = F.transform(few, lambda r: _key("a", author, F.when(F.size(r) == 1, numbers).otherwise(F.array().cast("array<string>")), r))
    initial = F.flatten(F.transform(F.filter(few, lambda r: F.size(r) == 2), lambda r: F.transform(first, lambda c: _key("i", c, r))))
    full = F.array(_key("f", whole), _key("f", main))
    single = F.when(n == 1, F.array(_key("s", author, F.substring(main[0], 1, 1)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(full, many, F.when(author.isNotNull(), F.concat(named, initial, single)).otherwise(F.array().cast("array<bigint>"))))


@lru_cache(1_000_000)
def _edits(a: str, b: str, most: int) -> int:
    return near(a, b, most)


def _aligned(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Words left over in a and in b after equal ones and mistyped ones are paired; edits."""
    left, right, edits = [w for w in a if w not in b], [w for w in b if w not in a], 0
    for w in list(left):
        most = 2 if len(w) > 5 else 1
        best = min(((_edits(w, x, most), x) for x in right if min(len(w), len(x)) > 2), default=(9, ""))
        if best[0] <= most:
            left.remove(w), right.remove(best[1])
            edits += best[0]
    return len(left), len(right), edits


def _dice(a: str, b: str) -> float:
    """Share of pairs of neighbouring letters that two texts have in common."""
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return 2 * len(x & y) / max(1, len(x) + len(y))


def _within(word: str, words: list[str]) -> bool:
    most = 2 if len(word) > 5 else 1 if len(word) > 2 else 0
    return any(_edits(word, w, most) <= most for w in words)


def _agree(a: list[str], b: list[str]) -> str:
    """Whether the volumes and years of two titles agree; no vote where one title alone has such a number."""
    if a == b:
        return "+"
    kinds = {n[0] for n in a} & {n[0] for n in b}
    return "-" if any({n for n in a if n[0] == k} != {n for n in b if n[0] == k} for k in kinds) else "?"


def votes(a: dict, b: dict) -> str:
    """One letter per matching function: ``+`` for, ``-`` against, else no vote; fields split by a bar.

    Title: same words but for typing errors, same subtitle, pairs of letters in common, each
    one's longest word in the other.  Number: same volume and year.  Author: same surname,
    fitting given names, shared words.
    """
    sub = "0"
    if a["whole"] == b["whole"]:
        close = look = longest = "+"
    else:
        shared = _dice(" ".join(a["whole"]), " ".join(b["whole"]))
        shared = max(shared, _dice(" ".join(a["main"]), " ".join(b["main"])))
        look = "+" if shared >= 0.85 else "-" if shared < 0.7 else "0"
        inside = [_within(max(x["main"], key=len), y["whole"]) for x, y in ((a, b), (b, a))]
        longest = "+" if all(inside) else "0" if any(inside) else "-"
        ways = [_aligned(a["whole"], b["whole"])]
        titled = len(a["whole"]) > len(a["main"]) and len(b["whole"]) > len(b["main"])  # both with a subtitle
        if ways[0][0] + ways[0][1] and not titled:
            ways += [_aligned(a["main"], b["main"]), _aligned(a["main"], b["whole"]), _aligned(a["whole"], b["main"])]
        lo, ro, edits = min(ways, key=lambda w: (w[0] + w[1], w[2]))
        short = min(len(a["main"]), len(b["main"]))
        close = "-" if lo and ro or lo + ro > 1 else "+" if lo + ro == 0 and edits <= max(2, short) else "0"
        if titled:
            sub = "+" if ways[0][0] + ways[0][1] == 0 else "-"
    number = _agree(a["numbers"], b["numbers"])
    sur = given = words = "0"
    if a["sur"] and b["sur"]:
        org = not a["given"] and not b["given"] and (" " in a["sur"] or " " in b["sur"])
        turned = a["sur"] in b["given"] or b["sur"] in a["given"]
        if org:
            x, y, _ = _aligned(a["words"], b["words"])
            sur = "+" if x + y == 0 else "-"
        else:
            most = 2 if max(len(a["sur"]), len(b["sur"])) > 5 else 1
            sur = "+" if turned or _edits(a["sur"], b["sur"], most) <= most else "-"
            if turned and a["given"] and b["given"]:
                ga, gb = (a["given"], [b["sur"]]) if a["sur"] in b["given"] else ([a["sur"]], b["given"])
                given = "+" if given_likelihood(ga, gb) > -7 else "-"
            elif a["given"] and b["given"]:
                given = "+" if given_likelihood(a["given"], b["given"]) > -7 else "-"
            if (given == "-" or sur == "-") and (_turned(a, b) or _turned(b, a)):
                sur = given = "+"
        x, y, _ = _aligned(a["words"], b["words"])
        shared = min(len(a["words"]) - x, len(b["words"]) - y)
        words = "+" if shared > 1 else "0" if shared else "-"  # one word in common may be anybody's
    return f"{close}{sub}{look}{longest}|{number}|{sur}{given}{words}"


def _turned(a: dict, b: dict) -> bool:
    """``a`` read with its parts in the other order fits ``b``."""
    if not a["given"] or not b["given"]:
        return False
    most = 2 if len(b["sur"]) > 5 else 1
    return _edits(a["given"][0], b["sur"], most) <= most and given_likelihood([a["sur"]], b["given"]) > -7


@F.arrow_udf(T.StringType())
def _votes_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Votes on wordings as text: their parts by tabs, the words of a part by spaces."""
    read = lru_cache(200_000)(lambda s: dict(zip((*_PARTS, "sur"), [*(p.split(" ") if p else [] for p in s.split("\t")[:-1]), s.rsplit("\t", 1)[1]])))
    return pa.array([votes(read(x), read(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())


class LabelModel:
    """Hidden facts, one for each field, and functions that vote on them or abstain.

    Learned: ``prior``, the joint distribution of the facts; ``table``, for each function how often
    it votes yes where its fact fails and where it holds (its accuracy); and ``tie``, for each two
    functions of a field the part of what they say within a state of the fact that they share
    (their correlation).  A function counts for ``weight``: one, or less the more it repeats others.
    ``worth`` is what the belief that functions are right counts for beforehand, in votes, and
    ``belief`` the accuracy believed in.  Fewer than three functions of a field can't check each
    other, whatever the counts, so there the accuracy is a given one, ``alone``.  Abstaining says nothing.
    """

    def __init__(self, rounds: int = 500, worth: float = 20.0, belief: float = 0.98, alone: float = 0.995):
        self.rounds, self.worth, self.belief, self.alone = rounds, worth, belief, alone

    def fit(self, counts: dict[str, int]) -> LabelModel:
        """``counts``: vote pattern (fields split by bars, one letter per function) to its number."""
        self.patterns = sorted(counts)
        self.n = np.array([counts[p] for p in self.patterns], float)
        fields = [len(x) for x in self.patterns[0].split("|")]
        self.field = np.repeat(np.arange(len(fields)), fields)
        votes = [p.replace("|", "") for p in self.patterns]
        self.yes, self.no = (np.array([[v == c for v in x] for x in votes], float) for c in "+-")
        self.states = np.array(list(product((0, 1), repeat=len(fields))))
        by = np.eye(len(fields))[self.field]
        self.checked = (by.sum(0) >= 3)[self.field]
        leaning = 1 / (1 + (1 / self.belief - 1) ** ((self.yes - self.no) @ by))  # as the belief has it
        post = np.prod(np.where(self.states[None], leaning[:, None], 1 - leaning[:, None]), axis=2)
        post = self._learn(post)
        self.tie = self._ties(post)
        self.weight = 1 / (1 + self.tie.sum(1))
        self.post = self._posterior(self.weight)
        return self

    def _posterior(self, weight: np.ndarray) -> np.ndarray:
        said = weight * (self.yes[:, None] * np.log(self.table) + self.no[:, None] * np.log1p(-self.table))
        log = np.log(self.prior) + np.stack([said[:, s[self.field], np.arange(len(self.field))].sum(1) for s in self.states], 1)
        out = np.exp(log - log.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def _learn(self, post: np.ndarray) -> np.ndarray:
        believed = self.worth * np.array([[1 - self.belief, self.belief], [self.belief, 1 - self.belief]])  # yes and no, by state
        for _ in range(self.rounds):
            w = self.n[:, None] * post
            self.prior = (w.sum(0) + 1) / (w.sum() + len(self.states))
            holds = w @ self.states
            mass = np.stack([self.n[:, None] - holds, holds])[:, :, self.field]
            yes, no = (mass * self.yes).sum(1) + believed[0][:, None], (mass * self.no).sum(1) + believed[1][:, None]
            self.table = np.where(self.checked, yes / (yes + no), np.array([[1 - self.alone], [self.alone]]))
            new = self._posterior(np.ones(len(self.field)))
            moved = np.abs(new - post).max()
            post = new
            if moved < 1e-7:
                break
        return post

    def _ties(self, post: np.ndarray) -> np.ndarray:
        """For each two functions of a field: the information that their votes share within the states, of what the lesser has."""
        k = len(self.field)
        out = np.zeros((k, k))
        holds = post @ self.states
        for i, j in combinations(range(k), 2):
            if self.field[i] != self.field[j]:
                continue
            shared = least = 0.0
            for z in (0, 1):
                w = self.n * (holds if z else 1 - holds)[:, self.field[i]]
                joint = np.array([[(w * a * b).sum() for b in (self.yes[:, j], self.no[:, j])] for a in (self.yes[:, i], self.no[:, i])]) + 1e-9
                p = joint / self.n.sum()
                a, b = p.sum(1), p.sum(0)
                shared += (p * np.log(p * p.sum() / np.outer(a, b))).sum()
                least += min(-(a * np.log(a / p.sum())).sum(), -(b * np.log(b / p.sum())).sum())
            out[i, j] = out[j, i] = shared / max(least, 1e-9)
        return out

    def accuracy(self) -> list[tuple[float, float]]:
        """For each function how often it says no where its fact fails, and yes where it holds."""
        return list(zip((1 - self.table[0]).tolist(), self.table[1].tolist()))

    def confidence(self) -> dict[str, float]:
        """The posterior of all facts for each pattern."""
        return dict(zip(self.patterns, self.post[:, -1].tolist()))


def label_model(counts: dict[str, int]) -> dict[str, float]:
    """Posterior of a match for each vote pattern; see ``LabelModel``."""
    return LabelModel().fit(counts).confidence() if counts else {}


def link_sources(entries: DataFrame, least: float = 0.5) -> DataFrame:
    """``(rec_a, rec_b, confidence)``: pairs of entries of two sources that are one work.

    ``entries``: ``side`` (the source, numbered from 0), ``rec`` (unique over all sources),
    ``title`` and ``authors`` (array of strings).  Repeated rows are one entry; an entry with
    several wordings has them all.  Entries without title words match nothing; without a usable
    author the title decides.  ``rec_a < rec_b``.
    """
    e = entries.select("side", "rec", "title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors")).where(F.col("rec").isNotNull())
    with Workspace(entries.sparkSession) as work:
        members = work.materialise(e.withColumn("node", F.xxhash64("side", "title", "authors")).dropDuplicates(["rec", "node"]), "link-entries")
        nodes = work.materialise(
            spread(members.dropDuplicates(["node"])).select("node", "side", _read_udf("title", "authors").alias("r")).where("r is not null").select("node", "side", "r.*"),
            "link-nodes",
        )
        voted = work.materialise(_voted(work, nodes), "link-votes")
        # At most one row for each combination of votes.
        counts = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
        good = [(p, float(c)) for p, c in label_model(counts).items() if c >= least]
        table = entries.sparkSession.createDataFrame(good, "votes string, confidence double")
        linked = voted.join(F.broadcast(table), "votes").select("a", "b", "confidence")
        rec = members.select("node", "rec")
        return work.result(
            linked.join(rec.select(F.col("node").alias("a"), F.col("rec").alias("ra")), "a")
            .join(rec.select(F.col("node").alias("b"), F.col("rec").alias("rb")), "b")
            .groupBy(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))
            .agg(F.max("confidence").alias("confidence")),
            "links",
        )


def _voted(work: Workspace, nodes: DataFrame) -> DataFrame:
    """``(a, b, votes)`` of each candidate pair of wordings of two sources, ``a`` of the lower one."""
    used = nodes.select(F.explode("main").alias("word")).unionByName(nodes.select(F.explode("words").alias("word")))
    meant = broadcast_if_small(work.materialise(meant_words(used), "meant-words"))
    # Wordings that hold a mistyped word, with the words that were meant.
    word = nodes.select("node", F.explode(F.array_union("main", "words")).alias("word")).join(meant, "word")
    fixed = word.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("m"))
    keys = lambda right: blocking_keys(right(F.col("main")), right(F.col("whole")), F.col("numbers"), right(F.array("sur"))[0], right(F.col("given")))
    plain = nodes.select("node", "side", keys(lambda c: c).alias("keys"))
    mended = nodes.join(fixed, "node").select("node", "side", keys(lambda c: F.array_sort(F.transform(c, lambda x: F.coalesce(F.try_element_at("m", x), x)))).alias("keys"))
    keyed = work.materialise(plain.unionByName(mended).select("node", "side", F.explode("keys").alias("k")).distinct(), "link-keys")
    # Each wording looks under its keys in the sources after its own.
    last = nodes.agg(F.max("side")).first()[0] or 0
    left = keyed.where(F.col("side") < last).select(F.col("node").alias("a"), "k", F.explode(F.sequence(F.col("side") + 1, F.lit(last))).alias("side"))
    pairs = left.join(keyed.select(F.col("node").alias("b"), "k", "side"), ["k", "side"]).select("a", "b").distinct()
    text = F.concat_ws("\t", *[F.array_join(c, " ") for c in _PARTS], F.coalesce("sur", F.lit("")))
    body = nodes.select("node", text.alias("body"))
    both = pairs.join(body.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(body.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return spread(both).select("a", "b", _votes_udf("x", "y").alias("votes"))

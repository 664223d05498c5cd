"""Variant spellings of names typed by people: link the spellings of each person.

Noisy-channel attribution.  Spellings are counted; each is read as a name (surname, given
names, or the words of an organisation).  Frequent readings are the candidate canonical forms.
A rarer reading goes to the candidate with the highest posterior: the log frequency of the
candidate (prior) plus the log likelihood of the way from it to the spelling: reordered parts,
initials, abbreviations and nicknames cost little, typing errors cost per edit.  Surnames are
mended first, by their frequency with an initial; then the given names under each surname and
initial are attributed to persons.  Whether two unlike names there are two persons or one with an
odd spelling is weighed against how often frequent names are so in the whole table, and initials
go to a person only if no other is close.  Candidates are found through deletion neighbourhoods,
first letters and formal names, never by comparing a whole group with itself.

A name that names nobody (empty, anonymous, various and the like) belongs to no one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from folioframe.llm.fold import fold_array
from folioframe.session import Workspace, spread

# Words that name nobody.
NOBODY = frozenset("anon anonymous anonym anonyme anonimo anónimo anonymus unknown various varied traditional none nobody na n/a nil null unattributed unsigned author authors several collective misc miscellaneous tbd trad unbekannt inconnu desconocido desconhecido अज्ञात विविध लोक".split())
# Titles and suffixes that belong to no name.
TITLES = frozenset("dr sir rev revd reverend capt captain mr mrs ms miss prof professor lady lord hon col colonel gen general maj major lt st dame baron count countess madame mme mlle herr frau don doña sr sra fr bp pandit shri श्री डॉ jr jun junior sen esq phd md ma".split())
# Words that mark an organisation, with their usual abbreviations.
ORGANISATION = {
    "society": "soc", "association": "assoc assn ass'n assocn", "committee": "comm cttee comtee", "brotherhood": "bros brhd", "company": "co coy", "club": "", "guild": "",
    "institute": "inst", "institution": "instn", "union": "", "league": "", "board": "bd", "council": "", "department": "dept", "university": "univ", "college": "coll", "academy": "acad",
    "fellowship": "", "federation": "fed", "commission": "commn", "corporation": "corp", "press": "", "office": "", "bureau": "", "library": "lib", "museum": "mus", "foundation": "fdn", "sisterhood": "", "fraternity": "",
}
SMALL = frozenset("of the for and in on at a an de du des la le les et und der die das von zu y e & s".split())
# Short forms that don't begin like the name, or lose its beginning.
NICKNAMES = {
    "abigail": "abby gail nabby", "albert": "bert bertie", "alexander": "sandy alec alex sasha lex", "alfred": "fred alf", "amelia": "millie emmy", "andrew": "drew dandy", "ann": "nan nancy nanny annie", "anthony": "tony",
    "augustus": "gus gussie", "barbara": "babs barb barbie", "bartholomew": "bart", "benjamin": "ben benny", "bridget": "biddy", "caroline": "carrie lina caro", "catherine": "kate kitty kathy kit kay cathy", "charles": "charlie chas chuck", "charlotte": "lottie",
    "christopher": "kit chris", "daniel": "dan danny", "david": "dave davy", "dorothy": "dot dolly dora dottie", "edmund": "ned ted eddie ed", "edward": "ned ted teddy eddie ed", "eleanor": "nell nellie nelly ellie nora lenore", "elizabeth": "betty bess bessie beth eliza liz lizzie lisa betsy libby elsie",
    "emily": "em millie", "esther": "hetty essie", "florence": "flo florrie", "frances": "fanny fran", "francis": "frank", "frederick": "fred freddy freddie", "gabriel": "gabe", "george": "georgie", "gerald": "jerry", "gilbert": "gil bert", "harold": "hal harry", "harriet": "hattie hatty", "helen": "nell nellie",
    "helene": "nell lena", "henry": "harry hal hank", "herbert": "bert", "hugh": "hughie", "isaac": "ike", "isabella": "bella izzy belle ibby tibbie", "jacob": "jake", "james": "jim jimmy jem jamie", "jane": "jenny janet", "jeremiah": "jerry", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey", "jose": "pepe",
    "josephine": "jo josie", "katherine": "kate kitty kathy kit kay katie", "lawrence": "larry lawrie laurie lorry", "leonard": "len lenny", "louisa": "lou", "margaret": "peggy meg maggie madge daisy greta mag margie rita", "martha": "patty mattie", "mary": "molly polly may mamie", "matilda": "tilly", "matthew": "matt", "michael": "mike mick",
    "nathaniel": "nat nate", "nicholas": "nick nicky colin", "oliver": "ollie noll nolly", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "rebecca": "becky becca", "richard": "dick rick richie", "robert": "bob bobby rob robin bert", "rosamund": "rosie", "samuel": "sam sammy", "sarah": "sally sadie", "stephen": "steve",
    "susannah": "sue susie sukey susy", "theodore": "ted teddy theo", "thomas": "tom tommy", "ursula": "ursie", "victoria": "vicky vic tori", "walter": "wally walt wat", "william": "bill billy will willie", "winifred": "freda win",
}
# Written abbreviations that aren't a beginning of the name.
CONTRACTIONS = {"wm": "william", "jas": "james", "chas": "charles", "thos": "thomas", "geo": "george", "jno": "john", "saml": "samuel", "danl": "daniel", "robt": "robert", "benj": "benjamin", "nathl": "nathaniel", "margt": "margaret", "edwd": "edward", "richd": "richard", "jos": "joseph", "fredk": "frederick", "alexr": "alexander", "elizth": "elizabeth", "hy": "henry"}

#: Log likelihood of a variant that no rule explains, and the posterior from which initials are a person's.
ODD, SURE = -3.0, 0.8

_FORMAL: dict[str, tuple[str, ...]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL[_s] = (*_FORMAL.get(_s, ()), _name)
_ORG_WORDS = {a: full for full, short in ORGANISATION.items() for a in (full, *short.split())}
_LONG_SHORT = {a: full for a, full in _ORG_WORDS.items() if a != full and len(a) > 3 and a not in ("bros", "comm", "coll", "acad", "inst")}
_DATES = re.compile(r"[,(]?\s*(?:b\.|d\.|c\.|ca\.)?\s*\d{3,4}\??\s*(?:[-–—]\s*(?:\d{2,4}\??)?)?\s*\)?")


def bare(word: str) -> str:
    """Lower case without accents (marks that change a Devanagari letter stay)."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not 0x300 <= ord(c) < 0x370)


def letters(word: str) -> int:
    return sum(unicodedata.category(c)[0] == "L" for c in word)


def near(a: str, b: str, most: int) -> int:
    """Edits (with neighbour swaps) between two words, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


@lru_cache(500_000)
def _org_word(w: str) -> bool:
    """An organisation's word, perhaps mistyped."""
    return w in _ORG_WORDS or letters(w) > 5 and any(near(w, full, 2) <= 2 for full in ORGANISATION if len(full) > 6)


@lru_cache(500_000)
def _long_form(w: str) -> str:
    """The full word of a mistyped abbreviation; other words stay."""
    if w in _ORG_WORDS or len(w) < 4:
        return w
    return next((f for a, f in _LONG_SHORT.items() if w[0] == a[0] and w[-1] == a[-1] and near(w, a, 1) <= 1), w)


def parse_name(name: str | None) -> dict | None:
    """The reading of a folded name: ``org`` words, or ``sur`` and ``given``; else None.

    ``sure`` says that the order of the parts is known (a comma, a single word).
    """
    if not name:
        return None
    hint = re.findall(r"\(([^)]*)\)", name)
    s = re.sub(r"\([^)]*\)", " ", name)
    s = _DATES.sub(" ", s) if re.search(r"\d", s) else s
    parts = [[w for w in re.split(r"[\s.·/;_]+", bare(p)) if w] for p in s.split(",")]
    parts = [[w.strip("'’`\"-") for w in p if w.strip("'’`\"-")] for p in parts]
    parts = [p for p in parts if p]
    words = [w for p in parts for w in p]
    if not words or all(w in NOBODY or w in SMALL for w in words):
        return None
    extra = [w.strip("'’`\".") for h in hint for w in re.split(r"[\s.]+", bare(h)) if w.strip("'’`\".")]
    org = [w.replace("’", "'").removesuffix("'s").rstrip("'") for w in words + extra]
    if len(org) > 1:
        org = [_long_form(w) for w in org]
    if any(w in _ORG_WORDS for w in org) or len(words) > 1 and any(_org_word(w) for w in org):
        kept = [_ORG_WORDS.get(w, w) for w in org if w not in SMALL]
        return {"org": sorted(set(kept))}
    if len(parts) > 1:
        given = [w for p in parts[1:] for w in p if w not in TITLES]
        sur = [w for w in parts[0] if w not in TITLES] or parts[0]
        if not given:
            given, sur = sur[:-1], sur[-1:]
        sure = True
    else:
        kept = [w for i, w in enumerate(words) if w not in TITLES or len(words) - i <= 1]
        while len(kept) > 2 and kept[-1] in TITLES:
            kept.pop()
        given, sur = kept[:-1], kept[-1:]
        sure = len(kept) < 2 or len(given[0]) == 1
    first = extra[0] if extra and given and len(given[0]) == 1 and extra[0][0] == given[0] else None
    if first:
        given = [first, *given[1:]]
    given = [CONTRACTIONS.get(w, w) for w in given]
    return {"sur": " ".join(sur), "given": given, "sure": sure}


def initials_of(given: list[str]) -> list[str]:
    """First letters the first given name can stand for; formal names of nicknames first."""
    if not given:
        return [""]
    g = given[0]
    out = [f[0] for f in _FORMAL.get(g, ())]
    return list(dict.fromkeys([*out, g[0]]))


_NAME = T.StructType(
    [
        T.StructField("org", T.ArrayType(T.StringType())), T.StructField("sur", T.StringType()), T.StructField("given", T.ArrayType(T.StringType())), T.StructField("sure", T.BooleanType()),
    ]
)
_NAME_ARROW = pa.struct([("org", pa.list_(pa.string())), ("sur", pa.string()), ("given", pa.list_(pa.string())), ("sure", pa.bool_())])


@F.arrow_udf(_NAME)
def _parse_udf(names: pa.Array) -> pa.Array:
    none = {"org": None, "sur": None, "given": None, "sure": None}
    return pa.array([none | r if (r := parse_name(n)) else None for n in fold_array(names).to_pylist()], _NAME_ARROW)


# Else a filter on the result would run the function a second time, before the rows are spread.
_parse_udf = _parse_udf.asNondeterministic()


def parsed_name(column: Column | str) -> Column:
    """Struct ``(org, sur, given, sure)`` of a name column, null where it names nobody."""
    return _parse_udf(column)


def deletions(word: str, most: int) -> set[str]:
    """The word and what is left of it after up to ``most`` deletions."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def edits_allowed(word: str) -> int:
    n = letters(word)
    return 2 if n >= 8 else 1 if n >= 6 else 0


@F.arrow_udf(T.ArrayType(T.StringType()))
def _near_keys(words: pa.Array) -> pa.Array:
    return pa.array([sorted(deletions(w, edits_allowed(w))) if w else [] for w in words.to_pylist()], pa.list_(pa.string()))


def abbreviates(short: str, full: str) -> bool:
    """``short`` is the beginning of ``full``, or some of its letters in order from the first on."""
    if not 1 < len(short) < len(full) or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def given_likelihood(a: list[str] | None, b: list[str] | None) -> float:
    """Log likelihood that ``a`` was written for the given names ``b``, or the other way round."""
    if not a or not b:
        return -1.5
    x, y = a[0], b[0]
    if x == y:
        return 0.0
    if len(x) == 1 or len(y) == 1:
        one, full = (x, y) if len(x) == 1 else (y, x)
        return -1.0 if full[0] == one else -2.0 if any(f[0] == one for f in _FORMAL.get(full, ())) else -12.0
    if x in _FORMAL and y in _FORMAL[x] or y in _FORMAL and x in _FORMAL[y] or set(_FORMAL.get(x, "")) & set(_FORMAL.get(y, "")):
        return -2.0
    if abbreviates(x, y) or abbreviates(y, x):
        return -1.5
    if min(letters(x), letters(y)) >= 4 and (d := near(x, y, 2)) <= (2 if min(letters(x), letters(y)) >= 6 else 1):
        return -3.0 * d
    return -12.0


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of frames that have a row per key under which a name may be found.

    Merged, never broadcast: the planner sizes such a frame as the names before the keys, a
    hundredth of its rows, and would send through the driver what has no bound.
    """
    return left.hint("merge").join(right, on)


def person_keys(work: Workspace, spellings: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """``(name, entity)`` of each distinct spelling that names somebody.

    ``spellings`` has one row per distinct ``name`` and its frequency ``n``.
    """
    read = work.materialise(
        spread(spellings).select(F.col(name).alias("name"), F.col(n).cast("double").alias("n"), parsed_name(name).alias("r")).where("r is not null").select("name", "n", "r.*"),
        "names-read",
    )
    people = _people(work, read.where("sur is not null"))
    orgs = _organisations(work, read.where("org is not null"))
    return people.unionByName(orgs)


def _people(work: Workspace, read: DataFrame) -> DataFrame:
    # Which words serve as given names and which as surnames, where the order is plain.
    word = read.where(F.size("given") > 0).select(
        "n", "sure", F.explode(F.array(F.struct(F.col("given")[0].alias("w"), F.lit(1).alias("g")), F.struct(F.col("sur").alias("w"), F.lit(0).alias("g")))).alias("x")
    )
    use = word.groupBy(F.col("x.w").alias("w")).agg(
        F.count_if(F.col("x.g") == 1).cast("double").alias("as_given"), F.count_if(F.col("x.g") == 0).cast("double").alias("as_sur")
    )
    use = work.materialise(use, "name-words")
    a = use.select(F.col("w").alias("sur"), F.col("as_given").alias("sg"), F.col("as_sur").alias("ss"))
    b = use.select(F.col("w").alias("g1"), F.col("as_given").alias("gg"), F.col("as_sur").alias("gs"))
    x = read.withColumn("g1", F.get("given", F.lit(0))).join(a, "sur", "left").join(b, "g1", "left")
    c = lambda k: F.coalesce(k, F.lit(0.0)) + 0.5
    plain = F.log(c("gg")) + F.log(c("ss"))
    turned = F.log(c("sg")) + F.log(c("gs")) - F.lit(0.7)
    swap = ~F.col("sure") & (F.size("given") > 0) & (turned > plain)
    x = x.select(
        "name", "n", F.when(swap, F.col("g1")).otherwise(F.col("sur")).alias("sur"),
        F.when(swap, F.concat(F.slice("given", 2, F.greatest(F.size("given") - 1, F.lit(0))), F.array("sur"))).otherwise(F.col("given")).alias("given"),
    )
    x = work.materialise(x.withColumn("initials", _initials_udf("given")), "names-parts")
    # Blocks: surname and first initial.  A nickname is read as the person its formal name
    # gives, if that person occurs; the most frequent one of several.
    literal = x.where(F.size("initials") == 1).groupBy("sur", F.col("initials")[0].alias("i")).agg(F.sum("n").alias("freq"))
    nick = x.where(F.size("initials") > 1).select("name", "n", "sur", "given", F.posexplode("initials").alias("p", "i"))
    own = (
        nick.join(literal, ["sur", "i"], "left")
        .withColumn("score", F.log(F.coalesce("freq", F.lit(0.0)) + 0.01) - F.col("p") * 0.5 - F.when(F.col("i") == F.substring(F.col("given")[0], 1, 1), 2.5).otherwise(0.0))
        .groupBy("name").agg(F.max_by(F.struct("i"), F.struct("score", -F.col("p"))).alias("b"), F.first("n").alias("n"), F.first("sur").alias("sur"), F.first("given").alias("given"))
        .select("name", "n", "sur", "given", F.col("b.i").alias("i"))
    )
    read1 = x.where(F.size("initials") == 1).select("name", "n", "sur", "given", F.col("initials")[0].alias("i")).unionByName(own)
    persons = read1.groupBy("sur", "i").agg(
        F.sum("n").alias("freq"), F.max_by("given", F.struct(F.when(F.length(F.get("given", F.lit(0))) > 1, F.col("n")).otherwise(0.0), F.col("name"))).alias("given")
    )
    persons = work.materialise(persons, "persons")
    # The channel for surnames: which block may a rarer one be a misspelling of.
    keyed = persons.select("sur", "i", "freq", "given", F.explode(_near_keys("sur")).alias("k"))
    left = keyed.select("k", "i", *[F.col(c).alias(f"v_{c}") for c in ("sur", "freq", "given")])
    right = keyed.select("k", "i", *[F.col(c).alias(f"c_{c}") for c in ("sur", "freq", "given")])
    typed = (
        _meet(left, right, ["k", "i"])
        .where((F.col("v_sur") != F.col("c_sur")) & ((F.col("c_freq") > F.col("v_freq")) | ((F.col("c_freq") == F.col("v_freq")) & (F.col("c_sur") < F.col("v_sur")))))
        .select("v_sur", F.col("i").alias("v_i"), "v_freq", "v_given", "c_sur", F.col("i").alias("c_i"), "c_freq", "c_given")
    )
    # A given name mistyped in its first letter, under the very surname.
    rare, full = persons.where(F.length(F.get("given", F.lit(0))) > 3), persons.where(F.length(F.get("given", F.lit(0))) > 3)
    first = (
        rare.select(F.col("sur").alias("v_sur"), F.col("i").alias("v_i"), F.col("freq").alias("v_freq"), F.col("given").alias("v_given"))
        .join(full.select(F.col("sur").alias("c_sur"), F.col("i").alias("c_i"), F.col("freq").alias("c_freq"), F.col("given").alias("c_given")), F.col("v_sur") == F.col("c_sur"))
        .where((F.col("v_i") != F.col("c_i")) & (F.col("c_freq") > F.col("v_freq")) & (F.levenshtein(F.col("v_given")[0], F.col("c_given")[0], 2) >= 0))
    )
    scored = (
        spread(typed.unionByName(first.select(typed.columns)).distinct())
        .withColumn("ll", _channel_udf("v_sur", "c_sur", "v_given", "c_given"))
        .withColumn("gain", F.col("ll") + F.log("c_freq") - F.log("v_freq"))
        .where(F.col("ll") > -11.0)
    )
    parent = scored.groupBy("v_sur", "v_i").agg(F.max_by(F.struct("c_sur", "c_i"), F.struct("gain", "c_freq", "c_sur")).alias("to"))
    parent = parent.select(F.struct(F.col("v_sur").alias("sur"), F.col("v_i").alias("i")).alias("v"), F.struct(F.col("to.c_sur").alias("sur"), F.col("to.c_i").alias("i")).alias("to"))
    root = roots(work, parent)
    block = F.coalesce("to", F.struct("sur", "i"))
    placed = read1.join(root, F.struct("sur", "i") == F.col("v"), "left").select("name", "n", F.concat_ws("|", block["sur"], block["i"]).alias("block"), F.coalesce(F.get("given", F.lit(0)), F.lit("")).alias("g"))
    return _persons_of_blocks(work, work.materialise(placed, "name-blocks"))


def roots(work: Workspace, parent: DataFrame) -> DataFrame:
    """``(v, to)`` with ``to`` the end of each chain of ``parent``; every round doubles the steps until nothing changes.

    Chains climb in frequency, so they have no circles.
    """
    at = work.materialise(parent, "parents")
    while True:
        up = at.select(F.col("v").alias("to"), F.col("to").alias("up"))
        on = at.join(up, "to", "left").select("v", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved"))
        at = work.materialise(on, "parents")
        if at.where("moved").isEmpty():
            return at.select("v", "to")


def _persons_of_blocks(work: Workspace, placed: DataFrame) -> DataFrame:
    """``(name, entity)``: the persons within each block of one surname and initial.

    Full given names are spellings of the more frequent one with the highest posterior (nickname,
    abbreviation, typing errors).  Names that are unlike all others of their block are another
    person's, unless that is rarer than an odd variant: how often two frequent given names of a
    block are unlike is learned from all blocks.  Initials go to the person who has four fifths
    of the block's posterior, and stay apart where it is closer.
    """
    full = placed.where(F.length("g") > 1).groupBy("block", "g").agg(F.sum("n").alias("freq"))
    rank = F.row_number().over(W.partitionBy("block").orderBy(F.desc("freq"), "g"))
    full = work.materialise(full.withColumn("r", rank), "given-names")
    top = full.where("r = 1").select("block", F.col("g").alias("top"), F.col("freq").alias("top_freq"))
    # Homonyms: of blocks with two frequent full names, the part where they are unlike.
    second = full.where("r = 2 and freq >= 2").join(top, "block").select(_alike_udf(F.array("g"), F.array("top")).alias("ll"))
    unlike, blocks = second.agg(F.count_if(F.col("ll") <= -7)).first()[0], top.where("top_freq >= 4").count()
    homonym = (unlike + 0.5) / (blocks + 1.0)
    v = full.select("block", F.col("g").alias("v"), F.col("freq").alias("vf"), F.explode(F.concat(_given_keys("g"), F.array(F.lit("top")))).alias("k"))
    c = full.select("block", F.col("g").alias("c"), F.col("freq").alias("cf"), F.explode(F.concat(_given_keys("g"), F.when(F.col("r") == 1, F.array(F.lit("top"))).otherwise(F.array().cast("array<string>")))).alias("k"))
    pairs = _meet(v, c, ["block", "k"]).where((F.col("cf") > F.col("vf")) | ((F.col("cf") == F.col("vf")) & (F.col("c") < F.col("v")))).select("block", "v", "vf", "c", "cf", (F.col("k") == "top").alias("is_top")).groupBy("block", "v", "vf", "c", "cf").agg(F.max("is_top").alias("is_top"))
    scored = spread(pairs).withColumn("ll", _alike_udf(F.array("v"), F.array("c")))
    # A short name an edit away may be another name: only a much rarer one is a spelling of it.
    short = (F.least(F.length("v"), F.length("c")) < 6) & (F.col("ll") <= -3) & (F.col("ll") > -7) & (F.col("cf") < 3 * F.col("vf"))
    odd = F.lit(ODD) + F.log(F.col("cf") / (F.col("cf") + F.col("vf")))
    ll = F.when((F.col("ll") > -7) & ~short, F.col("ll")).when(F.col("is_top") & (odd > float(np.log(homonym))), odd)
    key = lambda g: F.struct("block", F.col(g).alias("g"))
    parent = scored.withColumn("ll", ll).where("ll is not null").groupBy(key("v").alias("v")).agg(F.max_by(key("c"), F.struct(F.col("ll") + F.log("cf"), "c")).alias("to"))
    root = roots(work, parent)
    person = full.join(root, F.struct("block", "g") == F.col("v"), "left").select("block", "g", "freq", F.coalesce("to.g", "g").alias("person"))
    person = work.materialise(person, "given-persons")
    share = person.groupBy("block", "person").agg(F.sum("freq").alias("f")).groupBy("block").agg(F.max_by("person", F.struct("f", "person")).alias("best"), (F.max("f") / F.sum("f")).alias("share"))
    initial = share.where(F.col("share") >= SURE).select("block", "best")
    return (
        placed.join(person.select("block", "g", "person"), ["block", "g"], "left").join(initial, "block", "left")
        .select("name", F.concat_ws("|", F.lit("p"), "block", F.when(F.length("g") > 1, F.col("person")).when(F.length("g") == 1, F.coalesce("best", F.lit(""))).otherwise("")).alias("entity"))
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _given_keys(names: pa.Array) -> pa.Array:
    """What spellings of one given name share: deletions, the first letters, formal names."""
    out = []
    for g in names.to_pylist():
        formal = (g, *_FORMAL.get(g, ()))
        out.append(sorted({*(f"d {d}" for d in deletions(g, 1)), f"p {g[:2]}", *(f"n {f}" for f in formal)}))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.DoubleType())
def _alike_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([given_likelihood(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


_alike_udf = _alike_udf.asNondeterministic()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _initials_udf(given: pa.Array) -> pa.Array:
    return pa.array([initials_of(g or []) for g in given.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.DoubleType())
def _channel_udf(v_sur: pa.Array, c_sur: pa.Array, v_given: pa.Array, c_given: pa.Array) -> pa.Array:
    out = []
    for a, b, g, h in zip(v_sur.to_pylist(), c_sur.to_pylist(), v_given.to_pylist(), c_given.to_pylist()):
        most = edits_allowed(b) if a != b else 0
        d = near(a, b, 2) if a != b else 0
        out.append(-99.0 if d > most else -3.0 * d + given_likelihood(g, h))
    return pa.array(out, pa.float64())


_channel_udf = _channel_udf.asNondeterministic()


def _organisations(work: Workspace, read: DataFrame) -> DataFrame:
    """Organisations are their words in any order; the rarer form goes to the more frequent."""
    forms = read.groupBy("org").agg(F.sum("n").alias("freq"))
    df = _org_words(forms)
    rarest = (
        forms.select("org", F.explode("org").alias("w")).join(df, "w").groupBy("org")
        .agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("df", "w"))), 1, 2), lambda x: x["w"]).alias("keys"))
    )
    forms = work.materialise(forms.join(rarest, "org"), "organisations")
    pairs = _org_pairs(work, forms)
    parent = pairs.groupBy("v").agg(F.max_by("c", F.struct(F.col("ll") + F.log("cf"), F.col("c").cast("string"))).alias("to"))
    step = roots(work, parent)
    return read.join(step, F.col("org") == F.col("v"), "left").select("name", F.concat_ws("|", F.lit("o"), F.array_join(F.coalesce("to", "org"), " ")).alias("entity"))


def _org_words(forms: DataFrame) -> DataFrame:
    """``(w, df)``: in how many forms a word stands."""
    return forms.select(F.explode("org").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))


def _org_pairs(work: Workspace, forms: DataFrame) -> DataFrame:
    """``(v, vf, c, cf, ll)``: forms of ``(org, freq, keys)`` that may be spellings of a more frequent one.

    Each word of ``v`` is then written for a word of ``c``, so the pairs are looked up by one word
    of ``v``: the one whose counterparts stand in the fewest forms.  Words that thousands of
    organisations have (society, historical) bring nothing together.
    """
    df = work.materialise(_org_words(forms), "organisation-words")
    w = df.select("w", F.explode(_counterpart_keys("w", F.lit(False))).alias("k"))
    x = df.select(F.col("w").alias("x"), "df", F.explode(_counterpart_keys("w", F.lit(True))).alias("k"))
    near_words = _meet(w, x, ["k"]).select("w", "x", "df").distinct().transform(spread).where(_counterparts_udf("w", "x"))
    near_words = work.materialise(near_words, "organisation-counterparts")
    mass = near_words.groupBy("w").agg(F.sum("df").alias("mass"))
    rarest = forms.select("org", F.explode("org").alias("w")).join(mass, "w").groupBy("org").agg(F.min_by("w", F.struct("mass", "w")).alias("w"))
    a = forms.join(rarest, "org").select("w", F.col("org").alias("v"), F.col("freq").alias("vf"), F.col("keys").alias("v_keys"))
    b = forms.select(F.explode("org").alias("x"), F.col("org").alias("c"), F.col("freq").alias("cf"), F.col("keys").alias("c_keys"))
    return (
        _meet(a.join(near_words.select("w", "x"), "w"), b, ["x"])
        .where((F.size("v") == F.size("c")) & (F.col("v") != F.col("c")) & ((F.col("cf") > F.col("vf")) | ((F.col("cf") == F.col("vf")) & (F.col("c").cast("string") < F.col("v").cast("string")))))
        .transform(spread).withColumn("ll", _org_udf("v", "c", "v_keys", "c_keys")).where(F.col("ll") > -13.0)
        .select("v", "vf", "c", "cf", "ll").distinct()
    )


def counterparts(w: str, x: str) -> bool:
    """``w`` may be written for ``x`` in an organisation's name."""
    return w == x or letters(w) > 4 and near(w, x, 2) <= 2 or abbreviates(w, x) and len(w) >= 3 or abbreviates(x, w) and len(x) >= 3


@F.arrow_udf(T.BooleanType())
def _counterparts_udf(w: pa.Array, x: pa.Array) -> pa.Array:
    return pa.array([counterparts(a, b) for a, b in zip(w.to_pylist(), x.to_pylist())], pa.bool_())


_counterparts_udf = _counterparts_udf.asNondeterministic()


def counterpart_keys(word: str, other: bool) -> set[str]:
    """What a word shares with each of its counterparts (``other``: the key of a counterpart): itself,
    deletions, and three letters in order, as an abbreviation or as the full word."""
    short, full = "fs" if other else "sf"
    out = {f"= {word}", *(f"d {d}" for d in deletions(word, 2))}
    if len(word) > 2:
        out |= {f"{short} {word[:3]}", *(f"{full} {word[0]}{a}{b}" for a, b in combinations(word[1:], 2))}
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _counterpart_keys(words: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([sorted(counterpart_keys(w, o)) for w, o in zip(words.to_pylist(), other.to_pylist())], pa.list_(pa.string()))


@lru_cache(100_000)
def _org_keys(word: str) -> set[str]:
    return deletions(word, edits_allowed(word))


@F.arrow_udf(T.DoubleType())
def _org_udf(v: pa.Array, c: pa.Array, v_keys: pa.Array, c_keys: pa.Array) -> pa.Array:
    """Log likelihood of forms that meet under their two rarest words, as one of them may be mistyped or abbreviated."""
    out = []
    for a, b, k, m in zip(v.to_pylist(), c.to_pylist(), v_keys.to_pylist(), c_keys.to_pylist()):
        if all(_org_keys(x).isdisjoint(_org_keys(y)) for x in k for y in m):
            out.append(-99.0)
            continue
        left, right = [w for w in a if w not in b], [w for w in b if w not in a]
        cost = 0.0
        for w in left:
            best = min(((near(w, x, 2) if letters(w) > 4 else 9, x) for x in right), default=(9, ""))
            short = next((x for x in right if abbreviates(w, x) and len(w) >= 3 or abbreviates(x, w) and len(x) >= 3), None)
            if short:
                cost, _ = cost - 1.5, right.remove(short)
            elif best[0] <= 2:
                cost, _ = cost - 3.0 * best[0], right.remove(best[1])
            else:
                cost = -99.0
        out.append(cost)
    return pa.array(out, pa.float64())


_org_udf = _org_udf.asNondeterministic()


def variant_pairs(df: DataFrame, name: str, left: str = "author_a", right: str = "author_b") -> DataFrame:
    """``(left, right)``: pairs of different strings of ``name`` for one person, left < right.

    Null, empty and nobody's names never pair; repeated rows count as frequency.
    """
    with Workspace(df.sparkSession) as work:
        spellings = df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        keys = work.materialise(person_keys(work, work.materialise(spellings, "spellings")), "name-entities")
        a = keys.select("entity", F.col("name").alias(left))
        b = keys.select("entity", F.col("name").alias(right))
        return work.result(a.join(b, "entity").where(F.col(left) < F.col(right)).select(left, right), "name-pairs")

"""Names of organisations as bags of canonical words, and the words' weighted soft similarity."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.addresses import near, plain
from gleanwork.operators.skew import join_group_facts, join_salted, shuffled
from gleanwork.session import cut

#: Short forms in names of organisations.
WORD_FORMS = {
    "svc": "services", "svcs": "services", "serv": "services", "service": "services", "proll": "payroll", "mgmt": "management", "mgt": "management", "assoc": "associates", "assocs": "associates",
    "med": "medical", "bldg": "building", "exec": "executive", "bros": "brothers", "ptnrs": "partners", "lang": "language", "int": "international", "intl": "international",
    "center": "centre", "ctr": "centre", "rec": "recruitment", "recruit": "recruitment", "educ": "education", "edu": "education", "viz": "visualisation", "visualization": "visualisation",
    "sols": "solicitors", "solrs": "solicitors", "log": "logistics", "logist": "logistics", "const": "construction", "constr": "construction", "cons": "consulting", "consltg": "consulting",
    "softw": "software", "sw": "software", "accting": "accounting", "acctg": "accounting", "adv": "advisers", "advisors": "advisers", "sys": "systems", "des": "design", "intnl": "international",
}
#: Familiar forms of given names.
GIVEN_NAMES = {
    "dick": "richard", "rick": "richard", "sue": "susannah", "bill": "william", "will": "william", "kit": "christopher", "chris": "christopher", "peggy": "margaret", "meg": "margaret", "maggie": "margaret",
    "dot": "dorothy", "dotty": "dorothy", "ted": "edward", "ned": "edward", "ed": "edward", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "toni": "antonia", "fred": "frederick", "freddie": "frederick", "bob": "robert", "rob": "robert",
    "theo": "theodore", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "josie": "josephine", "jo": "josephine", "ben": "benjamin", "nat": "nathaniel", "nate": "nathaniel", "vicky": "victoria", "vicki": "victoria", "tori": "victoria",
    "sasha": "alexander", "alex": "alexander", "sandy": "alexander",
}
#: Words that do not tell organisations apart.
IGNORED = frozenset("the and ltd inc llc limited pvt private co gmbh company group plc corp corporation dr doctor mr mrs ms prof home welcome index contact about us untitled".split())
_TAG_LINE = re.compile(r"\s[–—|\-]+\s")
#: Words this far apart at most may be one word mistyped.
LONG_WORD = 9


def sound(word: str) -> str:
    """One spelling for those that sound alike."""
    return word.replace("ck", "k").replace("ks", "x").replace("ph", "f").translate(str.maketrans("yw", "iv"))


@lru_cache(1 << 16)
def _spelled_out(word: str) -> str:
    """The full form of a short one, also of a short one mistyped."""
    full = WORD_FORMS.get(word) or GIVEN_NAMES.get(word)
    if not full and 4 <= len(word) <= 6 and word not in IGNORED:
        close = {WORD_FORMS[k] for k in WORD_FORMS if len(k) >= 4 and word[0] == k[0] and (len(word) != len(k) or len(k) >= 6) and near(word, k, 1)}
        full = close.pop() if len(close) == 1 else None
    return full or word


def words_of(name: str | None) -> list[str]:
    """The canonical words of a name in their order, without tag line, legal form and courtesy title."""
    s = _TAG_LINE.split(plain((name or "").strip()), maxsplit=1)[0]
    s = re.sub(r"(?<=[a-z])[-‐‑](?=[a-z])", "", re.sub(r"[.'’`/]", "", s))
    return [sound(w) for w in map(_spelled_out, re.findall(r"[a-z0-9]+", s)) if w not in IGNORED]


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_words(names: pd.Series) -> pd.Series:
    return names.map(words_of)


@lru_cache(1 << 17)
def alike(a: str, b: str) -> float:
    """Likeness of two words: 1 if equal, less for a typing error or an initial, else 0."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.85 if a[0] == b[0] and len(a) != len(b) else 0.0
    if min(len(a), len(b)) < 4:
        return 0.0
    if near(a, b, 1):
        return 0.95
    return 0.85 if min(len(a), len(b)) >= LONG_WORD and near(a, b, 2) else 0.0


@lru_cache(1 << 17)
def one_error(torn: str, whole: str) -> float:
    """Likeness of a word torn apart and a whole one."""
    return 1.0 if torn == whole else 0.95 if len(whole) > 4 and near(torn, whole, 1) else 0.0


def soft_similarity(a: list[str], b: list[str], weight_a: list[float], weight_b: list[float]) -> float:
    """Weight of the words that have a like word on the other side, as a share of all weight.

    Two words next to each other may stand for one that was torn apart, with one typing error at most.
    """
    if not a or not b:
        return 0.0
    options = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if s := alike(x, y):
                options.append((s * (weight_a[i] + weight_b[j]), (i,), (j,)))
    for swapped, (p, q, wp, wq) in enumerate(((a, b, weight_a, weight_b), (b, a, weight_b, weight_a))):
        for i in range(len(p) - 1):
            torn = p[i] + p[i + 1]
            if min(len(p[i]), len(p[i + 1])) < 2 or len(torn) < 5:
                continue
            for j, y in enumerate(q):
                if abs(len(torn) - len(y)) > 1 or torn[0] != y[0] and torn[-1] != y[-1]:
                    continue
                if (s := one_error(torn, y)) and not alike(p[i], y) and not alike(p[i + 1], y):
                    x = (s * (2 * wq[j] + wp[i] + wp[i + 1]) * 0.999, (i, i + 1), (j,))
                    options.append(x if not swapped else (x[0], x[2], x[1]))
    used_a, used_b, got = set(), set(), 0.0
    total_a, total_b = sum(weight_a), sum(weight_b)
    for value, i, j in sorted(options, reverse=True):
        if used_a.isdisjoint(i) and used_b.isdisjoint(j):
            used_a.update(i)
            used_b.update(j)
            if len(i) != len(j):
                # a torn word weighs as the whole one
                parts = (sum(weight_a[k] for k in i), sum(weight_b[k] for k in j))
                whole = parts[0] if len(i) == 1 else parts[1]
                total_a += whole - parts[0]
                total_b += whole - parts[1]
                value = whole * 2 * 0.97
            got += value
    return got / max(total_a + total_b, 1e-9)


def _lists(col: pa.Array) -> list[list]:
    """The lists of a column, taken out of Arrow in one piece."""
    flat, out, at = col.flatten().to_pylist(), [], 0
    for n in col.value_lengths().to_pylist():
        out.append(flat[at : at + n])
        at += n
    return out


def _list_column(lists: list[list], kind: pa.DataType) -> pa.Array:
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([v for x in lists for v in x], kind))


@F.arrow_udf(T.DoubleType())
def _similarity(a: pa.Array, b: pa.Array, weight_a: pa.Array, weight_b: pa.Array) -> pa.Array:
    return pa.array([soft_similarity(*x) for x in zip(_lists(a), _lists(b), _lists(weight_a), _lists(weight_b))], pa.float64())


def _weight(names: Column, total: int) -> Column:
    return F.log(1 + F.lit(float(total)) / names)


def weigh(names: DataFrame) -> DataFrame:
    """``names`` (block, words) with ``weights``: the rarer a word among the distinct names, the more."""
    total = names.count()
    single = names.withColumn("name", F.struct("block", "words"))
    each = single.select("name", F.posexplode("words").alias("at", "word"))
    counts = each.groupBy("word").agg(F.countDistinct("name").alias("names"), F.count("*").alias("n"))
    weighed = join_group_facts(each, counts, "word", "n", total).select("name", "at", _weight(F.col("names"), total).alias("weight"))
    return weighed.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weight"))), lambda x: x.weight).alias("weights")).select("name.*", "weights")


#: Pieces of a word that one typing error can change: three, or four if neighbours are swapped.
PIECE, CHANGED = 3, 4
#: Words of more letters are not written down with each letter left out in turn.
MOST_FORMS = 30
#: Bits of the side of a pair that a word stands on.
LEFT, RIGHT = 1, 2


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(words: pd.Series) -> pd.Series:
    """The 3-letter pieces of words with two marks on either side, each numbered by its occurrence."""

    def of(word: str) -> list[str]:
        seen: dict[str, int] = {}
        marked = f"^^{word}$$"
        return [f"{p}{seen.setdefault(p, 0)}" for i in range(len(marked) - PIECE + 1) if (p := marked[i : i + PIECE]) and seen.update({p: seen.get(p, -1) + 1}) is None]

    return words.map(of)


def _letters(word: Column) -> Column:
    """A bit for each letter of the word."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(61)))))


#: The base of the hashes of forms, odd so that it has an inverse: leaving a letter out moves those behind it one place.
_BASE = 0x9E3779B97F4A7C15
_BACK = [np.uint64(pow(_BASE, -k, 1 << 64)) for k in (0, 1, 2)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _forms(words: pa.Array, twice: pa.Array) -> pa.Array:
    """Hashes of each word and of what is left without one letter or, where ``twice``, without two: equal for equal strings."""
    groups: dict[tuple, list[int]] = {}
    texts = words.to_pylist()
    for at, (w, t) in enumerate(zip(texts, twice.to_pylist())):
        groups.setdefault((len(w), t), []).append(at)
    parts, order = [], []
    for (n, two), places in groups.items():
        codes = np.frombuffer("".join(texts[k] for k in places).encode("utf-32-le"), np.uint32).reshape(len(places), n).astype(np.uint64)
        codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        codes *= np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)
        sums = np.zeros((len(places), n + 1), np.uint64)
        np.cumsum(codes, axis=1, out=sums[:, 1:])
        i, every = np.arange(n), sums[:, n:]
        out = [every, sums[:, i] + (every - sums[:, i + 1]) * _BACK[1]]
        if two:
            i, j = np.triu_indices(n, 1)
            out.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * _BACK[1] + (every - sums[:, j + 1]) * _BACK[2])
        forms = np.sort(np.concatenate(out, axis=1), axis=1)
        first = np.ones(forms.shape, bool)
        first[:, 1:] = forms[:, 1:] != forms[:, :-1]
        ends = np.concatenate([[0], np.cumsum(first.sum(1))])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(forms[first].view(np.int64))))
        order += places
    if not parts:
        return pa.array([], pa.list_(pa.int64()))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))


def like_words(words: DataFrame) -> DataFrame:
    """(word, like) for the distinct ``words`` (word, whole) that may be one word mistyped; not for equal ones.

    Words k errors or swaps apart share a form with k letters left out at most. Words of about
    MOST_FORMS letters and more have too many; for them a set-similarity join on the 3-letter pieces: k errors
    change CHANGED * k pieces at most, so with pieces in order of frequency two such words share
    one of their CHANGED * k + 1 rarest. Pairs are verified by edit distance. Words from LONG_WORD
    letters on may be two errors apart, others one. At least one of a pair is ``whole``; words that
    are not are joined neighbours, for which one error counts. With a column ``sides`` (LEFT, RIGHT
    or both) one of a pair is of the left, the other of the right.
    """
    fit = words.filter(F.length("word") >= 4).select("word", "whole", F.col("sides") if "sides" in words.columns else F.lit(LEFT | RIGHT).alias("sides"))
    fit = fit.withColumn("nr", F.xxhash64("word"))
    short = fit.filter(F.length("word") <= MOST_FORMS)
    formed = lambda bit, nr, whole: short.filter(F.col("sides").bitwiseAND(bit) > 0).select(F.col("nr").alias(nr), F.col("whole").alias(whole), F.explode(_forms("word", (F.length("word") >= LONG_WORD) & F.col("whole"))).alias("form"))
    met = formed(LEFT, "a", "whole_a").hint("shuffle_hash").join(formed(RIGHT, "b", "whole_b"), "form").filter("a <> b and (whole_a or whole_b)")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = lambda nr, *c: shuffled(fit.select(F.col("nr").alias(nr), *[F.col(x).alias(y) for x, y in zip(("word", "whole"), c)]))
    found = met.join(named("a", "word", "whole_a"), "a").join(named("b", "like", "whole_b"), "b").select("word", "like", (F.col("whole_a") & F.col("whole_b")).alias("wholes"))
    long_words = cut(fit.filter(F.length("word") >= MOST_FORMS - 1))
    if not long_words.isEmpty():
        found = found.unionByName(_long_pairs(long_words))
    pairs = cut(found.filter(_alike_or_torn("word", "like", "wholes")).select("word", "like").distinct())
    return pairs.unionByName(pairs.select(F.col("like").alias("word"), F.col("word").alias("like")))


def _long_pairs(long_words: DataFrame) -> DataFrame:
    """(word, like, wholes) of words of about MOST_FORMS letters and more that may be one."""
    pieces = cut(long_words.withColumn("p", _pieces("word"))).select("word", "whole", "sides", F.posexplode("p").alias("at", "piece"))
    counts = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    ranked = join_group_facts(pieces, counts, "piece", "n", pieces.count())
    own = cut(ranked.groupBy("word", "whole", "sides").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "at"))).alias("p")).withColumn("letters", _letters(F.col("word"))))
    found = None
    cols = ("word", "whole", "sides", "letters", "size")
    for errors, fits in ((1, F.length("word") >= MOST_FORMS), (2, (F.length("word") >= MOST_FORMS - 1) & F.col("whole"))):
        first = own.withColumn("size", F.length("word")).filter(fits).select(*cols, F.explode(F.slice("p", 1, CHANGED * errors + 1)).alias("p")).select(*cols, "p.piece", "p.at")
        # a piece both share stands at most as many places apart as there are errors
        a = first.withColumn("at", F.explode(F.sequence(F.col("at") - errors, F.col("at") + errors)))
        b = first.select("piece", "at", *[F.col(c).alias(f"like_{c}") for c in cols])
        met = a.join(b, ["piece", "at"]).filter((F.abs(F.col("size") - F.col("like_size")) <= errors) & (F.col("whole") | F.col("like_whole")))
        met = met.filter((F.col("sides").bitwiseAND(LEFT) > 0) & (F.col("like_sides").bitwiseAND(RIGHT) > 0) | (F.col("sides").bitwiseAND(RIGHT) > 0) & (F.col("like_sides").bitwiseAND(LEFT) > 0))
        # an error changes two letters of the alphabet at most
        met = met.filter((F.bit_count(F.col("letters").bitwiseXOR(F.col("like_letters"))) <= 2 * errors) & (F.col("word") < F.col("like_word")))
        # a swap of neighbours is two edits; two swaps are four
        met = met.filter(F.levenshtein("word", "like_word", 2 * errors) >= 0).select("word", F.col("like_word").alias("like"), (F.col("whole") & F.col("like_whole")).alias("wholes"))
        found = met if found is None else found.unionByName(met)
    return found


@F.pandas_udf(T.BooleanType())
def _alike_or_torn(a: pd.Series, b: pd.Series, wholes: pd.Series) -> pd.Series:
    return pd.Series([near(x, y, 1) or w and bool(alike(x, y)) for x, y, w in zip(a, b, wholes)], dtype="bool")


def joined_words(words: list[str], at: int) -> str | None:
    """The word at a place and the next as one, if they may be one torn apart."""
    torn = words[at] + words[at + 1]
    return torn if min(len(words[at]), len(words[at + 1])) >= 2 and len(torn) >= 5 else None


def all_joined(words: list[str]) -> list[str | None]:
    return [joined_words(words, k) for k in range(len(words) - 1)]


def _torn(words: Column) -> Column:
    """All ``joined_words`` of a name."""
    joined = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when((F.length(a) >= 2) & (F.length(b) >= 2) & (F.length(a) + F.length(b) >= 5), F.concat(a, b)))
    return F.array_compact(joined)


def heavy_keys(words: list[str], weights: list[float], least: float, meets: list[int] | None = None) -> list[tuple[str, float]]:
    """Words of which a lighter name must have a like one to reach ``least``, each with the weight of those before it.

    Of two names the heavier has half of their weight or more, so what neither side may lack is at
    most 2 (1 - least) of its weight; its heaviest words that together weigh more cannot all be
    without a like. They are given with what they may be parts of and with their initials. Any other
    order of words will do as well: with ``meets``, how many names have each word or one like it, those met by the fewest
    come first, so that the rare misspelling of a common word is no key if a name has others.
    """
    most, before, out = 2 * (1 - least) * sum(weights) + 1e-6, 0.0, {}
    torn = all_joined(words)
    for at in sorted(range(len(words)), key=lambda k: (meets[k] if meets else 0, -weights[k], k)):
        if before > most:
            break
        w = words[at]
        for key in (w, "." + w[0] if len(w) > 1 else "*" + w, *(torn[k] for k in (at - 1, at) if 0 <= k < len(torn) and torn[k])):
            out.setdefault(key, before)
        before += weights[at]
    return list(out.items())


def light_keys(words: list[str]) -> list[str]:
    """All words of a name, its joined neighbours and its initials."""
    out = dict.fromkeys(words)
    out |= dict.fromkeys("." + w if len(w) == 1 else "*" + w[0] for w in words)
    return list(out | dict.fromkeys(t for t in all_joined(words) if t))


#: Words of a name that its SIGN tells of; a word of less weight (in a 200th of all names) that is like more others than this is a hub.
TOPS, LIGHT, HUB = 4, 5.3, 3


def sign(words: list[str], weights: list[float], facts: dict[str, dict]) -> tuple:
    """What tells two names apart at a glance, the SIGN.

    ``reach`` (two parts) has a bit for each word and joined pair of the name, ``initials`` one for
    each of its single letters. Its TOPS heaviest words weigh w1, w2 and so on; another name without
    any bit of m1, and without the initial l1, has nothing like the first of them. ``facts`` has for
    each word and joined pair its bits in a reach (own) and those it looks for in another (like),
    and whether it is, or is like, a whole word (known).
    """
    torn = all_joined(words)
    bit = lambda letter: 1 << (ord(letter) % 61)
    reach, initials = [0, 0], 0
    for t in [*words, *(t for t in torn if t and facts[t]["known"])]:
        for k in (0, 1):
            reach[k] |= facts[t][f"own{k}"]
    for w in words:
        if len(w) == 1:
            initials |= bit(w)
    tops = []
    for at in sorted((k for k in range(len(words)) if len(words[k]) > 1), key=lambda k: (-weights[k], k))[:TOPS]:
        near_by = [words[at], *(torn[k] for k in (at - 1, at) if 0 <= k < len(torn) and torn[k] and facts[torn[k]]["known"])]
        mask = [0, 0]
        for t in near_by:
            for k in (0, 1):
                mask[k] |= facts[t][f"like{k}"]
        tops += [weights[at], *mask, bit(words[at][0])]
    return (*reach, initials, *tops, *[0.0, 0, 0, 0] * (TOPS - len(tops) // 4))


_SIGN = [("reach0", T.LongType()), ("reach1", T.LongType()), ("initials", T.LongType())] + [(f"{c}{i}", T.FloatType() if c == "w" else T.LongType()) for i in range(1, TOPS + 1) for c in ("w", "m0", "m1", "l")]
#: What the rows of the join carry of it: two words.
_BRIEF = [c for c, _ in _SIGN[:11]]
_FACTS = ("weight", "own0", "own1", "like0", "like1", "known", "meets")
_HEAVY = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("before", T.FloatType())]))
_KEYS = T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("total", T.DoubleType()), T.StructField("light", T.ArrayType(T.StringType())), T.StructField("heavy", _HEAVY), *[T.StructField(*x) for x in _SIGN]])


@F.arrow_udf(_KEYS)
def _keys(words: pa.Array, facts: pa.Array, least: pa.Array) -> pa.Array:
    """The weights, keys and SIGN of names from the facts of their words."""
    flat, at, out = facts.flatten(), 0, []
    told = list(zip(flat.field("word").to_pylist(), *(flat.field(c).to_pylist() for c in _FACTS)))
    for w, n, t in zip(_lists(words), facts.value_lengths().to_pylist(), least.to_pylist()):
        of = {x[0]: dict(zip(_FACTS, x[1:])) for x in told[at : at + n]}
        at += n
        weights = [of[x]["weight"] for x in w]
        out.append((weights, sum(weights), light_keys(w), heavy_keys(w, weights, t, [of[x]["meets"] for x in w]), *sign(w, weights, of)))
    weights, totals, light, heavy, *signs = map(list, zip(*out)) if out else [[] for _ in range(4 + len(_SIGN))]
    pair = pa.struct([("word", pa.string()), ("before", pa.float32())])
    cols = [_list_column(weights, pa.float64()), pa.array(totals, pa.float64()), _list_column(light, pa.string()), _list_column(heavy, pair)]
    cols += [pa.array(x, pa.float32() if isinstance(kind, T.FloatType) else pa.int64()) for x, (_, kind) in zip(signs, _SIGN)]
    return pa.StructArray.from_arrays(cols, ["weights", "total", "light", "heavy", *[c for c, _ in _SIGN]])


def _facts(vocabulary: DataFrame, likes: DataFrame) -> DataFrame:
    """``vocabulary`` with own0, own1, like0, like1, known, the bits among 122 that each word sets and looks for, and ``meets``, how many names have it or a like one.

    A word sets its own bit and looks for it and those of what is like it. Of a common word like
    more than HUB others these would be most bits, so the others set its bit instead.
    """
    nr = lambda c: F.pmod(F.xxhash64(c), F.lit(122)).cast("int")
    bit = lambda c, k: F.when((nr(c) >= 61 * k) & (nr(c) < 61 * (k + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), nr(c) - 61 * k)).otherwise(0)
    told = likes.join(shuffled(vocabulary.select(F.col("word").alias("like"), F.col("n").alias("like_n"))), "like")
    near_by = told.groupBy("word").agg(F.count("*").alias("others"), F.sum("like_n").alias("like_n"), *[F.bit_or(bit("like", k)).alias(f"near{k}") for k in (0, 1)])
    near_by = cut(vocabulary.join(near_by, "word").withColumn("hub", (F.col("others") > HUB) & (F.coalesce("weight", F.lit(LIGHT)) < LIGHT)).select("word", "others", "like_n", "near0", "near1", "hub"))
    hubs = near_by.filter("hub").select(F.col("word").alias("like"))
    set_for = likes.join(shuffled(hubs), "like").groupBy("word").agg(*[F.bit_or(bit("like", k)).alias(f"hub{k}") for k in (0, 1)])
    zero = F.lit(0).cast("long")
    own = [bit("word", k).bitwiseOR(F.coalesce(f"hub{k}", zero)).alias(f"own{k}") for k in (0, 1)]
    like = [bit("word", k).bitwiseOR(F.when(~F.col("hub"), F.col(f"near{k}")).otherwise(zero)).alias(f"like{k}") for k in (0, 1)]
    near_by = shuffled(near_by.join(set_for, "word", "left"))
    return vocabulary.join(near_by, "word", "left").select(*vocabulary.columns, *own, *like, (F.col("whole") | F.col("others").isNotNull()).alias("known"), (F.col("n") + F.coalesce("like_n", F.lit(0))).alias("meets"))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, left, right, score) for the distinct names of one block that score ``least`` or more.

    ``left`` and ``right`` have (block, words). Names are sets of words, and words sets of 3-letter
    pieces. A prefix-filtered join on the pieces of the distinct words of all names tells which
    words may be one (``like_words``). Names of one block are then joined by a prefix filter on
    their words in order of how many names they meet (``heavy_keys``): the heavier name's rarest words against all
    words of the lighter, equal or alike. A pair is dropped in the join if the heaviest words that
    one has and the other surely lacks (``sign``) outweigh what may be lacking. Other pairs are
    verified by ``soft_similarity``. Names without words and null blocks match nothing. Keys of
    many names are cut into slices.
    """
    sides = left.select("block", "words", F.lit(True).alias("is_left")).unionByName(right.select("block", "words", F.lit(False).alias("is_left")))
    sides = cut(sides.filter("block is not null and size(words) > 0").groupBy("block", "words").agg(F.max("is_left").alias("in_left"), F.max(~F.col("is_left")).alias("in_right")))
    # a block with names of one side only has no pairs
    both = sides.groupBy("block").agg(F.max("in_left").alias("a"), F.max("in_right").alias("b")).filter("a and b").select("block")
    sides = cut(sides.join(both, "block", "left_semi").withColumn("nr", F.xxhash64("words")))
    # a name has the same words, weights and keys in all its blocks
    bags = cut(sides.groupBy("nr", "words").agg(F.count("*").alias("blocks"), F.bit_or(F.col("in_left").cast("int") * LEFT + F.col("in_right").cast("int") * RIGHT).alias("sides")).withColumn("joined", _torn(F.col("words"))))
    sides, total = sides.drop("words"), sides.count()
    tokens = bags.select("blocks", "sides", F.explode(F.array_distinct("words")).alias("word"), F.lit(True).alias("whole")).unionByName(bags.select("blocks", "sides", F.explode(F.array_distinct("joined")).alias("word"), F.lit(False).alias("whole")))
    counts = tokens.groupBy("word").agg(F.max("whole").alias("whole"), F.bit_or("sides").alias("sides"), F.count("*").alias("n"), F.sum(F.when(F.col("whole"), F.col("blocks"))).alias("names"))
    vocabulary = cut(counts.withColumn("weight", _weight(F.col("names"), total)).drop("names"))
    likes = like_words(vocabulary.select("word", "whole", "sides"))
    facts = cut(_facts(vocabulary, likes))
    met = bags.select("nr", F.explode(F.array_distinct(F.concat("words", "joined"))).alias("word"))
    told = join_group_facts(met, facts.select("word", "n", *_FACTS), "word", "n", tokens.count()).groupBy("nr").agg(F.collect_list(F.struct("word", *_FACTS)).alias("facts"))
    keyed = cut(bags.select("nr", "words").join(told, "nr").select("nr", "words", _keys("words", "facts", F.lit(float(least))).alias("keys")).withColumn("total", F.col("keys.total")))
    signs = [F.col("total").cast("float").alias("total"), *[f"keys.{c}" for c in _BRIEF]]
    heavy = cut(keyed.select("nr", F.explode("keys.heavy").alias("x")).select("nr", "x.*"))
    also = join_salted(heavy, likes, "word", heavy.groupBy("word").agg(F.count("*").alias("n")), "n", heavy.count()).select("nr", F.col("like").alias("word"), "before")
    carried = ["nr", "total", *_BRIEF]
    # heavy words of the left meet light ones of the right, and the other way round: names of one side are never compared
    facing = lambda one, other: sides.filter(one).withColumn("to_right", F.lit(True)).unionByName(sides.filter(other).withColumn("to_right", F.lit(False)))
    side = lambda df, s, *more: cut(df.select(F.xxhash64("block", "word", "to_right").alias("k"), *[F.col(c).alias(f"{s}_{c}") for c in (*carried, *more)]))
    h = side(facing("in_left", "in_right").join(keyed.select("nr", *signs), "nr").join(heavy.unionByName(also), "nr"), "h", "before", "block", "to_right")
    g = side(facing("in_right", "in_left").join(keyed.select("nr", *signs, "keys.light"), "nr").withColumn("word", F.explode("light")).drop("light"), "g")
    none = lambda s, o, i: (F.col(f"{s}_m0{i}").bitwiseAND(F.col(f"{o}_reach0")) == 0) & (F.col(f"{s}_m1{i}").bitwiseAND(F.col(f"{o}_reach1")) == 0) & (F.col(f"{s}_l{i}").bitwiseAND(F.col(f"{o}_initials")) == 0)
    lacking = lambda s, o, most=2: sum(F.when(none(s, o, i), F.col(f"{s}_w{i}")).otherwise(0.0) for i in range(1, most + 1))
    may_lack = (1 - least) * (F.col("h_total") + F.col("g_total")) + 1e-3
    met = join_salted(h, g, "k", h.groupBy("k").agg(F.count("*").alias("n")), "n", h.count(), 2_000).filter("h_total >= g_total")
    met = met.filter((F.col("h_before") <= may_lack) & (lacking("h", "g") + lacking("g", "h") <= may_lack))
    of_way = lambda right, left: F.when(F.col("h_to_right"), F.col(right)).otherwise(F.col(left))
    pairs = met.select(F.col("h_block").alias("block"), of_way("h_nr", "g_nr").alias("l"), of_way("g_nr", "h_nr").alias("r")).distinct()
    of = lambda side: shuffled(keyed.select(F.col("nr").alias(side[0]), F.col("words").alias(side), F.col("keys.weights").alias(f"{side}_weights"), F.col("total").alias(f"{side}_total"), *[F.col(f"keys.{c}").alias(f"{side}_{c}") for c, _ in _SIGN]))
    full = pairs.join(of("left"), "l").join(of("right"), "r")
    full = full.filter(lacking("left", "right", TOPS) + lacking("right", "left", TOPS) <= (1 - least) * (F.col("left_total") + F.col("right_total")) + 1e-3)
    return cut(full.withColumn("score", _similarity("left", "right", "left_weights", "right_weights")).filter(F.col("score") >= least).select("block", "left", "right", "score"))

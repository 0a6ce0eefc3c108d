"""Postal addresses taken apart, and their localities looked up in a gazetteer."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of streets and their short forms.
KINDS = {
    "street": "street", "st": "street", "str": "street", "strasse": "street", "road": "road", "rd": "road", "place": "place", "pl": "place", "terrace": "terrace", "tce": "terrace", "terr": "terrace", "ter": "terrace",
    "drive": "drive", "dr": "drive", "drv": "drive", "court": "court", "ct": "court", "crt": "court", "lane": "lane", "ln": "lane", "la": "lane", "square": "square", "sq": "square",
    "boulevard": "boulevard", "blvd": "boulevard", "bvd": "boulevard", "boul": "boulevard", "bd": "boulevard", "avenue": "avenue", "ave": "avenue", "av": "avenue", "parkway": "parkway", "pkwy": "parkway", "pky": "parkway",
    "way": "way", "close": "close", "row": "row", "alley": "alley", "crescent": "crescent", "cres": "crescent", "highway": "highway", "hwy": "highway", "gardens": "gardens", "gdns": "gardens", "grove": "grove",
    "mews": "mews", "walk": "walk", "wharf": "wharf", "quay": "quay", "rise": "rise", "circle": "circle", "cir": "circle", "trail": "trail", "trl": "trail", "loop": "loop", "pike": "pike", "plaza": "plaza", "broadway": "broadway",
}
#: Kinds that stand before the name, words between them and the name, and kinds at the end of a name's own word.
LEADING = {
    "rue": "rue", "avenue": "avenue", "av": "avenue", "boulevard": "boulevard", "bd": "boulevard", "place": "place", "allee": "allee", "chemin": "chemin", "quai": "quai", "impasse": "impasse", "calle": "calle", "c": "calle",
    "avenida": "avenida", "avda": "avenida", "paseo": "paseo", "plaza": "plaza", "carrer": "carrer", "via": "via", "viale": "viale", "piazza": "piazza", "corso": "corso", "rua": "rua", "praca": "praca", "am": "am", "an": "an", "im": "im",
}
LINKING = frozenset("de du des d la le les l del della delle dei di do da dos das el los las der den dem".split())
ENDINGS = {"strasse": "street", "str": "street", "weg": "weg", "platz": "platz", "allee": "allee", "gasse": "gasse", "damm": "damm", "ufer": "ufer", "straat": "straat", "laan": "laan", "plein": "plein", "gracht": "gracht", "kade": "kade"}
DIRECTIONS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw"}
WORDS = {"mt": "mount", "pt": "port", "ft": "fort", "st": "saint", "hts": "heights", "n": "north", "s": "south", "e": "east", "w": "west", "prov": "province"}
_UNIT = re.compile(r"(?:#\s*|\b(?:suite|ste|flat|unit|apt|apartment|room|rm|floor|office(?:\s+no)?)\b\.?\s*(?:no\b\.?\s*)?)(\d+[a-z]?)\b|\b(\d+)(?:st|nd|rd|th)\s+floor\b")
_POSTCODE = re.compile(r"\b\d{5,}\b")
#: British, Canadian and Dutch postcodes.
_MIXED_CODE = re.compile(r"\b(?:[a-z]{1,2}\d[a-z\d]?\s+\d[a-z]{2}|[a-z]\d[a-z]\s*\d[a-z]\d|\d{4}\s+[a-z]{2}(?=\s+[a-z]{3}))\b")
_PREFIX = re.compile(r"\b(?:no|nr|bldg|building|plot|house)\b\.?\s*(?=\d)")
_NUMBER = re.compile(r"\d{1,5}[a-z]?(?:-\d{1,5}[a-z]?)?$")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)$")
_TOKEN = re.compile(r"\d+[a-z]?-\d+[a-z]?\b|[a-z0-9]+|,")
#: Words of a street's name, at most.
MOST_WORDS = 4
#: A gazetteer of up to so many entries goes to every task; the entries of a larger one are joined to the texts.
MOST_PLACES = 100_000
FIELDS = "city string, places array<long>, region array<long>, parents array<long>, postcode string, number string, street string, kind string, direction string, unit string, other string"


@lru_cache(1 << 14)
def plain(text: str) -> str:
    """Lower case without accents."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).replace("ß", "ss")


def shortened(word: str) -> set[str]:
    """The word and all forms with one letter left out; words one edit or swap apart share a form."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions, changes or swaps of neighbours part a and b.

    Only the middle part without the common beginning and end is compared, along its diagonal, so
    the time grows with the length times ``most``.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    start, end, shorter = 0, 0, min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return True
    if most == 1:
        return len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a == b[::-1])
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, ({0: i} if i <= most else {})
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cost = min(last.get(j, most) + 1, row.get(j - 1, most) + 1, last.get(j - 1, most + 1) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before.get(j - 2, most) + 1)
            row[j] = cost
        if min(row.values()) > most:
            return False
        before = last
    return row.get(len(b), most + 1) <= most


class Gazetteer:
    """Looks words up as cities, states and countries, exactly or one edit off.

    ``rows`` are (geo_id, country, country_code, state, state_code, city).
    """

    def __init__(self, rows: list[tuple]):
        self.city: dict[str, list[int]] = defaultdict(list)
        self.region: dict[str, set[tuple]] = defaultdict(set)
        self.within: dict[int, tuple] = {}
        self.id_of: dict[tuple, int] = {}
        for nr, country, code, state, state_code, city in sorted(rows, key=lambda r: r[0]):
            self.within[nr] = (country, state)
            if city:
                self.city[self.key(city)].append(nr)
            else:
                self.id_of[country, state] = nr
                self.region[self.key(state or country)].add((country, state))
                if abbreviation := state_code if state else code:
                    self.region["." + plain(abbreviation)].add((country, state))
                if state and state.lower().endswith(" province"):
                    self.region[self.key(state[:-9])].add((country, state))
        self.longest = max(map(len, self.city), default=0)
        self.off: dict[str, set[str]] = defaultdict(set)
        for name in self.city:
            for form in shortened(name):
                self.off[form].add(name)

    @staticmethod
    def key(name: str) -> str:
        return "".join(WORDS.get(w, w) for w in re.findall(r"[a-z0-9]+", plain(name)))

    def knows(self, words: list[str]) -> bool:
        """Whether the words are a city or region, maybe mistyped."""
        key = "".join(WORDS.get(w, w) for w in words)
        return key in self.city or key in self.region or (len(words) == 1 and "." + words[0] in self.region) or self.near_city(key) is not None

    def near_city(self, key: str) -> str | None:
        if not 6 <= len(key) <= self.longest + 1:
            return None
        found = {n for form in shortened(key) for n in self.off.get(form, ()) if near(key, n, 1)}
        return found.pop() if len(found) == 1 else None

    def locate(self, pieces: list[list[str]]) -> tuple[str | None, list[int], list[int], list[int]]:
        """City, its possible ids, ids of the regions named, ids of the regions around the city."""
        city, regions, rest = None, [], []
        for words in pieces:
            free = [True] * len(words)
            for size in range(min(6, len(words)), 0, -1):
                for at in range(len(words) - size + 1):
                    if not all(free[at : at + size]):
                        continue
                    span = words[at : at + size]
                    key = "".join(WORDS.get(w, w) for w in span)
                    if key in self.city and city is None:
                        city = key
                    elif hit := self.region.get(key) or (self.region.get("." + span[0]) if size == 1 else None):
                        regions.append(hit)
                    else:
                        continue
                    free[at : at + size] = [False] * size
            run: list[str] = []
            for w, f in [*zip(words, free), ("", False)]:
                if f:
                    run.append(w)
                elif run:
                    rest.append(run)
                    run = []
        if city is None:
            for words in rest:
                for size in range(min(4, len(words)), 0, -1):
                    for at in range(len(words) - size + 1):
                        city = city or self.near_city("".join(WORDS.get(w, w) for w in words[at : at + size]))
        ids = self.city.get(city, []) if city else []
        for hit in regions:
            ids = [i for i in ids if any(self.within[i][0] == c and (s is None or self.within[i][1] == s) for c, s in hit)] or ids
        named = sorted({self.id_of[h] for hit in regions for h in hit if h in self.id_of})
        parents = sorted({self.id_of[h] for i in ids for h in (self.within[i], (self.within[i][0], None)) if h in self.id_of})
        return city, ids, named, parents


def _number_at(t: list[str], at: int) -> bool:
    return 0 <= at < len(t) and bool(_NUMBER.match(t[at]))


def _name_word(word: str) -> bool:
    return word.isalpha() or bool(_ORDINAL.match(word))


def _numbers(t: list[str], first: int, last: int) -> list[tuple[int, int, str]]:
    """House numbers beside the tokens first to last: (rank, place, number), the likeliest first."""
    out = []
    if first >= 2 and t[first - 1] in "abcd" and t[first - 2].isdigit() and len(t[first - 2]) < 5:
        out.append((-1, first - 2, t[first - 2] + t[first - 1]))
    for at, rank in ((first - 1, 0), (last + 1, 1), (last + 2, 2), (first - 2, 3)):
        if _number_at(t, at) and (rank < 2 or t[at + (1 if rank == 3 else -1)] == ","):
            out.append((rank, at, t[at]))
    return sorted(out)


def _trailing(t: list[str], gazetteer: Gazetteer) -> tuple | None:
    """(rank, first, last, number, name, kind, direction, other name) of a street whose kind stands after its name."""
    best = None
    for i in range(1, len(t)):
        if t[i] not in KINDS or not _name_word(t[i - 1]) or (len(t[i - 1]) < 3 and t[i - 1] in DIRECTIONS and not _number_at(t, i - 2)):
            continue
        if i + 1 < len(t) and t[i + 1] in KINDS and len(t[i]) > 3 and len(t[i + 1]) > 2:
            continue  # 'Park Place Mews': the last one is the kind
        start = i - 1
        while start > 0 and i - start < MOST_WORDS + 1 and _name_word(t[start - 1]):
            start -= 1
        bounded = start and (_number_at(t, start - 1) or (t[start - 1] in "abcd" and len(t[start - 1]) == 1 and _number_at(t, start - 2)))
        other = None
        if not bounded:
            # the words before may be a place or belong to the name: both readings are kept
            for end in range(i - 1, start, -1):
                if gazetteer.knows(t[start:end]):
                    start = end
                    break
            other = " ".join(t[start:i]) if 1 < i - start <= MOST_WORDS and t[start] not in DIRECTIONS else None
            start = i - 1
            if start and t[start - 1] in DIRECTIONS:
                start -= 1
        last, direction, named = i, "", start
        if start < i - 1 and t[start] in DIRECTIONS:
            direction, named = DIRECTIONS[t[start]], start + 1
        elif i + 1 < len(t) and t[i + 1] in DIRECTIONS and (i + 2 == len(t) or t[i + 2] == "," or _number_at(t, i + 2)):
            last += 1
            direction = DIRECTIONS[t[last]]
        options = _numbers(t, start, last)
        if options and (best is None or options[0][0] < best[0]):
            rank, at, number = options[0]
            best = (rank, min(start, at), max(last, at), number, " ".join(t[named:i]), KINDS[t[i]], direction, other)
    return best


def _leading(t: list[str]) -> tuple | None:
    """The same of a street whose kind stands before its name, or at the end of its own word."""
    best = None
    for i, w in enumerate(t):
        first, last, name, kind = i, i, "", ""
        if w in LEADING:
            at = i + 1
            while at < len(t) and t[at] in LINKING:
                at += 1
            end = at
            while end < len(t) and end - at < MOST_WORDS and t[end].isalpha():
                end += 1
            if end > at:
                last, name, kind = end - 1, " ".join(t[at:end]), LEADING[w]
        else:
            ending = next((e for e in ENDINGS if w.endswith(e) and len(w) > len(e) + 2), None)
            if ending:
                name, kind = w[: -len(ending)], ENDINGS[ending]
                while first > 0 and t[first - 1].isalpha() and i - first < MOST_WORDS - 1:
                    first -= 1
                name = " ".join([*t[first:i], name])
        options = _numbers(t, first, last) if name else []
        if options and (best is None or options[0][0] < best[0]):
            rank, at, number = options[0]
            best = (rank, min(first, at), max(last, at), number, name, kind, "", None)
    return best


def parse(text: str | None, gazetteer: Gazetteer) -> tuple:
    """The FIELDS of an address; None for what is not written.

    A street is a house number beside a name and its kind: 'Upper Foo Street', 'Rue de Foo',
    'Foostrasse'. Numbers may be ranges or carry a letter; a number of five digits is taken for a
    postcode unless the street has no other.
    """
    s = re.sub(r"[|;·•\n\r\t()/]", ",", plain(text or ""))
    unit = postcode = None
    if m := _UNIT.search(s):
        unit, s = m[1] or m[2], s[: m.start()] + " , " + s[m.end() :]
    whole = s
    if m := _POSTCODE.search(s) or next((m for m in _MIXED_CODE.finditer(s) if m[0].split()[-1] not in KINDS and m[0].split()[-1] not in DIRECTIONS), None):
        postcode, s = m[0].replace(" ", ""), s[: m.start()] + " , " + s[m.end() :]
    split = lambda x: _TOKEN.findall(re.sub(r"['’]", "", _PREFIX.sub(" ", x)))
    t = split(s)
    best = _trailing(t, gazetteer) or _leading(t)
    if not best and postcode and len(postcode) == 5 and postcode.isdigit():
        again = split(whole)
        if best := _trailing(again, gazetteer) or _leading(again):
            t, postcode = again, None
    number = street = kind = direction = other = None
    if best:
        _, first, last, number, street, kind, direction, other = best
        t[first : last + 1] = [","]
    pieces, now = [], []
    for w in [*t, ","]:
        if w == ",":
            if now:
                pieces.append(now)
            now = []
        elif not w[0].isdigit():
            now.append(w)
    city, ids, regions, parents = gazetteer.locate(pieces)
    return city, ids, regions, parents, postcode, number, street, kind, direction, unit, other


GEO = ["geo_id", "country", "country_code", "state", "state_code", "city"]


def _entries(geo: DataFrame) -> DataFrame:
    return geo.filter("geo_id is not null and country is not null").select(*GEO)


def _names_of(geo_id: int, country: str, code: str | None, state: str | None, state_code: str | None, city: str | None) -> list[str]:
    """The keys under which a text may find an entry, '~' before those with a letter left out."""
    g = Gazetteer([(geo_id, country, code, state, state_code, city)])
    return [*g.city, *g.region, *(f"~{f}" for f in g.off)]


def _asked(text: str | None, longest: int) -> list[str]:
    """All keys that ``parse`` may look up for a text; none of a city has more than ``longest`` letters."""
    t = re.findall(r"[a-z0-9]+|,", re.sub(r"['’]", "", re.sub(r"[|;·•\n\r\t()/]", ",", plain(text or ""))))
    out = {}
    for at in range(len(t)):
        for size in range(1, 7):
            span = t[at : at + size]
            if len(span) < size or span[-1] == ",":
                break
            key = "".join(WORDS.get(w, w) for w in span)
            out[key] = None
            if size == 1:
                out["." + span[0]] = None
            if size <= 4 and 6 <= len(key) <= longest + 1:
                out |= dict.fromkeys(f"~{f}" for f in shortened(key))
    return list(out)


def _with_entries(df: DataFrame, text_col: str, geo: DataFrame) -> DataFrame:
    """(text, entries): the distinct texts with the entries of the gazetteer that they may name, and those around them.

    The other way for a gazetteer that is too large for every task: its names are joined with the
    spans of the texts, which costs some hundred keys for each distinct text.
    """
    keys = F.pandas_udf(lambda *c: pd.Series([_names_of(*[None if pd.isna(v) else v for v in r]) for r in zip(*c)]), "array<string>")
    entries = _entries(geo)
    # short forms are spelled out in keys, which at most triples their letters
    longest = 3 * (entries.agg(F.max(F.length("city"))).first()[0] or 0)
    spans = F.pandas_udf(lambda c: c.map(lambda t: _asked(t, longest)), "array<string>")
    named = entries.select(*GEO, F.explode(keys(*GEO)).alias("key"))
    texts = df.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    met = texts.select("text", F.explode(spans("text")).alias("key")).join(named, "key").select("text", *GEO).distinct()
    # the region and country of a city are needed to say what lies around it
    around = [met.select("text", *[F.col(c).alias(f"_{c}") for c in on]).distinct().join(entries.filter(only), [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in on]).select("text", *GEO) for on, only in ((["country", "state"], "city is null and state is not null"), (["country"], "city is null and state is null"))]
    every = met.unionByName(around[0]).unionByName(around[1]).distinct()
    return every.groupBy("text").agg(F.collect_list(F.struct(*GEO)).alias("entries"))


def parse_addresses(df: DataFrame, text_col: str, geo: DataFrame, prefix: str = "", fields: str = FIELDS) -> DataFrame:
    """``df`` with a column ``{prefix}at``, the parsed address; all null for a blank one.

    ``fields`` may be the first of FIELDS only.
    No shuffle as long as the gazetteer has up to MOST_PLACES entries, which go to every task;
    the entries of a larger one are joined to the texts.
    """
    spark = df.sparkSession
    names = [f.split()[0] for f in fields.split(", ")]
    rows = [tuple(r) for r in _entries(geo).limit(MOST_PLACES + 1).collect()]
    if len(rows) > MOST_PLACES:

        @F.pandas_udf(fields)
        def parsed_with(texts: pd.Series, entries: pd.Series) -> pd.DataFrame:
            small = lambda e: Gazetteer([tuple(x[c] for c in GEO) for x in e] if e is not None else [])
            return pd.DataFrame([parse(t, small(e))[: len(names)] for t, e in zip(texts, entries)], columns=names)

        told = _with_entries(df, text_col, geo).withColumnRenamed("text", "_text").withColumnRenamed("entries", "_entries")
        return df.join(told, F.col(text_col) == F.col("_text"), "left").withColumn(f"{prefix}at", parsed_with(F.col(text_col), F.col("_entries"))).drop("_text", "_entries")
    spread = spark.sparkContext.broadcast(rows)
    held: list[Gazetteer] = []

    @F.pandas_udf(fields)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(Gazetteer(spread.value))
        # an address is often written the same on many pages
        told = lru_cache(1 << 15)(lambda t: parse(t, held[0])[: len(names)])
        for texts in batches:
            yield pd.DataFrame([told(t) for t in texts], columns=names)

    return df.withColumn(f"{prefix}at", parsed(F.col(text_col)))

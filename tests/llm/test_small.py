"""Small cases: nulls, empties, ties, repeated rows, clashing columns, and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanwork.llm import address_matching, addresses, format_duplicates, leakage, linkage, name_variants, names, subjects, survivors
from gleanwork.llm.address_matching import building_links, same_building
from gleanwork.llm.addresses import Gazetteer, near, parse, parse_addresses
from gleanwork.llm.format_duplicates import format_duplicate_groups, format_duplicate_pairs
from gleanwork.llm.name_variants import variant_classes, variant_links
from gleanwork.llm.place_mapping import map_places
from gleanwork.llm.tokenize import VOCABULARIES, encode_corpus, encoder

GEO = [(1, "Quellia", "QLA", None, None, None), (2, "Quellia", "QLA", "West Tullidud", "WS", None), (3, "Quellia", "QLA", "West Tullidud", "WS", "Sendevam"), (4, "Quellia", "QLA", "West Tullidud", "WS", "Port Trekallix"), (5, "Veldoria", "VDR", None, None, None), (6, "Veldoria", "VDR", "Brasuskal Province", "BA", None), (7, "Veldoria", "VDR", "Brasuskal Province", "BA", "Port Trekallix")]
GEO_KIND = "geo_id long, country string, country_code string, state string, state_code string, city string"


@pytest.fixture(scope="module")
def geo(spark):
    return spark.createDataFrame(GEO, GEO_KIND)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# duplicates by formatting
QUERIES = [(1, "R&D Labs - St. John's"), (2, "st johns, r d LABS"), (2, "st johns, r d LABS"), (3, None), (4, ""), (5, "..."), (6, "labs r d"), (7, "fork-lift"), (8, "fork‑lift"), (9, "fork lift"), (10, "café"), (11, "cafe"), (12, "labs labs r d")]


def canonical(q):
    q = re.sub(r"(?<=[^\W_])['’\-‑.](?=[^\W_])", "", q or "")
    return " ".join(sorted(re.findall(r"[^\W_]+", q.lower())))


def test_format_duplicates(spark):
    df = spark.createDataFrame([(*q, "x") for q in QUERIES], "seq long, query string, key string")
    assert pairs(format_duplicate_pairs(df, "seq", "query")) == [(1, 2), (7, 8)]
    assert pairs(format_duplicate_groups(df, "seq", "query")) == [(1, 2), (6, 1), (7, 2), (9, 1), (10, 1), (11, 1), (12, 1)]


def test_format_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = ["tax", "law", "St.", "port", "R&D", "x-ray", "Ü"]
    rows = [(i, rng.choice([" ", ", ", " / "]).join(rng.choice((str.upper, str.lower))(w) for w in rng.sample(words, rng.randrange(1, 4)))) for i in range(3000)]
    first = {}
    want = []
    for i, q in rows:
        k = canonical(q)
        if k and first.setdefault(k, i) != i:
            want.append((first[k], i))
    assert pairs(format_duplicate_pairs(spark.createDataFrame(rows, "seq long, query string").repartition(7), "seq", "query")) == sorted(want)


def test_format_duplicates_at_every_filter_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"{rng.choice(['a', 'A'])}-{rng.randrange(4000)}!") for i in range(6000)]
    df = spark.createDataFrame(rows, "seq long, query string").repartition(9)
    want = pairs(format_duplicate_pairs(df, "seq", "query"))
    groups = pairs(format_duplicate_groups(df, "seq", "query"))
    assert sum(c for _, c in groups) == 6000 and len(groups) + len(want) == 6000
    for least, most in ((12, 12), (10, 29), (4, 8)):  # full, with several blocks, and too full to be of use
        monkeypatch.setattr(format_duplicates, "LEAST_LOG2", least)
        monkeypatch.setattr(format_duplicates, "MOST_LOG2", most)
        monkeypatch.setattr(format_duplicates, "BLOCK_LOG2", 8)
        assert pairs(format_duplicate_pairs(df, "seq", "query")) == want and pairs(format_duplicate_groups(df, "seq", "query")) == groups


def test_format_duplicates_of_nothing_and_long(spark):
    assert pairs(format_duplicate_pairs(spark.createDataFrame([], "seq long, query string"), "seq", "query")) == []
    long = " ".join(f"w{i}" for i in range(20_000))
    assert pairs(format_duplicate_pairs(spark.createDataFrame([(1, long), (2, long.upper()), (3, long + " x")], "seq long, query string"), "seq", "query")) == [(1, 2)]


# tokens
def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", None, " ", "<|endoftext|> don't  stop\n\n", "a" * 20_000, "naïve ☃ \U0001f600​x", *["".join(rng.choice("abcdeé ß1'\n-ß漢") for _ in range(200)) for _ in range(50)]]
    df = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert encode_corpus(df.limit(0)).count() == 0


def test_tokens_round_trip():
    coder = encoder(f"{VOCABULARIES}/byte_bpe_50k.tiktoken")
    back = {v: k for k, v in coder.ranks.items()}
    words = [w.encode() for w in ("hello", " hello", " unbelievable", "ß", "zzzzzz")]
    assert all(b"".join(back[i] for i in ids) == w for w, ids in coder.encode_words(iter(words)).items())


# places
def test_map_places(spark, geo):
    rows = [(1, "QLA", "W. Tullidud", "sendevam !"), (2, "quellai", None, " "), (3, None, None, "Pt. Trekallix/VDR"), (4, "Quellia", None, "home office"), (5, "", " ", None), (6, None, "BA VDR", None), (7, "Sendewam", None, None), (8, None, None, "Port Trekallix, West Tulidud"), (9, "Nowhere Union", None, None), (1, "QLA", "W. Tullidud", "sendevam !"), (10, "x" * 5000, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "request_id long, country string, state string, city string, value string")
    assert pairs(map_places(df, geo)) == [(1, 3), (2, 1), (3, 7), (4, 0), (6, 6), (7, 3), (8, 4), (9, 0), (10, 0)]
    assert pairs(map_places(df.limit(0), geo)) == []
    assert {g for _, g in pairs(map_places(df, geo.limit(0)))} == {0}


# addresses
def test_near():
    assert near("abcd", "abdc", 1) and near("abcd", "abd", 1) and not near("abcd", "badc", 1) and near("abcd", "badc", 2)


def test_near_equals_the_full_table():
    def full(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(9)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert all(near(a, b, k) == (full(a, b) <= k) for k in (1, 2)), (a, b)


def test_endless_words():
    word = "x" * 200_000
    assert near(word, word, 1) and near(word, "y" + word, 1) and not near(word, "yz" + word, 1) and not near("ab" * 50_000, "ba" * 49_999 + "cc", 2)
    assert parse(f"12 {word} Street, {word}", Gazetteer(GEO))[5] == "12"
    assert names.alike(word, word + "x") == 0.95


def test_candidates_of_names_are_complete(spark):
    rng = random.Random(12)
    stems = ["grugarult", "pildambilt", "crestevax", "haldubund", "ostrefal", "dombuk", "frederik", "f", "tax", "school", "services", "roofing"]

    def noisy(w):
        if len(w) > 4 and rng.random() < 0.4:
            i = rng.randrange(1, len(w) - 1)
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("aeou") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], f"{w[:i]} {w[i:]}"))
        return w.split()

    made = lambda: [x for w in rng.sample(stems, rng.randrange(1, 4)) for x in noisy(w)]
    left, right = [made() for _ in range(70)], [made() for _ in range(70)]
    frame = lambda rows: spark.createDataFrame([(b, w) for w in rows for b in "xy"], "block string, words array<string>")
    every = names.weigh(frame(left).unionByName(frame(right)).distinct()).collect()
    weight = {tuple(r.words): r.weights for r in every}
    for least in (0.72, 0.82):
        want = {(tuple(a), tuple(b)) for a in left for b in right if names.soft_similarity(a, b, weight[tuple(a)], weight[tuple(b)]) >= least}
        got = {(tuple(r.left), tuple(r.right)) for r in names.similar_names(frame(left), frame(right), least).collect()}
        assert got == want



def test_like_words_are_complete(spark):
    rng = random.Random(4)
    words = {"brondodron": True, "brodnodron": False, "x" * 29: True, "y" + "x" * 30: True, "x" * 31: True, "services": True, "srevices": False, "servcies": False}
    for _ in range(150):
        w = "".join(rng.choice(("bro", "dron", "nod", "tal")) for _ in range(rng.randrange(1, 5)))
        i = rng.randrange(1, len(w) - 1)
        words[w] = words[w[:i] + w[i + 1] + w[i] + w[i + 2 :]] = True
        words.setdefault(w[:i] + w[i + 1 :], rng.random() < 0.5)
    like = lambda a, b: near(a, b, 1) or words[a] and words[b] and names.alike(a, b)
    want = {(a, b) for a in words for b in words if a != b and len(a) > 3 < len(b) and (words[a] or words[b]) and like(a, b)}
    got = {tuple(r) for r in names.like_words(spark.createDataFrame(list(words.items()), "word string, whole boolean")).collect()}
    assert want <= got and all(near(a, b, 1) or names.alike(a, b) for a, b in got)


def test_typing_errors_of_common_words_do_not_hide_that_names_differ(spark, monkeypatch):
    typed = [["services"], *(["services"[:i] + "services"[i + 1 :]] for i in range(8))]
    left = [[f"{a}{b}ldorvan", "services"] for a in "bdfgklmnprst" for b in "aeiou"] * 4
    rows = [*left, *([w, "jane"] for (w,) in typed)]
    frame = lambda x: spark.createDataFrame([("x", w) for w in x], "block string, words array<string>")
    asked = []
    cut = names.cut
    monkeypatch.setattr(names, "cut", lambda df: asked.append(cut(df)) or asked[-1])
    names.similar_names(frame(rows), frame(left[:1]), 0.72)
    facts = {r.word: r for df in asked if "like0" in df.columns and "known" in df.columns for r in df.collect()}
    bits = lambda r, c: {(k, i) for k in (0, 1) for i in range(61) if getattr(r, f"{c}{k}") >> i & 1}
    assert len(bits(facts["services"], "like")) == 1  # not those of its eight misspellings too
    assert all(bits(facts["services"], "like") <= bits(facts[w], "own") for (w,) in typed)



def test_a_name_is_told_once_for_all_its_blocks(spark, monkeypatch):
    rows = [["grugarult", "school"], ["pildambilt", "tax"], ["dombuk", "roofing"]]
    frame = spark.createDataFrame([(b, w) for w in rows for b in "xyz"], "block string, words array<string>")
    cuts, cut = [], names.cut
    monkeypatch.setattr(names, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    assert names.similar_names(frame, frame, 0.82).count() == 9
    assert [df.count() for df in cuts if "keys" in df.columns] == [3]


def test_names_and_words_of_one_side_are_never_compared(spark, monkeypatch):
    words = [("crestevax", True, names.LEFT), ("crestevvax", True, names.LEFT), ("dombuki", True, names.RIGHT), ("dombuka", True, names.RIGHT), ("dombuko", True, names.LEFT | names.RIGHT)]
    got = {tuple(r) for r in names.like_words(spark.createDataFrame(words, "word string, whole boolean, sides int")).collect()}
    assert got == {(a, "dombuko") for a in ("dombuki", "dombuka")} | {("dombuko", a) for a in ("dombuki", "dombuka")}
    frame = lambda rows: spark.createDataFrame([("x", w) for w in rows], "block string, words array<string>")
    met, join = [], names.join_salted
    monkeypatch.setattr(names, "join_salted", lambda *x: met.append((x[2], join(*x))) or met[-1][1])
    assert names.similar_names(frame([["ostrefal", "school"]]), frame([["ostrefal", w] for w in ("school", *(f"school{i:02}" for i in range(40)))]), 0.72).count()
    assert sum(df.count() for key, df in met if key == "k") < 200


@pytest.mark.parametrize("text", ["brondodron", "aab", "x" * 30, "äöß2"])
def test_forms(spark, text):
    df = spark.createDataFrame([(text, False), (text, True), ("other", True)], "w string, t boolean")
    one, two = (len(r.f) for r in df.withColumn("f", names._forms("w", "t")).collect()[:2])
    without = lambda words: words | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))}
    assert (one, two) == (len(without({text})), len(without(without({text}))))


def test_parse():
    g = Gazetteer(GEO)
    for text in ("Unit 5, 12B North Foo Street, Sendevam, WS", "Foo St. N. 12B #5 | 1001234 Sendevam", "NO 12B N FOO STR SENDEVVAM"):
        at = parse(text, g)
        assert (at[0], at[5], at[6], at[7], at[8]) == ("sendevam", "12b", "foo", "street", "n"), text
    assert parse(None, g)[5] is None and parse("Sendevam, Quellia", g)[5] is None


@pytest.mark.parametrize(
    ("text", "postcode", "number", "street", "kind", "direction"),
    [
        ("5 Upper Baker Street", None, "5", "upper baker", "street", ""), ("9 Martin Luther King Drive", None, "9", "martin luther king", "drive", ""), ("12 Rue de Rivoli, 75001 Paris", "75001", "12", "rivoli", "rue", ""),
        ("Hauptstrasse 5", None, "5", "haupt", "street", ""), ("5 42nd Street", None, "5", "42nd", "street", ""), ("7 Foo Gardens", None, "7", "foo", "gardens", ""), ("12345 Ventura Boulevard", None, "12345", "ventura", "boulevard", ""),
        ("12-14 Foo Street", None, "12-14", "foo", "street", ""), ("221B Baker St, London NW1 6XE", "nw16xe", "221b", "baker", "street", ""), ("Keizersgracht 12, 1012 AB Amsterdam", "1012ab", "12", "keizers", "gracht", ""),
        ("12 St James Street", None, "12", "st james", "street", ""), ("3rd Floor, 8 North Street", None, "8", "north", "street", ""), ("100 Queen St W, Toronto M5H 2N2", "m5h2n2", "100", "queen", "street", "w"), ("5 Park Place Mews", None, "5", "park place", "mews", ""),
    ],
)
def test_streets_of_all_kinds(text, postcode, number, street, kind, direction):
    assert parse(text, Gazetteer(GEO))[4:9] == (postcode, number, street, kind, direction)


def test_both_readings_of_a_street_match(spark, geo):
    a = spark.createDataFrame([(1, "Sendevam Upper Foobar Street 5"), (2, "Foobar Street 5, Sendevam")], "place_key long, address string")
    b = spark.createDataFrame([(11, "5 Upper Foobar Street, Sendevam"), (12, "5 Foobar St, Sendevam")], "extract_id long, address string")
    assert pairs(same_building(a, b, geo, "place_key", "extract_id")) == [(1, 11), (1, 12), (2, 12)]
    links = {(r.side, r.id): r.links for r in building_links(a, b, geo, "place_key", "extract_id").collect()}
    assert links == {("place_key", 1): 2, ("place_key", 2): 1, ("extract_id", 11): 1, ("extract_id", 12): 2}


def test_large_gazetteers_are_joined(spark, geo, monkeypatch):
    texts = ["Unit 5, 12B North Foo Street, Sendevam, WS", "NO 12B N FOO STR SENDEVVAM", "Port Trekallix, BA, VDR", "W. Tullidud", None, " ", "12 Foo Street", "Sendevam Sendevam", "Brasuskal"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = lambda: {r.id: r["at"] for r in parse_addresses(df, "text", geo).collect()}
    want = rows()
    monkeypatch.setattr(addresses, "MOST_PLACES", 2)
    assert rows() == want


def test_same_building(spark, geo):
    left = [(1, "12 Foobar Street, Sendevam"), (2, "Foobar Rd 12, Sendevam"), (3, "12 Foobar St, 1009999"), (4, None), (5, " "), (6, "12 Foobar Street, Port Trekallix, VDR"), (1, "12 Foobar Street, Sendevam")]
    right = [(11, "Suite 9, Foobra Str. 12, Sendevam, QLA"), (12, "12A Foobar Street, Sendevam"), (13, "12 Foobar Street, Sendevam 1009999"), (14, "12 Foobar Street, Port Trekallix, QLA"), (15, "Sendevam")]
    a = spark.createDataFrame(left, "place_key long, address string").withColumn("place", F.lit("clash"))
    b = spark.createDataFrame(right, "extract_id long, address string")
    assert pairs(same_building(a, b, geo, "place_key", "extract_id")) == [(1, 11), (1, 13), (3, 11), (3, 13)]
    assert pairs(same_building(a.limit(0), b, geo, "place_key", "extract_id")) == []


def test_streets_two_errors_apart(spark, geo):
    left = [(1, "381 Vrntellond Terrace, Sendevam"), (2, "381 Vrntellond Terrace, 1009999"), (3, "7 Vrntellond Terrace, 2009999"), (4, "381 Vrntallond Terrace, Sendevam")]
    right = [(11, "381 Ventelond Terrace, Sendevam 1009999"), (12, "7 Ventelond Terrace, 2009999"), (13, "381 Foo Terrace, Sendevam")]
    a, b = spark.createDataFrame(left, "place_key long, address string"), spark.createDataFrame(right, "extract_id long, address string")
    assert pairs(same_building(a, b, geo, "place_key", "extract_id")) == [(1, 11), (2, 11), (3, 12)]


def test_no_address_is_broadcast(spark, geo, monkeypatch, tmp_path):
    a = spark.createDataFrame([(1, "12 Foobar Street, Sendevam"), (3, "12 Foobar St, 1009999")], "place_key long, address string")
    b = spark.createDataFrame([(11, "Foobra Str. 12, Sendevam, QLA"), (13, "12 Foobar Street, Sendevam 1009999")], "extract_id long, address string")
    for name, df in (("a", a), ("b", b)):
        df.write.parquet(f"{tmp_path}/{name}")  # only files have an estimated size
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    plans = []
    cut = address_matching.cut
    monkeypatch.setattr(address_matching, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    address_matching._matched(a, b, geo, "place_key", "extract_id", "address")
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


# names
def test_words_and_similarity():
    assert names.words_of("The Dr. Liz Hald-ubund Health Svcs Pvt Ltd | Sleep studies") == ["elizabeth", "haldubund", "health", "services"]
    assert names.words_of(None) == [] and names.words_of("Home") == []
    same = names.soft_similarity(["kres", "tevax", "school"], ["krestevax", "school"], [6, 6, 2], [7, 2])
    other = names.soft_similarity(["krestevax", "school"], ["krestevax", "roofing"], [7, 3], [7, 3])
    assert same > 0.9 > 0.75 > other and names.soft_similarity([], ["a"], [], [1]) == 0


PLACES = "place_key long, title string, website string, phonenumber string, address string"


def test_variant_links(spark, geo):
    places = [(1, "Crestevax Language School Ltd", None, " ", "Sendevam, Quellia"), (2, "Cres tevax Lang. School", "", None, "Sendevam"), (3, "Crestevax Roofing", None, None, "Sendevam"), (4, "Crestevax Language School", None, None, "Port Trekallix, VDR"), (5, None, None, None, "Sendevam"), (6, "Crestevax Language School", "http://x.example", None, "Sendevam")]
    pages = [(11, "http://www.cres.example/a", "Crestevvax Language School", "Sendevam, WS"), (12, "https://cres.example:443/b", "Home", None), (13, "http://other.example", "Dombuk Haulage", "Sendevam"), (14, None, "Crestevax Language School", "Sendevam"), (12, "https://cres.example:443/b", "Home", None)]
    a, b = spark.createDataFrame(places, PLACES), spark.createDataFrame(pages, "extract_id long, url string, name string, address string")
    assert pairs(variant_links(a, b, geo)) == [(1, 11), (1, 12), (2, 11), (2, 12)]
    assert {(r.side, r.id): r.links for r in variant_classes(a, b, geo).collect() if r.links} == {("place_key", 1): 2, ("place_key", 2): 2, ("extract_id", 11): 2, ("extract_id", 12): 2}


def test_platforms_are_matched_too(spark, geo, monkeypatch):
    places = [(1, "Crestevax Language School", None, None, "Sendevam"), (2, "Dombukil Haulage", None, None, "Port Trekallix, VDR"), (3, "Tevaxil Roofing", None, None, "Sendevam")]
    pages = [(11, "http://platform.co.uk/a", "Crestevax Language School", "Sendevam"), (12, "http://platform.co.uk/b", "Dombukil Haulage", None), (13, "http://other.co.uk/", "Tevaxil Roofing", "Sendevam")]
    a, b = spark.createDataFrame(places, PLACES), spark.createDataFrame(pages, "extract_id long, url string, name string, address string")
    want = pairs(variant_links(a, b, geo))
    monkeypatch.setattr(name_variants, "MOST_NAMES", 1)
    assert want == pairs(variant_links(a, b, geo)) == [(1, 11), (1, 12), (3, 13)]


def test_variants_of_mistyped_names_without_city(spark, geo):
    places = [(1, "Grugarult Solicitors", None, None, "Sendevam"), (2, "Pildambilt Render Works", None, None, "Sendevam"), *[(10 + i, f"{n} Solicitors", None, None, "Sendevam") for i, n in enumerate(("Dombuk", "Haldubund", "Tevaxil", "Crestevax"))]]
    pages = [(21, "http://a.example", "Grugaru lt Solicitors", None), (22, "http://b.example", "Grugrault Solicitors", None), (23, "http://c.example", "Pildambitl Redner Works", None), (24, "http://d.example", "Ostrefal Solicitors", None)]
    a, b = spark.createDataFrame(places, PLACES), spark.createDataFrame(pages, "extract_id long, url string, name string, address string")
    assert pairs(variant_links(a, b, geo)) == [(1, 21), (1, 22), (2, 23)]


def test_linkage(spark, geo):
    places = [(1, "Crestevax Language School", "http://cres.example", "555 123 4567", "12 Foobar St, Sendevam"), (2, "Crestevax Language School", "http://cres.example", "555 123 4567", "9 Other Rd, Port Trekallix, VDR"), (3, "Dombukil Haulage", None, None, "Sendevam"), (4, None, None, None, None)]
    listings = [(11, "The Crestevax Lang. School Ltd", None, "+1 555 123 4567", "Foobar Street 12, Sendevam"), (12, "Crestevax Roofing", None, None, "Sendevam"), (13, "Dombukil Haulage LLC", None, None, "Sendevam"), (14, "", None, None, "Sendevam"), (13, "Dombukil Haulage LLC", None, None, "Sendevam")]
    kind = PLACES.replace("place_key", "listing_id")
    left, right = spark.createDataFrame(places, PLACES), spark.createDataFrame(listings, kind)
    rows = linkage.link_businesses(left, right, geo).collect()
    assert {(r.side, r.id) for r in linkage.business_links(left, right, geo).collect() if r.links} == {("place_key", 1), ("place_key", 3), ("listing_id", 11), ("listing_id", 13)}
    assert sorted((r.place_key, r.listing_id) for r in rows) == [(1, 11), (3, 13)] and all(0.5 <= r.confidence <= 1 for r in rows)


def test_best_value_is_the_minimum():
    import numpy as np
    import pandas as pd

    rng = random.Random(2)
    low = [[{"w": rng.random(), "v": rng.random()} for _ in range(3)] for _ in range(20)]
    up = [[{"w": rng.random(), "v": rng.random()} for _ in range(3)] for _ in range(20)]
    pull = np.array([4 * rng.random() for _ in range(20)])
    table = lambda rules: pd.DataFrame({k: [np.array([r[k] for r in x]) for x in rules] for k in "wv"})
    got = linkage._best(table(low), table(up), pull, 4)
    grid = np.linspace(0, 1, 2001)
    for k in range(20):
        cost = sum(r["w"] * np.maximum(0, r["v"] - grid) ** 2 for r in low[k]) + sum(r["w"] * np.maximum(0, grid - r["v"]) ** 2 for r in up[k]) + linkage.STEP / 2 * (4 * grid**2 - 2 * pull[k] * grid)
        assert abs(grid[cost.argmin()] - got[k]) < 2e-3


# survivors
REC = "extract_id long, url string, crawled_at timestamp, origin string, name string, email array<string>, phone array<string>, address string, services string"


def test_survivors(spark, geo):
    import datetime as dt

    t = dt.datetime
    rows = [(1, "http://a.example/x", t(2025, 1, 1), "footer", "n", ["info@", "a@a.example"], ["2019 - 2024"], "Sendevam", "tax; law [more]"), (2, "https://WWW.a.example:443/", t(2025, 2, 1), "ld", "n", ["noreply"], ["+1 555 123 4567"], "Address line 1", "Services: "), (3, "http://m.a.example", None, None, "n", None, ["n/a", "555 123 4567"], "5 Foobar St, Sendevam", "We offer tax, law"), (4, "http://b.example", t(2025, 1, 1), "ld", "n", ["b@b.example"], [], "", None), (4, "http://b.example", t(2025, 1, 1), "ld", "n", ["b@b.example"], [], "", None), (5, None, None, "ld", "n", None, None, None, None)]
    recs, origins = spark.createDataFrame(rows, REC), spark.createDataFrame([("footer", 1), ("ld", 5)], "origin string, trust int")
    assert pairs(survivors.surviving_values(recs, origins, geo)) == [(1, "address", 3), (1, "email", 1), (1, "phone", 2), (1, "services", 3)]
    fused = survivors.fused_values(recs, origins, geo).collect()
    assert {(r.group_id, r.field) for r in fused} == {(1, f) for f in survivors.FIELDS} and all(0 < r.posterior <= 1 for r in fused)
    assert survivors.surviving_values(recs.limit(0), origins, geo).count() == 0 and survivors.fused_values(recs.limit(0), origins, geo).count() == 0


def test_no_origin_is_dropped(spark, geo):
    rows = [(k, "http://a.co.uk", None, f"o{k}", "n", [f"m{k}@a.example"], [f"555 123 4{k:03d}"], "5 Foobar St, Sendevam", "tax") for k in range(1, 1200)] + [(5000, "http://b.co.uk", None, "o1", "n", ["x@b.example"], None, None, None)]
    recs, origins = spark.createDataFrame(rows, REC), spark.createDataFrame([(f"o{k}", k) for k in range(1, 1200)], "origin string, trust int")
    assert {(r.group_id, r.extract_id) for r in survivors.surviving_values(recs, origins, geo, 1).collect()} == {(1, 1199)}


def test_all_entries_vote(spark, geo):
    rows = [(1, "http://a.example", None, "x", "n", ["one@a.example", "two@a.example"], None, None, None), (2, "http://a.example", None, "y", "n", ["two@a.example"], None, None, None), (3, "http://a.example", None, "z", "n", ["three@a.example"], None, None, None)]
    recs, origins = spark.createDataFrame(rows, REC), spark.createDataFrame([("z", 9)], "origin string, trust int")
    assert [(r.value, r.extract_id) for r in survivors.fused_values(recs, origins, geo).collect()] == [("two@a.example", 1)]
    assert pairs(survivors.surviving_values(recs, origins, geo)) == [(1, "email", 3)]


def test_no_stage_without_effect_on_survivors(spark, geo, monkeypatch):
    rows = [(k, f"http://{s}.example", None, o, "n", [f"m{k}@a.example"], None, None, None) for k, (s, o) in enumerate([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("b", "z")])]
    recs, origins = spark.createDataFrame(rows, REC), spark.createDataFrame([("x", 1), ("z", 9)], "origin string, trust int")
    monkeypatch.setattr(survivors, "_rated", lambda *_: pytest.fail("the order alone decides"))
    assert pairs(survivors.surviving_values(recs, origins, geo)) == [(0, "email", 0), (3, "email", 4)]


def test_copies_are_found(spark):
    rows = [(0.7, 0.7, 40.0, 30.0, 5.0), (0.7, 0.7, 50.0, 0.0, 50.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, t double, f double, d double").select(survivors.dependence(*[F.col(c) for c in "abtfd"])).collect()]
    assert got[0] > 0.95 > 0.2 > got[1]


# leaked items
ITEM = "Of 7763 cards that Prosupend Melmosix sent to Dollutis, 47 came back bilingual, against advice in January. Kotalmast wants 172 telephone slips from Prosupend Melmosix by October; Flotoldurt offers 8765, stale but by a single vote."
STOCK = "Read the note below and choose the answer that the front office would have given. "


def test_leaks(spark):
    items = [(i, STOCK + ITEM.replace("Prosupend", f"P{i}supend").replace("7763", f"{i}{i}63").replace("47 ", f"{i}7 ").replace("Melmosix", f"Melm{i}six").replace("Dollutis", f"D{i}llutis").replace("Kotalmast", f"Kot{i}mast").replace("172", f"1{i}2").replace("Flotoldurt", f"Flot{i}durt").replace("8765", f"8{i}65")) for i in range(1, 7)] + [(9, None), (10, "")]
    passage = items[1][1][len(STOCK) :]
    reworded = re.sub(r"(\w+) (\w+) (\w+)", r"\1 \2 indeed \3", passage).replace("came", "went")
    docs = [(1, "Before. " + passage + " After."), (2, "Text " + reworded), (3, "x " + passage[:60] + "\n<b>Other text stands here now.</b>\n" + passage[60:].upper()), (4, STOCK * 3), (5, "he sent 2263 cards that P2supend " + "word " * 50), (6, None), (7, ""), (8, passage.replace("supend", "su­pend").replace("cards", "ca-\nrds"))]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, h int")
    assert pairs(leakage.leaked_items(df, spark.createDataFrame(items, "item_id long, text string"))) == [(1, 2), (2, 2), (3, 2), (8, 2)]
    assert leakage.leaked_items(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leakage.leaked_items(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_long_and_dense_items(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500))
    items = [(1, "Quorvelt beats Zundrik"), (2, long), (3, "東京都の人口は千四百万人である。調査は毎年行われる"), (4, "plain words stand here for nothing in particular today")]
    docs = [(1, "He said that Quorvelt beats Zundrik, indeed."), (2, "x " + " ".join(long.split()[100:300]) + " y"), (3, "報告:東京都の人口は千四百万人である。以上"), (4, "nothing of all that"), (5, " ".join(long.split()[:100]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert pairs(leakage.leaked_items(df, spark.createDataFrame(items, "item_id long, text string"))) == [(1, 1), (2, 2), (3, 3)]


def test_items_of_shared_words_are_found(spark):
    stock = ["Wamendom lists quiet plates today.", "Bretisturt sends amber slips often.", "Kotalmast keeps stale badges here.", "Losurvost wants sealed pins again.", "Stivulek finds blank rosters twice."]
    two = [(10 * i + j, f"{stock[i]} {stock[j]}") for i in range(5) for j in range(i + 1, 5)]
    docs = [(1, "Before all that. " + ITEM + " After."), (2, f"He wrote: {stock[0]} {stock[1]} And so on."), (3, f"He wrote: {stock[0]} And so on."), (4, f"{stock[3]} That is all.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([*[(100 + k, ITEM if k % 2 else ITEM.upper()) for k in range(6)], *two, (200, stock[3])], "item_id long, text string")
    assert pairs(leakage.leaked_items(df, items)) == [*[(1, 100 + k) for k in range(6)], (2, 1), (4, 200)]


def test_a_third_of_a_short_item_is_found(spark):
    rng = random.Random(11)
    items = [["".join(rng.choice("abcdefghklmnoprstu") for _ in range(7)) for _ in range(12)] for _ in range(30)]
    docs = [(k, f"so it was {' '.join(w[3:7])} as they say") for k, w in enumerate(items)]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert pairs(got) == [(k, k) for k in range(30)]


def test_winnowing_keeps_every_shared_run(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(1000) for _ in range(30)], [rng.randrange(1000) for _ in range(30)], [rng.randrange(1000, 2000) for _ in range(2)]) for _ in range(50)]
    df = spark.createDataFrame([(a + run, run + b) for a, b, run in rows] + [([5], [5])], "a array<long>, b array<long>")
    assert df.filter(~F.arrays_overlap(leakage.winnow(F.col("a")), F.col("b"))).count() == 0
    longer = spark.createDataFrame([(a + run * 2, run * 2 + b) for a, b, run in rows] + [([5], [5])], "a array<long>, b array<long>")
    assert longer.filter(~F.arrays_overlap(leakage.winnow(F.col("a"), 4), leakage.winnow(F.col("b"), 4))).count() == 0


# subjects
def test_subjects(spark):
    rng = random.Random(6)
    words = {1: "ledger audit invoice loan accruals treasury payroll bond tax margin budget auditor interest cashflow pension fund credit debtor".split(), 2: "goal match striker coach derby keeper relay sprint stadium league penalty squad referee training marathon trophy jersey".split()}
    plain_ = ["the door is green and it stands open to you.", "we are here for you since a long time."]
    docs, labels = [], []
    for i in range(300):
        own = rng.choice([[1], [2], [1, 2], []])
        s = [f"we have the {rng.choice(words[k])} and a {rng.choice(words[k])} for you." for k in own for _ in range(3)] + plain_
        docs.append((i, " ".join(s)))
        if i < 80:
            labels += [(i, k) for k in own] or [(i, None)]
    docs += [(900, None), (901, ""), (902, "   "), (903, "x " * 50_000)]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, labels string")
    lab = spark.createDataFrame(labels + labels[:3], "doc_id long, subject_id long")
    got = set(pairs(subjects.subjects_of(df, lab)))
    want = {(i, k) for i, t in docs[80:300] for k in (1, 2) if any(w in t for w in words[k])}
    held_out = {x for x in got if 80 <= x[0] < 300}
    assert len(held_out & want) / len(want) > 0.95 and len(held_out & want) / len(held_out) > 0.95
    assert not {x for x in got if x[0] >= 900}
    assert subjects.subjects_of(df, lab.limit(0)).count() == 0

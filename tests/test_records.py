from pyspark.sql import functions as F

from gleanwork.operators import phrases
from gleanwork.plans import records

PLACES = "place_key long, seq long, fetched_at timestamp, title string, website string, cid string, placeid string, phonenumber string, address string, category string"
PAGES = "extract_id long, url string, name string, email array<string>, phone array<string>, address string, services string"


def test_pages_complete_listings_and_add_companies(spark):
    log = spark.createDataFrame([(7, "bakery in Leipzig")], "seq long, query string")
    places = spark.createDataFrame([(1, 7, None, "Brotlinde", "https://brotlinde.test/x", "c1", None, "0341 7720415", "3 Quay Rd, Leipzig, Germany", "bakery"), (2, 7, None, "Brotlinde", "", "c2", None, None, "", "bakery"), (3, 7, None, "Daily Herald", "", "c3", None, "1", "x", "bakery")], PLACES)
    pages = spark.createDataFrame(
        [
            (11, "https://brotlinde.test/", "Brotlinde", [], None, "", "rye"),
            (12, "https://brotlinde.test/contact", None, ["shop@brotlinde.test"], None, None, None),
            (21, "http://okapi.test", None, None, ["+27 21 555 0134"], None, None),
            (22, "http://okapi.test/contact", "Okapi Depot", ["yard@okapi.test"], None, "3 Quay Rd, Cape Town", "crates"),
            (31, "http://silent.test/", "Silent Films", None, None, "x", None),
            (41, "https://facebook.com/okapi", "Okapi", ["a@okapi.test"], None, None, None),
        ],
        PAGES,
    )
    got = {r.seq: r for r in records.records(places, log, pages).collect()}
    assert set(got) == {1, 21 + records.AFTER_LISTINGS}
    assert got[1].business_email == "shop@brotlinde.test" and got[1].services == "bakery | rye" and got[1].source_page.endswith("/contact") and (got[1].city, got[1].country) == ("", "Germany")
    other = got[21 + records.AFTER_LISTINGS]
    assert other.company_name == "Okapi Depot" and other.business_phone == "+27 21 555 0134" and other.business_email == "yard@okapi.test"
    assert records.records(places.limit(0), log, pages.limit(0)).count() == 0


def test_target_caps_a_category(spark):
    log = spark.createDataFrame([], "seq long, query string")
    rows = [(i, None, None, f"Firm number {i} {'abcdef'[i]}x", None, f"c{i}", None, f"0341 77204{i}0", "x", "bakery") for i in range(5)]
    assert sorted(r.seq for r in records.records(spark.createDataFrame(rows, PLACES), log, None, 2).collect()) == [0, 1]


def test_places_asked_for_fill_in(spark):
    df = spark.createDataFrame([("",), ("3 Quay Rd, Leipzig, Saxony, Germany",)], "full_business_address string")
    assert [tuple(r)[1:] for r in records.located(df, state="Thuringia", location="Jena").collect()] == [("", "Thuringia", ""), ("Leipzig", "Saxony", "Germany")]
    assert [tuple(r)[1:] for r in records.located(df.limit(1), location="Jena").collect()] == [("Jena", "", "")]


def test_query_pool(spark):
    df = spark.createDataFrame([("Rye Bakery Services", ["rye", "Rye"], "Jena", ["Gera"])], "n string, k array<string>, l string, c array<string>")
    pool = lambda most: df.select(phrases.query_pool(F.col("n"), F.col("k"), F.col("l"), F.col("c"), F.lit(most))).first()[0]
    assert pool(6) == ["rye in Jena", "rye companies in Jena", "Rye Bakery Services in Jena", "Rye Bakery companies in Jena", "rye in Gera", "Rye Bakery Services in Gera"]
    assert pool(1000)[-1] == "specialist Rye Bakery companies in Gera" and len(pool(1000)) == len({q.lower() for q in pool(1000)})
    assert df.select(phrases.expansion_phrases(F.col("n"), F.col("k"))).first()[0][:4] == ["rye consultants", "rye contractors", "rye services company", "Rye Bakery consultants"]

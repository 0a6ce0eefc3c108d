import json
import zipfile

from pyspark.sql import functions as F

from gleanwork.functions import html
from gleanwork.sinks import files
from gleanwork.sources import search

BAKERY = """<!doctype html><title>Brotlinde Mühle – Bäckerei</title><meta property="og:description" content="Bread since 1907."><nav><a href="#menu">Menu</a>
<a href="/visit-us">Plan a trip</a><a href="/team?x=1#top">Contact the crew</a><a href="/kontakt/contact.html">Mail</a><a href="/price.pdf">Contact sheet</a></nav>
<p>Hotline (0341) 77 20 415, fax 0341 77 20 99, since 1907 - 2024, order 1234567890</p>
<ul><li><a href="/products/rye">Rye loaves</a><li><a href="/products">Read more</a><li><a href="/solutions/catering">Catering</a></ul>
<a href="https://www.instagram.com/brotlinde">Photos</a><a href="https://muehlenverband.test/a">Guild</a><a href="https://shop.muehlenverband.test/b">Guild shop</a>
<a href="mailto:Laden@brotlinde.test?cc=x@y.test">Post</a><a href="tel:+49-341-7720415">Ring</a><style>.a{}</style>
<div class="our address">Plot 5, Gerber Industrial Estate, Leipzig 04109</div>"""
DEPOT = """<script type="application/LD+json">[{"@type":["Thing","Store"],"legalName":"Okapi Depot","telephone":["+27 21 555 0134","x"],"email":"mailto:Yard@okapi-depot.test","address":[{"streetAddress":"3 Quay Rd","addressCountry":{"name":"South Africa"}}]}]</script>
<script type="application/ld+json">{broken</script><title>Service unavailable</title><h2>Crates</h2><h3>Menu</h3><h3>Pallets on loan</h3>"""


def test_extraction():
    got = html.extract(BAKERY, "https://brotlinde.co.uk/")
    assert got["name"] == "Brotlinde Mühle" and got["email"] == ["laden@brotlinde.test", "x@y.test"]
    # a tel link goes first, then what looks most like a number; plain counting and years are none
    assert got["phone"] == ["+49 341 7720415", "(0341) 77 20 415"]
    assert got["address"] == "Plot 5, Gerber Industrial Estate, Leipzig 04109" and not got["blocked"]
    assert got["contact_links"] == ["https://brotlinde.co.uk/kontakt/contact.html", "https://brotlinde.co.uk/visit-us", "https://brotlinde.co.uk/team?x=1"]
    # neither social sites nor a second page of one site
    assert got["external_links"] == ["https://muehlenverband.test/a"] and not got["listing"]
    assert got["services"] == "Bread since 1907. | Services: Rye loaves, Catering"


def test_linked_data_comes_first():
    got = html.extract(DEPOT, "https://okapi-depot.test/")
    assert got["name"] == "Okapi Depot" and got["phone"] == ["+27 21 555 0134"] and got["email"] == ["yard@okapi-depot.test"]
    assert got["address"] == "3 Quay Rd, South Africa" and got["blocked"] and got["services"] == "Services: Crates, Pallets on loan"


def test_sites_under_second_level_names_are_apart():
    page = "<a href='https://other.co.uk/contact'>a</a><a href='https://www.mine.co.uk/locations'>b</a>"
    got = html.extract(page, "http://mine.co.uk")
    assert got["contact_links"] == ["https://www.mine.co.uk/locations"] and got["external_links"] == ["https://other.co.uk/contact"]


def test_many_links_make_a_list():
    page = "".join(f"<a href='https://firm{i}.test/'>x</a>" for i in range(html.LIST_LINKS))
    assert html.extract(page, "http://list.test")["listing"] and not html.extract(page[: -len("<a href='https://firm11.test/'>x</a>")], "http://list.test")["listing"]


def test_whole_pages_are_read_if_wanted():
    late = "x " * 150_000 + "late@far.test"
    assert html.extract(late, "")["email"] == [] and html.extract(late, "", scan=None)["email"] == ["late@far.test"]


def test_pages_column(spark):
    df = spark.createDataFrame([("https://brotlinde.test/", BAKERY), ("https://x.test/", None), (None, "<p>broken <b"), ("https://[bad", "<a href='https://[bad/contact'>contact</a>"), ("https://y.test", "a" * 300_000)], "url string, html string")
    rows = html.extract_pages(df).select("page.*").collect()
    assert rows[0].name == "Brotlinde Mühle" and rows[1].email == [] and rows[1].name == "x.test" and len(rows) == 5


def test_replay_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"kind": "places", "query": "q", "page": 1, "places": [{"title": "A", "cid": "1", "thumbnailUrl": "x"}, {"title": "B", "cid": "1"}, {"title": "C"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"kind": "organic", "query": "q", "organic": [{"link": "https://a.example"}, {"link": "ftp://b"}, {"link": "https://a.example"}]}))
    (tmp_path / "c.json").write_text("{broken")
    df = search.replayed(spark, str(tmp_path))
    assert df.count() == 6
    assert sorted(r.title for r in search.distinct_listings(df.filter("kind = 'places'"), ["query", "page"], "pos").collect()) == ["A", "C"]
    assert [r.link for r in search.organic_links(df.filter("kind = 'organic'")).collect()] == ["https://a.example"]


def test_full_pages(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 7), ("a", 3, 10)], "q string, page int, n int")
    assert sorted(r.page for r in search.full_pages(df, "q", "page", "n").collect()) == [1, 2]


def test_robots(spark):
    pages = spark.createDataFrame([("http://a.example/private/x",), ("http://a.example/ok",), ("http://b.example/",), ("http://dead.example/",)], "url string")
    robots = spark.createDataFrame([("a.example", "/private"), ("dead.example", None)], "host string, rule string")
    assert sorted(r.url for r in search.allowed_by_robots(pages, robots).collect()) == ["http://a.example/ok", "http://b.example/"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("=x", "a"), ("y", "b")], "name string, category string")
    assert files.write_if_changed(df, str(tmp_path / "t")) and not files.write_if_changed(df.orderBy(F.desc("name")), str(tmp_path / "t"))
    assert files.write_if_changed(df.limit(1), str(tmp_path / "t"))
    files.by_category(df, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("category=*")) == ["category=a", "category=b"]
    assert files.workbook(df, str(tmp_path / "w.xlsx"), "a/b") == 2
    assert " =x" in zipfile.ZipFile(tmp_path / "w.xlsx").read("xl/worksheets/sheet1.xml").decode()
    files.save_snapshot({"t": df}, str(tmp_path / "s"))
    assert files.load_snapshot(spark, str(tmp_path / "s"))["t"].count() == 2 and files.load_snapshot(spark, str(tmp_path / "none")) == {}
    # a checkpoint may be written from the last one, and only the last two are kept
    for _ in range(3):
        files.save_snapshot({"t": files.load_snapshot(spark, str(tmp_path / "s"))["t"].unionByName(df)}, str(tmp_path / "s"))
    assert files.load_snapshot(spark, str(tmp_path / "s"))["t"].count() == 8 and len(list((tmp_path / "s").glob("version=*"))) == 2


def test_workbooks_go_on_with_further_sheets(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    assert files.workbook({"Big": spark.range(25).select("id"), "big": spark.range(0).select("id")}, path, most=10) == 25
    assert files.rows_held(path) == {"Big": 10, "Big 2": 10, "Big 3": 5, "big 4": 0}
    df = spark.createDataFrame([("x", "a"), ("y", None)], "name string, category string")
    assert files.category_workbooks(df, str(tmp_path)) == {"": 1, "a": 1}


def test_ledger_csv(spark, tmp_path):
    df = spark.createDataFrame([("k2", 2), ("k1", 1)], "key string, ts int")
    files.ledger_csv(df, str(tmp_path / "l"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "l").glob("*.csv")))
    assert text.startswith("\ufeffkey,ts\n") and text.index("k1") < text.index("k2")


def test_engines_in_order(spark):
    engines = spark.sql("select 'a' engine, 1 nr, 2 failures, timestamp'2026-01-01 00:00:00' failed_at union all select 'b', 2, 0, null union all select 'c', 3, 0, null")
    results = spark.createDataFrame([("a", "q", "1"), ("b", "q", "2"), ("c", "q", "3"), ("c", "r", "4")], "engine string, query string, link string")
    got = lambda now: sorted(r.link for r in search.first_answer(engines, results, now).collect())
    assert got("2026-01-01 00:00:59") == ["2", "4"] and got("2026-01-01 00:01:00") == ["1", "4"]


def test_links_until_there_are_enough(spark):
    df = spark.createDataFrame([("q", 1, 0, "http://a"), ("q", 1, 1, "http://b"), ("q", 2, 0, "http://a"), ("q", 2, 1, "http://c"), ("q", 3, 0, "http://d")], "query string, page int, pos int, link string")
    assert sorted(r.link for r in search.found_in_order(df, 3).collect()) == ["http://a", "http://b", "http://c"]

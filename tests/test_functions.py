import pytest
from pyspark.sql import functions as F

from gleanwork.functions import rules
from gleanwork.functions import text as X


def values(spark, rows, *cols):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [tuple(r) for r in df.select(*[c.alias(f"o{i}") for i, c in enumerate(cols)]).collect()]


def test_urls(spark):
    c = F.col("c0")
    cases = {
        "https://user@WWW.Shop.Example.co.uk:8080/a?b": ("shop.example.co.uk", "example.co.uk"),
        "acme.com/path": ("acme.com", "acme.com"),
        "http://a b.com/": ("a b.com", "a b.com"),
        "http://under_score.example.org": ("under_score.example.org", "example.org"),
        "": ("", ""),
        None: ("", ""),
    }
    got = values(spark, [(u,) for u in cases], X.norm_domain(c), X.root_domain(c))
    # a blank URL has no host
    assert got == list(cases.values())


def test_skip_domains(spark):
    c = F.col("c0")
    got = values(spark, [("https://www.yelp.com/x",), ("daily-news.example",), ("city.gov",), ("acme.example",), ("",)], X.is_skip_domain(c), X.is_aggregator(c))
    assert got == [(True, True), (True, False), (True, False), (False, False), (True, False)]


def test_names_and_contacts(spark):
    c = F.col("c0")
    assert values(spark, [("Brotlinde Pvt. Ltd.",), ("IBM",), (None,), ("Été & Fils GmbH",)], X.norm_name(c)) == [("brotlinde",), ("",), ("",), ("tfils",)]
    assert values(spark, [("+27 21 555 0134",), ("1234567",), (None,)], X.norm_phone(c)) == [("7215550134",), ("",), ("",)]
    assert values(spark, [("  A@B.C \n",), (None,)], X.norm_email(c)) == [("a@b.c",), ("",)]
    assert values(spark, [("=1+1",), ("-5",), ("a \u0007 b",), (None,)], X.cell_safe(c)) == [(" =1+1",), ("-5",), ("a b",), ("",)]


@pytest.mark.parametrize(("phone", "good"), [("+27 21 555 0134", True), ("123-456-7890", False), ("2019 - 2024", False), ("12/05/2024", False), ("000 000 0000", False), ("123", False)])
def test_valid_phone(spark, phone, good):
    assert values(spark, [(phone,)], X.valid_phone(F.col("c0"))) == [(good,)]


def test_contacts_in_text(spark):
    row = values(spark, [("Mail: Yard@Okapi.io, x@example.com, yard@okapi.io. Call (021) 555-0134 or 021 555 0134",)], X.find_emails(F.col("c0")), X.find_phones(F.col("c0")))[0]
    assert row[0] == ["yard@okapi.io"]
    assert row[1] == ["(021) 555-0134"]


def test_titles(spark):
    c = F.col("c0")
    assert values(spark, [("Home | Brotlinde Mühle",), ("Okapi – Crates",), ("Welcome",), (None,), ("A|Bc",)], X.clean_title(c)) == [("Brotlinde Mühle",), ("Okapi",), ("",), ("",), ("A|Bc",)]


def test_query_keys(spark):
    a, b = F.col("c0"), F.col("c1")
    pairs = [("Top recruitment agencies in St. Louis", "recruitment agency in St Louis", True), ("staffing agency in Delhi", "recruitment agency in Delhi", False), ("3D rendering studios", "3D rendering services", True), ("3D animation studio", "3D rendering studio", False)]
    assert [x == y for x, y in values(spark, [(p, q) for p, q, _ in pairs], X.norm_query(a), X.norm_query(b))] == [e for *_, e in pairs]


def test_split_address(spark):
    rows = [("12 MG Road, Bangalore, Karnataka 560001, India", ""), ("Mumbai", ""), ("", "Austria"), ("", "Pune"), (None, None)]
    got = [tuple(r[0]) for r in values(spark, rows, X.split_address(F.col("c0"), F.col("c1")))]
    assert got == [("Bangalore", "Karnataka", "India"), ("", "Mumbai", ""), ("", "", "Austria"), ("Pune", "", ""), ("", "", "")]


def test_redirects(spark):
    c = F.col("c0")
    got = values(spark, [("/l/?uddg=https%3A%2F%2Facme.example%2F&x=1",), ("https://s.example/ck?u=a1aHR0cHM6Ly9hY21lLmV4YW1wbGU",), ("https://plain.example",)], X.unwrap_redirect(c))
    assert got == [("https://acme.example/",), ("https://acme.example",), ("https://plain.example",)]


def test_blocked_urls(spark):
    bad = ["http://127.0.0.1/", "http://[::1]/", "http://169.254.169.254/x", "http://10.0.0.8", "http://192.168.1.1", "http://100.64.0.1", "file:///etc/passwd", "ftp://a.example", "http://a.example:22/", "http://printer.local", "http://x.internal/", "http://0.0.0.0/", "http://2130706433/", "http://0x7f.1/", "http://010.0.0.1/"]
    good = ["https://acme.example/", "http://acme.example:8080/x", "https://8.8.8.8/"]
    got = [r[0] for r in values(spark, [(u,) for u in bad + good], X.url_block_reason(F.col("c0")))]
    assert all(got[: len(bad)]) and not any(got[len(bad) :])


def test_rejection_order(spark):
    cols = [F.col(f"c{i}") for i in range(5)]
    rows = [("IBM", "", "", "", ""), ("Daily Herald", "http://yelp.com", "", "", ""), ("Acme Staffing", "http://yelp.com", "", "", ""), ("Acme Staffing", "", "", "1", ""), ("Acme Staffing", "http://acme.example", "", "", "")]
    got = [r[0] for r in values(spark, rows, rules.rejection(*cols, F.lit(False)))]
    assert got == ["no plausible company name", "name looks like publisher or article", "website is a directory, social or media domain", "no official website and not a listing", ""]


def test_confidence(spark):
    cols = [F.col(f"c{i}") for i in range(5)]
    got = values(spark, [("Acme Staffing", "http://a.example", "a@b.c", "1", "x"), ("", "", "", "", "")], rules.confidence(*cols, F.lit(True)))
    assert got == [(100,), (10,)]

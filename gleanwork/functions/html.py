"""What a crawled page says about its company: one Arrow function from HTML to a struct."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain, islice
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import constants as C

SCHEMA = "name string, email array<string>, phone array<string>, address string, services string, title string, blocked boolean, contact_links array<string>, external_links array<string>, listing boolean"
#: Limits on what is kept of a page.
SCAN, MOST_EMAILS, MOST_PHONES, MOST_EXTERNAL, MOST_SERVICES = 200_000, 3, 2, 60, 10
#: Fixed value: links to other sites from which a page is a list of companies.
LIST_LINKS = 12
_SILENT = {"script", "style", "template", "noscript", "rt", "rp"}
_BLOCK = {"p", "div", "br", "li", "tr", "td", "h1", "h2", "h3", "h4", "section", "article", "header", "footer", "address", "ul", "ol", "table", "title"}
_LD_KEYS = ("@graph", "publisher", "mainEntity", "itemListElement", "item", "provider", "author")
_EMAIL, _PHONE = re.compile(C.EMAIL), re.compile(C.PHONE)
_SERVICE, _CALL, _CONTACT = (re.compile(p, re.I) for p in (C.SERVICE_LINK, C.PHONE_CONTEXT, C.CONTACT_LINK))
_ADDRESS_WORD, _ADDRESS_CLASS = re.compile(C.ADDRESS_WORD, re.I), re.compile(C.ADDRESS_CLASS, re.I)
_FILE = re.compile(r"\.(pdf|jpg|png|zip|docx?)$", re.I)
_MEDIA = re.compile(C.MEDIA_DOMAIN, re.I)
_PUBLIC = re.compile(r"\.(gov|edu|mil)$|\.(gov|edu|ac)\.")
_SKIPPED, _LISTS = frozenset(C.SKIP_DOMAINS), frozenset(C.AGGREGATOR_DOMAINS)


def tidy(s: object) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(s or ""))).strip()


class Page(HTMLParser):
    """Text, links, metadata and marked regions of a page, gathered in one pass."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.text, self.meta, self.anchors, self.heads, self.ld, self.regions = [], {}, [], [], [], {"address": [], "prop": [], "class": []}
        self.title, self.stack, self.open, self.silent = "", [], [], 0
        try:
            self.feed(html)
            self.close()
        except Exception:  # noqa: BLE001 - broken markup keeps what was read before it
            pass

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "meta":
            for k in ("property", "name"):
                if a.get(k):
                    self.meta.setdefault((k, a[k].lower()), a.get("content", ""))
            return
        if tag in ("br", "img", "input", "link", "hr"):
            return
        if tag in _SILENT:
            self.silent += 1
        self.stack.append(tag)
        kinds = []
        if tag == "script" and "ld+json" in a.get("type", "").lower():
            kinds.append(("ld", None))
        if tag == "a":
            kinds.append(("a", a.get("href", "")))
        if tag in ("h2", "h3"):
            kinds.append(("h", None))
        if tag == "title" and not self.title:
            kinds.append(("t", None))
        if tag == "address":
            kinds.append(("address", None))
        if a.get("itemprop", "").lower() == "address":
            kinds.append(("prop", None))
        if _ADDRESS_CLASS.search(a.get("class", "")) or _ADDRESS_CLASS.search(a.get("id", "")):
            kinds.append(("class", None))
        self.open += [(k, v, len(self.stack), []) for k, v in kinds]

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.text.append("\n")
        if tag not in self.stack:
            return
        while self.stack:
            depth, last = len(self.stack), self.stack.pop()
            if last in _SILENT:
                self.silent -= 1
            for entry in [e for e in self.open if e[2] == depth]:
                self.open.remove(entry)
                self.keep(*entry)
            if last == tag:
                break

    def keep(self, kind, value, _, parts):
        s = "".join(parts)
        if kind == "ld":
            self.ld.append(s)
        elif kind == "a":
            self.anchors.append((value, tidy(s)))
        elif kind == "h":
            self.heads.append(tidy(s))
        elif kind == "t":
            self.title = tidy(s)
        else:
            self.regions[kind].append(tidy(s))

    def handle_data(self, data):
        for kind, _, _, parts in self.open:
            if kind == "ld" or not self.silent:
                parts.append(data)
        if not self.silent and "title" not in self.stack[-1:]:
            self.text.append(data)

    def said(self, *names: str) -> str:
        for n in names:
            for k in ("property", "name"):
                if self.meta.get((k, n)):
                    return tidy(self.meta[k, n])
        return ""


def linked_data(blocks: list[str]) -> Iterator[dict]:
    """The objects of the JSON-LD blocks, outer before inner."""

    def walk(node):
        if isinstance(node, list):
            for x in node:
                yield from walk(x)
        elif isinstance(node, dict):
            yield node
            for k in _LD_KEYS:
                if k in node:
                    yield from walk(node[k])

    for block in blocks:
        try:
            yield from walk(json.loads(block))
        except ValueError:
            continue


def organisation(blocks: list[str]) -> dict[str, str]:
    """Name, e-mail, phone, address and description of the organisations in JSON-LD, the first of each."""
    out = {"name": "", "email": "", "phone": "", "address": "", "description": "", "site": ""}
    for node in linked_data(blocks):
        kinds = node.get("@type") or ""
        kinds = [str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])]
        if "website" in kinds:
            out["site"] = out["site"] or tidy(node.get("name"))
        if not any(h in k for k in kinds for h in C.ORGANISATION_TYPES):
            continue
        where = node.get("address")
        where = where[0] if isinstance(where, list) and where else where
        if isinstance(where, dict):
            named = (v.get("name") if isinstance(v := where.get(k), dict) else v for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"))
            where = ", ".join(tidy(v) for v in named if v)
        call = node.get("telephone")
        found = {
            "name": node.get("name") or node.get("legalName"), "email": str(node.get("email") or "").replace("mailto:", "").lower(), "phone": call[0] if isinstance(call, list) and call else call,
            "address": where if isinstance(where, str) else "", "description": node.get("description"),
        }
        for k, v in found.items():
            out[k] = out[k] or (tidy(v) if isinstance(v, (str, int)) else "")
    return out


def root_of(url: str) -> str:
    """``text.root_domain`` for one URL."""
    full = url if "://" in url else f"http://{url}"
    try:
        host = re.sub(r"^www\.", "", re.sub(r":.*$", "", urlsplit(full).netloc.lower().rpartition("@")[2]))
    except ValueError:
        return ""
    labels = [x for x in host.split(".") if x]
    if len(labels) >= 3 and labels[-2] in C.SECOND_LEVEL and len(labels[-1]) == 2:
        return ".".join(labels[-3:])
    return ".".join(labels[-2:]) if len(labels) >= 2 else host


@lru_cache(1 << 14)
def skipped(root: str) -> bool:
    """``text.is_skip_domain`` for one registrable domain."""
    return root == "" or root in _SKIPPED or bool(_PUBLIC.search(root) or _MEDIA.search(re.sub(r"\.[^.]*$", "", root)))


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href).partition("#")[0]
    except ValueError:
        return ""


def _good_email(e: str) -> bool:
    return bool(e) and len(e) <= 80 and not any(b in e for b in C.BAD_EMAIL_PARTS)


def _good_phone(p: str) -> bool:
    d = re.sub(r"\D", "", p)
    return 8 <= len(d) <= 15 and len(set(d)) > 2 and not re.match(C.DATE_LIKE, p) and not re.match(C.YEAR_RANGE, p) and d not in C.SEQUENTIAL_DIGITS


def emails_of(page: Page, html: str, text: str) -> list[str]:
    """Addresses of mailto links, then of the text, then of the markup; the first MOST_EMAILS."""
    links = (unquote(h[7:].partition("?")[0])[:500] for h, _ in page.anchors if h.lower().startswith("mailto:"))
    found = chain(chain.from_iterable(map(_EMAIL.findall, links)), _EMAIL.findall(text), _EMAIL.findall(html))
    tidied = (e.strip(".-_").lower() for e in found)
    return list(islice(dict.fromkeys(e for e in tidied if _good_email(e)), MOST_EMAILS))


def phones_of(page: Page, text: str) -> list[str]:
    """Numbers of tel links, then those that look most like one; of equal digits the first one counts."""
    links = ((10, unquote(h[4:]).replace("-", " ").strip()) for h, _ in page.anchors if h.lower().startswith("tel:"))
    read = ((3 * bool(_CALL.search(text[max(0, m.start() - 30) : m.start()])) + 2 * m[0].strip().startswith("+") + ("(" in m[0]), m[0]) for m in _PHONE.finditer(text))
    ranked: dict[str, tuple[int, str]] = {}
    for score, said in chain(links, read):
        if _good_phone(p := tidy(said)):
            ranked.setdefault(re.sub(r"\D", "", p), (score, p))
    return [p for _, p in sorted(ranked.values(), key=lambda x: -x[0])[:MOST_PHONES]]


def address_of(page: Page, text: str) -> str:
    """The first marked or comma-separated address of a page."""
    sized = lambda t: 10 <= len(t) <= 250
    number = lambda t: sized(t) and any(c.isdigit() for c in t)
    worded = lambda t: number(t) and _ADDRESS_WORD.search(t)
    lines = (tidy(x) for x in text.split("\n") if x.count(",") >= 2)
    tries = ((page.regions["address"], sized), (page.regions["prop"], number), (page.regions["class"], lambda t: worded(t) and "@" not in t), (lines, lambda t: 15 <= len(t) <= 200 and worded(t)))
    return next((t for texts, fits in tries for t in texts if fits(t)), "")


def services_of(page: Page, about: str) -> str:
    """The description and what the links to services, or else the headings, offer."""
    generic = lambda t: t.lower() in C.GENERIC_LINK_TEXT
    offers = list(islice(dict.fromkeys(t for h, t in page.anchors if _SERVICE.search(h) and 3 <= len(t) <= 45 and not generic(t)), MOST_SERVICES))
    if len(offers) < 3:
        offers = list(dict.fromkeys([*offers, *(h for h in page.heads if 3 <= len(h) <= 60 and not generic(h))]))[:8]
    return " | ".join(x for x in (about, "Services: " + ", ".join(offers) if offers else "") if x)[:500]


def contact_links(page: Page, base: str) -> list[str]:
    """Links within the site to pages of contacts, those called so first."""
    own, found = root_of(base), {}
    for href, said in page.anchors:
        href = href.strip()
        if href.lower().startswith(("mailto:", "tel:", "javascript:", "#")) or not (_CONTACT.search(href) or _CONTACT.search(said)):
            continue
        link = _joined(base, href)
        if link.lower().startswith("http") and root_of(link) == own and link.rstrip("/") != base.rstrip("/") and not _FILE.search(link):
            found.setdefault(link)
    return sorted(found, key=lambda u: "contact" not in u.lower())


def external_links(page: Page, base: str) -> list[str]:
    """The first link to each other site that may be a company's own, MOST_EXTERNAL at most."""
    own, found = root_of(base), {}
    for href, _ in page.anchors:
        href = href.strip()
        root = root_of(href) if href.lower().startswith(("http://", "https://")) else ""
        if root and root != own and not skipped(root):
            found.setdefault(root, href)
    return list(islice(found.values(), MOST_EXTERNAL))


def extract(html: str | None, url: str | None, scan: int | None = SCAN) -> dict:
    """The SCHEMA of a page; blank fields for what it does not say.

    Contacts are looked for in the first ``scan`` characters of the text and of the markup, in all if it is None.
    """
    page, base = Page(html or ""), url or ""
    text = "".join(page.text)[:scan]
    org = organisation(page.ld)
    emails = emails_of(page, (html or "")[:scan], text)
    if org["email"] and org["email"] not in emails:
        emails.insert(0, org["email"])
    phones = phones_of(page, text)
    if org["phone"] and _good_phone(org["phone"]) and org["phone"] not in phones:
        phones.insert(0, org["phone"])
    about = (org["description"] or page.said("description", "og:description"))[:220]
    parts = [p.strip(C.TITLE_EDGE) for p in re.split(C.TITLE_SPLIT, page.title)]
    headline = next((p for p in parts if len(p) >= 2 and p.lower() not in C.TITLE_PARTS), "")[:120]
    try:
        host = re.sub(r"^www\.", "", re.sub(r":.*$", "", urlsplit(full).netloc.lower().rpartition("@")[2]))
    except ValueError:
        return ""
    labels = [x for x in host.split(".") if x]
    if len(labels) >= 3 and labels[-2] in C.SECOND_LEVEL and len(labels[-1]) == 2:
        return ".".join(labels[-3:])
    return ".".join(labels[-2:]) if len(labels) >= 2 else host


@lru_cache(1 << 14)
def skipped(root: str) -> bool:
    """``text.is_skip_domain`` for one registrable domain."""
    return root == "" or root in _SKIPPED or bool(_PUBLIC.search(root) or _MEDIA.search(re.sub(r"\.[^.]*$", "", root)))


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href).partition("#")[0]
    except ValueError:
        return ""


def _good_email(e: str) -> bool:
    return bool(e) and len(e) <= 80 and not any(b in e for b in C.BAD_EMAIL_PARTS)


def _good_phone(p: str) -> bool:
    d = re.sub(r"\D", "", p)
    return 8 <= len(d) <= 15 and len(set(d)) > 2 and not re.match(C.DATE_LIKE, p) and not re.match(C.YEAR_RANGE, p) and d not in C.SEQUENTIAL_DIGITS


def emails_of(page: Page, html: str, text: str) -> list[str]:
    """Addresses of mailto links, then of the text, then of the markup; the first MOST_EMAILS."""
    links = (unquote(h[7:].partition("?")[0])[:500] for h, _ in page.anchors if h.lower().startswith("mailto:"))
    found = chain(chain.from_iterable(map(_EMAIL.findall, links)), _EMAIL.findall(text), _EMAIL.findall(html))
    tidied = (e.strip(".-_").lower() for e in found)
    return list(islice(dict.fromkeys(e for e in tidied if _good_email(e)), MOST_EMAILS))


def phones_of(page: Page, text: str) -> list[str]:
    """Numbers of tel links, then those that look most like one; of equal digits the first one counts."""
    links = ((10, unquote(h[4:]).replace("-", " ").strip()) for h, _ in page.anchors if h.lower().startswith("tel:"))
    read = ((3 * bool(_CALL.search(text[max(0, m.start() - 30) : m.start()])) + 2 * m[0].strip().startswith("+") + ("(" in m[0]), m[0]) for m in _PHONE.finditer(text))
    ranked: dict[str, tuple[int, str]] = {}
    for score, said in chain(links, read):
        if _good_phone(p := tidy(said)):
            ranked.setdefault(re.sub(r"\D", "", p), (score, p))
    return [p for _, p in sorted(ranked.values(), key=lambda x: -x[0])[:MOST_PHONES]]


def address_of(page: Page, text: str) -> str:
    """The first marked or comma-separated address of a page."""
    sized = lambda t: 10 <= len(t) <= 250
    number = lambda t: sized(t) and any(c.isdigit() for c in t)
    worded = lambda t: number(t) and _ADDRESS_WORD.search(t)
    lines = (tidy(x) for x in text.split("\n") if x.count(",") >= 2)
    tries = ((page.regions["address"], sized), (page.regions["prop"], number), (page.regions["class"], lambda t: worded(t) and "@" not in t), (lines, lambda t: 15 <= len(t) <= 200 and worded(t)))
    return next((t for texts, fits in tries for t in texts if fits(t)), "")


def services_of(page: Page, about: str) -> str:
    """The description and what the links to services, or else the headings, offer."""
    generic = lambda t: t.lower() in C.GENERIC_LINK_TEXT
    offers = list(islice(dict.fromkeys(t for h, t in page.anchors if _SERVICE.search(h) and 3 <= len(t) <= 45 and not generic(t)), MOST_SERVICES))
    if len(offers) < 3:
        offers = list(dict.fromkeys([*offers, *(h for h in page.heads if 3 <= len(h) <= 60 and not generic(h))]))[:8]
    return " | ".join(x for x in (about, "Services: " + ", ".join(offers) if offers else "") if x)[:500]


def contact_links(page: Page, base: str) -> list[str]:
    """Links within the site to pages of contacts, those called so first."""
    own, found = root_of(base), {}
    for href, said in page.anchors:
        href = href.strip()
        if href.lower().startswith(("mailto:", "tel:", "javascript:", "#")) or not (_CONTACT.search(href) or _CONTACT.search(said)):
            continue
        link = _joined(base, href)
        if link.lower().startswith("http") and root_of(link) == own and link.rstrip("/") != base.rstrip("/") and not _FILE.search(link):
            found.setdefault(link)
    return sorted(found, key=lambda u: "contact" not in u.lower())


def external_links(page: Page, base: str) -> list[str]:
    """The first link to each other site that may be a company's own, MOST_EXTERNAL at most."""
    own, found = root_of(base), {}
    for href, _ in page.anchors:
        href = href.strip()
        root = root_of(href) if href.lower().startswith(("http://", "https://")) else ""
        if root and root != own and not skipped(root):
            found.setdefault(root, href)
    return list(islice(found.values(), MOST_EXTERNAL))


def extract(html: str | None, url: str | None, scan: int | None = SCAN) -> dict:
    """The SCHEMA of a page; blank fields for what it does not say.

    Contacts are looked for in the first ``scan`` characters of the text and of the markup, in all if it is None.
    """
    page, base = Page(html or ""), url or ""
    text = "".join(page.text)[:scan]
    org = organisation(page.ld)
    emails = emails_of(page, (html or "")[:scan], text)
    if org["email"] and org["email"] not in emails:
        emails.insert(0, org["email"])
    phones = phones_of(page, text)
    if org["phone"] and _good_phone(org["phone"]) and org["phone"] not in phones:
        phones.insert(0, org["phone"])
    about = (org["description"] or page.said("description", "og:description"))[:220]
    parts = [p.strip() for p in re.split(r"\s+[|\-–—:•·»«/]\s+|\s*[|•·»«]\s*", page.title)]
    headline = next((p for p in parts if len(p) >= 2 and p.lower() not in C.TITLE_PARTS), "")[:120]
    try:
        host = re.sub(r"^www\.", "", re.sub(r":.*$", "", urlsplit(base if "://" in base else f"http://{base}").netloc.lower().rpartition("@")[2]))
    except ValueError:
        host = ""
    name = (org["name"] or page.said("og:site_name") or org["site"] or headline or host)[:150]
    external = external_links(page, base)
    return {
        "name": name, "email": emails, "phone": phones, "address": org["address"] or address_of(page, text), "services": services_of(page, about), "title": page.title,
        "blocked": bool(re.search(C.BLOCKED_TITLE, page.title, re.I)), "contact_links": contact_links(page, base), "external_links": external, "listing": root_of(base) in _LISTS or len(external) >= LIST_LINKS,
    }


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", scan: int | None = SCAN) -> DataFrame:
    """``pages`` (url, ...) with a column ``page`` of SCHEMA. No shuffle; null pages give blank fields.

    Contacts are looked for in the first ``scan`` characters of a page, in whole pages if it is None.
    """
    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, u, scan) for h, u in zip(html, url)], columns=columns)

    return pages.withColumn("page", run(html_col, url_col))

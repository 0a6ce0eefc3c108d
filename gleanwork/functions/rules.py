"""Which records are companies, and how far a record can be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions import constants as C
from gleanwork.functions import text as X


#: A line that begins with a blocked title.
BLOCKED_LINE = r"""^[ \t>*#"'-]*(?:""" + C.BLOCKED_TITLE + ")"


def has(col: Column) -> Column:
    return X.text(col) != ""


def relevant(terms: Column, *texts: Column) -> Column:
    """Whether one of the terms stands in the lower-case texts; no terms, no relevance."""
    blob = F.lower(F.array_join(F.filter(F.array(*[X.text(t) for t in texts]), lambda t: t != ""), " "))
    return F.coalesce(F.exists(terms, lambda t: F.contains(blob, t)), F.lit(False))


def rejection(name: Column, website: Column, email: Column, phone: Column, address: Column, listed: Column) -> Column:
    """The first reason against a record, blank if it is accepted."""
    bad_name = (F.length(X.text(name)) < 3) | (X.norm_name(name) == "")
    media = X.text(name).rlike("(?iU)" + C.MEDIA_NAME) | X.text(name).rlike("(?iU)" + C.JUNK_NAME)
    return (
        F.when(bad_name, F.lit("no plausible company name"))
        .when(media, F.lit("name looks like publisher or article"))
        .when(has(website) & X.is_skip_domain(website), F.lit("website is a directory, social or media domain"))
        .when(~has(website) & ~listed, F.lit("no official website and not a listing"))
        .when(~(has(email) | has(phone) | has(address) | has(website)), F.lit("no useful business attribute"))
        .otherwise(F.lit(""))
    )


def blocked_title(title: Column) -> Column:
    return X.text(title).rlike("(?iU)" + C.BLOCKED_TITLE)


def blocked_text(text: Column) -> Column:
    """Whether a line of the text, however long the text, begins with what error and waiting pages are titled."""
    return X.text(text).rlike("(?imd)" + BLOCKED_LINE)


def confidence(name: Column, website: Column, email: Column, phone: Column, address: Column, relevance: Column) -> Column:
    """Points for what a record has, at most 100."""
    points = [(has(website), 25), (has(email), 20), (has(phone), 20), (has(address), 15), (has(name) & (X.text(name) != X.text(website)) & F.trim(X.text(name)).contains(" "), 10), (relevance, 10)]
    total = F.lit(0)
    for met, n in points:
        total = total + F.when(met, n).otherwise(0)
    return F.least(total, F.lit(100))

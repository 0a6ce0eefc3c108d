"""Passages of held-out evaluation items in a corpus, found by winnowing.

Every text is reduced to runs of k words; of each window of w runs the one with the smallest hash
is kept, so any k + w - 1 words in a row that a document shares with an item leave a common
fingerprint. Fingerprints that several items share (stock instructions, forms of questions) are no
evidence, unless an item has hardly a word of its own. Documents and items are joined on the others,
and pairs with enough in common are aligned word by word. Items of equal words are one until the end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.llm.addresses import near, plain, shortened
from gleanwork.operators.skew import join_group_facts, join_salted
from gleanwork.session import cut, spread_rows

#: Share of an item's words that make a case, common fingerprints from which a pair is aligned, and words of a passage.
LEAST_SHARE, LEAST_HITS, LEAST_WORDS = 1 / 3, 2, 4
#: The same share for an item that has neither words nor runs of its own: only the whole item makes a case.
WHOLE_SHARE = 0.9
#: Words of an item from which on its runs and windows have the given lengths. A passage of a short item may be left with
#: three words in a row when it is reworded; one of a long item has longer runs, which are rarer by chance.
TIERS = ((0, 2, 2), (300, 4, 4))
#: A word or run is common to the items if more than this share of them (and COMMON_LEAST) have it.
COMMON_SHARE, COMMON_LEAST = 0.02, 3
#: Fingerprints of documents are looked up in a table of so many bytes (seven bits used of each) before they are joined; it only saves work.
BITMAP_LOG2 = 17
#: Longest gaps inside a passage: in words of the document (inserted text) and of the item.
GAP_DOCUMENT, GAP_ITEM = 14, 6
_UNSEEN = "[­​-‏⁠﻿]"
_BROKEN = r"(\p{L})[-‐‑]\s*\n\s*(?=\p{L})"
#: Scripts without spaces between words; each character is a word.
_DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿"


def _words(text: Column) -> Column:
    """Words of a text in the JVM: no unseen characters, no line-end hyphens, no tags, lower case."""
    seen = F.regexp_replace(text, _UNSEEN, "")
    whole = F.regexp_replace(F.regexp_replace(seen, _BROKEN, "$1"), "<[^<>]*>", " ")
    return F.regexp_extract_all(F.lower(whole), F.lit(rf"([{_DENSE}]|[\p{{L}}\p{{N}}&&[^{_DENSE}]]+)"), F.lit(1))


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _neighbours(array: Column, join) -> Column:
    """``join`` of each element and the next."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 2, n), join)


def _runs(words: Column, k: int) -> Column:
    """Hashes of the runs of k words."""
    if k == 2:
        return _once(words, lambda w: _neighbours(w, lambda a, b: F.xxhash64(a, b)))
    starts = lambda w: F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
    return _once(words, lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " "))))


def winnow(hashes: Column, window: int = 2) -> Column:
    """The distinct smallest hashes of all windows; of fewer hashes than a window has, the smallest."""
    if window == 2:
        return _once(hashes, lambda h: F.when(F.size(h) < 2, h).otherwise(F.array_distinct(_neighbours(h, lambda a, b: F.least(a, b)))))
    few = lambda h: F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)
    return _once(hashes, lambda h: F.when(F.size(h) <= window, few(h)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.array_min(F.slice(h, i, window))))))


def words_of(text: str | None) -> list[str]:
    """The same words in Python, without accents."""
    s = re.sub(_UNSEEN, "", text or "")
    s = re.sub(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])", "", s)
    return re.findall(rf"[{_DENSE}]|[^\W_{_DENSE}]+", plain(re.sub(r"<[^<>]*>", " ", s)))


class Passages:
    """The words of a document, to align items with."""

    def __init__(self, text: str | None):
        self.place: dict[str, list[int]] = defaultdict(list)
        for at, w in enumerate(words_of(text)):
            self.place[w].append(at)
        self.forms: dict[str, list[str]] | None = None

    def like(self, word: str) -> set[str]:
        """Words of the document that are the word mistyped."""
        if len(word) <= 3 or word.isdigit():
            return set()
        if self.forms is None:
            self.forms = defaultdict(list)
            for w in self.place:
                if 3 < len(w) <= LONGEST_FORM and not w.isdigit():
                    for form in shortened(w):
                        self.forms[form].append(w)
        if len(word) >= LONGEST_FORM:
            return {w for w in self.place if near(w, word, 1)}
        return {w for f in shortened(word) for w in self.forms.get(f, ()) if near(w, word, 1)}

    def share(self, words: list[str], own: list[bool]) -> float:
        """Share of the item's words inside passages that the document holds; ``own`` are those few items have."""
        place = self.place
        met = []
        for j, w in enumerate(words):
            met += [(at, j) for x in ([w] if w in place else self.like(w)) for at in place[x]]
        met.sort()
        least = min(LEAST_WORDS, len(words))
        best: list[tuple[float, int]] = []
        first = 0
        for k, (at, j) in enumerate(met):
            while met[first][0] < at - GAP_DOCUMENT:
                first += 1
            value, back = 0.0, -1
            for b in range(first, k):
                at2, j2 = met[b]
                if at2 < at and 0 < j - j2 <= GAP_ITEM and (v := best[b][0] - 0.25 * (at - at2 + j - j2 - 2)) > value:
                    value, back = v, b
            best.append((value + (1.5 if own[j] else 1.0), back))
        covered: set[int] = set()
        used: set[int] = set()
        for k in sorted(range(len(met)), key=lambda k: -best[k][0]):
            if best[k][0] < least:
                break
            if k in used:
                continue
            chain, at = [], k
            while at >= 0 and at not in used:
                chain.append(at)
                at = best[at][1]
            used.update(chain)
            hit = {met[c][1] for c in chain}
            span = set(range(min(hit), max(hit) + 1))
            mine = [j for j in span if own[j]]
            known = [j for j in mine if j in hit]
            # most of the item's own words in the span must be there, and not just one name
            if len(chain) >= least and 2 * len(known) >= len(mine) and len({words[j] for j in known}) >= min(2, least):
                covered |= span
        return len(covered) / len(words) if words else 0.0


#: Words of this length on are compared with each other; shorter ones by their forms with a letter left out.
LONGEST_FORM = 200


def _classes(items: DataFrame) -> DataFrame:
    """(class, ids, texts, words): the items by their words in order; copies of an item are not several items."""
    split = F.pandas_udf(lambda c: c.map(words_of), T.ArrayType(T.StringType()))
    texts = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    read = cut(texts.withColumn("words", split("text")))
    return cut(read.groupBy(F.xxhash64("words").alias("class")).agg(F.first("words").alias("words"), F.collect_set("item_id").alias("ids"), F.collect_set("text").alias("texts")))


def _item_table(classes: DataFrame, least: float) -> DataFrame:
    """(class, ids, words, own, plain, whole): the words of each item in order, and which of them few items have.

    An item with fewer than two such words is ``plain``: its own are the words of the runs that few
    items have. If there are none either, all words count and only the ``whole`` item makes a case.
    """
    each = classes.select("class", F.explode(F.array_distinct("words")).alias("word"))
    used = each.groupBy("word").agg(F.count("*").alias("n"))
    rare = join_group_facts(each, used, "word", "n", each.count()).filter(F.col("n") <= least).groupBy("class").agg(F.collect_set("word").alias("rare"))
    few = F.least(F.lit(2), F.size(F.array_distinct("words")))
    owning = classes.join(rare, "class", "left").select("class", "ids", "words", F.transform("words", lambda w: F.coalesce(F.array_contains("rare", w), F.lit(False))).alias("own"), (F.coalesce(F.size("rare"), F.lit(0)) < few).alias("plain"))
    owning = cut(owning)
    if not owning.filter("plain").limit(1).count():
        return owning.withColumn("whole", F.lit(False))
    runs = owning.select("class", "plain", F.explode(F.array_distinct(_runs(F.col("words"), 2))).alias("h"))
    few_have = runs.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") <= least).select("h")
    of_runs = runs.filter("plain").join(few_have, "h").groupBy("class").agg(F.collect_set("h").alias("runs"))
    held = lambda w, at: F.coalesce(F.array_contains("runs", F.xxhash64(F.get("words", at), F.get("words", at + 1))), F.lit(False))
    owning = owning.join(of_runs, "class", "left").withColumn("in_runs", F.transform("words", lambda w, at: held(w, at) | held(w, at - 1))).drop("runs")
    mine = F.size(F.array_distinct(F.filter("words", lambda w, at: F.get("in_runs", at))))
    owning = owning.withColumn("whole", F.col("plain") & (mine < few))
    own = F.when(F.col("whole"), F.transform("words", lambda w: F.lit(True))).when(F.col("plain"), F.col("in_runs")).otherwise(F.col("own"))
    return owning.withColumn("own", own).drop("in_runs")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for each document with a passage of a third or more of an item's words.

    Passages may be reformatted, lightly reworded, mistyped or broken by other text; what several
    items share and quotes of a few words do not count, unless they are the whole item. Items of the
    same words are found together, however many they are. Null and empty texts have no passages. Whole texts are read, whatever their length. Of the documents
    only those with fingerprints in a small table of the items' are shuffled; fingerprints and
    items that many documents share are cut into slices or broadcast by ``operators.skew``.
    """
    classes = _classes(items)
    least = max(COMMON_LEAST, COMMON_SHARE * classes.count())
    table = cut(_item_table(classes, least))
    longest = table.agg(F.max(F.size("words"))).first()[0] or 0
    tiers = [t for t in TIERS if t[0] <= longest]
    said = classes.select("class", F.size("words").alias("n"), F.explode("texts").alias("text")).withColumn("w", _words(F.col("text")))
    docs = spread_rows(documents.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    prints = hashes = None
    for at, (start, k, window) in enumerate(tiers):
        end = TIERS[at + 1][0] if at + 1 < len(TIERS) else 1 << 31
        # all runs of an item, of which a document's winnowed ones are a part
        own = said.filter((F.col("n") >= start) & (F.col("n") < end)).select("class", "n", F.explode(F.array_distinct(_runs(F.col("w"), k))).alias("h"))
        prints = own if prints is None else prints.unionByName(own)
        kept = winnow(_runs(_words(F.col("text")), k), window)
        hashes = kept if hashes is None else F.array_distinct(F.concat(hashes, kept))
    prints = cut(prints.distinct().join(table.select("class", "plain"), "class"))
    few = prints.groupBy("h").agg(F.count("*").alias("shared")).filter(F.col("shared") <= least).select("h", F.lit(True).alias("few"))
    # all runs of an item without words of its own, as those that few have may not be among the kept ones of a document
    prints = cut(prints.join(few, "h", "left").filter("few or plain").select("class", "n", "h"))
    # a run is needed twice, but once if the item has no two windows or a third of it may leave one only
    needed = prints.groupBy("class").agg(F.when((F.count("*") > 2) & (F.max("n") > 3 * LEAST_WORDS), F.lit(LEAST_HITS)).otherwise(1).alias("needed"))
    any_short = needed.filter("needed = 1").limit(1).count() > 0
    size = 1 << BITMAP_LOG2
    byte = lambda h, probe: F.shiftright(h, 24 * probe).bitwiseAND(F.lit(size - 1)).cast("int")
    bit = lambda h, probe: F.pmod(F.shiftright(h, 24 * probe + BITMAP_LOG2), F.lit(7)).cast("int")
    slots = prints.select(F.explode(F.array(*[byte(F.col("h"), p) * 7 + bit(F.col("h"), p) for p in (0, 1)])).alias("s")).distinct().toPandas()["s"].to_numpy(np.int64)
    table_of_bits = np.zeros(size, np.uint8)
    np.bitwise_or.at(table_of_bits, slots // 7, (1 << (slots % 7)).astype(np.uint8))
    bitmap = F.lit(bytearray(table_of_bits.tobytes()))
    held = lambda h, probe: F.ascii(F.substring(bitmap, byte(h, probe) + 1, F.lit(1)).cast("string"))
    hit = lambda h, probe: F.call_function("shiftright", held(h, probe), bit(h, probe)).bitwiseAND(F.lit(1)) == 1
    marked = docs.withColumn("h", F.filter(hashes, lambda h: hit(h, 0) & hit(h, 1))).filter(F.size("h") >= (1 if any_short else LEAST_HITS))
    close = cut(marked)
    each = close.select("doc_id", F.explode("h").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("n"))
    common = join_salted(each, prints.select("class", "h"), "h", counts, "n", each.count()).groupBy("doc_id", "class").agg(F.count_distinct("h").alias("hits"))
    pairs = cut(common.join(needed, "class").filter("hits >= needed").select("doc_id", "class"))
    per_item = pairs.groupBy("class").agg(F.count("*").alias("n"))
    told = join_group_facts(pairs, table.join(per_item, "class"), "class", "n", pairs.count()).select("doc_id", "ids", "words", "own", "whole")
    both = told.join(close.select("doc_id", "text"), "doc_id")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, passages = None, None
        for batch in batches:
            found = []
            for doc, ids, words, own, whole, text in zip(batch["doc_id"], batch["ids"], batch["words"], batch["own"], batch["whole"], batch["text"]):
                if text != last:
                    last, passages = text, Passages(text)
                if passages.share(list(words), list(own)) >= (WHOLE_SHARE if whole else LEAST_SHARE):
                    found += [(doc, item) for item in ids]
            yield pd.DataFrame(found, columns=["doc_id", "item_id"])

    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    return both.mapInPandas(align, kinds).distinct()

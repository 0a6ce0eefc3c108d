"""Subject areas of documents by complement naive Bayes over sentences, refined by EM.

Each sentence is compared with each subject on its own: the log odds of its words under the
subject against its complement, within the sentence's language. The first model comes from the
labelled documents. Expectation-maximization then spreads it over all documents: a document's
shares of sentences about each subject, and what is left for none, (E) weigh the counts of its
words (M). Words that most documents of a language use count little. The shares are turned into a
calibrated posterior, for each subject independently, on labelled documents held out for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.addresses import plain
from gleanwork.session import cut, spread_rows

#: Frequent words that tell languages apart.
LANGUAGES = {
    "en": "the and of to for we is are in our with you that who was has before it by a an how what since",
    "de": "der die das und für wir sie mit ist uns bei zu nach ein eine nicht es den geht als um seit was ohne von unser alles",
    "fr": "le la les et de des pour nous vous est avec sur un une du ne à qu depuis notre puis rien même au en chez",
    "es": "el los las y de para nos con es un una por su que se lo en del al nada desde no sin nuestro demás después usted",
}
#: The languages (by number) that each frequent word tells.
STOP_WORDS: dict[str, list[int]] = {}
for _nr, _said in enumerate(LANGUAGES.values()):
    for _word in {plain(w) for w in _said.split()}:
        STOP_WORDS.setdefault(_word, []).append(_nr)
#: Words are hashed into buckets of each language: 2^16 for up to FEW_DOCUMENTS, twice as many for four times the
#: documents, up to 2^19, so that the model, which every task holds, stays under 8 MB a subject.
LOG2_BUCKETS, FEW_DOCUMENTS = (16, 19), 200_000
#: Rounds of EM at most; it ends when the counts move by less than this share.
ROUNDS, MOVED = 4, 0.01
#: Pseudo-documents of a word, and the log odds and lead from which a sentence is about a subject.
SMOOTHING, ABOUT, LEAD = 4.0, 1.3, 0.7
#: A word in this share of a language's documents does not count at all.
COMMON = 1 / 3
#: Log odds from which a sentence is a quoted evaluation item.
QUOTED = 4.0
#: Share of a document's own sentences from which it is about a subject.
LEAST_SHARE = 1 / 6
#: Slope of the posterior over the share before it is calibrated.
SLOPE = 40.0
#: A document counts for no subject if none is likelier than this; one in between is left to its subjects.
NONE = 0.05
#: Labelled documents that fit the first model and the calibration, at most; of these one of HELD_OUT calibrates only.
MOST_LABELLED, HELD_OUT = 200_000, 10
_TAG = re.compile(r"<[^<>]*>")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_END = re.compile(r"(?<=[.!?])[\"”»']?\s+(?=[^\W\d_]|[\"“«¿¡\d*•-])|\n+")
_LISTING = re.compile(r"https?://|www\.|\breviews\)|@|\+\d|\btel\b|\||[{}]|©|\d{4}-\d{2}|^contact:", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")


@lru_cache(1 << 17)
def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode())


@lru_cache(1 << 17)
def _plain_word(word: str) -> tuple[str, bool, bool]:
    """A word without accents, whether it is written small, and whether it counts by itself."""
    p = plain(word)
    return p, word[0].islower(), len(p) > 1


def filter_buckets(documents: int) -> int:
    """Buckets of a language for a number of documents."""
    return 1 << int(min(LOG2_BUCKETS[1], LOG2_BUCKETS[0] + max(0.0, np.ceil(np.log2(max(1, documents) / FEW_DOCUMENTS) / 2))))


def sentences(text: str | None) -> list[str]:
    """The document's own sentences, without markup, listing and contact lines, headings and menus."""
    out = []
    for s in _END.split(_UNSEEN.sub("", _TAG.sub("\n", text or ""))):
        s = s.strip(" \t*•-–>#\"“”")
        if len(_WORD.findall(s)) >= 3 and not _LISTING.search(s) and (s[-1] in ".!?;…," or len(s.split()) >= 6):
            out.append(s)
    return out


def languages(parts: list[str]) -> list[int]:
    """A language for each sentence, the document's where a sentence tells too little."""
    n = len(LANGUAGES)
    each = []
    for s in parts:
        c = [0] * n
        for w in re.findall(r"[^\W\d_]+", plain(s)):
            for g in STOP_WORDS.get(w, ()):
                c[g] += 1
        each.append(c)
    whole = [sum(c[g] for c in each) for g in range(n)]
    main = max(range(n), key=lambda g: (whole[g], -g))
    return [max(range(n), key=lambda g: (c[g], g == main, -g)) if max(c) >= 2 else main for c in each]


def features(sentence: str, language: int, buckets: int) -> list[int]:
    """Buckets of the words and word pairs in lower case (in German, of all words)."""
    words = [_plain_word(w) for w in _WORD.findall(sentence)]
    own = {_hash(w) % buckets for w, low, counts in words if counts and (low or language == 1)}
    own |= {_hash(f"{a} {b}") % buckets for (a, x, _), (b, y, _) in zip(words, words[1:]) if x and y}
    return [language * buckets + f for f in sorted(own)]


class Batch:
    """Sentences of documents as flat arrays: ``at`` the features one after another, ``sizes`` of the
    sentences, their languages, and ``doc`` the row of each sentence."""

    def __init__(self, pdf: pd.DataFrame):
        self.rows = len(pdf)
        flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in pdf[c]]) if len(pdf) else np.zeros(0, kind)
        self.at, self.sizes, self.langs = flat("at", np.int64), flat("sizes", np.int64), flat("langs", np.int64)
        self.doc = np.repeat(np.arange(self.rows), [len(x) for x in pdf["sizes"]])

    def presence(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of each feature a document has, once."""
        size = 1 << 40
        both = np.unique(np.repeat(self.doc, self.sizes) * size + self.at)
        return both // size, both % size

    def spoken(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, language) of each language a document has, once."""
        both = np.unique(self.doc * len(LANGUAGES) + self.langs)
        return both // len(LANGUAGES), both % len(LANGUAGES)


class Model:
    """Log odds of each bucket for each class: none, the subjects in order, quoted items."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray):
        classes, buckets = counts.shape[1], counts.shape[0] // len(LANGUAGES)
        totals = totals + 0.5
        share = np.repeat(totals / totals.sum(1, keepdims=True), buckets, axis=0)
        number = np.repeat(totals.sum(1), buckets)
        seen = counts.sum(1)
        p = (counts + SMOOTHING * share) / (seen + SMOOTHING)[:, None]
        weight = np.clip(1 - seen / (COMMON * number), 0, 1)[:, None]
        odds = (np.log(p / (1 - p)) - np.log(share / (1 - share))) * weight
        self.odds, self.subjects = odds.astype(np.float32), classes - 2

    def shares(self, batch: Batch) -> np.ndarray:
        """Share of each document's own sentences about each subject."""
        scores = np.zeros((len(batch.sizes), self.subjects + 2), np.float32)
        some = np.flatnonzero(batch.sizes)
        if len(some):
            starts = (np.cumsum(batch.sizes) - batch.sizes)[some]
            scores[some] = np.add.reduceat(self.odds[batch.at], starts, axis=0)
        own = scores[:, -1] < QUOTED
        s, doc = scores[own, 1:-1], batch.doc[own]
        number = np.bincount(doc, minlength=batch.rows)
        about = np.zeros((batch.rows, self.subjects))
        if len(s):
            best = s.argmax(1)
            top = s[np.arange(len(s)), best]
            second = np.partition(s, -2, axis=1)[:, -2] if self.subjects > 1 else np.zeros(len(s))
            hit = (top >= ABOUT) & (top - second >= LEAD)
            np.add.at(about, (doc[hit], best[hit]), 1)
        return about / np.maximum(number, 1)[:, None]


def _taken_apart(texts: DataFrame, buckets: int) -> DataFrame:
    """``texts`` (doc_id, text, labels) as (doc_id, labels, langs, sizes, at): languages and features of the sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, sizes, at = [], [], []
            for text in batch["text"]:
                parts = sentences(text)
                spoken = languages(parts)
                found = [features(s, g, buckets) for s, g in zip(parts, spoken)]
                langs.append(spoken)
                sizes.append([len(f) for f in found])
                at.append([x for f in found for x in f])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "labels": batch["labels"], "langs": langs, "sizes": sizes, "at": at})

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(run, f"doc_id {kind}, labels array<int>, langs array<int>, sizes array<int>, at array<int>")


def _counts(rows: DataFrame, weigh, classes: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class a bucket occurs in, and of each class a language has, over all rows.

    ``weigh`` gives a batch's documents by classes. Each task adds up its rows; what comes to the
    driver has the size of the model.
    """
    n_lang = len(LANGUAGES)
    size = buckets * n_lang

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((size + n_lang, classes), np.float64)
        for pdf in batches:
            batch = Batch(pdf)
            w = weigh(batch, pdf["labels"])
            (doc, at), (speaker, lang) = batch.presence(), batch.spoken()
            for k in np.flatnonzero(w.any(0)):
                sums[:size, k] += np.bincount(at, weights=w[doc, k], minlength=size)
                sums[size:, k] += np.bincount(lang, weights=w[speaker, k], minlength=n_lang)
        used = np.flatnonzero(sums.any(1))
        for start in range(0, len(used), 1 << 16):
            part = used[start : start + (1 << 16)]
            yield pd.DataFrame({"at": part, **{f"c{k}": sums[part, k] for k in range(classes)}})

    parts = rows.mapInPandas(run, "at long, " + ", ".join(f"c{k} double" for k in range(classes)))
    got = parts.groupBy("at").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)]).toArrow()
    sums = np.zeros((size + n_lang, classes))
    at = got["at"].to_numpy()
    for k in range(classes):
        sums[at, k] = got[f"c{k}"].to_numpy()
    return sums[:size], sums[size:]


def _from_labels(labels: pd.Series, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the labelled documents of a batch, evenly, and which those are; -1 is no subject."""
    w, known = np.zeros((len(labels), classes)), np.zeros(len(labels), bool)
    for row, own in enumerate(labels):
        if own is not None:
            known[row] = True
            for k in own:
                w[row, k + 1] = 1 / len(own)
    return w, known


def calibrate(shares: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each subject the slope and the share of half posterior of 1 / (1 + exp(-slope (share - cut))).

    Both are fitted by likelihood on held-out documents, some labels of which are taken to be wrong:
    first for all subjects together, near the stated limit LEAST_SHARE and SLOPE, then for each
    subject near what all have in common.
    """
    cuts, slopes = np.linspace(LEAST_SHARE * 0.75, LEAST_SHARE * 1.25, 21), np.array([15.0, 25.0, 40.0, 60.0, 90.0])

    def fit(x: np.ndarray, y: np.ndarray, slope: float, cut_: float) -> tuple[float, float]:
        z = slopes[:, None, None] * (x[None, None] - cuts[None, :, None])
        p = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6) * 0.9 + 0.05
        value = np.log(np.where(y, p, 1 - p)).sum(-1) - 2 * ((cuts - cut_) / 0.02)[None] ** 2 - 2 * np.log(slopes / slope)[:, None] ** 2
        i, j = np.unravel_index(int(value.argmax()), value.shape)
        return float(slopes[i]), float(cuts[j])

    some = (shares > 0) | truth
    common = fit(shares[some], truth[some], SLOPE, LEAST_SHARE) if some.any() else (SLOPE, LEAST_SHARE)
    each = [fit(shares[some[:, k], k], truth[some[:, k], k], *common) for k in range(shares.shape[1])]
    return np.array([s for s, _ in each]), np.array([c for _, c in each])


def subject_posteriors(documents: DataFrame, labels: DataFrame, items: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject_id, share, posterior) of each document and subject with any sentence about it.

    ``labels`` has (doc_id, subject_id), null for a document without subject; at most
    MOST_LABELLED labelled documents are used to fit the first model and the calibration, each for
    one of the two. ``items`` are evaluation items whose quotes do not count. Null and empty texts
    have no subject; no labels at all give no rows. Repeated labels count once.
    """
    spark = documents.sparkSession
    subjects = sorted(r[0] for r in labels.filter("subject_id is not null").select("subject_id").distinct().collect())
    doc_kind, subject_kind = (f.schema[c].dataType.simpleString() for f, c in ((documents, "doc_id"), (labels, "subject_id")))
    schema = f"doc_id {doc_kind}, subject_id {subject_kind}, share double, posterior double"
    if not subjects:
        return spark.createDataFrame([], schema)
    number = {s: k for k, s in enumerate(subjects)}
    classes = len(subjects) + 2
    order = F.xxhash64("doc_id")
    mine = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("names")).orderBy(order, "doc_id").limit(MOST_LABELLED).withColumn("aside", F.pmod(order, F.lit(HELD_OUT)) == 0)
    given = {r["doc_id"]: ([number[s] for s in r["names"]] or [-1], r["aside"]) for r in mine.collect()}
    taught = {d: own for d, (own, aside) in given.items() if not aside} or {d: own for d, (own, _) in given.items()}
    table = pa.table({"doc_id": pa.array(list(taught), type=_arrow(documents, "doc_id")), "labels": pa.array(list(taught.values()), pa.list_(pa.int32()))})
    texts = documents.filter("doc_id is not null and text is not null and text != ''").select("doc_id", "text")
    buckets = filter_buckets(texts.count())
    rows = spread_rows(texts).join(F.broadcast(spark.createDataFrame(table)), "doc_id", "left")
    apart = cut(_taken_apart(rows, buckets))  # read again in each round
    teaching = apart.filter("labels is not null")
    quoted = None
    if items is not None:
        # quoted items are a class of their own, the last one
        quoted = items.filter("text is not null").select(F.lit(None).cast(doc_kind).alias("doc_id"), "text", F.array(F.lit(len(subjects))).alias("labels"))
        quoted = cut(_taken_apart(quoted, buckets))
    with_items = lambda df: df if quoted is None else df.unionByName(quoted)
    counts = _counts(with_items(teaching), lambda batch, own: _from_labels(own, classes)[0], classes, buckets)
    for _ in range(rounds):
        spread = spark.sparkContext.broadcast(Model(*counts))

        def weigh(batch, own, spread=spread):
            w, known = _from_labels(own, classes)
            share = spread.value.shares(batch)
            # a document counts for its subjects, by their shares, as far as one is likely, and for none by what is left
            post = np.where(share > 0, 1 / (1 + np.exp(-SLOPE * (share - LEAST_SHARE))), 0)
            some, parts = post.max(1, keepdims=True, initial=0), share * post
            soft = np.concatenate([np.where(some < NONE, 1.0, 0.0), parts / np.maximum(parts.sum(1, keepdims=True), 1e-9) * some, np.zeros((len(share), 1))], axis=1)
            return np.where(known[:, None], w, soft)

        before, counts = counts, _counts(with_items(apart), weigh, classes, buckets)
        spread.unpersist()
        of = lambda c: c[0] / max(c[0].sum(), 1e-9)
        if np.abs(of(counts) - of(before)).sum() < MOVED:
            break
    last = spark.sparkContext.broadcast(Model(*counts))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share = last.value.shares(Batch(pdf))
            row, k = np.nonzero(share)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "k": k.astype(np.int32), "share": share[row, k]})

    found = apart.mapInPandas(score, f"doc_id {doc_kind}, k int, share double")
    held = {d: own for d, (own, aside) in given.items() if aside} or {d: own for d, (own, _) in given.items()}
    place = {d: i for i, d in enumerate(held)}
    asked = spark.createDataFrame(pa.table({"doc_id": pa.array(list(held), type=_arrow(documents, "doc_id"))}))
    shares, truth = np.zeros((len(held), len(subjects))), np.zeros((len(held), len(subjects)), bool)
    for d, k, x in found.join(F.broadcast(asked), "doc_id", "left_semi").collect():
        shares[place[d], k] = x
    for d, own in held.items():
        truth[place[d], [k for k in own if k >= 0]] = True
    slopes, cuts = calibrate(shares, truth)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("k"))
    posterior = 1 / (1 + F.exp(-pick([float(x) for x in slopes]) * (F.col("share") - pick([float(x) for x in cuts]))))
    return found.select("doc_id", pick(subjects).cast(subject_kind).alias("subject_id"), "share", posterior.alias("posterior"))


def _arrow(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def subjects_of(documents: DataFrame, labels: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject_id) for each subject whose posterior is a half or more; see subject_posteriors."""
    return subject_posteriors(documents, labels, items).filter("posterior >= 0.5").select("doc_id", "subject_id").distinct()

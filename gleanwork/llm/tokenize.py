"""Encoding of texts by a public byte-level BPE vocabulary.

The encoding of a word is determined by the last token of each of its prefixes: the last token of
a prefix p is the one vocabulary entry t that ends p and may follow the last token of p without t.
The distinct words are therefore walked as a trie, depth first, carrying the last-token states
down; what words share as a prefix is computed once. Sorted order is the depth-first order, so
the trie is held as the stack of states of the current path.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.session import spread_rows

VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pre-tokenisation pattern of the byte_bpe vocabularies.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a task keeps, and the longest word that is kept.
KEPT_WORDS, KEPT_LENGTH = 200_000, 64


class PrefixEncoder:
    """Exact BPE by last-token states; ``ranks`` maps byte strings to ids in merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.length = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        for token, at in sorted(ranks.items(), key=lambda x: x[1]):
            self.length[at] = len(token)
            if len(token) > 1 and (pair := self._parts(token, at)):
                self.left[at], self.right[at] = pair
                self.joined[pair] = at

    def _parts(self, token: bytes, at: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token, found by merging its bytes with earlier merges."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            found = [(m, i) for i in range(len(parts) - 1) if (m := self.joined.get((parts[i], parts[i + 1]))) is not None and m < at]
            if not found:
                return None
            m, i = min(found)
            parts[i : i + 2] = [m]
        return (parts[0], parts[1])

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of a and b leaves exactly these two tokens."""
        known = self.follows.get((a, b))
        if known is None:
            known = self.follows[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo merges from the later one on; a merge across the seam that comes before the one
        # just undone would have been taken first.
        bound = len(self.left)
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < bound:
                return False
            inner_a, inner_b = self.right[a], self.left[b]
            if a > b and inner_a != a:
                bound, a = a, inner_a
            elif inner_b != b and (b >= a or inner_a == a):
                bound, b = b + 1, inner_b
            elif inner_a != a:
                bound, a = a, inner_a
            else:
                return True

    def encode_words(self, words: Iterator[bytes]) -> dict[bytes, list[int]]:
        out, path, previous = {}, [], b""
        for word in sorted(words):
            shared = len(os.path.commonprefix((previous, word)))
            del path[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - self.longest), end):
                    token = self.ranks.get(word[start:end])
                    if token is not None and (not start or self.may_follow(path[start - 1], token)):
                        path.append(token)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(path[end - 1])
                end -= self.length[path[end - 1]]
            out[word], previous = ids[::-1], word
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(read_ranks(path))
    return _encoders[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) for each row, without special tokens; null and empty texts give the empty list.

    Strings of special tokens in a text are ordinary text. Rows are kept as they are, repeated ids
    included; other columns are not read. No shuffle: each task encodes the distinct words of its
    batches and keeps up to KEPT_WORDS of them. ``vocabulary`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        coder, split, kept = encoder(vocabulary), regex.compile(WORD_PATTERN).findall, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [split(t) if t else [] for t in part.column(1).to_pylist()]
                fresh = {w for t in texts for w in t if w not in kept}
                if len(kept) + len(fresh) > KEPT_WORDS:
                    kept, fresh = {}, {w for t in texts for w in t}
                coded = coder.encode_words(w.encode("utf-8") for w in fresh)
                now = {w: coded[w.encode("utf-8")] for w in fresh}
                ids = [[i for w in t for i in (now.get(w) or kept[w])] for t in texts]
                kept |= {w: x for w, x in now.items() if len(w) <= KEPT_LENGTH}
                if len(coder.follows) > 10 * KEPT_WORDS:
                    coder.follows.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = spread_rows(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")

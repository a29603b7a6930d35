"""Benchmark decontamination: item-sized windows of text close to a benchmark item.

Items and windows of as many words are multisets of five-word shingles. Windows that hold
enough of some item's shingles to reach the similarity at all (an exact bound, by an
inverted index of the items' shingles) get a SimHash. A multi-index finds all items within
a radius of it: the 64 bits are cut into eight blocks, and fingerprints within the radius
agree in some block up to an eighth of it. The weighted Jaccard similarity of the two
multisets decides on what is found.

At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average, with a deviation of
2.9; radius 23 is 4.6 deviations above that, so about one window in 100,000 at exactly
that similarity is missed, and fewer above it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from .common import kept_rows, text_of
from .textscan import LOWER, mix, word_blocks, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
_BLOCKS = 8
_WIDTH = 64 // _BLOCKS
#: Windows start within so many shingles if their fingerprints are made together.
_SPAN = 1 << 13
#: Items and their words that one pass over the documents takes; more are taken in further passes.
PASS_ITEMS, PASS_WORDS = 2000, 1 << 20
_PLACE = np.random.default_rng(31).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * _PLACE[i]
    return mix(out)


def simhash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the multisets hashes[s : s + size], for ascending starts."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        lo = int(starts[at])
        to = int(np.searchsorted(starts, lo + _SPAN))
        part = starts[at:to] - lo
        bits = np.unpackbits(hashes[lo : lo + int(part[-1]) + size].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=ones[1:])
        out[at:to] = np.packbits(2 * (ones[part + size] - ones[part]) > size, axis=1).view(">u8").ravel()
        at = to
    return out


def _text_words(text: str | None) -> np.ndarray:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    first, last, _ = word_bounds(data, np.array([0]), np.array([len(data)]))
    return word_hashes(data, first, last)


@dataclass
class Item:
    id: object
    words: int
    k: int
    counts: Counter
    size: int
    print: int


class Index:
    """A pass's items: their shingles, and the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[object, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.items: list[Item] = []
        for item_id, text in items:
            words = _text_words(text)
            if len(words):
                k = min(SHINGLE, len(words))
                h = shingles(words, k)
                self.items.append(Item(item_id, len(words), k, Counter(h.tolist()), len(h), int(simhash(h, np.array([0]), len(h))[0])))
        self.known = {k: np.unique(np.array([h for i in self.items if i.k == k for h in i.counts], np.uint64)) for k in {i.k for i in self.items}}
        self.seen = {}
        for k, known in self.known.items():
            self.seen[k] = np.zeros(1 << 20, bool)
            self.seen[k][(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.holders = {}
        for k, known in self.known.items():
            pairs = [(h, n) for n, i in enumerate(self.items) if i.k == k for h in i.counts]
            at = np.searchsorted(known, np.array([h for h, _ in pairs], np.uint64))
            order = np.argsort(at, kind="stable")
            bounds = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(known)))))
            self.holders[k] = bounds, np.array([n for _, n in pairs], np.int64)[order]
        self.words = np.array([i.words for i in self.items], np.int64)
        self.longest = int(self.words.max(initial=1))

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The multi-index: of each block, the variants within its share of the radius and their items."""
        near, tables = self.radius // _BLOCKS, []
        flips = np.array([sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(_WIDTH), n)], np.int64)
        for block in range(_BLOCKS):
            part = np.array([i.words << _WIDTH | (i.print >> block * _WIDTH) & ((1 << _WIDTH) - 1) for i in self.items], np.int64)
            variants = (part[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(variants, kind="stable")
            tables.append((variants[order], order // len(flips)))
        return tables

    def present(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are some item's shingles, and which of the known ones."""
        maybe = np.flatnonzero(self.seen[k][(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        known = self.known[k]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        same = known[at] == hashes[maybe]
        return maybe[same], at[same]

    def _holding(self, hashes: np.ndarray, k: int, n: int):
        """(item, places of its shingles, size, need) for each item of which a text of n words holds enough shingles for some window."""
        place, shingle = self.present(hashes, k)
        bounds, holders = self.holders[k]
        many = bounds[shingle + 1] - bounds[shingle]
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        item, place = holders[np.repeat(bounds[shingle], many) + inside], np.repeat(place, many)
        total = np.bincount(item, minlength=len(self.items))
        size = np.minimum(self.words, n) - k + 1
        need = np.ceil(self.similarity * (size + self.words - k + 1) / (1 + self.similarity) - 1e-9).astype(np.int64)
        enough = (total > 0) & (total >= need)
        of_some = enough[item]
        item, place = item[of_some], place[of_some]
        order = np.argsort(item, kind="stable")
        ends = np.cumsum(total[enough])
        for i, a, b in zip(np.flatnonzero(enough).tolist(), (ends - total[enough]).tolist(), ends.tolist()):
            yield i, place[order[a:b]], int(size[i]), int(need[i])

    def near(self, prints: np.ndarray, words: int) -> list[tuple[int, int]]:
        """All (print, item) of this many words whose fingerprints differ in at most `radius` bits."""
        found: set[tuple[int, int]] = set()
        for block, (variants, item) in enumerate(self.tables):
            part = np.int64(words) << _WIDTH | ((prints >> np.uint64(block * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
            lo, hi = np.searchsorted(variants, part, "left"), np.searchsorted(variants, part, "right")
            for w in np.flatnonzero(lo < hi):
                found.update((int(w), int(i)) for i in item[lo[w] : hi[w]])
        return sorted((w, i) for w, i in found if (int(prints[w]) ^ self.items[i].print).bit_count() <= self.radius)

    def _best(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Of each item reached (by its place): similarity, first word and words of its best window."""
        best: dict[int, tuple[float, int, int]] = {}
        n = len(words)
        for k in self.known:
            if n < k:
                continue
            h, windows = shingles(words, k), {}
            for i, places, size, need in self._holding(h, k, n):
                held = np.zeros(len(h) + 1, np.int64)
                held[places + 1] = 1
                held = np.cumsum(held)
                windows.setdefault((self.items[i].words, size), []).append(np.flatnonzero(held[size:] - held[:-size] >= need))
            for (count, size), found in windows.items():
                starts = np.unique(np.concatenate(found))
                for w, i in self.near(simhash(h, starts, size), count):
                    item, s = self.items[i], int(starts[w])
                    both = sum((Counter(h[s : s + size].tolist()) & item.counts).values())
                    value = both / (size + item.size - both)
                    if value >= self.similarity and (i not in best or (value, -s) > (best[i][0], -best[i][1])):
                        best[i] = (value, s, min(item.words, n))
        return best

    def search(self, words: np.ndarray) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item reached; `words` are a text's hashes."""
        best = self._best(words)
        return [(self.items[i].id, *best[i]) for i in sorted(best)]

    def rows(self, texts: pa.Array):
        """(row, matches) for each text (binary, no nulls) that holds something of an item."""
        if not self.items:
            return
        held, best, at = np.zeros(0, np.uint64), {}, 0
        for lo, hi, data, starts, ends, opens, closes in word_blocks(texts):
            data = LOWER[data]
            first, last, doc = word_bounds(data, starts, ends)
            words = word_hashes(data, first, last)
            if not (opens and closes):  # a stretch of a long text; what the longest item may need is kept for the next
                held, best, at = (words, {}, 0) if opens else (np.concatenate((held, words)), best, at)
                if len(held) >= self.longest or closes and not at:
                    for i, (value, start, n) in self._best(held).items():
                        if i not in best or value > best[i][0]:
                            best[i] = value, start + at, n
                    cut = max(len(held) - self.longest + 1, 0)
                    held, at = held[cut:], at + cut
                if closes and best:
                    yield lo, [(self.items[i].id, *best[i]) for i in sorted(best)]
                continue
            bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
            touched: set[int] = set()
            for k in self.known:
                touched.update(doc[self.present(shingles(words, k), k)[0]].tolist())  # a run across texts may add one; its search finds nothing
            for d in sorted(touched):
                matches = self.search(words[bounds[d] : bounds[d + 1]])
                if matches:
                    yield lo + d, matches


def _passes(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in bounded blocks, so that what is sent out has a fixed size however long the benchmark."""
    block, words = [], 0
    for item_id, text in benchmark.select(item_col, text_col).toLocalIterator():
        n = len((text or "").split())
        if block and (len(block) == PASS_ITEMS or words + n > PASS_WORDS):
            yield block
            block, words = [], 0
        block.append((item_id, text))
        words += n
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, similarity, start_word, n_words): the best window of each document for each item it comes close to.

    Words are runs without ASCII white space, A-Z lower-cased. Items of fewer than five
    words are one shingle; items without words match nothing; a document shorter than
    an item is one window. Null texts count as empty. Repeated rows give repeated
    matches; empty tables give none.
    """
    rows = docs.select(col(id_col), text_of(col(text_col)).alias("_text"))
    id_type = rows.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, similarity double, start_word long, n_words long"

    def one_pass(items):
        def run(batches):
            index = Index(items, similarity)
            for batch in batches:
                found = [(i, *m) for i, matches in index.rows(batch.column(1).cast(pa.binary())) for m in matches]
                if found:
                    row, item, value, start, n = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(item), pa.array(value), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                        names=[id_col, item_col, "similarity", "start_word", "n_words"],
                    )

        return rows.mapInArrow(run, schema)

    out = None
    for items in _passes(benchmark, item_col, "text"):
        out = one_pass(items) if out is None else out.unionByName(one_pass(items))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` in which no item is found, without a join; columns unchanged, whatever their names.

    Null texts count as empty and stay; repeated rows all stay or go; an empty table stays
    empty, and an empty benchmark takes nothing out.
    """
    place = docs.columns.index(text_col)

    def one_pass(frame, items):
        def run(batches):
            index = Index(items, similarity)
            for batch in batches:
                texts = batch.column(place)
                texts = pa.array(["" if x is None else x for x in texts.to_pylist()], pa.string()) if texts.null_count else texts
                dirty = [i for i, _ in index.rows(texts.cast(pa.binary()))]
                clean = np.ones(len(batch), bool)
                clean[dirty] = False
                yield batch.filter(pa.array(clean))

        return kept_rows(frame, run)

    for items in _passes(benchmark, item_col, "text"):
        docs = one_pass(docs, items)
    return docs

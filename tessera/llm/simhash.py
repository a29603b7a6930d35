"""SimHash fingerprints and near-duplicate classes by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius then meet on at least one variant. The rows are
shuffled on the variant, which spreads evenly, and a variant never gathers more
fingerprints than its own ball holds (65 at radius 2), however many documents share
one of them: copies are merged into one fingerprint before anything is emitted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col, cols
from .common import free_name, small_batches, stored, temporary_tables, text_key, text_of
from .graph import components
from .textscan import LOWER, mix, word_blocks, word_bounds, word_hashes

BITS = 64
_BLOCK = 1 << 16
#: Bytes of a text whose words are taken together.
_CHUNK = 1 << 20
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1).astype(np.int64)
_BYTE_BASE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _chunks(text: bytes):
    """The text in parts cut behind white space."""
    at = 0
    while at < len(text):
        to = at + _CHUNK
        while to < len(text) and text[to - 1] not in b" \t\n\x0b\f\r":
            to += 1
        yield text[at:to]
        at = to


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased and words are runs without ASCII white space. A text with
    fewer words than a shingle is one shingle; one without words has fingerprint 0.
    A bit is set if it is set in more than half of the shingles' XXH64 values. A very
    long text is taken in parts.
    """
    digest, ones, n, words = xxhash.xxh64_digest, np.zeros((8, 8), np.int64), 0, []
    for part in _chunks(text):
        words += part.lower().split()
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        ends = ends[shingle - 1 :].tolist()
        for at in range(0, len(starts), _BLOCK):
            raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])])
            cells = np.frombuffer(raw, np.uint8).reshape(-1, 8) + _BYTE_BASE
            ones += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
        n += len(starts)
        words = words[len(words) - shingle + 1 :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text, as a signed long. Null text counts as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(col(id_col), text_of(col(text_col)).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


def _ball(radius: int, width: int = BITS) -> Column:
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints (column fp) within `radius` differing bits.

    Fingerprints that meet on a variant are within 2 * half of each other. For an even
    radius that is the radius itself, so each is linked to the least of its bucket: the
    same classes as all pairs, without the pairs. For an odd one the bucket's pairs
    are formed (a bucket is bounded by the ball) and those too far apart dropped. In
    either case pairs are deduplicated and verified by their differing bits.
    """
    half = (radius + 1) // 2
    variants = prints.select("fp").distinct().select("fp", F.explode(_ball(half)).alias("_mask"))
    variants = variants.select("fp", F.col("fp").bitwiseXOR(F.col("_mask")).alias("_variant"))
    if radius % 2:
        other = variants.select(F.col("fp").alias("v"), "_variant")
        pairs = variants.select(F.col("fp").alias("u"), "_variant").join(other, "_variant").where("u < v").select("u", "v")
    else:
        least = F.min("fp").over(Window.partitionBy("_variant"))
        pairs = variants.select(least.alias("u"), F.col("fp").alias("v")).where("u < v")
    return pairs.distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id): each row's fingerprint and the smallest id reachable over links.

    One row comes back for every input row, repeated ids and texts included. Rows with
    equal fingerprints are linked, those without words too. A null id gets its
    fingerprint's class and never names one unless all ids of the class are null. An
    empty table gives no rows; other columns are ignored.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    member = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    member = member.join(distinct, "fp")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = distinct.join(member.select("fp", "root").join(named, "root").drop("root"), "fp", "left")
    classes = stored(classes.select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")  # a plain scan: a hot fingerprint's rows can be split
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


# Near duplicates by shingle similarity: fingerprints and a prefix filter propose, the shingles decide.


def _shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[i : i + len(out)])
    return out


#: A byte's bits, the highest first, as eight bytes of one word: sums of up to 255 of them count each bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run hashes[starts[i] : starts[i + 1]] (none empty), the bits that more than half have."""
    size = np.diff(np.append(starts, len(hashes)))
    subs = -(-size // 255)
    first = np.cumsum(subs) - subs
    at = np.repeat(starts, subs) + 255 * (np.arange(int(subs.sum())) - np.repeat(first, subs))
    cells = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.add.reduceat(_SPREAD[cells[:, j]], at)[:, None].view(np.uint8) for j in range(8)], axis=1)
    return np.packbits(2 * np.add.reduceat(ones, first, axis=0, dtype=np.int64) > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate((np.ones(min(len(a), 1), bool), a[1:] != a[:-1]))]


def sketches(texts: pa.Array, shingle: int, prints: bool = True):
    """(first row, bounds, shingles, fingerprints) of runs of texts.

    `shingles` holds the sorted distinct 32-bit hashes of each text's word shingles, text
    after text as `bounds` say; A-Z are lower-cased, and a text with fewer words than a
    shingle is one. Fingerprints are SimHashes of the 64-bit hashes, repeats included.
    """
    carried, found, ones, n = np.zeros(0, np.uint64), [], np.zeros(64, np.int64), 0
    for lo, hi, data, starts, ends, opens, closes in word_blocks(texts):
        first, last, doc = word_bounds(LOWER[data], starts, ends)
        words = word_hashes(LOWER[data], first, last)
        if not (opens and closes):  # a block of one very long text
            words = np.concatenate((carried, words)) if not opens else words
            h = _shingles_of(words, shingle)
            found, ones, n = ([], np.zeros(64, np.int64), 0) if opens else (found, ones, n)
            if not len(h) and closes and not n and len(words):
                h = _shingles_of(words, len(words))
            found.append(_distinct((h >> np.uint64(32)).astype(np.uint32)))
            for at in range(0, len(h), _BLOCK):
                ones += np.unpackbits(h[at : at + _BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            n += len(h)
            carried = words[max(len(words) - shingle + 1, 0) :]
            if len(found) >= 16 or closes:
                found = [_distinct(np.concatenate(found))]
            if closes:
                yield lo, np.array([0, len(found[0])]), found[0], np.packbits(2 * ones > n).view(">u8").astype(np.uint64)
                carried, found = carried[:0], []
            continue
        size = np.bincount(doc, minlength=hi - lo)
        begin = np.cumsum(size) - size
        h = _shingles_of(words, shingle)
        whole = doc[: len(h)] == doc[shingle - 1 :] if len(h) else np.zeros(0, bool)
        h, owner = h[whole], doc[: len(whole)][whole]
        few = np.flatnonzero((size > 0) & (size < shingle))
        if len(few):
            one = np.concatenate([_shingles_of(words[begin[i] : begin[i] + size[i]], int(size[i])) for i in few])
            h, owner = np.concatenate((h, one)), np.concatenate((owner, few))
        key = _distinct(owner.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
        bounds = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
        marks = np.zeros(hi - lo, np.uint64)
        if prints and len(h):
            order = np.argsort(owner, kind="stable")
            own, at = np.unique(owner[order], return_index=True)
            marks[own] = majority(h[order], at)
        yield lo, bounds, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), marks


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of one text's word shingles."""
    return next((s for _, _, s, _ in sketches(pa.array([text], pa.binary()), shingle, False)), np.zeros(0, np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Texts whose shingles are counted, and in how many of them a shingle must be to come late in the order of prefixes.
#: Both only change how many candidates there are: any one order of all shingles loses no pair.
SAMPLE_TEXTS, COMMON = 10_000, 6


def _common_shingles(plain: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample hold, sorted, and in how many texts they are."""
    some = plain.where(F.pmod(F.xxhash64("th"), F.lit(plain.count() // SAMPLE_TEXTS + 1)) == 0).select("th", "_text").dropDuplicates(["th"])

    def run(batches):
        for batch in batches:
            for _, _, found, _ in sketches(batch.column(1).cast(pa.binary()), shingle, False):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["shingle"])

    rows = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy("shingle").collect()
    return np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows], np.int64)


def prefixes(bounds: np.ndarray, shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, shingles) of the prefixes of sorted sets: their first shingles, common ones last, of which similar sets share one.

    The similarity asks for `similarity * n` common shingles of a set of n, so not all of
    them can be behind the first n - similarity * n + 1.
    """
    size = np.diff(bounds)
    take = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    owner = np.repeat(np.arange(len(size)), size)
    often = np.zeros(len(shingles), np.int64)
    if len(common[0]) and len(shingles):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        often = np.where(common[0][at] == shingles, common[1][at], 0)
    order = np.argsort(owner << 32 | np.minimum(often, (1 << 32) - 1), kind="stable")
    early = np.arange(len(shingles)) - np.repeat(bounds[:-1], size) < np.repeat(take, size)
    return np.concatenate(([0], np.cumsum(take))), shingles[order][early]


#: Bits of the filter that spares texts without candidates from being shingled; its size is fixed.
_FILTER_BITS = 1 << 22


def _asked_texts(plain: DataFrame, asked: DataFrame) -> DataFrame:
    """Those texts (th, _text) whose key falls on a slot of the asked keys: all that are asked and few others.

    The filter has 2^16 words at most, whatever the number of keys, so it can be
    broadcast; a full one lets everything through. Other texts never leave the JVM.
    """
    slot = F.pmod(F.xxhash64("th"), F.lit(_FILTER_BITS)).alias("slot")
    words = asked.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    found = plain.select("th", slot, "_text").join(F.broadcast(words), F.shiftright("slot", 6) == F.col("word"))
    return found.where(F.expr("shiftrightunsigned(bits, cast(slot % 64 as int)) & 1 = 1")).select("th", "_text")


def _similar(similarity: float):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            ok = [jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= similarity for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return run


def _verified(plain: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the stored pairs (u, v) of texts whose shingle sets are similar; only texts of some pair are shingled."""
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    asked = stored(texts.select("node", "th").join(asked, "node"), "asked")

    def sets(batches):
        for batch in batches:
            for lo, bounds, found, _ in sketches(batch.column(1).cast(pa.binary()), shingle, False):
                n = len(bounds) - 1
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), blobs], names=["th", "shingles"])

    named = _asked_texts(plain, asked).mapInArrow(sets, "th binary, shingles binary").dropDuplicates(["th"])
    named = stored(named.join(asked, "th").select("node", "shingles"), "shingles")
    mine, others = named.select(F.col("node").alias("u"), F.col("shingles").alias("a")), named.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return stored(pairs.join(mine, "u").join(others, "v").select("u", "v", "a", "b").mapInArrow(_similar(similarity), "u long, v long"), "links")


def _likely(meetings: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of the meetings (u, v, size, _size), one for each shared prefix shingle, that can be similar at all.

    What two sets share is in both prefixes or behind the one that ends first, where
    similarity * n - 1 shingles at most are left of n: the meetings must make up for the rest.
    """
    t, slack = F.lit(similarity), F.lit(1e-9)
    shared = F.ceil(t / (1 + t) * (F.col("size") + F.col("_size")) - slack)
    behind = F.ceil(t * F.greatest("size", "_size") - slack) - 1
    meetings = meetings.where(F.least("size", "_size") >= t * F.greatest("size", "_size") - slack)
    return meetings.groupBy("u", "v", "size", "_size").agg(F.count("*").alias("_n")).where(F.col("_n") >= shared - behind).select("u", "v")


def _likely_places(meetings: DataFrame, similarity: float) -> DataFrame:
    """`_likely` with the places (at, _at) of shared shingles, which come in one order in all prefixes.

    Of the `shared` shingles at least that similar sets have in common, the i-th is
    followed by shared - i in either set. So the first k that they share leave shared - k
    at least behind, and k of them meet there: half of those that meet at all are asked for,
    which leaves out meetings on the common shingles at the prefixes' ends.
    """
    t, slack = F.lit(similarity), F.lit(1e-9)
    shared = F.ceil(t / (1 + t) * (F.col("size") + F.col("_size")) - slack)
    need = shared - F.ceil(t * F.greatest("size", "_size") - slack) + 1
    k = F.ceil(need / 2)
    meetings = meetings.where(F.least("size", "_size") >= t * F.greatest("size", "_size") - slack)
    meetings = meetings.where(F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) >= shared - k + 1)
    return meetings.groupBy("u", "v", "size", "_size").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("u", "v")


def _stars(entries: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Likely pairs of each bucket's head with its other texts."""
    met = entries.join(heads, "shingle").where(F.col("node") != F.col("_head.node"))
    return _likely(met.select(F.least("node", "_head.node").alias("u"), F.greatest("node", "_head.node").alias("v"), "size", F.col("_head.size").alias("_size")), similarity)


def _first(condition: Column | None = None) -> Column:
    """Of a bucket's texts, the one whose prefix is shared most: of many copies, the one that is most like all."""
    of = F.struct("rank", "node", "size")
    return F.min(of if condition is None else F.when(condition, of)).alias("_head")


#: All pairs that links left apart are formed when their meetings are fewer than so many for each entry of a bucket, or
#: after so many rounds of heads. Both only change the order of the work.
MEETINGS, ROUNDS = 1000, 4


def similar_links(plain: DataFrame, shingle: int, similarity: float, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(texts, links): the distinct texts (node, th, place), and pairs (u, v) of their nodes with similar shingle sets.

    The links connect all texts that are similar. Ball hashing of fingerprints proposes
    first; what is similar beyond its radius comes of an exact prefix-filter join: each
    text emits a prefix of its shingles, and similar texts meet on enough of them. There
    the most central text of each bucket is tried against the others, then, as long as
    many meet, the most central of those left apart, and last all pairs that these links
    left apart and that meet often enough: a large group of copies costs no square of its
    size, and no text hides another. Sampled counts put common shingles last, so that few
    texts meet on them. Buckets are counted and given their heads by combined aggregates;
    joins on them can be split where one is hot.
    """
    common = _common_shingles(plain, shingle)

    def sketch(batches):
        for batch in batches:
            for lo, bounds, found, marks in sketches(batch.column(2).cast(pa.binary()), shingle):
                n = len(marks)
                at, first = prefixes(bounds, found, similarity, common)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(first.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[:2]), pa.array(np.diff(bounds)), pa.array(marks.view(np.int64)), lists], names=["th", "place", "size", "fp", "prefix"])

    marked = plain.mapInArrow(sketch, "th binary, place long, size long, fp long, prefix array<long>")
    marked = marked.groupBy("th").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("size", "fp", "prefix")))
    marked = stored(marked.withColumn("node", F.monotonically_increasing_id()), "sketches")  # written once, so the numbers stay
    texts = marked.select("node", "th", "place")
    least = marked.groupBy("fp").agg(F.min("node").alias("u"))
    same = marked.select("fp", F.col("node").alias("v")).join(least, "fp").select("u", "v").where("u <> v")
    of = lambda side: least.select(F.col("fp").alias(f"_{side}"), F.col("u").alias(side))
    ball = links(marked, radius).select(F.col("u").alias("_u"), F.col("v").alias("_v")).join(of("u"), "_u").join(of("v"), "_v").select("u", "v")
    ball = same.unionByName(ball).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    empty = F.when(F.size("prefix") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("prefix"))  # texts without words are alike
    entries = marked.select("node", "size", F.posexplode(empty).alias("at", "shingle"))
    again = entries.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    entries = stored(entries.join(again, "shingle"), "shared-shingles")
    rank = entries.groupBy("node").agg((-F.sum("n") / F.greatest(F.max("size"), F.lit(1))).alias("rank"))
    entries = stored(entries.drop("n").join(rank, "node"), "ranked")

    tried, found = [], []

    def verify(pairs: DataFrame, label: str) -> None:
        for before in tried:
            pairs = pairs.join(before, ["u", "v"], "left_anti")
        tried.append(stored(pairs, label))
        found.append(_verified(plain, texts, tried[-1], shingle, similarity))

    def all_links() -> DataFrame:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    verify(ball.unionByName(_stars(entries, entries.groupBy("shingle").agg(_first()), similarity)).distinct(), "pairs")
    for _ in range(ROUNDS):
        member = components(all_links()).select("node", F.col("root"))
        labelled = entries.select("node", "size", "rank", "at", "shingle").join(member, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        labelled = stored(labelled, "labelled")
        split = labelled.groupBy("shingle").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("shingle")
        entries = stored(labelled.join(split, "shingle"), "split-buckets")
        meet = entries.groupBy("shingle").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n") / 2)).first()
        if not meet[0] or meet[1] <= MEETINGS * meet[0]:
            break
        top = entries.groupBy("shingle").agg(F.min(F.struct("rank", "node", "label")).alias("_top")).select("shingle", F.col("_top.label").alias("_label"))
        second = entries.join(top, "shingle").groupBy("shingle").agg(_first(F.col("label") != F.col("_label")))
        verify(_stars(entries, second, similarity), "pairs")
    others = entries.select(F.col("node").alias("v"), F.col("size").alias("_size"), F.col("at").alias("_at"), F.col("label").alias("_label"), "shingle")
    apart = entries.withColumnRenamed("node", "u").join(others, "shingle").where(F.col("u") < F.col("v")).where(F.col("label") != F.col("_label"))
    verify(_likely_places(apart, similarity), "pairs")
    return texts, all_links()


def first_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """Of each group of similar texts, the row with the smallest id.

    Texts are similar if the Jaccard similarity of their sets of word shingles is at
    least `similarity`; a group is all that are reached over similar texts.

    Of equal texts the row with the smallest id stays, of repeated rows one (a null id
    comes last; ids that are no whole numbers are ordered by their hashes; rows of equal
    id and text by a hash of their other columns). Null texts count as empty; texts without
    words are similar to each other; very long texts are taken in blocks. Columns are
    unchanged, whatever their names; an empty table stays empty. Rows that go are named by
    their keys and taken out by an anti-join, so that rows are moved only if these are many.
    """
    names = docs.columns
    key, number = text_key(text_of(col(text_col))), col(id_col)
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        number = F.shiftrightunsigned(F.xxhash64(col(id_col)), 2)
    place = F.coalesce(F.when(col(id_col).isNotNull(), number.cast("long")), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_of(col(text_col))), 2))
    rest = [n for n in names if n not in (id_col, text_col)]
    other = F.xxhash64(F.lit(1), *[F.to_json(F.struct(col(n))) if isinstance(docs.schema[n].dataType, (T.MapType, T.VariantType)) else col(n) for n in rest])
    plain = docs.select(key.alias("th"), place.alias("place"), text_of(col(text_col)).alias("_text"))
    tag = free_name(docs, "_key")
    with temporary_tables(docs.sparkSession), small_batches(docs.sparkSession):  # the list of rows that go is all that stays
        texts, links_ = similar_links(plain, shingle, similarity)
        member = components(links_).join(texts, "node").select("th", "root", F.struct("place", "th").alias("_at"))
        least = member.groupBy("root").agg(F.min("_at").alias("_least"))
        later = stored(member.join(least, "root").where("_at <> _least").select("th", F.lit(True).alias("_later")), "later-copies")
        marks = F.struct(key.alias("th"), place.alias("place"), other.alias("other"))
        kinds = docs.select(marks.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
        kinds = stored(kinds.select("k.*", "n"), "kinds")  # every kind of row, without its texts
        first = kinds.groupBy("th").agg(F.min(F.struct("place", "other")).alias("_first"))
        judged = kinds.join(first, "th").join(later, "th", "left")
        stays = F.col("_later").isNull() & (F.struct("place", "other") == F.col("_first"))
        judged = judged.select(F.struct("th", "place", "other").alias(tag), stays.alias("stays"), "n")
        judged = stored(judged.where("not stays or n > 1"), "judged")
    rows = docs.withColumn(tag, marks)
    alone = rows.join(judged.select(tag), tag, "left_anti")
    twins = rows.join(judged.where("stays").select(tag), tag, "left_semi").dropDuplicates([tag])
    return alone.unionByName(twins).select(*cols(names))

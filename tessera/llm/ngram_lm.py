"""A bigram language model in an Elias-Fano trie, trained on and queried from Spark.

Level 1 holds the words of the training texts: their hashes in order (the rank is the
word's id) and their cumulative counts, both Elias-Fano; a count is the difference of
neighbours. The cumulative counts are monotone pointers too: context c and word w stand
at C[c] + w / U * n(c) in the mass of all bigrams, which is cut into parts of equal
mass, so that a frequent context spans several parts and none grows with the corpus.
Each part of level 2 has its contexts, pointers to their successors, and successors
relative to their context (w + U * rank of the context), with smoothed probabilities in
one byte each. A query finds the context in its part, then the word among its
successors. Levels are files in the shared folder, memory-mapped by executors.

Probabilities are Witten-Bell: known words share 1 - n1 / N of the unigram mass (n1:
words seen once), the one class of unknown words has the rest, and a bigram is
(n(c, w) + T(c) P(w)) / (n(c) + T(c)) with T the number of distinct successors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from . import files
from .common import shared_dir, stored, text_of
from .elias_fano import EliasFano, dump, load
from .textscan import LOWER, word_blocks, word_bounds, word_hashes

#: Words of a level-1 part (as a target), and tokens' mass of a level-2 part.
PART_WORDS, PART_MASS = 1 << 19, 1 << 21
#: Tokens counted together, and bytes of text tokenised or looked up together.
_TOGETHER = 1 << 20
_BYTES = 1 << 20
#: Files of a model that a worker keeps open.
_OPEN = 64
#: The end of a text as a word's hash; a word whose hash this is gets the next one.
END = 0
#: log10 probability = -code / STEP.
STEP = 24.0


@dataclass(frozen=True)
class Shape:
    """What the driver knows of a model: sizes only."""

    folder: str
    bits: int
    base: tuple[int, ...]  # first id of each level-1 part
    mass: tuple[int, ...]  # cumulative count before each level-1 part
    words: int  # V
    tokens: int  # N
    once: int  # n1
    texts: int  # training texts
    part_mass: int

    @property
    def universe(self) -> int:
        return self.words + 2

    @property
    def unknown(self) -> float:
        """Probability of the class of unknown words."""
        return max(self.once, 1) / self.tokens if self.tokens > 1 else 1.0


def _tokens(texts: pa.Array):
    """(first row, rows, token hashes, token owners, is first of its text, token before) for runs of texts.

    Each text ends with END. A long one comes in blocks; all but its first have the last
    token of the block before, the others None.
    """
    before = None
    for lo, hi, data, starts, ends, opens, closes in word_blocks(texts, _BYTES):
        n = hi - lo
        data = LOWER[data]
        first, last, doc = word_bounds(data, starts, ends)
        hashes = word_hashes(data, first, last)
        hashes[hashes == END] = END + 1
        words = np.bincount(doc, minlength=n)
        before = None if opens else before
        if closes:
            at = np.cumsum(words + 1) - 1
            out, owner = np.full(len(hashes) + n, END, np.uint64), np.repeat(np.arange(n), words + 1)
            inner = np.ones(len(out), bool)
            inner[at] = False
            out[inner] = hashes
            head = np.zeros(len(out), bool)
            head[at - words] = before is None
        else:
            out, owner, head = hashes, np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
            head[:1] = before is None
        if len(out):
            yield lo, n, out, owner, head, before
            before = out[-1]


class Trie:
    """The model's files, opened as they are needed."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.base = np.array([*shape.base, shape.words], np.int64)

    @lru_cache(maxsize=_OPEN)  # noqa: B019  one trie lives as long as its worker
    def part(self, name: str) -> dict:
        try:
            source = files.reader(self.shape.folder, name)
        except FileNotFoundError:
            return {}
        arrays = load(source.read_buffer() if hasattr(source, "read_buffer") else source.read())
        found = {n.rpartition(".")[0]: None for n in arrays if n.endswith(".shape")}
        return {n: EliasFano(arrays, n) for n in found} | {n: a for n, a in arrays.items() if "." not in n}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        shift = np.uint64(64 - self.shape.bits) if self.shape.bits else None
        part = (hashes >> shift).astype(np.int64) if shift is not None else np.zeros(len(hashes), np.int64)
        for p in np.unique(part):
            words = self.part(f"words-{p}").get("hash")
            if words is not None:
                lo, hi = np.searchsorted(part, (p, p + 1))
                found = words.find(hashes[lo:hi])
                out[lo:hi] = np.where(found >= 0, found + self.base[p], -1)
        return out

    def counts(self, ids: np.ndarray, types: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cumulative count before, count, distinct successors) of sorted ids; words + 0 is the start of texts."""
        before, count, kinds = (np.zeros(len(ids), np.int64) for _ in range(3))
        part = np.searchsorted(self.base, ids, "right") - 1
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, (p, p + 1))
            if p >= len(self.shape.base):
                before[lo:hi], count[lo:hi] = self.shape.tokens, self.shape.texts
                if types:
                    kinds[lo:hi] = self.part("types-start").get("types", np.zeros(1, np.int64))[0]
                continue
            local = ids[lo:hi] - self.base[p]
            sums = self.part(f"words-{p}")["sum"]
            a, b = sums.get(local).astype(np.int64), sums.get(local + 1).astype(np.int64)
            before[lo:hi], count[lo:hi] = a + self.shape.mass[p], b - a
            if types:
                kinds[lo:hi] = self.part(f"types-{p}")["types"][local]
        return before, count, kinds

    def place(self, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The level-2 part of each (context, word)."""
        inside = (word.astype(np.float64) / self.shape.universe * count).astype(np.int64)
        return (before + inside) // self.shape.part_mass

    def bigrams(self, part: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the bigrams' probabilities, -1 where there is none; rows in order of part."""
        out = np.full(len(part), -1, np.int64)
        for p in np.unique(part):
            level = self.part(f"bigrams-{p}")
            if not level:
                continue
            lo, hi = np.searchsorted(part, (p, p + 1))
            c = level["context"].find(context[lo:hi].astype(np.uint64))
            at = np.flatnonzero(c >= 0)
            x = c[at].astype(np.uint64) * np.uint64(self.shape.universe) + word[lo:hi][at].astype(np.uint64)
            found = level["successor"].find(x)
            ok = np.flatnonzero(found >= 0)
            inside = level["pointer"].get(c[at[ok]]) <= found[ok].astype(np.uint64)
            out[lo + at[ok[inside]]] = level["code"][found[ok[inside]]]
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) by the word's count, 0 for the class of unknown words."""
        s = self.shape
        return np.where(count > 0, (1 - s.unknown) * count / max(s.tokens, 1), s.unknown)


@lru_cache(maxsize=2)
def _trie(shape: Shape) -> Trie:
    return Trie(shape)


def _pairs(trie: Trie, hashes: np.ndarray, head: np.ndarray, before):
    """Per token: its count, its predecessor's id (the start's for the first; -1 unknown), and its own id."""
    more = 0 if before is None else 1
    distinct, back = np.unique(np.concatenate(([before], hashes)) if more else hashes, return_inverse=True)
    ids = trie.ids(distinct)
    known = ids >= 0
    count = np.zeros(len(distinct), np.int64)
    count[known] = trie.counts(ids[known])[1]
    own = ids[back]
    context = np.concatenate(([-1], own[:-1]))[more:]
    context[head] = trie.shape.words
    return count[back[more:]], context, own[more:]


def _distinct_pairs(context: np.ndarray, word: np.ndarray):
    """(context, word, count, inverse) of distinct pairs, in order."""
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    first = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))) if len(c) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    return c[at], w[at], np.diff(np.append(at, len(c))), back


def _with_counts(trie: Trie, c: np.ndarray, types: bool = False):
    """`Trie.counts` for sorted ids with repeats."""
    distinct, back = np.unique(c, return_inverse=True)
    return tuple(x[back] for x in trie.counts(distinct, types))


def _squeeze(*columns: np.ndarray) -> bytes:
    """Integer columns as planes of bytes, compressed."""
    raw = b"".join(np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + raw)


def _spread(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def _count_words(batches):
    for batch in batches:
        for _, _, hashes, _, _, _ in _tokens(batch.column(0).cast(pa.binary())):
            distinct, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n)], names=["hash", "n"])


def _by_key(batches, columns: int):
    """(key, columns) of consecutive rows with the same first column, over all batches of a sorted partition."""
    key, held = None, []
    for batch in batches:
        rows = [batch.column(i) for i in range(columns + 1)]
        keys = rows[0].to_numpy(zero_copy_only=False)
        cut = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            if keys[a] != key:
                if held:
                    yield key, held
                key, held = keys[a], []
            held.append([r.slice(a, b - a) for r in rows[1:]])
    if held:
        yield key, held


def _save(folder: str, name: str, parts: dict) -> None:
    """Write a file whole; the content depends on the data alone, so that a task run again writes the same."""
    system, path = files.place(folder)
    system.create_dir(path, recursive=True)
    import uuid

    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as sink:
        sink.write(dump(parts))
    system.move(draft, f"{path}/{name}")


def _write_words(folder: str, part_type=np.uint64):
    def run(batches):
        for part, held in _by_key(batches, 2):
            hashes = np.concatenate([h[0].to_numpy() for h in held]).view(np.uint64)
            n = np.concatenate([h[1].to_numpy() for h in held]).astype(np.int64)
            order = np.argsort(hashes)
            hashes, n = hashes[order], n[order]
            total = np.concatenate(([0], np.cumsum(n))).astype(np.uint64)
            _save(folder, f"words-{part}", EliasFano.encode(hashes, 1 << 64, "hash") | EliasFano.encode(total, int(total[-1]) + 1, "sum"))
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (part, len(n), n.sum(), (n == 1).sum())], names=["part", "words", "mass", "once"])

    return run


def _count_pairs(shape: Shape):
    def run(batches):
        trie = _trie(shape)
        held, size = [], 0

        def flush():
            c, w, n, _ = _distinct_pairs(*(np.concatenate(x) for x in zip(*held)))
            before, count, _ = _with_counts(trie, c)
            part = trie.place(before, count, w)
            cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
            blobs = [_squeeze(np.diff(c[a:b], prepend=0), w[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for batch in batches:
            for _, _, hashes, _, head, before in _tokens(batch.column(0).cast(pa.binary())):
                _, context, own = _pairs(trie, hashes, head, before)
                held.append((context, own))
                size += len(own)
                if size >= _TOGETHER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge_pairs(batches):
    for part, held in _by_key(batches, 1):
        columns = [_spread(blob, 3) for h in held for blob in h[0].to_pylist()]
        c = np.concatenate([np.cumsum(x[0]) for x in columns])
        w, n = (np.concatenate([x[i] for x in columns]) for i in (1, 2))
        context, word, _, back = _distinct_pairs(c, w)
        total = np.bincount(back, n).astype(np.int64)
        distinct, types = np.unique(context, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([_squeeze(np.diff(context, prepend=0), word, total)], pa.binary()), pa.array([distinct.tolist()], pa.list_(pa.int64())), pa.array([types.tolist()], pa.list_(pa.int64()))],
            names=["part", "blob", "context", "types"],
        )


def _write_types(shape: Shape):
    def run(batches):
        base = [*shape.base, shape.words, shape.words + 1]
        for part, held in _by_key(batches, 2):
            out = np.zeros(base[part + 1] - base[part], np.int64)
            for h in held:
                out[h[0].to_numpy() - base[part]] = h[1].to_numpy()
            _save(shape.folder, f"types-{part}" if part < len(shape.base) else "types-start", {"types": out.astype(np.uint32 if out.max(initial=0) < 1 << 32 else np.int64)})
            yield pa.RecordBatch.from_arrays([pa.array([int(part)])], names=["part"])

    return run


def _write_bigrams(shape: Shape):
    def run(batches):
        trie = _trie(shape)
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                context, word, n = _spread(blob, 3)
                context = np.cumsum(context)
                _, total, types = _with_counts(trie, context, True)
                distinct, back = np.unique(word, return_inverse=True)
                p = trie.unigram(trie.counts(distinct)[1])[back]
                smoothed = np.log10((n + types * p) / (total + types))
                code = np.clip(np.rint(-smoothed * STEP), 0, 255).astype(np.uint8)
                own, first, rank = np.unique(context, return_index=True, return_inverse=True)
                successor = rank.astype(np.uint64) * np.uint64(shape.universe) + word.astype(np.uint64)
                _save(
                    shape.folder, f"bigrams-{part}",
                    EliasFano.encode(own.astype(np.uint64), shape.universe, "context")
                    | EliasFano.encode(first.astype(np.uint64), len(context) + 1, "pointer")
                    | EliasFano.encode(successor, len(own) * shape.universe, "successor") | {"code": code},
                )
                yield pa.RecordBatch.from_arrays([pa.array([int(part)])], names=["part"])

    return run


def train(docs: DataFrame, training: Column, text_col: str = "text", part_words: int = PART_WORDS, part_mass: int = PART_MASS) -> Shape:
    """Count, smooth and write the model of the rows where `training` holds; every n-gram of them is kept.

    A null text is an empty one, a repeated row counts again, a very long text is taken in
    blocks; other columns are ignored. No training row: a model without words.
    """
    spark = docs.sparkSession
    texts = docs.where(training).select(text_of(text_col).alias("_text"))
    folder = shared_dir(spark, "ngram-lm")
    words = stored(texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("hash") == END, F.col("n")))).first()
    if not total[0]:
        return Shape(folder, 0, (), (), 0, 0, 0, 0, part_mass)
    bits = max(0, math.ceil(math.log2(total[0] / part_words)))
    part = F.shiftrightunsigned("hash", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    sorted_words = words.select(part.alias("part"), "hash", "n").repartition("part").sortWithinPartitions("part")
    built = sorted(stored(sorted_words.mapInArrow(_write_words(folder), "part long, words long, mass long, once long"), "word-parts").collect())
    base, mass, at = [], [], {r["part"]: r for r in built}
    count = weight = 0
    for p in range(1 << bits):
        base.append(count)
        mass.append(weight)
        if p in at:
            count, weight = count + at[p]["words"], weight + at[p]["mass"]
    shape = Shape(folder, bits, tuple(base), tuple(mass), count, weight, sum(r["once"] for r in built), total[2], part_mass)
    blobs = texts.mapInArrow(_count_pairs(shape), "part long, blob binary").repartition("part").sortWithinPartitions("part")
    merged = stored(blobs.mapInArrow(_merge_pairs, "part long, blob binary, context array<long>, types array<long>"), "bigrams")
    kinds = merged.select(F.explode(F.arrays_zip("context", "types")).alias("_x")).groupBy(F.col("_x.context").alias("id")).agg(F.sum("_x.types").alias("types"))
    everyone = [int(b) for b in shape.base]
    home = F.size(F.filter(F.array(*[F.lit(b) for b in [*everyone, shape.words]]), lambda b: b <= F.col("id"))).cast("long") - 1
    empty = spark.range(0, len(everyone) + 1).select(F.col("id").alias("part"))  # a part without contexts has a file too
    first = empty.select("part", F.element_at(F.array(*[F.lit(b) for b in [*everyone, shape.words]]), (F.col("part") + 1).cast("int")).cast("long").alias("id"), F.lit(0).cast("long").alias("types"))
    own = kinds.select(home.alias("part"), "id", "types")
    spans = [b - a for a, b in zip(everyone, [*everyone[1:], shape.words])] + [1]
    first = first.where(F.element_at(F.array(*[F.lit(s) for s in spans]), (F.col("part") + 1).cast("int")) > 0)
    rows = own.unionByName(first).groupBy("part", "id").agg(F.max("types").alias("types"))
    stored(rows.repartition("part").sortWithinPartitions("part").mapInArrow(_write_types(shape), "part long"), "type-parts")
    stored(merged.select("part", "blob").mapInArrow(_write_bigrams(shape), "part long"), "bigram-parts")
    return shape


def score(docs: DataFrame, shape: Shape, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score and score (log10 probabilities of the whole text, its end included).

    Null texts are empty: the end alone. Repeated ids and rows are scored one by one, an
    empty table gives no rows, very long texts are taken in blocks, other columns are
    ignored. With a model of no texts every word is of the unknown class, which then is
    certain: both scores are 0.
    """
    rows = docs.select(col(id_col), text_of(col(text_col)).alias("_text"))

    def run(batches):
        trie = _trie(shape)
        for batch in batches:
            out = np.zeros((4, len(batch)))
            for lo, n, hashes, owner, head, last in _tokens(batch.column(1).cast(pa.binary())):
                count, context, own = _pairs(trie, hashes, head, last)
                base = np.log10((count + 1) / (shape.tokens + shape.words + 1))
                value = np.log10(trie.unigram(count))
                asked = np.flatnonzero(context >= 0) if shape.words else np.zeros(0, np.int64)
                c, w, _, back = _distinct_pairs(context[asked], own[asked])
                before, total, types = _with_counts(trie, c, True)
                code = np.full(len(c), -1, np.int64)
                seen = np.flatnonzero(w >= 0)
                code[seen] = trie.bigrams(trie.place(before[seen], total[seen], w[seen]), c[seen], w[seen])
                shrink = np.log10(np.maximum(types, 1e-300) / np.maximum(total + types, 1e-300))
                shrink = np.where(types > 0, shrink, 0.0)
                value[asked] = np.where(code[back] >= 0, -code[back] / STEP, value[asked] + shrink[back])
                for i, x in enumerate((None, (count > 0).astype(float), base, value)):
                    out[i, lo : lo + n] += np.bincount(owner, x, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])],
                names=[id_col, "n_tokens", "n_known", "base_score", "score"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")

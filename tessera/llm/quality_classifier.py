"""A text quality classifier learned from positive and unlabelled text.

Trusted positives are labelled rows; every other text is unlabelled, good or bad. The
class prior (the share of good text among the unlabelled) is estimated from the
highest-scored bins of a positive-against-unlabelled model, and a small network then
minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
so that unlabelled text may hold any share of good text. It sees only statistics of
the whole text: character classes, word shapes, repetition, lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from .common import fold_of, kept_rows, text_of
from .textscan import LOWER, word_blocks, word_bounds, word_hashes

#: Byte classes, in this order: lower, upper, digit, space, line end, other white space, bar, symbol,
#: angle, exclamation, stop, comma, other mark, control, lead byte, low continuation, high continuation.
_CLASS = np.full(256, 12, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[:32] = 13
_CLASS[127] = 13
_CLASS[[9, 11, 12, 13]] = 5
_CLASS[32], _CLASS[10], _CLASS[ord("|")] = 3, 4, 6
_CLASS[[ord(c) for c in "#*$%&"]] = 7
_CLASS[[ord(c) for c in "<>"]] = 8
_CLASS[ord("!")], _CLASS[ord(".")], _CLASS[ord(",")] = 9, 10, 11
_CLASS[0xC0:], _CLASS[0x80:0x9F], _CLASS[0x9F:0xC0] = 14, 15, 16
_CLASSES = 17
_WORD_FEATURES = 14
N_FEATURES = _CLASSES + _WORD_FEATURES
#: Weight decay of the network.
DECAY = 3e-4


def _repeats(doc: np.ndarray, hashed: np.ndarray, times: np.ndarray):
    """(doc, word, times) of distinct words of each text, in order."""
    order = np.lexsort((hashed, doc))
    h, d, t = hashed[order], doc[order], times[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    return d[head], h[head], np.add.reduceat(t, head) if len(head) else t


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(class counts and sums over words of each text, distinct words, each text's first and last word)."""
    n = len(starts)
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n), ends - starts)
    count = np.bincount(owner * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    first, last, doc = word_bounds(data, starts, ends)
    hashed = word_hashes(LOWER[data], first, last)
    length = (last - first).astype(np.float64)
    upper = np.concatenate(([0], np.cumsum(kind == 1)))
    letters = np.concatenate(([0], np.cumsum(kind <= 1)))
    marks = np.concatenate(([0], np.cumsum((kind >= 6) & (kind <= 8))))
    span = lambda c: c[last] - c[first]
    total = lambda x: np.bincount(doc, x, n)
    same = np.concatenate((np.zeros(min(len(doc), 1), bool), (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])))
    sums = [
        np.ones(len(doc)), length, length**2, same, (span(upper) > 1) & (span(upper) == span(letters)), (span(upper) > 0) & (kind[first] == 1),
        span(marks) > 0, kind[last - 1] == 9, kind[last - 1] == 10,
    ]
    return np.concatenate((count, np.stack([total(x) for x in sums], 1)), 1), _repeats(doc, hashed, np.ones(len(doc))), hashed[:1], hashed[-1:]


def _statistics(sums: np.ndarray, repeats: tuple) -> np.ndarray:
    n = len(sums)
    count, (words, length, squares, *shares) = sums[:, :_CLASSES], sums[:, _CLASSES:].T
    out = np.zeros((n, N_FEATURES))
    out[:, :_CLASSES] = count / np.maximum(count.sum(1), 1)[:, None]
    per = np.maximum(words, 1)
    same, capitals, title, marks, cried, stopped = (x / per for x in shares)
    d, _, times = repeats
    distinct, most = np.bincount(d, minlength=n), np.zeros(n)
    np.maximum.at(most, d, times)
    average = length / per
    out[:, _CLASSES:] = np.stack(
        [
            np.log1p(words), average / 10, np.sqrt(np.maximum(squares / per - average**2, 0)) / 10, same, distinct / per, most / per, np.bincount(d, times * np.log(times), n) / per,
            capitals, title, marks, cried, stopped, np.log1p(words / (count[:, 4] + 1)), np.bincount(d, times > 1, n) / np.maximum(distinct, 1),
        ],
        axis=1,
    )
    return out * (count.sum(1) > 0)[:, None]


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text (binary, no nulls); all zeros for an empty one.

    A very long text is taken in blocks; only its distinct words are held.
    """
    out = np.zeros((len(texts), N_FEATURES), np.float64)
    for lo, hi, data, starts, ends, opens, closes in word_blocks(texts):
        sums, repeats, first, last = _sums(data, starts, ends)
        if not (opens and closes):
            if not opens:
                sums = sums + held[0]  # noqa: F821
                sums[0, _CLASSES + 3] += len(first) and len(held[2]) and first[0] == held[2][0]  # noqa: F821  the same word over the edge
                repeats = _repeats(*(np.concatenate(x) for x in zip(held[1], repeats)))  # noqa: F821
                last = last if len(last) else held[2]  # noqa: F821
            held = sums, repeats, last
        if closes:
            out[lo:hi] = _statistics(sums, repeats)
    return out


@dataclass(frozen=True)
class Model:
    """Standardisation, one hidden layer of tanh units, and the class prior it was trained with."""

    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Estimated probability that a text is good."""
        hidden = _hidden(np.clip((x - self.centre) / self.scale, -8, 8), self.weights)
        return _sigmoid(hidden @ self.weights[2] + self.weights[3])


def _hidden(x: np.ndarray, w: tuple) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(x: np.ndarray, slope, units: int, rounds: int, batch: int, groups: tuple[np.ndarray, np.ndarray], seed: int, decay: float):
    """Adam on mini-batches that draw from both groups; slope gives d risk / d output for a batch."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)), np.zeros(units), rng.normal(0, 1 / np.sqrt(units), units), np.zeros(())]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, rounds + 1):
        rows = [rng.choice(g, min(batch, len(g)), replace=False) for g in groups]
        part = x[np.concatenate(rows)]
        hidden = _hidden(part, w)
        d = slope(hidden @ w[2] + w[3], len(rows[0]))
        back = np.outer(d, w[2]) * (1 - hidden**2)
        grads = [part.T @ back + decay * w[0], back.sum(0), hidden.T @ d + decay * w[2], d.sum()]
        rate = 0.01 * min(1.0, 2 * (1 - step / (rounds + 1)))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def estimate_prior(p: np.ndarray, n_positive: int, u: np.ndarray, n_unlabelled: int) -> float:
    """Share of positives among the unlabelled, from the shares p and u of both groups that score above each of some cuts.

    Above a cut where all are positive, the ratio of the two shares is the prior;
    elsewhere it is larger. The least upper bound over cuts is taken (best bin
    estimation), each ratio widened by its sampling error.
    """
    bound = (u + np.sqrt(np.log(40) / (2 * n_unlabelled))) / np.maximum(p, 1e-9)
    best = int(np.argmin(bound + np.sqrt(np.log(40) / (2 * n_positive)) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def risk_slope(prior: float):
    """Derivative of the non-negative risk by each output; where its second part is below zero, of that part's negative.

    Outputs are those of `n` positives, then of unlabelled texts; the loss is logistic.
    """

    def slope(z: np.ndarray, n: int) -> np.ndarray:
        p, u = _sigmoid(z[:n]), _sigmoid(z[n:])
        negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
        down = np.concatenate((-prior * p / n, u / len(u)))
        if negative < 0:  # the unbiased estimate has gone below zero: walk it back
            return -down
        return down + np.concatenate((prior * (p - 1) / n, np.zeros(len(u))))

    return slope


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(0), x.std(0) + 1e-6


@dataclass(frozen=True)
class Half:
    """What the prior of one half of the texts is estimated with: a model of positives against
    unlabelled texts of the *other* half (a model's own positives would look too good), cuts on its scores,
    and the share of this half's positives above each."""

    model: Model
    cuts: np.ndarray
    shares: np.ndarray
    n_positive: int

    def above(self, x: np.ndarray) -> np.ndarray:
        """How many rows score above each cut, then how many there are."""
        scores = np.sort(self.model.score(x))
        return np.append(len(scores) - np.searchsorted(scores, self.cuts, "left"), len(scores))

    def prior(self, above: np.ndarray) -> float:
        return estimate_prior(self.shares, self.n_positive, above[:-1] / above[-1], int(above[-1]))


def halves(positive: list[np.ndarray], unlabelled: list[np.ndarray], rounds: int = 300, batch: int = 512, seed: int = 7) -> list[Half]:
    """Both halves' estimators; if a half lacks either group, each is made of all rows."""
    if min(map(len, [*positive, *unlabelled])) == 0:
        positive, unlabelled = ([np.concatenate(g)] * 2 for g in (positive, unlabelled))

    def against(z, n):
        return np.concatenate(((_sigmoid(z[:n]) - 1) / n, _sigmoid(z[n:]) / (len(z) - n)))

    centre, scale = _standard(np.concatenate((*positive, *unlabelled)))
    out = []
    for i in range(2):
        p, u = positive[1 - i], unlabelled[1 - i]
        x = np.clip((np.concatenate((p, u)) - centre) / scale, -8, 8)
        w = _train(x, against, 4, rounds, batch, (np.arange(len(p)), np.arange(len(p), len(x))), seed, 1e-2)
        model = Model(centre, scale, w, float("nan"))
        own = model.score(positive[i])
        cuts = np.quantile(own, np.linspace(0.02, 0.9, 45))
        out.append(Half(model, cuts, (own[None, :] >= cuts[:, None]).mean(1), len(own)))
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, units: int = 24, rounds: int = 1500, batch: int = 512, seed: int = 7) -> Model:
    """Learn from feature rows of trusted positives and of unlabelled texts; without a prior, that of the unlabelled rows."""
    if prior is None:
        parts = [unlabelled[i::2] for i in range(2)]
        found = halves([positive[i::2] for i in range(2)], parts, min(rounds // 3, 300), batch, seed)
        prior = float(np.mean([h.prior(h.above(x)) for h, x in zip(found, parts) if len(x)]))
    x = np.concatenate((positive, unlabelled))
    centre, scale = _standard(x)
    x = np.clip((x - centre) / scale, -8, 8)
    groups = (np.arange(len(positive)), np.arange(len(positive), len(x)))
    return Model(centre, scale, _train(x, risk_slope(prior), units, rounds, batch, groups, seed + 1, DECAY), prior)


def _sample(rows: DataFrame, keys: list, bound: int, seed: int) -> DataFrame:
    """At most about `bound` rows, chosen by a hash of their keys."""
    share = min(1.0, bound / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) < F.lit(int(share * (1 << 53))))


def _class_prior(texts: DataFrame, found: list[Half]) -> float:
    """The prior over all rows of (half, text): every text is scored, each task sends its counts above the cuts."""

    def run(batches):
        sums = [np.zeros(len(h.cuts) + 1, np.int64) for h in found]
        for b in batches:
            x, half = features(b.column(1).cast(pa.binary())), b.column(0).to_numpy(zero_copy_only=False)
            for i, h in enumerate(found):
                sums[i] += h.above(x[half == i])
        half, cut = (np.concatenate(c) for c in zip(*((np.full(len(s), i), np.arange(len(s))) for i, s in enumerate(sums))))
        yield pa.RecordBatch.from_arrays([pa.array(half, pa.int32()), pa.array(cut, pa.int32()), pa.array(np.concatenate(sums))], names=["half", "cut", "n"])

    sums = [np.zeros(len(h.cuts) + 1, np.int64) for h in found]
    for r in texts.mapInArrow(run, "half int, cut int, n long").groupBy("half", "cut").agg(F.sum("n").alias("n")).collect():
        sums[r.half][r.cut] = r.n
    return float(np.mean([h.prior(s) for h, s in zip(found, sums) if s[-1]]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, bound: int = 6000, seed: int = 11) -> Model | None:
    """Fit on at most about `bound` trusted positives and `bound` unlabelled texts.

    Trusted are rows of `labels` with quality 1 whose crc32(id) modulo `folds` is not
    0; no other label is read. The two samples' ids (bounded, whatever the corpus) are
    broadcast, and only the features of those texts come to the driver: one row an id,
    of an id's several texts the least. The class prior is counted over all texts, null and
    empty ones, those without an id and repeated rows included; very long ones are taken in
    blocks. None if there is no trusted positive with a text, so for an empty table.
    """
    trusted = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    trusted = _sample(trusted.where(fold_of(F.col("_id"), folds) != 0), ["_id"], bound, seed).select("_id", F.lit(1).alias("_trusted"))
    ids = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull())
    plain = _sample(ids, ["_id"], bound, seed + 1).distinct().select("_id", F.lit(0).alias("_trusted"))
    chosen = trusted.unionByName(plain)
    texts = docs.select(F.col(id_col).alias("_id"), F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 2)), F.lit(2)).cast("int").alias("_half"), text_of(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_trusted", "_half", "_text")

    def run(batches):
        for b in batches:
            x = features(b.column(3).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], names=["id", "trusted", "half", "x"])

    schema = T.StructType([T.StructField("id", rows.schema["_id"].dataType), *T._parse_datatype_string("trusted int, half int, x array<double>").fields])
    found = rows.mapInArrow(run, schema).groupBy("id", "trusted", "half").agg(F.min("x").alias("x")).drop("id").toPandas()
    parts = [[np.array(found.x[(found.trusted == t) & (found.half == h)].tolist()).reshape(-1, N_FEATURES) for h in range(2)] for t in (1, 0)]
    parts = [[g[np.lexsort(g.T)] for g in p] for p in parts]  # the same model whatever the order of arrival
    positive, unlabelled = map(np.concatenate, parts)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, _class_prior(texts.select("_half", "_text"), halves(*parts)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """id (or the columns `keep`) and the score as column `name`, one row per input row.

    Null and empty texts are scored like any other (their statistics are zeros), very long
    ones in blocks. Without a model every score is 0.5. An empty table gives no rows.
    """
    keep = keep or [id_col]
    rows = docs.select(*[col(c).alias(f"_{i}") for i, c in enumerate(keep)], text_of(col(text_col)).alias("_scored"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_scores(model, b.column(len(keep))), pa.float64())], names=[*(f"_{i}" for i in range(len(keep))), "score"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*keep, name)


def _scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    if model is None or not len(texts):
        return np.full(len(texts), 0.5)
    texts = texts.fill_null("") if texts.null_count else texts
    return model.score(features(texts.cast(pa.binary())))


def above(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose texts score `least` or more; columns are unchanged, whatever their names.

    Null texts count as empty; without a model, with every score at 0.5, all rows stay or none.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(place)) >= least))

    return kept_rows(docs, run)

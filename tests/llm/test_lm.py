import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_lm
from tessera.llm.elias_fano import EliasFano, dump, load


@pytest.mark.parametrize("bound", [1, 50, 10**6, 1 << 40, 1 << 64])
def test_elias_fano(bound):
    rng = random.Random(bound)
    values = sorted({rng.randrange(bound) for _ in range(300)} | {0, bound - 1})
    parts = load(dump(EliasFano.encode(np.array(values, np.uint64), bound, "x") | {"code": np.arange(3, dtype=np.uint8)}))
    seq = EliasFano(parts, "x")
    assert seq.get(np.arange(len(values))).tolist() == values and parts["code"].tolist() == [0, 1, 2]
    asked = np.array([*values, *(rng.randrange(bound) for _ in range(500))], np.uint64)
    where = {v: i for i, v in enumerate(values)}
    assert seq.find(asked).tolist() == [where.get(int(v), -1) for v in asked]


def test_elias_fano_with_repeats_and_nothing():
    seq = EliasFano(load(dump(EliasFano.encode(np.array([3, 3, 3, 9], np.uint64), 10, "x"))), "x")
    assert seq.get(np.arange(4)).tolist() == [3, 3, 3, 9] and seq.find(np.array([3, 4, 9], np.uint64)).tolist() == [0, -1, 3]
    assert EliasFano(load(dump(EliasFano.encode(np.zeros(0, np.uint64), 10, "x"))), "x").find(np.array([3], np.uint64)).tolist() == [-1]


def brute(rows):
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    c, pair, total, types = Counter(), Counter(), Counter(), Counter()
    for _, text, train in rows:
        if train:
            c.update(tok(text))
            pair.update(zip(["<s>", *tok(text)], tok(text)))
    for (x, _), n in pair.items():
        total[x] += n
        types[x] += 1
    big, v = sum(c.values()), len(c)
    unknown = max(sum(n == 1 for n in c.values()), 1) / big if big > 1 else 1.0
    p = lambda w: (1 - unknown) * c[w] / max(big, 1) if w in c else unknown
    code = lambda x: min(255, round(-math.log10(x) * ngram_lm.STEP)) / ngram_lm.STEP
    out = []
    for i, text, _ in rows:
        t, score = tok(text), 0.0
        for x, w in zip(["<s>", *t], t):
            if not total[x]:
                score += math.log10(p(w))
            elif (x, w) in pair:
                score -= code((pair[x, w] + types[x] * p(w)) / (total[x] + types[x]))
            else:
                score += math.log10(types[x] / (total[x] + types[x]) * p(w))
        out.append((i, len(t), sum(w in c for w in t), sum(math.log10((c[w] + 1) / (big + v + 1)) for w in t), score))
    return big, out


@pytest.mark.parametrize("parts", [(1 << 19, 1 << 21), (7, 40)])
def test_equals_brute_force_over_any_parts(spark, parts):
    rng = random.Random(7)
    words = ["the", "The", "of", "é", "x y", *(f"w{i}" for i in range(60))]
    text = lambda: rng.choice([" ", "\n", "\t "]).join(rng.choices(words, weights=[40, 20, 20, 5, 5, *[1] * 60], k=rng.randint(0, 60)))
    rows = [(i, text(), i % 3 > 0) for i in range(80)] + [(500, None, True), (501, "", False), (None, "the unseen", False), (None, "the unseen", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash boolean").repartition(3)
    model = ngram_lm.train(df, F.col("hash"), part_words=parts[0], part_mass=parts[1])
    big, want = brute(rows)
    got = sorted((tuple(r) for r in ngram_lm.score(df, model).collect()), key=str)
    assert model.tokens == big and len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4])


def test_tokens_do_not_depend_on_the_blocks(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "a", *(" ".join(rng.choices(["b", "cc", "\n", "d" * 40], k=rng.randint(1, 200))) for _ in range(30))]
    raw = pa.array([t.encode() for t in texts], pa.binary())

    def stream():
        out, last = [], {}
        for lo, _, hashes, owner, head, before in ngram_lm._tokens(raw):
            for i, (h, o, first) in enumerate(zip(hashes.tolist(), owner.tolist(), head.tolist())):
                previous = None if first else int(before) if i == 0 else int(hashes[i - 1])
                assert first or previous == last[lo + o]
                out.append((lo + o, h, first))
                last[lo + o] = h
        return out

    whole = stream()
    monkeypatch.setattr(ngram_lm, "_BYTES", 16)
    assert stream() == whole and [sum(o == i for o, _, _ in whole) for i in range(len(texts))] == [len(t.split()) + 1 for t in texts]


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["a", "b", "c d", "e"]) for _ in range(1_500_000))
    rows = [(1, long, True), (2, "a b " * 40, True), (3, "x" * 3_000_000, False), (4, long[: len(long) // 2], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(2)
    _, want = brute(rows)
    got = sorted(tuple(r) for r in ngram_lm.score(df, ngram_lm.train(df, F.col("train"))).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3:] == pytest.approx(w[3:]) for g, w in zip(got, want))


def test_no_training_text_and_no_text(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngram_lm.train(df, F.lit(False))
    assert tuple(ngram_lm.score(df, model).first()) == (1, 3, 0, 0.0, 0.0)
    assert ngram_lm.score(df.limit(0), ngram_lm.train(df, F.lit(True))).count() == 0


def test_held_out_text_is_likelier_than_by_the_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.col("doc_id") % 7 == 2
    scored = ngram_lm.score(docs.where(held), ngram_lm.train(docs, ~held)).agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]

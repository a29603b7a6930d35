import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tessera.llm import graph, simhash


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one Two", "É é ÉÉ x y", "a b c", "a b c d " * 50]
    texts += [" ".join(rng.choice(["a", "Bb", "c\n", "dé", "\x0b", "z"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprint(b"x y z w " * 70000) == plain_fingerprint("x y z w " * 70000)


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_links_of_even_and_odd_radius_reach_what_all_pairs_reach(spark):
    rng = random.Random(2)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            for _ in range(rng.randint(0, 2)):
                base ^= 1 << rng.randrange(64)
            prints.append(base)
    prints = sorted(set(prints + [0, 1, 3, (1 << 64) - 1, 1 << 63]))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    at = {p: i for i, p in enumerate(prints)}
    for radius in (1, 2):
        want = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
        got = [(at[r.u % (1 << 64)], at[r.v % (1 << 64)]) for r in simhash.links(df, radius).collect()]
        assert all((prints[a] ^ prints[b]).bit_count() <= radius for a, b in got)
        assert union_find(len(prints), got) == union_find(len(prints), want)
        if radius == 1:
            assert {frozenset(e) for e in got} == {frozenset(e) for e in want}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(map(tuple, graph.components(df).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    roots = union_find(700, real)
    assert got == {x: roots[x] for e in real for x in e}
    assert graph.components(df.limit(0)).count() == 0


def test_classes_over_odd_rows(spark):
    rows = [(5, "a b c d", "x"), (3, "A  B\tc d", "y"), (3, "A  B\tc d", "y"), (None, "a b c d", "z"), (9, None, "z"), (8, "", "q"), (None, "alone here now", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_first_of_similar(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, groups = [], []
    common = [word() for _ in range(15)]
    for g in range(25):
        base = [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(160)]
        for c in range(3):
            copy = list(base)
            if c:
                copy[rng.randrange(160)] = word()
            rows.append((g * 10 + c, " ".join(copy), "k", g))
            groups.append(g)
    rows += [(1000, None, "k", 0), (1001, "", "k", 0), (None, rows[0][1], "k", 0), (2000, "short one", "k", 0), (2000, "short one", "k", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, _row long")
    out = simhash.first_of_similar(df)
    assert out.columns == df.columns
    kept = sorted(r.doc_id for r in out.collect())
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t, _, _ in rows if i is not None and t is not None}
    stay = [i for i in kept if i < 1000]
    assert {i for i in stay} >= {g * 10 for g in range(25)} and len(stay) <= 27
    assert all(any(simhash.jaccard(sets[i], sets[j]) >= 0.8 for j in sets if j < i) for i in range(0, 250) if i in sets and i not in stay)
    assert [i for i in kept if i >= 1000] == [1000, 2000]
    assert simhash.first_of_similar(df.limit(0)).count() == 0


def test_an_unrelated_head_of_the_bucket_hides_no_copy(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(160)]
    other = rng.sample(base, 160)  # the same words, so the same word fingerprints
    swapped = [*base[:80], base[81], base[80], *base[82:]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([other, base, swapped])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_similar(df).collect()) == [0, 1]


def test_links_reach_what_brute_force_reaches(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    common, texts = [" ".join(rng.choices(words, k=12)) for _ in range(3)], ["", " ", "one", "one two"]
    for _ in range(20):
        base = rng.choices(words, k=rng.randint(60, 200))
        line = rng.choice(common).split()
        for _ in range(5):
            copy = [*base, *line]
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts = sorted(set(texts))
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8]
    plain = spark.createDataFrame([(t.encode(), i, t) for i, t in enumerate(texts)], "th binary, place long, _text string")
    for sample, meetings in ((10_000, 1000), (30, 0)):
        monkeypatch.setattr(simhash, "SAMPLE_TEXTS", sample)
        monkeypatch.setattr(simhash, "MEETINGS", meetings)
        nodes, links = simhash.similar_links(plain, 5, 0.8)
        at = {r.node: r.place for r in nodes.collect()}
        got = [(at[r.u], at[r.v]) for r in links.collect()]
        assert {frozenset(e) for e in got} <= {frozenset(e) for e in want} and len(want) > 30
        assert union_find(len(texts), got) == union_find(len(texts), want)


def test_one_of_a_group_stays_whose_base_is_not_the_first(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(160)]
    first, second = list(base), list(base)
    for copy, places in ((first, (20, 60, 100)), (second, (40, 80, 120))):
        for i in places:
            copy[i] = word()
    texts = {1: first, 2: second, 3: base}
    sets = {i: simhash.shingle_set(" ".join(w).encode(), 5) for i, w in texts.items()}
    assert simhash.jaccard(sets[1], sets[2]) < 0.8 <= min(simhash.jaccard(sets[1], sets[3]), simhash.jaccard(sets[2], sets[3]))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert [r.doc_id for r in simhash.first_of_similar(df).collect()] == [1]


def plain_set(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + min(k, len(words))]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_sketches_do_not_depend_on_the_batch_or_the_blocks(monkeypatch):
    from tessera.llm import textscan

    rng = random.Random(9)
    texts = [b"a b c", b"", b" \n", b"x " * 3000, "É ß a b c d e".encode(), b"A b C d e F", *(" ".join(rng.choices("abcd", k=rng.randint(0, 90))).encode() for _ in range(40))]
    raw = pa.array(texts, pa.binary())

    def flat(parts):
        return [(bounds[i + 1] - bounds[i], found[bounds[i] : bounds[i + 1]].tolist(), int(marks[i])) for _, bounds, found, marks in parts for i in range(len(marks))]

    whole = flat(simhash.sketches(raw, 5))
    assert [n for n, _, _ in whole] == [len(plain_set(t, 5)) for t in texts]
    assert whole == [x for t in texts for x in flat(simhash.sketches(pa.array([t], pa.binary()), 5))]
    blocks = textscan.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda t: blocks(t, 7))
    assert flat(simhash.sketches(raw, 5)) == whole
    assert simhash.jaccard(np.array([], np.uint32), np.array([], np.uint32)) == 1.0
    prints = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_CHUNK", 5)
    assert [simhash.fingerprint(t) for t in texts] == prints


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(10)
    common = (np.arange(0, 100, 3, dtype=np.uint32), np.array([rng.randint(6, 50) for _ in range(34)]))
    for _ in range(300):
        a = sorted(rng.sample(range(200), rng.randint(1, 60)))
        b = sorted({*rng.sample(a, max(1, len(a) - rng.randint(0, 6))), *rng.sample(range(200), rng.randint(0, 6))})
        bounds = np.array([0, len(a), len(a) + len(b)])
        at, first = simhash.prefixes(bounds, np.array(a + b, np.uint32), 0.8, common)
        if simhash.jaccard(np.array(a), np.array(b)) >= 0.8:
            assert {*first[: at[1]].tolist()} & {*first[at[1] :].tolist()}


def test_rows_that_stay_keep_their_columns_whatever_their_names(spark):
    text = " ".join(str(i * 7919) for i in range(60))
    rows = [(3, text, 1, "k"), (3, text, 1, "k"), (3, text, 2, "k"), (4, text + " more", 1, "k"), (None, "other text", 5, None), (None, "other text", 5, None), (9, None, 1, "n"), (8, "", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `_KEY` string")
    out = simhash.first_of_similar(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert [(r[0], r[1]) for r in got] == [(3, text), (8, ""), (None, "other text")] and set(got) <= set(rows)


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    texts = sorted({*texts, " ".join(base), *(" ".join(word() for _ in range(80)) for _ in range(30))}, key=lambda t: t[::-1])
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    want = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_similar(df).collect()) == sorted(set(want)) and 30 < len(set(want)) < 100


def test_only_asked_texts_go_to_python_in_small_batches(spark):
    from tessera.llm.common import small_batches, text_key
    from tessera.llm.simhash import _asked_texts

    plain = spark.range(5000).select(F.concat(F.lit("text "), "id").alias("_text")).withColumn("th", text_key(F.col("_text"))).coalesce(1)
    asked = plain.where("_text like '%77'").select("th")
    found = _asked_texts(plain, asked)
    assert 50 <= found.count() < 70 and asked.exceptAll(found.select("th")).count() == 0
    assert _asked_texts(plain, asked.limit(0)).count() == 0 and _asked_texts(plain, plain.select("th")).count() == 5000

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, many = spark.conf.get(name), plain.mapInArrow(sizes, "n long")
    with small_batches(spark):
        assert max(r.n for r in many.collect()) == 1000
    assert spark.conf.get(name) == before and max(r.n for r in many.collect()) == 5000

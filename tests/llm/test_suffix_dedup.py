import hashlib
import random
from collections import Counter

import pytest

from tessera.llm.suffix_dedup import suffix_dedup, without_repeats
from tessera.llm.suffix_family import SuffixFamily, common_prefix, runs
from tessera.llm.suffix_index import SuffixIndex


def brute(texts, length):
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    docs = [text(rng.randint(0, 60)) for _ in range(30)]
    docs += [f"{text(5)} {rng.choice(shared)} {text(7)}" for _ in range(60)]
    near = text(90).split()
    for _ in range(25):
        copy = list(near)
        for _ in range(4):
            copy[rng.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    return [*docs, docs[3], docs[3], docs[40], "", "a", "ab" * 150, "x" * 400, "é" * 130, text(3000)]


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_equals_brute_force_whichever_way_an_anchor_goes(spark, hot):
    texts = corpus(1)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length=60, k=24, hot=hot).collect()}
    want = dict(enumerate(brute([t.encode() for t in texts], 60)))
    assert got == want
    assert sum(v[1] for v in want.values()) > 5000


def test_nulls_repeated_rows_clashing_columns_and_empty_table(spark):
    text = "0123456789" * 30
    rows = [(1, text, "a"), (1, text, "a"), (None, text[5:205], "b"), (2, None, "c"), (3, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = suffix_dedup(df).collect()
    assert len(got) == 5
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (0, 0), (200, 200), (300, 300), (300, 300)]
    assert suffix_dedup(df.limit(0)).count() == 0


def test_family_finds_the_same_over_any_batches():
    rng = random.Random(5)
    entries = []
    for slot in range(300):
        core = rng.choice([b"core-one", b"core-two"])
        right = bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 12)))
        left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        entries.append((core + right, left, slot))

    def masks(size):
        family = SuffixFamily(length=20, core=8)
        for at in range(0, len(entries), size):
            family.add(entries[at : at + size])
        assert len(family.levels) <= 10
        sizes = [len(level) for level in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:]))
        return {k: v for k, v in family.mask.items() if v}

    want = {}
    for s, left, slot in entries:
        for d in range(13):
            if len(left) >= d and len(s) >= 20 - d and any(o != slot and t[: 20 - d] == s[: 20 - d] and m[:d] == left[:d] and len(m) >= d for t, m, o in entries):
                want[slot] = want.get(slot, 0) | 1 << d
    assert masks(300) == masks(17) == masks(1) == want


def test_small_parts():
    assert common_prefix(b"abc", b"abd") == 2 and common_prefix(b"ab", b"abc") == 2 and common_prefix(b"\0a", b"\0b") == 1
    assert runs(0b1011100) == [(2, 4), (6, 6)] and runs(0) == []


def test_rows_without_repeats_stay_though_they_are_blank(spark):
    passage = " ".join(str(i * 7919) for i in range(80))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, passage), (5, passage), (6, f"{passage} and more"), (7, "short"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in without_repeats(df, length=200).collect()}
    assert {i: out.get(i, "gone") for i in (1, 2, 3, 4, 5, 7, 8)} == {1: None, 2: "", 3: " \t\n", 4: "gone", 5: "gone", 7: "short", 8: ""}
    assert out[6].endswith("and more") and passage not in out[6]


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_stored_family_over_batches_equals_brute_force(spark, tmp_path, hot):
    texts = [*corpus(2), None]
    random.Random(3).shuffle(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    index = SuffixIndex(spark, f"file://{tmp_path}/family", length=60, k=24, hot=hot)
    ends = (0, 20, 45, 45, 70, len(rows))
    for n, (lo, hi) in enumerate(zip(ends, ends[1:])):
        index.add(spark.createDataFrame(rows[lo:hi], "doc_id long, text string, th string").repartition(3))
        if n in (1, 4):  # old texts too learn what a later batch repeats
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in index.report(spark.createDataFrame(rows[:hi], "doc_id long, text string, th string")).collect()}
            assert got == dict(enumerate(brute([(t or "").encode() for t in texts[:hi]], 60)))
        sizes = index.levels()
        assert all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= n + 1
    assert sum(v[1] for v in got.values()) > 5000


def test_a_failed_batch_leaves_the_stored_family_as_it_was(spark, tmp_path, monkeypatch):
    passage = " ".join(str(i * 7919) for i in range(80))
    index = SuffixIndex(spark, f"file://{tmp_path}/family")
    assert index.levels() == []
    one = spark.createDataFrame([(1, passage)], "doc_id long, text string")
    two = spark.createDataFrame([(2, f"new {passage}")], "doc_id long, text string")
    index.add(one)
    levels = index.levels()
    with monkeypatch.context() as m:
        m.setattr(SuffixIndex, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(two)
    assert index.levels() == levels and index.report(one).first().n_removed == 0
    index.add(two)
    assert index.report(one).first().n_removed == len(passage) and index.report(two).first().n_removed == len(passage)

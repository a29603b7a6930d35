import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import decontamination as dc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for row, (_, text) in enumerate(docs):
        w = words(text)
        for item, body in items:
            b = words(body)
            if not b:
                continue
            k, best = min(5, len(b)), None
            grams = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
            c, s = Counter(grams(b)), grams(w)
            size = min(len(b), len(w)) - k + 1
            for at in range(len(s) - size + 1) if size > 0 else ():
                both = sum((Counter(s[at : at + size]) & c).values())
                value = both / (size + len(b) - k + 1 - both)
                if value >= 0.8 and (best is None or value > best[0]):
                    best = (value, at, min(len(b), len(w)))
            if best:
                out[row, item] = best
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(12, 50))) for i in range(30)] + [(90, "one two"), (91, ""), (92, None), (93, "a a a a a a a a a a a a"), (94, "É b C d e")]
    docs = []
    for i in range(150):
        body = text(rng.randint(0, 80)).split()
        if i % 3 == 0:
            passage = (rng.choice(items[:30])[1]).upper().split()
            if i % 2:
                passage[rng.randrange(len(passage))] = "edited"
            body[5:5] = passage
        docs.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    docs += [(200, items[4][1]), (201, " ".join(items[5][1].split()[:-1])), (202, None), (203, ""), (204, "say one  Two now"), (205, "a " * 300), (None, items[6][1]), (200, items[4][1]), (206, f"{text(60000)} {items[7][1]}")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    index = dc.Index(items)
    got = {(i, m[0]): m[1:] for i, ms in index.rows(pa.array([(t or "").encode() for _, t in docs], pa.binary())) for m in ms}
    want = brute(docs, items)
    assert want.keys() - got.keys() == set() and got == want and len(want) > 30
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, similarity string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(((r.doc_id, r.item_id, r.similarity) for r in dc.contamination(df, bench).collect()), key=str)
    assert rows == sorted(((docs[row][0], item, v[0]) for (row, item), v in want.items()), key=str)
    clean = dc.without_contamination(df, bench)
    assert clean.columns == df.columns
    dirty = {row for row, _ in want}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d[0] for i, d in enumerate(docs) if i not in dirty), key=str)


def test_long_texts_in_blocks_give_the_same(monkeypatch):
    from tessera.llm import textscan

    docs, items = corpus()
    docs += [(300, f"{items[3][1]} " + "z y " * 40 + items[3][1] + "   \n" * 30), (301, "one two " * 60), (302, " ".join(items[8][1].split()[:-1]))]
    raw, blocks = pa.array([(t or "").encode() for _, t in docs if len(t or "") < 10**5], pa.binary()), textscan.word_blocks
    index = dc.Index(items)
    whole = list(index.rows(raw))
    for size in (9, 100, 1000):
        monkeypatch.setattr(dc, "word_blocks", lambda t, n=size: blocks(t, n))
        assert list(index.rows(raw)) == whole


def test_passes_and_empty_tables(spark, monkeypatch):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, dc.contamination(df, bench).collect()))
    monkeypatch.setattr(dc, "PASS_ITEMS", 7)
    assert sorted(map(str, dc.contamination(df, bench).collect())) == whole
    assert dc.contamination(df, bench.limit(0)).count() == 0 and dc.contamination(df.limit(0), bench).count() == 0
    assert dc.without_contamination(df, bench.limit(0)).count() == len(docs)


def test_multi_index_misses_nothing_within_the_radius():
    rng = random.Random(1)
    items = [(i, " ".join(str(rng.random()) for _ in range(20))) for i in range(40)]
    index = dc.Index(items)
    prints = []
    for item in index.items:
        for n in (0, 3, 10, 15, 16, 25):
            flipped = item.print
            for b in rng.sample(range(64), n):
                flipped ^= 1 << b
            prints.append(flipped)
    got = index.near(np.array(prints, np.uint64), 20)
    assert got == sorted((w, i) for w, p in enumerate(prints) for i, item in enumerate(index.items) if (p ^ item.print).bit_count() <= dc.RADIUS)


def test_items_edited_to_the_threshold_are_found_whatever_their_fingerprints():
    rng = random.Random(9)
    word = lambda: str(rng.random())
    items = [(i, [word() for _ in range(22)]) for i in range(400)]
    index = dc.Index([(i, " ".join(w)) for i, w in items])
    texts = [" ".join([word(), word(), *w[1:-1], word(), word()]) for _, w in items]  # 16 of 18 shingles: 0.8
    got = [(row, m[0], m[1]) for row, ms in index.rows(pa.array([t.encode() for t in texts], pa.binary())) for m in ms]
    assert got == [(i, i, 0.8) for i in range(400)]

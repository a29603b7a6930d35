import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import quality_classifier as qc
from tessera.llm.quality_rules import quality_rules


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b" ", b"One two two.\nTHREE!! $$$", "é É ça".encode(), b"word " * 5000]
    whole = qc.features(pa.array(texts, pa.binary()))
    assert (whole[0] == 0).all() and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(qc.features(pa.array([t], pa.binary()))[0], whole[i])


def plain_features(text):
    """The statistics of one text, word by word."""
    if not text:
        return [0.0] * qc.N_FEATURES
    kinds = [0] * 17
    for b in text:
        c = chr(b)
        kinds[
            0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() and b < 128 else 3 if c == " " else 4 if c == "\n" else 5 if c in "\t\v\f\r" else 6 if c == "|"
            else 7 if c in "#*$%&" else 8 if c in "<>" else 9 if c == "!" else 10 if c == "." else 11 if c == "," else 13 if b < 32 or b == 127 else 14 if b >= 0xC0
            else 15 if 0x80 <= b < 0x9F else 16 if b >= 0x9F else 12
        ] += 1
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]
    out = [k / len(text) for k in kinds]
    if not words:
        return out + [0.0] * 14
    n, low = len(words), [w.lower() for w in words]
    times, lengths = Counter(low), [len(w) for w in words]
    mean = sum(lengths) / n
    is_upper = lambda b: 65 <= b <= 90
    capitals = [all(is_upper(b) for b in w if is_upper(b) or 97 <= b <= 122) and sum(map(is_upper, w)) > 1 for w in words]
    return out + [
        math.log1p(n), mean / 10, math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0)) / 10, sum(a == b for a, b in zip(low, low[1:])) / n, len(times) / n, max(times.values()) / n,
        sum(t * math.log(t) for t in times.values()) / n, sum(capitals) / n, sum(is_upper(w[0]) for w in words) / n, sum(any(b in b"|#*$%&<>" for b in w) for w in words) / n,
        sum(w.endswith(b"!") for w in words) / n, sum(w.endswith(b".") for w in words) / n, math.log1p(n / (kinds[4] + 1)), sum(t > 1 for t in times.values()) / len(times),
    ]


def test_features_equal_a_plain_count_over_any_blocks(monkeypatch):
    from tessera.llm import textscan

    rng = random.Random(4)
    pool = ["the", "The", "THE", "A!", "b.", "c,", "$5", "<b>", "é", "\n", "\t", "x1", "#|*", "\x01", "Aé", "ÀB", "AB-CD"]
    texts = ["", " ", "\n \n", "a", *(rng.choice([" ", "  ", "\n"]).join(rng.choices(pool, k=rng.randint(1, 80))) for _ in range(60))]
    raw = pa.array([t.encode() for t in texts], pa.binary())
    want = [plain_features(t.encode()) for t in texts]
    assert np.allclose(qc.features(raw), want)
    blocks = textscan.word_blocks
    for size in (5, 40):
        monkeypatch.setattr(qc, "word_blocks", lambda t, n=size: blocks(t, n))
        assert np.allclose(qc.features(raw), want)


def test_the_risk_is_the_non_negative_one():
    rng = np.random.default_rng(2)
    prior, n = 0.4, 25
    for shift in (0.0, 6.0):  # with every positive far on the good side and none unlabelled there, the negative part is below zero
        z = rng.normal(0, 1, 60) + np.where(np.arange(60) < n, shift, -shift)
        soft = lambda v: np.logaddexp(0, v)

        def parts(z):
            return prior * soft(-z[:n]).mean(), soft(z[n:]).mean() - prior * soft(z[:n]).mean()

        slope = qc.risk_slope(prior)(z, n)
        down = parts(z)[1]
        assert (down < 0) == (shift > 0)
        value = (lambda z: sum(parts(z))) if down >= 0 else (lambda z: -parts(z)[1])
        for i in range(60):
            e = np.zeros(60)
            e[i] = 1e-6
            assert abs((value(z + e) - value(z - e)) / 2e-6 - slope[i]) < 1e-6


def test_prior_and_risk_on_known_mixtures():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7):
        good = lambda n: rng.normal(1.5, 1, (n, 4))
        bad = lambda n: rng.normal(-1.5, 1, (n, 4))
        unlabelled = np.concatenate((good(int(3000 * share)), bad(int(3000 * (1 - share)))))
        model = qc.fit(good(2000), unlabelled, rounds=900)
        assert abs(model.prior - share) < 0.08
        assert (model.score(good(1000)) >= 0.5).mean() > 0.97 and (model.score(bad(1000)) < 0.5).mean() > 0.97


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = qc.learn(docs, labels)
    scored = {r.doc_id: r.score for r in qc.score(docs, model).collect()}
    held = [(scored[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(scored) == docs.count() and all(0 <= s <= 1 for s in scored.values())
    assert sum((s >= 0.3) == bool(q) for s, q in held) / len(held) > 0.97
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.99


def test_classifier_over_odd_rows(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (None, "x y", 9.0), (2, "z " * 100000, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, quality int")
    assert qc.learn(docs, labels) is None
    assert [r.score for r in qc.score(docs, None).collect()] == [0.5] * 4
    assert qc.score(docs.limit(0), None).count() == 0
    named = qc.score(docs, None, keep=docs.columns, name="__q")
    assert named.columns == ["doc_id", "text", "score", "__q"]
    odd = spark.createDataFrame([(1, "x", 2, 3), (1, None, 2, 3)], "doc_id long, text string, `a.b` int, __quality int")
    model = qc.fit(qc.features(pa.array([b"good text here."] * 9)), qc.features(pa.array([b"x", b"bad", b"good text here."] * 9)), rounds=20)
    assert sorted(map(tuple, qc.above(odd, model, 0.0).collect()), key=str) == [(1, "x", 2, 3), (1, None, 2, 3)] and qc.above(odd, model, 1.1).columns == odd.columns
    assert qc.score(odd, model, keep=["a.b"]).columns == ["a.b", "score"]


def test_prior_counts_every_text_and_repeated_ids_count_once(spark, monkeypatch):
    good, bad = "A calm sentence of plain words follows here. ", "BUY ||| NOW !!! ### "
    rows = [(i, (good if i % 4 == 0 else bad) * (1 + i % 7)) for i in range(400)] + [(None, bad), (3, None), (0, good), *[(8, good * 2)] * 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int")
    seen, inner, sampled = [], qc._class_prior, qc.fit
    monkeypatch.setattr(qc, "_class_prior", lambda texts, found: seen.append((texts.collect(), found, inner(texts, found))) or seen[0][2])
    monkeypatch.setattr(qc, "fit", lambda p, u, prior: seen.append((len(p), len(u))) or sampled(p, u, prior, rounds=30))
    model = qc.learn(docs, labels)
    (texts, found, prior), (positives, plain) = seen
    want = [h.prior(h.above(qc.features(pa.array([r._text.encode() for r in texts if r._half == i], pa.binary())))) for i, h in enumerate(found)]
    assert len(texts) == len(rows) and model.prior == prior and abs(prior - sum(want) / 2) < 1e-12
    trusted = {i for i in range(0, 200, 4) if zlib.crc32(str(i).encode()) % 5}
    assert positives == len(trusted) and plain == 400


def brute_rules(rows, limit):
    lines = Counter()
    for key in {(i, h, t or "") for i, h, t in rows}:
        lines.update({(key[1], norm) for norm in (" ".join(re.split(r"[\x20\x09-\x0D]+", x)).strip(" ").lower() for x in key[2].split("\n")) if norm})
    out = []
    for i, h, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        n = Counter(grams)
        covered = {j + d for j, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        gone = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in full if lines[h, " ".join(re.split(r"[\x20\x09-\x0D]+", x)).strip(" ").lower()] >= limit)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered), failed, gone, not failed and len(words) - gone >= 0.3 * len(words)))
    return sorted(out, key=str)


def test_rules_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bé", "C", "d#", "e|*", "😀", "the", "of"]) + (str(rng.randrange(300)) if rng.random() < 0.7 else "")
    line = lambda: rng.choice([" ", "\t", "  "]).join(word() for _ in range(rng.randint(0, 14)))
    shared = ["Shared  LINE of many words here", "other shared line"]
    rows = []
    for i in range(60):
        body = [line() for _ in range(rng.randint(0, 14))]
        if i % 2:
            body.insert(0, rng.choice(shared))
        if i % 9 == 0:
            body += body[:3]
        rows.append((i, rng.choice(["h1", "h2", None]), "\n".join(body)))
    rows += [(70, "h1", "x y z " * 40), (71, "h1", None), (72, None, ""), (None, "h2", "shared line of many words here\n" + line()), rows[5], rows[5], (73, "h1", "\n".join([shared[0]] * 30 + [line()]))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, _key string")
    for limit in (3, 10):
        assert sorted((tuple(r) for r in quality_rules(df, max_docs=limit).collect()), key=str) == brute_rules(rows, limit)
    assert quality_rules(df.limit(0)).count() == 0


def test_common_lines_are_taken_out_of_texts(spark):
    rows = [(i, "h", f"own {i}\n  Shared\tline \n\nend {i}") for i in range(3)] + [(3, "g", "shared line"), (4, "h", None), (5, "h", "shared line")]
    found = quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_docs=4, texts=True)
    left = {r.doc_id: (r.kept_text, r.removed_words) for r in found.collect()}
    assert left == {**{i: (f"own {i}\n\nend {i}", 2) for i in range(3)}, 3: ("shared line", 0), 4: ("", 0), 5: ("", 2)}

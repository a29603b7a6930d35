import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import files, packing, token_counts, tokens
from tessera.llm.common import shared_dir

WORDS = tokens.public("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")


def sample():
    rng = random.Random(1)
    pieces = ["the", " Of", " naïve", "'s", "'tis", " don't", "\n", "  ", "\t", " 12,345", "!!", "#*$", "日本語", "😀", " <|endoftext|>", " ", "ſ", "\r\n", " ẞtraße", ". "]
    texts = ["", " ", "\n\n", "a", "end <|endoftext|> more", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", " <|endoftext| >", "<|endoftext|>\n\n"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    return texts


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_file(monkeypatch):
    ids, encode = reference(), tokens.encoder(*WORDS).encode
    for text in sample():
        assert encode(text).tolist() == ids(text)
    whole = " ".join(sample())
    want = encode(whole).tolist()
    monkeypatch.setattr(tokens, "_CHUNK", 50)
    assert encode(whole).tolist() == want == ids(whole)


def check_pieces(rows, texts, length=2048):
    encode = tokens.encoder(*WORDS).encode
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for doc, parts in by_doc.items():
        ids, at = np.append(encode(texts[doc]), np.uint32(1)).astype("<u4"), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for parts in by_window.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        total += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return by_doc, padding / max(total, 1)


def test_packing_is_an_exact_cover_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, WORDS).collect()
    by_doc, share = check_pieces(rows, texts)
    assert by_doc.keys() == texts.keys() and share < 0.02


def test_packing_odd_rows(spark):
    long = "word " * 30000
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (4, "no end of sentence " * 700, "d"), (5, "one<|endoftext|>two " * 40, "e"), (6, "Very long. It has sentences. " * 150_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").coalesce(1)
    by_doc, share = check_pieces(packing.pack(df, WORDS).collect(), {i: t or "" for i, t, _ in rows})
    assert set(by_doc) == {1, 2, 3, 4, 5, 6} and len(by_doc[1]) == 1 and by_doc[1][0].doc_tokens == 1 and share < 0.01
    twice = spark.createDataFrame([(None, "x"), (None, "x"), (7, "y"), (7, "y")], "doc_id long, text string").coalesce(1)
    got = packing.pack(twice, WORDS).agg(F.sum("length")).first()[0]
    assert got == 8 and packing.pack(df.limit(0), WORDS).count() == 0


def brute_cost(at, cost, length):
    """Least cost over all ways to cut, by trying every window."""
    best = {0: 0}
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= length and i in best:
                options.append(best[i] + (0 if n & (n - 1) == 0 else length - n) + cost[j] + packing.PER_WINDOW)
        if options:
            best[j] = min(options)
    return best[len(at) - 1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    length = rng.choice([16, 32])
    at = np.cumsum([0] + [rng.randint(1, 6) for _ in range(40)])
    cost = np.array([0] + [rng.choice([0, 4]) for _ in range(40)])
    ends = packing.cuts(at, cost, length, last=True)
    assert ends == sorted(set(ends)) and ends[-1] == at[-1] and all(b - a <= length for a, b in zip([0, *ends], ends))
    paid = 0
    for a, b in zip([0, *ends], ends):
        n = b - a
        paid += packing.PER_WINDOW + (0 if n & (n - 1) == 0 else length - n)
        paid += int(cost[at.tolist().index(b)]) if b in at else packing.HARD_CUT
    assert paid <= brute_cost(at.tolist(), cost.tolist(), length)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_over_any_block_size(spark, block):
    import uuid

    rng = np.random.default_rng(block)
    folder, want = shared_dir(spark, f"flat-{uuid.uuid4().hex}"), {}
    for name, closed in (("a", True), ("b", False), ("empty", True), ("only", True)):
        lengths = [] if name == "empty" else [0, 0, 3] if name == "only" else rng.integers(0, 9, 25).tolist()
        ids = [x for n in lengths for x in [*rng.integers(0, 99, n).tolist(), 99]]
        if not closed:
            ids, lengths = [*ids, 1, 2, 3], [*lengths, 3]
        with files.create(folder, name) as sink:
            sink.write(np.array(ids, "<u2").tobytes())
        want |= {(name, i): n for i, n in enumerate(lengths)}
    names = spark.createDataFrame([(n,) for n in ("a", "b", "empty", "only")], "file string")
    tasks = []
    kept = token_counts.stored
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_counts, "stored", lambda df, label: (tasks.append((label, df.rdd.getNumPartitions())), kept(df, label))[1])
        got = {(r.file, r.ordinal): r.n_tokens for r in token_counts.scan_flat(names, folder, 99, block).collect()}
    assert got == want and (block == 1 << 20 or dict(tasks)["separators"] >= 4)


def test_token_counts(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "x"), (1, "one two three"), (4, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    encode = tokens.encoder(*WORDS).encode
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, WORDS, block=1000).collect()), key=str)
    assert got == sorted(((i, len(encode(t or ""))) for i, t in rows), key=str)
    assert token_counts.token_counts(df.limit(0), WORDS).count() == 0

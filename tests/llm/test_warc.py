import gzip
import hashlib
import random
import subprocess
import sys

import pytest

from tessera.llm import files, warc


def test_loser_tree_merges_like_sorting():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(9), i, j) for j in range(rng.randint(0, 12))) for i in range(k)]
        merged = list(warc.LoserTree(runs, lambda x: x[0]))
        assert [x[0] for x in merged] == sorted(x[0] for r in runs for x in r) and sorted(merged) == sorted(x for r in runs for x in r)
        assert merged == sorted(merged, key=lambda x: x[0:2])


@pytest.mark.parametrize("url,key", [("http://www.Example.com/A?b=1", "com,example)/a?b=1"), ("https://m.x.org:8080", "org,x,m:8080)/"), (None, ")/"), ("http://[bad", "http://[bad")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_records_are_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "é" * 600), (2, "http://a.b/x", "é" * 600), (3, "http://a.b/\nø", "short")], "page_id long, url string, html string").coalesce(1)
    folder, archives = warc.write_archives(pages)
    name = archives.first()[0]
    with files.reader(folder, name) as source:
        raw = source.read_at(files.size(folder, name), 0)
        assert [c for _, _, c in warc.members(source, len(raw))] == [c for c in _split(gzip.decompress(raw))]
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: revisit") == 1 and "WARC-Target-URI: http://a.b/%0A%C3%B8\r\n" in text


def _split(content):
    out = [b"WARC/1.1\r\n" + p for p in content.split(b"WARC/1.1\r\n")[1:]]
    return out


def test_history_equals_brute_force(spark):
    rng = random.Random(2)
    html = ["x" * 999, "x" * 1000, "é" * 500, "é" * 499, "long " * 300, "", None, "<html>"]
    rows = [(i, rng.choice([None, "http://www.a.com/1", "http://a.com/1", "https://b.org/x?y=1"]), rng.choice(html)) for i in range(120)]
    rows += [rows[3], rows[3], (None, "http://a.com/1", "x" * 1000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        revisit = i is not None and h in best and i < best[h]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    got = warc.capture_history(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key, r.capture_time, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert warc.capture_history(df.limit(0)).count() == 0


def test_a_task_for_each_archive_and_merges_of_any_width(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice('ab')}.com/{rng.randrange(40)}", "x" * rng.randrange(30)) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    folder, archives = warc.write_archives(df)
    entries = warc.read_runs(archives, folder)
    assert archives.count() == 7 == entries.rdd.getNumPartitions() and all(n > 0 for n in entries.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
    blocks = warc.write_runs(entries, folder)
    want = sorted((tuple(r) for r in entries.collect()), key=warc._order)
    for fan_in, sample in ((64, 100_000), (2, 3)):
        monkeypatch.setattr(warc, "RANGE_ROWS", 100)
        monkeypatch.setattr(warc, "SAMPLE_BLOCKS", sample)
        assert [tuple(r) for r in warc.merge_index(blocks, folder, fan_in).collect()] == want
    low, high = warc._order(want[300]), warc._order(want[600])
    files_ = [r.file for r in blocks.select("file").distinct().collect()]
    assert [e for _, e in sorted((x for f in files_ for x in warc._from(folder, f, low, high)), key=lambda x: x[0])] == want[300:600]


def test_revisits_name_the_record_they_refer_to(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", "é" * 600), (2, "http://a.b/y", "é" * 600)], "page_id long, url string, html string").coalesce(1)
    folder, archives = warc.write_archives(pages)
    name = archives.first()[0]
    with files.reader(folder, name) as source:
        heads = [warc.parse(c)[0] for _, _, c in warc.members(source, files.size(folder, name))]
    by_type = {h["warc-type"]: h for h in heads}
    assert by_type["revisit"]["warc-refers-to"] == by_type["response"]["warc-record-id"] and by_type["revisit"]["warc-refers-to-target-uri"] == "http://a.b/y"


def test_a_damaged_archive_is_noticed(spark, tmp_path):
    import zlib

    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    record = warc.record(1, "http://a", "0" * 40, b"body", None)
    (tmp_path / "bad.warc.gz").write_bytes(squeeze.compress(record) + squeeze.flush())
    with pytest.raises(Exception, match="does not hold what it states"):
        warc.read_runs(spark.createDataFrame([("bad.warc.gz",)], "archive string"), f"file://{tmp_path}").collect()


def test_nothing_else_imports_this_folder():
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert not any(q.startswith('op') for q in n) and 'pipeline' not in n and len(n) > 30"
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})

import csv
import io
import json
import sqlite3
import zipfile

import pytest

from tessera import cli
from tessera.api import process
from tessera.config import load_settings
from tessera.operators import report
from tessera.plans.preset import PresetError, Selector, preset_from
from tessera.sources import catalog, readers, sinks, templates
from tessera.sources.html import attribute_table
from tessera.sources.sqlgate import UnsafeSql, check_sql, quoted

LINKS = {"entity_position": "at", "entity_time": "observed_at", "spatial_temporal": "instant"}


def preset(selector, **body):
    base = {"common": {"entity": "const(dev)"}, "expected_columns": ["lat", "lon", "ts", "gone"],
            "assertions": [{"position": {"latitude_wgs84": "column(lat)", "longitude_wgs84": "column(lon)"}, "time": {"instant": "column(ts)", "epoch": "unix_s"}, "links": LINKS}]}
    return preset_from({"preset": {"id": body.pop("id", "t.t"), "name": body.pop("name", "T")}, "input_selector": selector} | base | body)


def database(path):
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode=wal")
    db.execute("CREATE TABLE LOC (id INTEGER, lat REAL, lon REAL, ts REAL)")
    db.execute("INSERT INTO LOC VALUES (1, 1.5, 2.5, 10), (1, 1.5, 2.5, 10)")
    db.commit()
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.execute("INSERT INTO LOC VALUES (2, 3.5, NULL, 20)")
    db.commit()
    copy = {s: open(f"{path}{s}", "rb").read() for s in ("", "-wal", "-shm")}
    db.close()
    for s, raw in copy.items():
        open(f"{path}{s}", "wb").write(raw)
    return copy


def workbook(path, rows, sheet="Data"):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda r, row: "".join(f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{r}"><v>{v}</v></c>' for i, v in enumerate(row) if v is not None)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Empty" r:id="r1"/><sheet name="{sheet}" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/b.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")


REPORT = """<?xml version="1.0"?><project xmlns="http://pa.cellebrite.com/report/2.0"><decodedData>
<modelType type="Location"><model type="Location" id="m1" deleted_state="Intact"><field name="Source"><value><![CDATA[gps]]></value></field><field name="TimeStamp"><value format="utc">2025</value></field><field name="Name"><empty/></field>
<modelField name="Position"><model type="Coordinate" id="c1"><field name="Latitude"><value>38.34</value></field></model></modelField></model></modelType>
<modelType type="Call"><model type="Call" id="m2"><field name="Direction"><value>In\x01</value></field><multiModelField name="Parties"><model type="Party" id="p1"><field name="Role"><value>From</value></field></model></multiModelField></model></modelType>
</decodedData><extraInfos><extraInfo id="m1"><sourceInfo><nodeInfo name="db" path="/a/db" tableName="t" offset="1" size="9"/></sourceInfo></extraInfo><extraInfo id="m1"><sourceInfo><nodeInfo name="late" path="/b"/></sourceInfo></extraInfo></extraInfos></project>"""


def entry(path):
    return catalog.discover(path, 0).entries[0]


def test_csv_keeps_text_and_positions(spark, tmp_path):
    (tmp_path / "x.csv").write_text('junk\na,b,a\n007,"multi\nline",NA\n\n,1001,é\n', encoding="utf-8-sig")
    s = Selector("csv", name="x.csv", read={"skip_rows": 1})
    got = readers.read_table(spark, entry(tmp_path / "x.csv"), s).orderBy("_line").collect()
    assert [tuple(r) for r in got] == [(1, "007", "multi\nline", "NA", None), (2, None, "1001", "é", None)]
    assert got[0].asDict().keys() == {"_line", "a", "b", "a.1", "_recovery"}


def test_sqlite_with_sidecar(spark, tmp_path):
    database(tmp_path / "d.sqlite")
    e = entry(tmp_path)
    assert catalog.detect(e) == "sqlite" and [x.name for x in catalog.discover(tmp_path)] == ["d.sqlite"] and readers.sqlite_tables(e) == ["LOC"]
    got = readers.read_table(spark, e, Selector("sqlite", name="d.sqlite", table="LOC")).orderBy("_line").collect()
    assert [tuple(r) for r in got] == [(1, "1", "1.5", "2.5", "10.0", "live"), (2, "2", "3.5", None, "20.0", "wal")]
    by_sql = readers.read_table(spark, e, Selector("sqlite", name="d.sqlite", sql="SELECT lat, ts FROM LOC WHERE id = 1"))
    assert by_sql.columns == ["_line", "LOC.lat", "LOC.ts", "_recovery"] and by_sql.count() == 1
    assert readers.peek_columns(e, Selector("sqlite", name="d.sqlite", table="NONE")) is None and readers.peek_columns(e, Selector("sqlite", sql="SELECT 1")) is None


def test_sql_gate():
    for good in ("SELECT a FROM t", "select * from t where x = 'DROP; --'", "WITH q AS (SELECT 1) SELECT * FROM q"):
        assert check_sql(good) == good
    for bad in ("", "SELECT 1; SELECT 2", "DELETE FROM t", "SELECT a AS b FROM t", "PRAGMA x", "SELECT 1 FROM t -- x\n; ATTACH 'a'", "INSERT INTO t SELECT 1", "SELECT load FROM t UNION SELECT 1 FROM (DROP)"):
        with pytest.raises(UnsafeSql):
            check_sql(bad)
    assert quoted("a b") == '"a b"'
    for bad in ('a"b', "", "a\0"):
        with pytest.raises(UnsafeSql):
            quoted(bad)


def test_excel(spark, tmp_path):
    workbook(tmp_path / "w.xlsx", [["lat", "lon", None, "ts"], ["1.5", 2.5, None, 10], [None, None, None, None], ["x", None, None, 3]])
    e = entry(tmp_path)
    assert catalog.detect(e) == "excel" and list(readers.sheet_names(e)) == ["Empty", "Data"]
    got = readers.read_table(spark, e, Selector("excel", name="w.xlsx", sheet="Data")).orderBy("_line").collect()
    assert [tuple(r)[1:5] for r in got] == [("1.5", "2.5", None, "10"), ("x", None, None, "3")]


def test_long_sheets_are_never_held(tmp_path):
    import tracemalloc

    from tessera.file_queries import _workbook

    peaks = []
    for n in (2_000, 40_000):
        tracemalloc.start()
        _workbook(tmp_path / f"{n}.xlsx", ["a", "b", "c"], ((i, None if i % 2 else f"<{i}>", i / 2) for i in range(n)), sheet="Long")
        rows = readers.table_of(entry(tmp_path / f"{n}.xlsx"), Selector("excel", name=f"{n}.xlsx", sheet="Long"))[1]()
        assert all(row[1:] == [None if i % 2 else f"<{i}>", str(i / 2)] for i, row in enumerate(rows))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 1_000_000


@pytest.mark.parametrize("name", ["excel_scan", "excel_sheets"])
def test_workbooks_are_written_without_collecting(spark, sf, name, monkeypatch):
    import tessera.file_queries  # noqa: F401  adds its queries
    from tessera.queries import QUERIES

    want = spark.read.parquet(f"{sf}/part.parquet").count()
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: pytest.fail("a table was collected"))
    made = QUERIES[name](spark, sf)
    monkeypatch.undo()
    assert made.count() == {"excel_scan": want, "excel_sheets": 2}[name]


def test_xml_inline(spark, tmp_path):
    (tmp_path / "report.xml").write_text(REPORT)
    e = entry(tmp_path)
    assert catalog.detect(e) == "xml" and readers.namespace_of(e).endswith("2.0")
    row = readers.read_table(spark, e, Selector("xml", name="report.xml", model="Location")).first()
    assert (row["uuid"], row["Source"], row["Position.Latitude"], row["TimeStamp.format"], row["Name"], row["deleted_state"]) == ("m1", "gps", "38.34", "utc", None, "Intact")


def test_report_dump(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.ufdr", "w") as z:
        z.writestr("report.xml", REPORT)
    out = report.dump(spark, tmp_path / "r.ufdr", tmp_path / "out")
    assert out == {"0_Call.csv": 1, "0_Location.csv": 1, "1_Coordinate.csv": 1, "1_Party.csv": 1}
    rows = list(csv.DictReader(io.StringIO((tmp_path / "out" / "0_Location.csv").read_text("utf-8-sig"))))
    assert rows[0]["uuid"] == "m1" and rows[0]["source_path"] == "/a/db" and rows[0]["TimeStamp"] == "2025"
    rows = list(csv.DictReader(io.StringIO((tmp_path / "out" / "1_Party.csv").read_text("utf-8-sig"))))
    assert rows[0]["main-uuid"] == "m2" and rows[0]["Role"] == "From"
    e = report.open_report(tmp_path / "r.ufdr")
    only = report.read_report(spark, e, ["Call"])
    assert {r.model_type for r in only.collect()} == {"Call", "Party"}
    changes, base = report.check_drift(report.shape(report.read_report(spark, e)), None, "1")
    assert changes is None and report.check_drift(report.shape(only), base, "2")[0].count() == 0


def test_block_index_passes_over_marks_in_text(tmp_path):
    ns = "http://pa.cellebrite.com/report/2.0"
    model = lambda i, text: f'<model type="A" id="{i}"><field name="T"><value><![CDATA[{text}]]></value></field></model>'
    pad = "x" * (1 << 20)  # marks on both sides of the pieces that are read
    text = f"""<?xml version="1.0"?><project xmlns="{ns}"><decodedData><!-- <modelType type="C"> --><modelType type="A">{model(1, '</modelType><modelType type="B">')}{model(2, pad)}</modelType>
<modelType type="Empty"/><modelType type='B'><model type="B" id="3"/></modelType></decodedData><extraInfos><extraInfo id="2"><sourceInfo><nodeInfo path="/p" name="n"/></sourceInfo></extraInfo></extraInfos></project>"""
    (tmp_path / "report.xml").write_text(text)
    e = entry(tmp_path)
    head, blocks, sources = readers.block_index(e)
    assert head.startswith(b"<project") and [k for k, _, _ in blocks] == ["A", "B"] and text[sources:].startswith("<extraInfos")
    assert all(text[a:b].startswith("<modelType") and text[a:b].endswith("</modelType>") for _, a, b in blocks)
    assert [m.get("id") for _, a, b in blocks for m in readers.block_models(e, head, a, b)] == ["1", "2", "3"]
    assert [m.get("id") for m in readers.report_models(e, "B")] == ["3"] and list(readers.source_entries(e)) == [("2", "/p", "n", None, None, None)]


def test_staging(tmp_path):
    assert [readers.copied(s, "primary") for s in readers.STAGING] == [True, False, True] and not readers.copied("tier", "secondary")
    with pytest.raises(ValueError):
        readers.copied("sometimes", None)
    database(tmp_path / "d.sqlite")
    e, s = entry(tmp_path), Selector("sqlite", name="d.sqlite", table="LOC")
    assert [list(readers.table_of(e, s, False, copy)[1]()) for copy in (True, False)] == [[["1", "1.5", "2.5", "10.0"]] * 2] * 2
    assert load_settings(None, staging="tier").staging == "tier"


def test_folder_and_archive_are_alike(spark, tmp_path):
    tree = tmp_path / "tree" / "fs" / "private"
    tree.mkdir(parents=True)
    parts = database(tree / "d.sqlite")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for suffix, raw in parts.items():
            z.writestr(f"fs/private/d.sqlite{suffix}", raw)
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(tmp_path / "a.zip", "a.zip")
        z.writestr("broken.zip", b"PK\x03\x04nothing")
    p = preset({"format": "sqlite", "path": "/private/d.sqlite", "table": "LOC"})
    results = [process(spark, tmp_path / n, [p]) for n in ("tree", "a.zip")]
    key = lambda r: sorted((x.row_uid, x.source_record_uid, x.latitude_wgs84, x.input_record_id) for x in r.rows.collect())
    assert key(results[0]) == key(results[1]) and len(key(results[0])) == 2
    nested = catalog.discover(tmp_path / "outer.zip", 2)
    assert [e.logical_path for e in nested] == ["a.zip/fs/private/d.sqlite", "broken.zip"] and len(nested.warnings) == 1
    assert catalog.fingerprint(nested.entries[0]) == catalog.fingerprint(catalog.discover(tmp_path / "tree").entries[0])


def test_bomb(tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "BOMB_BYTES", 1000)
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"\0" * 10**6)
    with pytest.raises(catalog.ZipBomb):
        catalog.read_bytes(catalog.discover(tmp_path / "b.zip").entries[0])


def test_a_run_writes_tables_and_sidecars(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "a" / "x.csv").write_text("lat,lon,ts,extra\n1,2,10,q\n3,4,10.4,r\n")
    (src / "y.csv").write_text("lat,lon,ts,other\n5,6,99,s\n")
    (src / "z.bin").write_bytes(b"?")
    presets = [preset({"format": "csv", "name": "x.csv"}, id="t.x", name="X/1"), preset({"format": "csv", "name": "y.csv"}, id="t.y", name="X 1")]
    r = process(spark, src, presets, tmp_path / "out")
    assert r.counts == {"sources": 3, "matched": 2, "rows": 3, "ranked": 2} and r.unmatched == ["z.bin"]
    rows = list(csv.DictReader((tmp_path / "out" / "assertions.csv").open()))
    assert [x["orig_extra"] for x in rows] == ["q", "r", ""] and rows[2]["orig_other"] == "s" and [x["record_rank"] for x in rows] == ["1", "2", ""]
    trace = json.loads((tmp_path / "out" / "assertions.traceability.json").read_text())
    assert trace["sources"][0]["columns"] == {"known": ["lat", "lon", "ts"], "new": ["extra"], "drift_missing": ["gone"], "mapped_absent": []}
    assert all(s["integrity"]["unchanged"] for s in trace["sources"]) and trace["prov"]["wasGeneratedBy"]
    r = process(spark, src, presets, tmp_path / "split", split=True, source_columns=False)
    assert {p.name for p in r.outputs} >= {"X_1.csv", "X_1_2.csv"} and "orig_lat" not in (tmp_path / "split" / "X_1.csv").read_text()


def test_forced_mode(spark, tmp_path):
    workbook(tmp_path / "other.xlsx", [["lat", "lon", "ts"], ["1", "2", "3"]], sheet="Elsewhere")
    p = preset({"format": "excel", "name": "w.xlsx", "sheet": "Data"})
    assert process(spark, tmp_path / "other.xlsx", [p]).rows.count() == 1
    with pytest.raises(PresetError):
        process(spark, tmp_path / "other.xlsx", [preset({"format": "csv", "name": "w.csv"})])
    with pytest.raises(ValueError, match="entity"):
        (tmp_path / "x.csv").write_text("lat,lon,ts\n1,2,3\n")
        process(spark, tmp_path / "x.csv", [preset({"format": "csv", "name": "x.csv"}, common={"entity": "param(entity)"})])


def test_settings_profiles_templates_and_cli(tmp_path, capsys):
    (tmp_path / "c.toml").write_text('[timezone]\nlocal_zone = "Europe/Paris"\n[discovery]\nroot_prefix_depth = 3\n')
    s = load_settings(tmp_path / "c.toml", split=True)
    assert (s.local_zone, s.root_prefix_depth, s.split) == ("Europe/Paris", 3, True)
    for bad in ("[x]\na=1\n", "[output]\na=1\n", '[timezone]\nlocal_zone = "No/Where"\n'):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            load_settings(tmp_path / "c.toml")
    sinks.save_profile(tmp_path / "p.json", [tmp_path / "a.yaml"])
    assert sinks.load_profile(tmp_path / "p.json") == [tmp_path / "a.yaml"]
    page = "<html><title> Web  Visits </title><table><tr><th>x</th></tr></table><table><tr><th>Attribute</th><th>Description</th></tr><tr><td>URL</td><td>The &amp; url</td></tr></table></html>"
    assert attribute_table(page) == ("Web Visits", [("URL", "The & url")]) and attribute_table(None) == ("", [])
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.htm").write_text(page)
    assert cli.main(["templates", str(tmp_path / "pages"), "-o", str(tmp_path / "drafts"), "--tool", "Tool"]) == 0
    assert (tmp_path / "drafts" / "web_visits.yaml").exists()
    assert cli.main(["lint", str(tmp_path / "drafts")]) == 0 and "unfilled-placeholder" in capsys.readouterr().out
    now = templates.read_templates(tmp_path / "pages")
    assert templates.difference(now, {"Web Visits": ["Other"]}) == {"missing": [], "modified": ["Web Visits"], "unchanged": []}


def test_titles_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from tessera.queries import ORACLES, QUERIES

    titles = ["a&amp", "t = &quot;b", "&amp;lt; &lt;b&gt; &amp;amp; &#65; &copy", " x \t\n y ", "a\xa0\u2003b&nbsp;", "&", "&;lt;", ""]
    pages = [f"<html><head><title>{t}</title></head><body><p>z&amp</p><svg><title>other</title></svg></body></html>" for t in titles]
    rows = [*enumerate([*pages, "<p>none</p>", "", None])]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["html_tables"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == sorted(con.execute(ORACLES["html_tables"]).fetchall()) and got[0][1] == "a&amp" and got[-1][1] is None
    assert attribute_table(pages[1])[0] == 't = "b' and attribute_table(pages[4])[0] == "a b"  # the reader itself decodes all


def test_archive_fingerprint(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"1")
        z.writestr("y", b"2")
    before = catalog.archive_fingerprint(tmp_path / "a.zip", ["x"])
    assert before == catalog.archive_fingerprint(tmp_path / "a.zip", ["x"]) and set(before) == {"table", "size", "entry:x"}


def test_streaming_ingest(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    p = preset({"format": "csv", "name": "x.csv"})
    rows = spark.createDataFrame([(1, "1", "2", "10"), (2, "1", "2", "10.2")], "_line long, lat string, lon string, ts string")
    for n in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), rows.schema, p, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * (n + 1)

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions.identity import RECORD_SPACE, ROW_SPACE
from tessera.operators import drift, frontier, lookup, merge, nested
from tessera.operators.assemble import Run, assemble, check_unique
from tessera.operators.untangle import untangle
from tessera.plans.preset import PresetError, preset_from
from tessera.plans.registry import register_python_transform, register_transform, unregister
from tessera.schema import IDENTITY_COLUMNS, OUTPUT_COLUMNS

LINKS = {"entity_position": "at", "entity_time": "observed_at", "spatial_temporal": "instant"}


def preset(**body):
    head = {"id": "t.t", "name": "T", "tier": "secondary"}
    return preset_from({"preset": head, "input_selector": {"format": "csv", "name": "x.csv"}, **body})


def test_columns():
    assert len(OUTPUT_COLUMNS) == len(set(OUTPUT_COLUMNS)) == 45 and len(IDENTITY_COLUMNS) == 34


def test_a_record_becomes_its_assertions(spark):
    rows = [(1, "38.4 - -0.45", "10", "1500", "2500", "07"), (2, None, "x", "9", None, None)]
    df = spark.createDataFrame(rows, "_line long, `C.x` string, Spd string, Entry string, Exit string, Item string")
    p = preset(
        patterns={"c": r"(?P<lat>[-\d.]+) - (?P<lon>[-\d.]+)"},
        common={"entity": "const(a)", "entity_type": {"from": "column(Item)", "pipe": "cast(int)"}},
        assertions=[
            {"position": {"latitude_wgs84": {"from": "column(C.x)", "extract": "c.lat"}, "longitude_wgs84": {"from": "column(C.x)", "extract": "c.lon"},
                          "horizontal_speed_kmh": {"from": "column(Spd)", "pipe": "cast(float)", "unit": "m/s"}},
             "time": {"interval": {"lower": "column(Entry)", "upper": "column(Exit)"}, "temporal_source": "const(gps)"}, "links": LINKS},
            {"time": {"instant": "column(Entry)", "epoch": "unix_ms"}, "links": LINKS | {"entity_time": "recorded_at"}},
        ],
    )
    out = assemble(df, p, Run(entity="run", logical_path="d/x.csv", fingerprint="f")).orderBy("_line", "_ordinal").collect()
    a, b, c, d = out
    assert (a.latitude_wgs84, a.longitude_wgs84, a.latitude_source_field, a.horizontal_speed_kmh) == (38.4, -0.45, "C.x", 36.0)
    assert (a.entity, a.entity_type, a.temporal_source, a.source_tier, a.raw_source_path, a.input_record_id) == ("run", "7", "gps", "secondary", "d/x.csv", "#1")
    assert (a.time_lower_unix_utc_us, a.time_upper_unix_utc_us, a.time_lower_source_field, a.time_upper_source_field) == (1500, 2500, "Entry", "Exit")
    assert (b.time_lower_unix_utc_us, b.entity_time_link, b.latitude_wgs84) == (1_500_000, "recorded_at", None)
    assert c.horizontal_speed_kmh is None and ("horizontal_speed_kmh", "cast", "x") in [tuple(w) for w in c["_warnings"]]
    assert (c.time_upper_unix_utc_us, c.time_upper_raw, a["orig_C.x"], a["orig_Item"]) == (None, None, "38.4 - -0.45", "07")
    assert a.source_record_uid == b.source_record_uid == str(uuid.uuid5(RECORD_SPACE, "f|d/x.csv|1"))
    assert b.row_uid == str(uuid.uuid5(ROW_SPACE, "f|d/x.csv|1|1|" + "|".join(f"{n}={b[n]!r}" for n in IDENTITY_COLUMNS)))
    assert len({r.row_uid for r in out}) == 4


def test_zones_and_unknown_offsets(spark):
    rows = [(1, "2025-12-06T13:00:00", "UTC+01:00[DST]"), (2, "2025-10-26T02:30:00", "local"), (3, "2025-12-06T13:00:00", "UTC+05:00"), (4, "2025-12-06T13:00:00+02:00", None), (5, "junk", None), (6, "2025-12-06T13:00:00", None)]
    df = spark.createDataFrame(rows, "_line long, t string, z string")
    p = preset(assertions=[{"time": {"instant": "column(t)", "format": "iso8601", "zone": "column(z)"}}])
    noon = 1765026000000000
    at = lambda zone: {r["_line"]: r for r in assemble(df, p, Run(local_zone=zone)).collect()}
    paris, bare = at("Europe/Paris"), at(None)
    assert [paris[i].time_lower_unix_utc_us for i in (1, 3, 4)] == [noon - 3_600_000_000, noon - 18_000_000_000, noon - 7_200_000_000]
    assert paris[1].utc_offset_hours == 1.0 and [tuple(w)[1] for w in paris[2]["_warnings"]] == ["clock overlap"]
    assert bare[1].time_lower_unix_utc_us == noon - 3_600_000_000 and [tuple(w)[1] for w in bare[1]["_warnings"]] == ["local zone not set"]
    assert (bare[6].utc_offset_hours, bare[6].utc_offset_state, bare[4].utc_offset_hours, bare[3].utc_offset_hours) == (None, "unknown", 2.0, 5.0)
    assert (bare[5].time_lower_unix_utc_us, bare[5].utc_offset_state, bare[5].time_lower_raw) == (None, None, "junk")


def test_globs_errors_and_ids(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", None)], "_line long, t1 string, t2 string")
    with pytest.raises(PresetError, match="ambiguous"):
        assemble(df, preset(assertions=[{"time": {"instant": "column(t*)"}}]))
    mapped = lambda c: preset(source_record_uid=f"column({c})", assertions=[{"time": {"instant": "column(none)"}}])
    assert [tuple(r) for r in check_unique(assemble(df, mapped("t1"))).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="no record id"):
        assemble(df, mapped("t2")).collect()
    with pytest.raises(Exception):
        assemble(df, preset(common={"altitude_m": "column(t1)"}, assertions=[{"time": {"instant": "column(none)"}}])).collect()


def test_registered_transforms(spark):
    register_transform("upper")(lambda v, args, options: F.upper(v))
    register_python_transform("backwards")(lambda v, args, options: v[::-1] if v != "bad" else 1 / 0)
    try:
        df = spark.createDataFrame([(1, "ab"), (2, "bad")], "_line long, t string")
        p = preset(common={"entity": {"from": "column(t)", "pipe": "backwards | upper"}}, assertions=[{"time": {"instant": "column(none)"}}])
        got = {r["_line"]: r for r in assemble(df, p).collect()}
        assert got[1].entity == "BA" and got[2].entity is None and got[2]["_warnings"][0]["step"] == "backwards"
    finally:
        unregister("upper")
        unregister("backwards")


def ranked(spark, rows, **options):
    df = spark.createDataFrame(rows, "_line long, t string, e string, acc string, note string")
    p = preset(common={"entity": "column(e)"}, assertions=[{"position": {"horizontal_accuracy_m": "column(acc)", "raw_position": "column(note)"}, "time": {"instant": "column(t)"}}])
    return {r["_line"]: (r.record_rank, r.record_type) for r in untangle(assemble(df, p), **options).collect()}


def test_untangle(spark):
    rows = [(1, "1000000", "a", "50", None), (2, "1400000", "a", "10", None), (3, "5000000", "a", "5", None)]
    assert ranked(spark, rows) == {1: (2, "additional"), 2: (1, "main"), 3: (None, None)}
    assert ranked(spark, rows, resolution_us=1000) == {i: (None, None) for i in (1, 2, 3)}
    ties = [(1, "-1", None, None, None), (2, "-5", None, None, " "), (3, "-9", None, None, "x"), (4, "-9", "b", "1", None), (5, None, None, None, None), (6, None, None, None, None)]
    assert ranked(spark, ties) == {1: (2, "additional"), 2: (3, "additional"), 3: (1, "main"), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_merge_views(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", "q")], "_line long, `a.b` string, c string")
    b = spark.createDataFrame([(1, "z", None), (2, "x", None)], "_line long, `a.b` string, c string")
    out = merge.merge_views(a, b, ["a.b", "c"], "journal").orderBy("position").collect()
    assert [(r["a.b"], r.c, r.recovery) for r in out] == [("x", None, "both"), ("y", "q", "db_only_unique"), ("z", None, "journal")]
    united = merge.union_all([a.select("_line"), b.select("c")])
    assert united.columns == ["_line", "c"] and united.count() == 5


def test_source_join(spark):
    records = spark.createDataFrame([("m1",), ("m2",), (None,)], "id string")
    entries = spark.createDataFrame([(2, "m1", "late"), (1, "m1", "first"), (3, None, "x")], "seq long, id string, path string")
    assert sorted(map(tuple, lookup.with_source(records, entries, "id", "id", ["seq"], ["path"]).collect()), key=str) == [("m1", "first"), ("m2", None), (None, None)]


def test_reports(spark):
    assert frontier.frontier(["a", "b1", "new"], ["a", "b*", "gone"], ["a", "zz"]) == {"known": ["a", "b1"], "new": ["new"], "drift_missing": ["gone"], "mapped_absent": ["zz"]}
    shape = lambda rows: spark.createDataFrame(rows, drift.SHAPE)
    before, now = shape([("type", "l", "A"), ("type", "l", "B"), ("field", "A", "x"), ("field", "B", "y")]), shape([("type", "l", "A"), ("field", "A", "z")])
    assert sorted(map(tuple, drift.drift(now, before).collect())) == [("field", "new", "A", "z"), ("field", "removed", "A", "x")]
    base = drift.upsert_baseline(spark.createDataFrame([], "kind string, owner string, name string, detected string, last_seen string"), before, "1")
    again = {tuple(r)[:3]: tuple(r)[3:] for r in drift.upsert_baseline(base, now, "2").collect()}
    assert again["type", "l", "A"] == ("1", "2") and again["field", "A", "x"] == ("1", "1") and again["field", "A", "z"] == ("2", "2")


def test_nested(spark):
    schema = "id string, model_type string, fields map<string,string>, children array<struct<id:string,model_type:string,fields:map<string,string>,children:array<struct<id:string,model_type:string,fields:map<string,string>>>>>"
    rows = [("a", "Call", {"b": "1", "a": "2"}, [("p", "Party", {"n": "x"}, [("q", "Name", {})])])]
    flat = nested.flatten(spark.createDataFrame(rows, schema))
    assert sorted((r.level, r.model_type, r.top_type, r.id, r.parent_id) for r in flat.collect()) == [(0, "Call", "Call", "a", None), (1, "Party", "Call", "p", "a"), (2, "Name", "Call", "q", "p")]
    assert [tuple(r) for r in drift.relations(flat).orderBy("owner").collect()] == [("relation", "Call", "Party"), ("relation", "Party", "Name")]
    seen = spark.createDataFrame([(2, "T", {"x": "1", "y": "2"}), (1, "T", {"z": "3"})], "seq long, kind string, fields map<string,string>")
    assert nested.field_order(seen, ["kind"], "fields", "seq").first().names == ["z", "x", "y"]
    assert [tuple(r) for r in nested.pivot(seen, ["seq"], "fields", ["z", "x"]).orderBy("seq").collect()] == [(1, "3", None), (2, None, "1")]

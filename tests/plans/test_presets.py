import pytest

from tessera.plans.grammar import Ref, Step, parse_pipe, parse_ref, scalar
from tessera.plans.lint import exit_code, lint, lint_paths
from tessera.plans.match import located, match_file, missing_columns, path_pattern, structural_score
from tessera.plans.preset import PresetError, load_presets, preset_from


def body(**changes):
    raw = {
        "preset": {"id": "a.b", "name": "N", "tier": "primary", "os_version": ">=1"},
        "input_selector": {"format": "csv", "name": "x.csv"},
        "expected_columns": ["lat", "lon", "ts"],
        "common": {"entity": "param(entity)", "raw_source_path": "preset(path)"},
        "assertions": [{"position": {"latitude_wgs84": "column(lat)", "longitude_wgs84": "column(lon)"}, "time": {"instant": "column(ts)", "epoch": "unix_s"},
                        "links": {"entity_position": "at", "entity_time": "observed_at", "spatial_temporal": "instant"}}],
    }
    raw.update(changes)
    return raw


def test_references_and_pipes():
    assert parse_ref("column(A B)") == Ref("column", "A B") and parse_ref('column("A (m)")') == Ref("column", "A (m)")
    assert [parse_ref(f"const({x})").arg for x in ("7", "1.5", "true", "null", "'7'", "word")] == [7, 1.5, True, None, "7", "word"]
    assert parse_ref("column(t*)").is_glob and not parse_ref("column(t)").is_glob
    for wrong in ("column", "column()", "other(x)", "param(x)", "preset(x)", "filename(x)", 3):
        with pytest.raises(ValueError):
            parse_ref(wrong)
    assert parse_pipe("cast(float) | split('|', index=-1)|lookup(t, on_unknown=null)") == (
        Step("cast", ("float",)), Step("split", ("|",), {"index": -1}), Step("lookup", ("t",), {"on_unknown": None}),
    )
    assert parse_pipe("arithmetic(value == 1)") == parse_pipe("arithmetic('value == 1')") == (Step("arithmetic", ("value == 1",)),)
    assert scalar("1e3") == 1000.0
    with pytest.raises(ValueError):
        parse_pipe("split('a")


WRONG = {
    "no header": {"preset": None}, "no id": {"preset": {"name": "x"}}, "tier": {"preset": {"id": "a.b", "name": "x", "tier": "first"}},
    "no selector": {"input_selector": None}, "empty selectors": {"input_selector": []}, "format": {"input_selector": {"format": "pdf", "name": "x"}},
    "path and name": {"input_selector": {"format": "csv", "name": "x", "path": "/x"}}, "neither": {"input_selector": {"format": "csv"}},
    "table and sql": {"input_selector": {"format": "sqlite", "name": "x", "table": "t", "sql": "SELECT 1"}}, "no sheet": {"input_selector": {"format": "excel", "name": "x"}},
    "no model": {"input_selector": {"format": "xml", "name": "x"}}, "two stars": {"input_selector": {"format": "csv", "path": "/a/**/b"}},
    "no assertions": {"assertions": []}, "no time": {"assertions": [{"position": {}}]}, "two times": {"assertions": [{"time": {"instant": "column(a)", "interval": {}}}]},
    "no upper": {"assertions": [{"time": {"interval": {"lower": "column(a)"}}}]}, "epoch and format": {"assertions": [{"time": {"instant": "column(a)", "epoch": "unix_s", "format": "%Y"}}]},
    "epoch": {"assertions": [{"time": {"instant": "column(a)", "epoch": "mac"}}]}, "owned": {"common": {"row_uid": "column(a)"}}, "unknown field": {"common": {"colour": "column(a)"}},
    "vocabulary": {"common": {"deleted": "const(gone)"}}, "link": {"assertions": [{"time": {"instant": "column(a)"}, "links": {"entity_time": "then"}}]},
    "link name": {"assertions": [{"time": {"instant": "column(a)"}, "links": {"other": "at"}}]}, "pattern": {"patterns": {"p": "("}},
    "extract": {"patterns": {"p": "(?P<a>x)"}, "common": {"entity": {"from": "column(a)", "extract": "p.b"}}}, "lookups": {"lookup_tables": {"t": 1}}, "expected": {"expected_columns": [1]},
}


@pytest.mark.parametrize("name", WRONG)
def test_what_a_preset_may_not_be(name):
    with pytest.raises(PresetError):
        preset_from(body(**WRONG[name]), "p.yaml")


def test_loading(tmp_path):
    import yaml

    (tmp_path / "b.yaml").write_text(yaml.safe_dump(body()))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "draft.yaml").write_text(yaml.safe_dump(body()) + "# TODO\n")
    assert [p.id for p in load_presets(tmp_path)] == ["a.b"]
    (tmp_path / "b.yaml").unlink()
    with pytest.raises(PresetError):
        load_presets(tmp_path)


def test_paths():
    s = preset_from(body(input_selector={"format": "csv", "path": "/private/*/{uuid}/x.csv"})).selectors[0]
    uid = "12345678-9abc-DEF0-1234-56789abcdef0"
    assert located(s, f"private/var/{uid}/x.csv") and located(s, f"fs1/private/var/{uid}/x.csv") and located(s, f"fs1\\private\\var\\{uid}\\x.csv")
    assert not located(s, f"a/fs1/private/var/{uid}/x.csv") and not located(s, "private/var/other/x.csv") and not located(s, f"private/a/b/{uid}/x.csv")
    assert "[^/]+" in path_pattern("/a/*/c")
    n = preset_from(body()).selectors[0]
    assert located(n, "deep/down/x.csv") and not located(n, "X.csv")


def test_gate_score_and_winner():
    assert structural_score(["a", "b*", "c"], ["a", "bb"]) == 0
    p, wide = preset_from(body()), preset_from(body(preset={"id": "c.d", "name": "wide"}, expected_columns=["lat", "lon", "ts", "acc"]))
    assert missing_columns(p, ["lat", "ts"]) == ["lon"]
    pick = lambda columns: match_file([p, wide], "x.csv", "csv", lambda s: columns)
    assert [x[0].id for x in pick(["lat", "lon", "ts", "acc"]).chosen] == ["c.d"]
    assert [x[0].id for x in pick(["lat", "lon", "ts"]).chosen] == ["a.b"]
    lost = pick(["lat"])
    assert not lost.chosen and len(lost.unsatisfied) == 2
    assert [x[0].id for x in pick(None).chosen] == ["a.b"]
    assert match_file([p], "x.csv", "sqlite", lambda s: None).notes
    globbed = preset_from(body(assertions=[{"time": {"instant": "column(t*)", "epoch": "unix_s"}}]))
    assert missing_columns(globbed, ["ts"]) == [] and missing_columns(globbed, ["x"]) == ["t*"]


def test_lint(tmp_path):
    codes = lambda **c: {f.code for f in lint(preset_from(body(**c)))}
    assert codes() == set()
    assert "id-naming" in codes(preset={"id": "A", "name": "x", "os_version": "1"})
    assert codes(preset={"id": "a.b", "name": "x", "tier": "secondary"}) == {"tier-tool", "no-os-version"}
    assert codes(common={}) == {"no-raw-source-path"}
    assert codes(source_record_uid="column(Z_PK)") == {"rowid-as-uid", "mapped-not-declared"}
    assert codes(expected_columns=[]) == {"no-expected-columns"}
    assert codes(expected_columns=["lat", "l?n"]) == {"mapped-not-declared"}
    assert codes(input_selector={"format": "csv", "name": "TODO.csv"}) == {"unfilled-placeholder"}
    assert codes(input_selector={"format": "csv", "path": "/a/12345678-9abc-def0-1234-56789abcdef0/x"}) == {"literal-uuid-in-path"}
    assert codes(input_selector=[{"format": "csv", "name": "x"}, {"format": "csv", "name": "y", "role": "b"}]) == {"multi-role-unsupported"}
    half = [{"position": {"latitude_wgs84": "column(lat)", "altitude_m": {"from": "column(ts)", "pipe": "arithmetic(value + 978307200)"}}, "time": {"instant": "column(ts)", "format": "%Y"}}]
    assert codes(assertions=half) == {"half-coordinate", "missing-link", "naive-timezone", "raw-epoch-arithmetic"}
    (tmp_path / "x.yaml").write_text("a: [")
    (tmp_path / "y.yaml").write_text("a: 1")
    found = lint_paths([tmp_path])
    assert [f.code for f in found] == ["yaml-error", "parse-error"] and exit_code(found) == 1 and exit_code(lint(preset_from(body(common={}))), strict=True) == 1

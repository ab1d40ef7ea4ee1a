import json
import zipfile

import pytest

from seamgraph.observe import ObservationError, column_number, observe_folder, observe_resource, observe_workbook


def book(path, formula=True, sheet="xl/worksheets/s.xml", head=""):
    site = "http://schemas.openxmlformats.org"
    main, rel = f"{site}/spreadsheetml/2006/main", f"{site}/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Secret" r:id="k"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="k" Target="worksheets/s.xml"/></Relationships>')
        f = "<f>B1*2</f>" if formula else ""
        z.writestr(sheet, f'<worksheet xmlns="{main}"><dimension ref="A1:B1"/><sheetData><row spans="1:2" r="1"><c r="A1">{f}</c><c r="B1"/></row></sheetData></worksheet>')


def code(f, *a, **k):
    with pytest.raises(ObservationError) as e:
        f(*a, **k)
    return e.value.code


def test_folder(tmp_path):
    src = tmp_path / "source"
    (src / "keep").mkdir(parents=True)
    (src / "skip").mkdir()
    (src / "keep/secret.txt").write_text("password")
    (src / "skip/x").write_text("x")
    seen = observe_folder(tmp_path, "source", excluded_directory_names=("skip",))
    assert seen == observe_folder(tmp_path, "source", excluded_directory_names=("skip",))
    assert (seen["entry_count"], seen["excluded_directory_count"], seen["entry_kinds"]) == (2, 1, {"directory": 1, "file": 1})
    assert "secret" not in json.dumps(seen) and "password" not in json.dumps(seen)
    assert code(observe_folder, tmp_path, "source", maximum_entries=1) == "entry-limit-exceeded"
    assert code(observe_folder, tmp_path, "../x") == "source-outside-root"
    assert code(observe_folder, tmp_path, "none") == "source-not-found"
    assert code(observe_folder, tmp_path, "source", excluded_directory_names=("a/b",)) == "invalid-exclusion"
    assert code(observe_folder, tmp_path, "source", maximum_entries=0) == "invalid-limit"
    (tmp_path / "link").symlink_to(src)
    assert code(observe_folder, tmp_path, "link") == "symbolic-link-rejected"
    (src / "in").symlink_to(src / "keep")
    assert observe_folder(tmp_path, "source")["entry_kinds"]["symbolic_link_rejected"] == 1


def test_workbook(tmp_path):
    book(tmp_path / "b.xlsx")
    seen = observe_workbook(tmp_path, "b.xlsx")
    sheet = seen["sheets"][0]
    assert (sheet["row_count"], sheet["cell_count"], sheet["formula_count"], sheet["dimension"]) == (1, 2, 1, "A1:B1")
    assert "Secret" not in json.dumps(seen)
    assert observe_workbook(tmp_path, "b.xlsx", include_labels=True)["sheets"][0]["label"] == "Secret"
    book(tmp_path / "bad.xlsx", head="<!DOCTYPE x>")
    assert code(observe_workbook, tmp_path, "bad.xlsx") == "unsafe-xml"
    book(tmp_path / "none.xlsx", sheet="xl/other.xml")
    assert code(observe_workbook, tmp_path, "none.xlsx") == "missing-workbook-part"
    assert code(observe_workbook, tmp_path, "b.xlsx", maximum_columns=1) == "column-limit-exceeded"
    (tmp_path / "z.xlsx").write_text("no zip")
    assert code(observe_workbook, tmp_path, "z.xlsx") == "invalid-workbook"


def test_columns():
    assert [column_number(x) for x in ("A1", "$AZ$3", "ba9", "7", "A0")] == [1, 52, 53, None, None]


def test_resource(tmp_path):
    (tmp_path / "d").mkdir()
    config = tmp_path / "c.json"
    item = dict(resource_ref="r", kind="folder", root=str(tmp_path), source="d")
    config.write_text(json.dumps(dict(schema_version="0.10.0", resources=[item])))
    seen = observe_resource(config, "r")
    assert str(tmp_path) not in json.dumps(seen) and seen["resource_ref"] == "r" and "source_ref" not in seen
    assert code(observe_resource, config, "x") == "resource-not-selected"
    config.write_text(json.dumps(dict(schema_version="0.10.0", resources=[item | {"extra": 1}])))
    assert code(observe_resource, config, "r") == "invalid-configuration"

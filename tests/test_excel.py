"""Workbooks written by hand: headers, blanks, repeated names, dates, whole numbers, shared and inline strings."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from emberlog.sources import excel

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def workbook(path, tables, shared=(), date1904=False, empty_rows=True):
    """``tables``: name -> rows of cells, each an XML tail such as ('n', '1.0', style) or None."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(tables)
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="[Red]0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs></styleSheet>')
        for i, n in enumerate(names, 1):
            body = []
            for y, row in enumerate(tables[n], 1):
                cells = []
                for x, c in enumerate(row):
                    if c is None:
                        continue
                    kind, v, *style = c
                    s = f' s="{style[0]}"' if style else ""
                    inner = f"<is><t>{escape(v)}</t></is>" if kind == "inlineStr" else f"<v>{escape(v)}</v>"
                    cells.append(f'<c r="{letters(x)}{y}" t="{kind}"{s}>{inner}</c>')
                if cells or not empty_rows:
                    body.append(f'<row r="{y}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return str(path)


def test_rules_of_sheets(spark, tmp_path):
    t = lambda v: ("inlineStr", v)
    tables = {
        "empty": [],
        "head only": [[t("a"), t("b")]],
        "data & more": [
            [None, None],
            [t("when"), None, t("name"), t("name"), t(" x "), ("s", "0"), None],
            [("n", "45413.4166666667", "1"), ("n", "3.0"), ("s", "1"), ("b", "1"), ("n", "1.5"), ("str", "f"), t("beyond")],
            [None, None, None, None, None, None],
            [("n", "45413", "2"), ("n", "1e3"), t(""), ("b", "0"), ("n", "2.25", "3"), ("e", "#N/A")],
            [("n", "0.5", "4"), ("n", "12345678901234567"), t("é\nx"), None, None, None],
        ],
        "second": [[t("k")], [("d", "2024-05-01T10:00:00")]],
    }
    path = workbook(tmp_path / "x.xlsx", tables, ["<t>shared</t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh>"])
    got = excel.read(spark, path)
    assert list(got) == ["data & more", "second"]
    one = got["data & more"]
    assert one.columns == ["when", "col_2", "name", "name_2", "x", "shared"]
    assert [tuple(r) for r in one.collect()] == [
        ("2024-05-01 10:00:00", "3", "rich", "true", "1.5", "f"),
        ("2024-05-01 00:00:00", "1000", None, "false", "2.25", "#N/A"),
        ("12:00:00", "12345678901234567", "é\nx", None, None, None),
    ]
    assert [tuple(r) for r in got["second"].collect()] == [("2024-05-01 10:00:00",)]
    whole = spark.read.format("workbook").load(path)
    assert whole.rdd.getNumPartitions() == 4 and whole.filter("sheet = 'empty'").count() == 0


def test_calendars_and_wide_sheets(spark, tmp_path):
    path = workbook(tmp_path / "m.xlsx", {"s": [[("inlineStr", "d")] * 30, [("n", "1", "1")] * 30]}, date1904=True)
    got = excel.read(spark, path)["s"]
    assert got.columns[:2] == ["d", "d_2"] and len(got.columns) == 30 and got.first()[29] == "1904-01-02 00:00:00"
    assert excel._moment(1, False) == "1900-01-01 00:00:00" and excel._moment(61, False) == "1900-03-01 00:00:00"


def test_what_is_no_workbook(spark, tmp_path):
    (tmp_path / "n.xlsx").write_text("no zip")
    with pytest.raises(excel.ExcelError):
        excel.sheets(str(tmp_path / "n.xlsx"))
    with pytest.raises(excel.ExcelError):
        excel.read(spark, workbook(tmp_path / "e.xlsx", {"a": [], "b": [[("inlineStr", "only")]]}))
    with pytest.raises(excel.ExcelError):
        excel.read(spark, str(tmp_path / "old.xls"))

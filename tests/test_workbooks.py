"""Workbooks and system files that the tests write by hand."""

import struct
import zipfile

import pytest

from fieldmark.sources import tables, workbooks


def xlsx(path, sheets, shared=(), styles="", date1904=False):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k == 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'


def test_workbook(spark, tmp_path):
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>day</t></is></c><c r="D2" t="s"><v>0</v></c><c r="E2" t="str"><v>ok</v></c><c r="F2" t="s"><v>2</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="B3"><v>1</v></c><c r="C3" s="1"><v>45000</v></c><c r="E3" t="b"><v>1</v></c><c r="AA3"><v>9</v></c></row>'
        '<row r="5"><c r="A5" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r><rPh><t>no</t></rPh></is></c><c r="B5" s="3"><v>2.5</v></c><c r="C5" s="2"><v>45000.5</v></c><c r="E5" t="b"><v>0</v></c><c r="D5" t="e"><v>#N/A</v></c></row><row r="6"/>'
    )
    xlsx(tmp_path / "a.xlsx", {"一": rows, "two": '<row><c t="str"><v>x</v></c></row><row><c><v>7</v></c></row>'}, ("<t>姓 名</t>", "<t>n</t>", "<t></t>", '<t xml:space="preserve">王 </t>'), STYLES)
    df = tables.read_table(spark, f"file://{tmp_path}/a.xlsx")
    assert df.columns == ["姓 名", "n", "day", "ok"] and [t for _, t in df.dtypes] == ["string", "double", "string", "boolean"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("王 ", 1.0, "2023-03-15", True), ("ab", 2.5, "2023-03-15 12:00:00", False)], key=repr)
    raw = tables.read_table(spark, f"file://{tmp_path}/a.xlsx", clean=False)
    assert raw.columns == ["姓 名", "n", "day", "姓 名.1", "ok", "Unnamed: 5"]
    assert tables.read_table(spark, f"file://{tmp_path}/a.xlsx", sheet="two").first()["x"] == 7
    assert tables.read_table(spark, f"file://{tmp_path}/a.xlsx", sheet=1).columns == ["x"]
    xlsx(tmp_path / "old.xlsx", {"s": '<row><c t="str"><v>d</v></c></row><row><c s="1"><v>1</v></c></row>'}, styles=STYLES, date1904=True)
    assert tables.read_table(spark, f"file://{tmp_path}/old.xlsx").first()["d"] == "1904-01-02"
    xlsx(tmp_path / "none.xlsx", {"s": ""})
    assert tables.read_table(spark, f"file://{tmp_path}/none.xlsx", clean=False).count() == 0
    with pytest.raises(ValueError, match="xlsx"):
        tables.read_table(spark, f"file://{tmp_path}/b.xls")


def test_workbooks_of_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "LOT", 2)
    (tmp_path / "d.xlsx").mkdir()
    for k, names in enumerate((("a", "b"), ("b", "c"))):
        rows = "<row>" + "".join(f'<c t="str"><v>{n}</v></c>' for n in names) + "</row>" + "".join(f"<row><c><v>{10 * k + i}</v></c><c><v>{i}</v></c></row>" for i in range(5))
        xlsx(tmp_path / f"d.xlsx/{k}.xlsx", {"s": rows})
    df = tables.read_table(spark, f"file://{tmp_path}/d.xlsx")
    assert df.columns == ["a", "b", "c"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(i, i, None) for i in range(5)] + [(None, 10 + i, i) for i in range(5)], key=repr)


def sav(path, variables, rows, packed=1, order="<", extra=b"", labels=b""):
    """``variables``: name, width, missing count, missing codes."""
    i = lambda *x: struct.pack(f"{order}{len(x)}i", *x)
    d = lambda x: struct.pack(order + "d", x)
    out = b"$FL2" + b"@(#) hand".ljust(60) + i(2, -1, packed, 0, len(rows)) + d(100.0) + b"01 Jan 26" + b"00:00:00" + b"".ljust(64) + b"\0\0\0"
    assert len(out) == 176
    for name, width, missing, codes in variables:
        out += i(2, width, 0, missing, 0, 0) + name.encode().ljust(8) + b"".join(codes)
        for _ in range(max(1, -(-width // 8)) - 1):
            out += i(2, -1, 0, 0, 0, 0) + b" " * 8
    out += labels + i(6, 1) + b"note".ljust(80) + extra + i(999, 0)
    slots = []
    for row in rows:
        for (_, width, *_), v in zip(variables, row, strict=True):
            if width == 0:
                slots.append(None if v is None else float(v))
            else:
                text = v.encode().ljust(-(-width // 8) * 8)
                slots += [text[k : k + 8] for k in range(0, len(text), 8)]
    if not packed:
        out += b"".join(x if isinstance(x, bytes) else d(-1.7976931348623157e308 if x is None else x) for x in slots)
    else:
        codes, raw, body = [], [], b""
        for x in [*slots, "end"]:
            if x == "end":
                codes.append(252)
            elif x is None:
                codes.append(255)
            elif isinstance(x, float) and x == int(x) and 1 <= x + 100 <= 251:
                codes.append(int(x) + 100)
            elif x == b" " * 8:
                codes.append(254)
            else:
                codes.append(253)
                raw.append(x if isinstance(x, bytes) else d(x))
            if len(codes) == 8 or x == "end":
                body += bytes(codes).ljust(8, b"\0") + b"".join(raw)
                codes, raw = [], []
        out += body
    path.write_bytes(out)


@pytest.mark.parametrize(("packed", "order"), [(1, "<"), (0, "<"), (1, ">"), (0, ">")])
def test_system_file(spark, tmp_path, packed, order):
    i = lambda *x: struct.pack(f"{order}{len(x)}i", *x)
    d = lambda x: struct.pack(order + "d", x)
    variables = [("SEX", 0, 1, [d(9.0)]), ("SCORE", 0, -3, [d(-5.0), d(-1.0), d(99.5)]), ("NAME", 12, 0, []), ("CODE", 3, 1, [b"zz".ljust(8)])]
    rows = [(1, 3.25, "王小明", "a"), (2, -3, "", "zz"), (9, 99.5, "Ann Bo", "b"), (None, 7, "x" * 12, ""), (2, 1e300, "é", "a")]
    long = b"SEX=geschlecht\tSCORE=punkte"
    extra = i(7, 20, 1, 5) + b"UTF-8" + i(7, 13, 1, len(long)) + long + i(7, 3, 4, 2) + b"\0" * 8
    labels = i(3, 2) + d(1.0) + b"\x04male".ljust(8) + d(2.0) + b"\x06female".ljust(8) + i(4, 1, 1) + i(3, 1) + b"a".ljust(8) + b"\x01A".ljust(8) + i(4, 1, 5)
    sav(tmp_path / "s.sav", variables, rows, packed, order, extra, labels)
    path = f"file://{tmp_path}/s.sav"
    df = tables.read_table(spark, path)
    assert df.columns == ["geschlecht", "punkte", "NAME", "CODE"] and [t for _, t in df.dtypes] == ["bigint", "double", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 3.25, "王小明", "a"), (2, None, None, None), (None, None, "Ann Bo", "b"), (None, 7.0, "x" * 12, None), (2, 1e300, "é", "a")]
    told = [tuple(r) for r in tables.read_table(spark, path, labels=True).select("geschlecht", "CODE").collect()]
    assert told == [("male", "A"), ("female", None), (None, "b"), (None, None), ("female", "A")]


def test_long_strings_of_system_files(spark, tmp_path):
    text = "".join(chr(97 + k % 26) for k in range(300))
    variables = [("T", 255, 0, []), ("T0", 48, 0, []), ("N", 0, 0, [])]
    body = b"T=00300\0\t"
    sav(tmp_path / "l.sav", variables, [(text[:252], text[252:], 5), ("short", "", 6)], extra=struct.pack("<4i", 7, 14, 1, len(body)) + body)
    assert [tuple(r) for r in tables.read_table(spark, f"file://{tmp_path}/l.sav").collect()] == [(text, 5), ("short", 6)]
    (tmp_path / "z.sav").write_bytes(b"$FL3" + b"\0" * 200)
    with pytest.raises(Exception, match="not a system file"):
        tables.read_table(spark, f"file://{tmp_path}/z.sav")

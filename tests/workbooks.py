"""Write small .xlsx files for tests."""

import zipfile

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(ref, value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):  # (serial, style)
        return f'<c r="{ref}" s="{value[1]}"><v>{value[0]}</v></c>'
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def write_workbook(path, rows, shared=()):
    """First sheet stored as the second part, so sheet order has to be honoured."""
    body = "".join(
        f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(row)) + "</row>"
        for i, row in enumerate(rows, start=1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>'
                           '<sheet name="Data" sheetId="2" r:id="rId2"/>'
                           '<sheet name="Other" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
                         '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">' + "".join(shared) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in parts.items():
            zf.writestr(name, text)

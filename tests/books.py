"""Small workbooks written by hand, in the public file format."""

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letters(index: int) -> str:
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(row: int, column: int, value, texts: list[str]) -> str:
    at = f'r="{_letters(column)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):  # (serial, style)
        return f'<c {at} s="{value[1]}"><v>{value[0]}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {at}><v>{value!r}</v></c>"
    if value.startswith("inline:"):
        return f'<c {at} t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    texts.append(value)
    return f'<c {at} t="s"><v>{len(texts) - 1}</v></c>'


def write_book(path, rows: list[list]) -> None:
    """First sheet with ``rows``, behind a second one. Style 1 is a date, style 2 an own date format."""
    texts: list[str] = []
    body = "".join(
        f'<row r="{r}">' + "".join(_cell(r, c, v, texts) for c, v in enumerate(row)) + "</row>"
        for r, row in enumerate(rows, 1)
    )
    half = lambda t: f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r></si>"
    shared = "".join(half(t) if t.startswith("rich") else f"<si><t>{escape(t)}</t></si>" for t in texts)
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>'
        '<sheet name="Data" sheetId="7" r:id="rId9"/><sheet name="Other" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_REL}">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
        '<Relationship Id="rId9" Target="/xl/worksheets/data.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>',
        "xl/worksheets/data.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">{shared}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/>'
        '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in parts.items():
            book.writestr(name, content)

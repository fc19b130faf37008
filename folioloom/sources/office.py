"""Office files by the standard library: they are zip archives of XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .parse import _trimmed, table_html, table_markdown

# The name spaces of the formats.
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SLIDE = (9144000, 6858000)
#: An archive member beyond this is refused.
MOST_BYTES = 512 << 20


class _Package:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MOST_BYTES:
            raise ValueError(f"{name} is too large")
        return ET.fromstring(self.zip.read(name))

    def links(self, name: str) -> dict[str, str]:
        """Relationship ids of a part, and the parts that they name."""
        folder, base = posixpath.split(name)
        found = self.xml(f"{folder}/_rels/{base}.rels")
        return {} if found is None else {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in found}


def _column(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def parse_xlsx(data: bytes) -> Iterator[dict]:
    """A table for each sheet with cells, as values."""
    pack = _Package(data)
    shared = pack.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared] if shared is not None else []
    links = pack.links("xl/workbook.xml")
    for sheet in pack.xml("xl/workbook.xml").iter(f"{_S}sheet"):
        part = links[sheet.get(f"{_R}id")]
        tree = pack.xml(part if part.startswith("xl/") else f"xl/{part}")
        rows: list[list[str]] = []
        for row in tree.iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) if letters else len(cells) + 1
                cells += [""] * (at - len(cells))
                value, kind = c.find(f"{_S}v"), c.get("t", "n")
                if kind == "inlineStr":
                    words = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif value is None or value.text is None:
                    words = ""
                elif kind == "s":
                    words = strings[int(value.text)]
                elif kind == "b":
                    words = "True" if value.text == "1" else "False"
                else:
                    words = value.text
                cells[at - 1] = words.strip()
            rows.append(cells)
        width = max(map(len, rows), default=0)
        rows, width = _trimmed([r + [""] * (width - len(r)) for r in rows])
        if rows:
            name = sheet.get("name")
            meta = {"sheet_name": name, "headers": rows[0], "rows_count": len(rows), "cols_count": width}
            yield {"type": "table", "content": table_markdown(rows), "raw_content": table_html(rows), "selector": f"{name}!A1:{_column(width)}{len(rows)}", "metadata": meta}


def _word_text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(data: bytes) -> Iterator[dict]:
    """All paragraphs, headings by the name of their style, then all tables."""
    pack = _Package(data)
    styles = pack.xml("word/styles.xml")
    names, default = {}, "Normal"
    for s in styles.iter(f"{_W}style") if styles is not None else ():
        name = s.find(f"{_W}name").get(f"{_W}val")
        # The format keeps built-in heading names in lower case.
        name = re.sub("^heading (?=\\d)", "Heading ", name)
        names[s.get(f"{_W}styleId")] = name
        if s.get(f"{_W}type") == "paragraph" and s.get(f"{_W}default") == "1":
            default = name
    body = pack.xml("word/document.xml").find(f"{_W}body")
    for n, p in enumerate(body.findall(f"{_W}p"), 1):
        if words := _word_text(p).strip():
            style = p.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(f"{_W}val"), default) if style is not None else default
            kind = "heading" if name.startswith("Heading") else "paragraph"
            yield {"type": kind, "content": words, "raw_content": ET.tostring(p, "unicode"), "selector": f"body > p[{n}]", "metadata": {"style": name}}
    for n, t in enumerate(body.findall(f"{_W}tbl"), 1):
        rows = [["\n".join(_word_text(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        text = table_markdown(rows, pad=False)
        yield {"type": "table", "content": text, "raw_content": text, "selector": f"body > table[{n}]", "metadata": {"rows_count": len(rows)}}


def parse_pptx(data: bytes) -> Iterator[dict]:
    """Slides in order: text of placeholders as headings, other text, tables and pictures, with boxes as shares of the slide."""
    pack = _Package(data)
    deck, links = pack.xml("ppt/presentation.xml"), pack.links("ppt/presentation.xml")
    size = deck.find(f"{_P}sldSz")
    width, height = (int(size.get("cx")), int(size.get("cy"))) if size is not None else _SLIDE

    def box(shape: ET.Element, layout: dict) -> list[float] | None:
        frame = shape.find(f".//{_A}xfrm")
        frame = shape.find(f"{_P}xfrm") if frame is None else frame
        if frame is None or frame.find(f"{_A}off") is None:
            mark = shape.find(f".//{_P}ph")
            found = layout.get((mark.get("type"), mark.get("idx"))) if mark is not None else None
            if found is None:
                return None
            x, y, w, h = found
        else:
            off, ext = frame.find(f"{_A}off"), frame.find(f"{_A}ext")
            x, y, w, h = int(off.get("x")), int(off.get("y")), int(ext.get("cx")), int(ext.get("cy"))
        return [round(x / width, 4), round(y / height, 4), round((x + w) / width, 4), round((y + h) / height, 4)]

    def shapes(parent: ET.Element) -> Iterator[ET.Element]:
        for shape in parent:
            if shape.tag == f"{_P}grpSp":
                yield from shapes(shape)
            elif shape.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}pic"):
                yield shape

    def text(p: ET.Element) -> str:
        return "".join("\v" if x.tag == f"{_A}br" else x.text or "" for x in p.iter() if x.tag in (f"{_A}t", f"{_A}br")).strip()

    for n, entry in enumerate(deck.iter(f"{_P}sldId"), 1):
        name = links[entry.get(f"{_R}id")]
        layout = {}
        for part in pack.links(name).values():
            if "slideLayout" in part and (tree := pack.xml(part)) is not None:
                for shape in tree.iter(f"{_P}sp"):
                    mark, off, ext = shape.find(f".//{_P}ph"), shape.find(f".//{_A}off"), shape.find(f".//{_A}ext")
                    if mark is not None and off is not None and ext is not None:
                        layout[mark.get("type"), mark.get("idx")] = int(off.get("x")), int(off.get("y")), int(ext.get("cx")), int(ext.get("cy"))
        for shape in shapes(pack.xml(name).find(f"{_P}cSld/{_P}spTree")):
            place = {"page_number": n, "bbox": box(shape, layout)}
            table, picture = shape.find(f".//{_A}tbl"), shape.find(f".//{_A}blip")
            if table is not None:
                rows = [["\n".join(text(p) for p in c.iter(f"{_A}p")).strip() for c in r.findall(f"{_A}tc")] for r in table.findall(f"{_A}tr")]
                if rows:
                    yield {"type": "table", "content": table_markdown(rows), "raw_content": table_html(rows), "metadata": {"headers": rows[0], "rows_count": len(rows)}, **place}
            elif shape.tag == f"{_P}pic":
                part = pack.links(name).get(picture.get(f"{_R}embed"), "") if picture is not None else ""
                ident = shape.find(f".//{_P}cNvPr").get("id")
                yield {"type": "image", "content": f"[Image: slide {n}, shape {ident}]", "raw_content": None, "metadata": {"content_type": f"image/{posixpath.splitext(part)[1].lstrip('.').replace('jpg', 'jpeg')}"}, **place}
            else:
                mark = shape.find(f".//{_P}ph")
                for p in shape.iter(f"{_A}p"):
                    if words := text(p):
                        runs = []
                        for r in p.findall(f"{_A}r"):
                            look, piece = r.find(f"{_A}rPr"), "".join(t.text or "" for t in r.iter(f"{_A}t"))
                            if look is not None and look.get("b") == "1":
                                piece = f"<b>{piece}</b>"
                            if look is not None and look.get("i") == "1":
                                piece = f"<i>{piece}</i>"
                            runs.append(piece)
                        meta = {"placeholder_type": mark.get("type", "body")} if mark is not None else {}
                        yield {"type": "heading" if mark is not None else "paragraph", "content": words, "raw_content": "".join(runs) or words, "metadata": meta, **place}

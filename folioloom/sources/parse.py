"""Parsers of single documents: text or bytes to elements, in plain Python.

Each yields dicts of the element columns that it knows; ``elements`` turns them
into rows.  They run inside ``mapInPandas`` over whole documents.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser


def table_markdown(rows: list[list[str]], pad: bool = True) -> str:
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(rows[0]), line(["---"] * width), *(line(r + [""] * (width - len(r)) if pad else r) for r in rows[1:])])


def table_html(rows: list[list[str]]) -> str:
    if not rows:
        return "<table></table>"
    width = len(rows[0])
    cells = lambda row, tag: "".join(f"<{tag}>{c}</{tag}>" for c in row)
    body = [f"    <tr>{cells(r + [''] * (width - len(r)), 'td')}</tr>" for r in rows[1:]]
    return "\n".join(["<table border='1'>", f"  <thead>\n    <tr>{cells(rows[0], 'th')}</tr>\n  </thead>", "  <tbody>", *body, "  </tbody>\n</table>"])


def _trimmed(rows: list[list[str]]) -> tuple[list[list[str]], int]:
    """Without empty rows, and without the columns to the right that are empty in all."""
    rows = [r for r in rows if any(r)]
    width = max((k + 1 for r in rows for k, c in enumerate(r) if c), default=1)
    return [r[:width] for r in rows], width


def parse_text(text: str) -> Iterator[dict]:
    """A paragraph for each line that isn't blank."""
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            yield {"type": "paragraph", "content": line.strip(), "raw_content": line, "start_line": n, "end_line": n}


def parse_csv(text: str) -> Iterator[dict]:
    """One table; the dialect is guessed from the first 8192 characters."""
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:8192])
    except csv.Error:
        dialect = csv.excel
    rows, width = _trimmed([[c.strip() for c in row] for row in csv.reader(io.StringIO(text), dialect)])
    if rows:
        meta = {"headers": rows[0], "rows_count": len(rows), "cols_count": width, "delimiter": dialect.delimiter}
        yield {"type": "table", "content": table_markdown(rows), "raw_content": table_html(rows), "start_line": 1, "end_line": len(rows), "metadata": meta}


def parse_json(text: str) -> Iterator[dict]:
    """Leaves as ``key: value`` with their paths; an array of objects as one table."""
    data = json.loads(text)
    dump = lambda x: json.dumps(x, ensure_ascii=False)

    def walk(value, path: str, key: str | None) -> Iterator[dict]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}", k)
        elif isinstance(value, list):
            names = list(dict.fromkeys(k for x in value if isinstance(x, dict) for k in x))
            if names and all(isinstance(x, dict) for x in value):
                rows = [names, *([str(x.get(k, "")) for k in names] for x in value)]
                meta = {"headers": names, "rows_count": len(rows), "array_length": len(value)}
                yield {"type": "table", "content": table_markdown(rows), "raw_content": table_html(rows), "selector": path, "metadata": meta}
            else:
                for k, x in enumerate(value):
                    yield from walk(x, f"{path}[{k}]", None)
        elif key is not None:
            yield {"type": "text", "content": f"{key}: {value}", "raw_content": dump({key: value}), "selector": path, "metadata": {"key": key, "value_type": type(value).__name__}}
        else:
            yield {"type": "text", "content": str(value), "raw_content": text.strip() if path == "$" else dump(value), "selector": path}

    yield from walk(data, "$", None)


# ---- HTML -----------------------------------------------------------------------------------------------------------

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr basefont bgsound command frame image isindex nextid spacer menuitem".split())
_SKIPPED = frozenset("script style noscript svg head meta link template".split())
_UNREAD = frozenset("script style template".split())


class _Node:
    __slots__ = ("name", "attrs", "up", "kids", "start", "end", "nth", "names")

    def __init__(self, name: str, attrs: dict, up: _Node | None, start: int) -> None:
        self.name, self.attrs, self.up, self.kids, self.start, self.end = name, attrs, up, [], start, start
        self.names: dict[str, int] = {}  # how many kids have each name
        self.nth = 0
        if up is not None:
            self.nth = up.names[name] = up.names.get(name, 0) + 1
            up.kids.append(self)

    def _below(self, skip: frozenset[str]) -> Iterator[_Node | str]:
        """Everything below in page order, without what is in nodes of the skipped names; no recursion, however deep."""
        open_ = [iter(self.kids)]
        while open_:
            for kid in open_[-1]:
                if isinstance(kid, str):
                    yield kid
                elif kid.name not in skip:
                    yield kid
                    open_.append(iter(kid.kids))
                    break
            else:
                open_.pop()

    def walk(self) -> Iterator[_Node]:
        return (x for x in self._below(frozenset()) if isinstance(x, _Node))

    def pieces(self) -> Iterator[str]:
        return (x for x in self._below(_UNREAD) if isinstance(x, str))

    def text(self, separator: str) -> str:
        return separator.join(p for x in self.pieces() if (p := x.strip()))

    def selector(self) -> str:
        parts, node = [], self
        while node.up is not None:
            if node.attrs.get("id"):
                parts.append(f"{node.name}#{node.attrs['id']}")
                break
            parts.append(f"{node.name}:nth-of-type({node.nth})" if node.up.names[node.name] > 1 else node.name)
            node = node.up
        return " > ".join(reversed(parts))


class _Tree(HTMLParser):
    """A tree of what is written: nothing is closed for another tag's sake, an end tag closes up to the nearest of its name."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.root = html, _Node("", {}, None, 0)
        self.open: dict[str, int] = {}  # how many open nodes have each name
        self.at, self.lines = self.root, [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()
        while self.at is not self.root:
            self._end(self.at, len(html))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, node: _Node, place: int) -> None:
        node.end = place
        self.open[node.name] -= 1
        self.at = node.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self._place())
        node.end = node.start + len(self.get_starttag_text() or "")
        if tag not in _VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end(self.at, self.at.end)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        start = self._place()
        while (node := self.at).name != tag:
            self._end(node, start)
        close = self.html.find(">", start)
        self._end(node, close + 1 if close >= 0 else len(self.html))

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse_html(html: str) -> Iterator[dict]:
    """Headings, paragraphs, tables, list items, images, code, quotes and rules; text directly in a container is dropped."""
    tree = _Tree(html)
    body = next((n for n in tree.root.walk() if n.name == "body"), tree.root)

    def element(node: _Node, kind: str, content: str, **meta) -> dict:
        level = meta.pop("level", None)
        return {"type": kind, "content": content, "raw_content": html[node.start : node.end], "selector": node.selector(), "level": level, "metadata": meta}

    def image(node: _Node) -> Iterator[dict]:
        src, alt, title = (node.attrs.get(k, "") for k in ("src", "alt", "title"))
        if src:
            yield element(node, "image", alt or src, src=src, alt=alt, **({"title": title} if title else {}))

    def table(node: _Node) -> Iterator[dict]:
        rows = [[c.text(" ") for c in tr.walk() if c.name in ("td", "th")] for tr in node.walk() if tr.name == "tr"]
        if rows := [r for r in rows if r]:
            yield element(node, "table", table_markdown(rows), headers=rows[0], rows_count=len(rows))

    def items(node: _Node) -> Iterator[dict]:
        for li in node.kids:
            if isinstance(li, _Node) and li.name == "li" and (words := li.text(" ")):
                yield element(li, "list_item", words, ordered=node.name == "ol")

    def code(node: _Node) -> Iterator[dict]:
        inner = next((n for n in node.walk() if n.name == "code"), None)
        names = inner.attrs.get("class", "").split() if inner else []
        language = next((m[1] for c in names if (m := re.match("lang(?:uage)?-(.*)", c))), None)
        yield element(node, "code", "".join((inner or node).pieces()), **({"language": language} if language is not None else {}))

    def words(kind: str, separator: str = " ") -> Callable[[_Node], Iterator[dict]]:
        def read(node: _Node) -> Iterator[dict]:
            if kind == "paragraph":
                for n in node.walk():
                    if n.name == "img":
                        yield from image(n)
            if found := node.text(separator):
                yield element(node, kind, found, **({"level": int(node.name[1])} if kind == "heading" else {}))

        return read

    readers = {f"h{k}": words("heading") for k in range(1, 7)}
    readers |= {"p": words("paragraph"), "blockquote": words("blockquote", "\n"), "table": table, "ul": items, "ol": items, "img": image, "pre": code}
    readers["hr"] = lambda node: iter([element(node, "hr", "---")])

    open_ = [iter(body.kids)]
    while open_:
        for kid in open_[-1]:
            if isinstance(kid, str) or kid.name in _SKIPPED:
                continue
            if kid.name in readers:
                yield from readers[kid.name](kid)
            else:
                open_.append(iter(kid.kids))
                break
        else:
            open_.pop()


def html_title(html: str) -> str:
    return next((n.text("") for n in _Tree(html).root.walk() if n.name == "title"), "")


# ---- Markdown -------------------------------------------------------------------------------------------------------

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^\n]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_BULLET = re.compile(r"( {0,3})([-*+]|(\d{1,9})[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_QUOTE = re.compile(r" {0,3}> ?(.*)$")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^\s)>]*)>?(?:\s+[\"'(]([^\"')]*)[\"')])?\s*\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_CODE_SPAN = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")
_INLINE_HTML = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def _plain(text: str) -> str:
    """Inline Markdown as text: markup goes, images go, code and links keep their words."""
    kept: list[str] = []

    def hold(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    text = text.replace("\x00", "\ufffd")
    text = _CODE_SPAN.sub(lambda m: hold(m[2].replace("\n", " ").strip() if m[2].strip() else m[2]), text)
    text = _ESCAPE.sub(lambda m: hold(m[1]), text)
    text = _IMAGE.sub("", text)
    text = _LINK.sub(r"\1", text)
    text = _AUTOLINK.sub(lambda m: hold(m[1]), text)
    text = _INLINE_HTML.sub("", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*"):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", text, flags=re.S)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text, flags=re.S)
    text = re.sub(r"(?: {2,}|\\)\n", "\n", text)
    from html import unescape

    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], unescape(text))


def _row(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


class _Blocks:
    """Block structure, line by line; containers are read as documents of their own with the lines' own numbers."""

    def __init__(self, source: list[str]) -> None:
        self.source, self.out = source, []

    def add(self, kind: str, content: str, first: int, last: int, level: int | None = None, raw: str | None = None, **meta) -> None:
        raw = "\n".join(self.source[first:last]) if raw is None else raw
        self.out.append({"type": kind, "content": content, "raw_content": raw, "start_line": first + 1, "end_line": last, "level": level, "metadata": meta})

    def inline(self, text: str, first: int, last: int, level: int | None, within: dict) -> None:
        for alt, src, title in _IMAGE.findall(_CODE_SPAN.sub("", text)):
            self.out.append({"type": "image", "content": alt, "raw_content": f"![{alt}]({src})", "metadata": {"src": src, "alt": alt, **({"title": title} if title else {})}})
        if words := _plain(text).strip():
            if level is not None:
                self.add("heading", words, first, last, level)
            elif "ordered" in within:
                self.add("list_item", words, first, last, **{k: v for k, v in within.items() if k != "quoted"}, **({"in_blockquote": True} if within.get("quoted") else {}))
            else:
                self.add("blockquote" if within.get("quoted") else "text", words, first, last)

    def read(self, lines: list[tuple[int, str]], within: dict) -> None:
        i = 0
        while i < len(lines):
            n, line = lines[i]
            if not line.strip():
                i += 1
                continue
            if line.startswith("    ") or line.startswith("\t"):
                j = i
                while j < len(lines) and (not lines[j][1].strip() or lines[j][1].startswith(("    ", "\t"))):
                    j += 1
                while not lines[j - 1][1].strip():
                    j -= 1
                body = [x[4:] if x.startswith("    ") else x[1:] if x.startswith("\t") else "" for _, x in lines[i:j]]
                self.add("code", "\n".join(body) + "\n", n, lines[j - 1][0] + 1)
                i = j
            elif m := _FENCE.match(line):
                if m[2][0] == "`" and "`" in m[3]:
                    i = self.paragraph(lines, i, within)
                    continue
                close = re.compile(rf" {{0,3}}{m[2][0]}{{{len(m[2])},}}[ \t]*$")
                j = next((k for k in range(i + 1, len(lines)) if close.match(lines[k][1])), len(lines))
                body = [re.sub(rf"^ {{0,{len(m[1])}}}", "", x) for _, x in lines[i + 1 : j]]
                info = _plain(m[3].strip()) if m[3].strip() else ""
                last = lines[j][0] + 1 if j < len(lines) else lines[-1][0] + 1
                self.add("code", "".join(x + "\n" for x in body), n, last, **({"language": info} if info else {}))
                i = j + 1
            elif m := _ATX.match(line):
                self.inline(m[2] or "", n, n + 1, len(m[1]), within)
                i += 1
            elif _RULE.match(line):
                self.add("hr", "---", n, n + 1)
                i += 1
            elif _QUOTE.match(line):
                j, inner = i, []
                while j < len(lines) and lines[j][1].strip():
                    q = _QUOTE.match(lines[j][1])
                    if not q and (_starts_block(lines[j][1]) or not inner or not inner[-1][1].strip()):
                        break
                    inner.append((lines[j][0], q[1] if q else lines[j][1]))
                    j += 1
                self.read(inner, {**{k: v for k, v in within.items() if k != "ordered" and k != "start"}, "quoted": True} if "ordered" not in within else {**within, "quoted": True})
                i = j
            elif (m := _BULLET.match(line)) and not _RULE.match(line):
                i = self.items(lines, i, m, within)
            elif _HTML_BLOCK.match(line):
                j = i
                while j < len(lines) and lines[j][1].strip():
                    j += 1
                content = "\n".join(x for _, x in lines[i:j]).strip()
                self.add("html", content, n, lines[j - 1][0] + 1, raw=content)
                i = j
            elif i + 1 < len(lines) and "|" in line and _DELIMITER.match(lines[i + 1][1]) and len(_row(line)) == len(_row(lines[i + 1][1])):
                i = self.table(lines, i)
            else:
                i = self.paragraph(lines, i, within)

    def table(self, lines: list[tuple[int, str]], i: int) -> int:
        j = i + 2
        while j < len(lines) and lines[j][1].strip() and not _starts_block(lines[j][1]):
            j += 1
        header = _row(lines[i][1])
        rows = [(_row(x) + [""] * len(header))[: len(header)] for _, x in lines[i + 2 : j]]
        text = "\n".join([" | ".join(header), " | ".join("---" for _ in header), *(" | ".join(r) for r in rows)])
        self.add("table", text, lines[i][0], lines[j - 1][0] + 1, headers=header, rows=rows)
        return j

    def paragraph(self, lines: list[tuple[int, str]], i: int, within: dict) -> int:
        j, held = i, []
        while j < len(lines):
            line = lines[j][1]
            if not line.strip() or j > i and _starts_block(line) and not _SETEXT.match(line):
                break
            if j > i and (m := _SETEXT.match(line)):
                self.inline("\n".join(held), lines[i][0], lines[j][0] + 1, 1 if m[1][0] == "=" else 2, within)
                return j + 1
            held.append(line.lstrip() if j + 1 < len(lines) and lines[j + 1][1].strip() else line.strip())
            j += 1
        self.inline("\n".join(held), lines[i][0], lines[j - 1][0] + 1, None, within)
        return j

    def items(self, lines: list[tuple[int, str]], i: int, m: re.Match, within: dict) -> int:
        """One list: items of the same kind of marker, each with the lines indented under it."""
        mark = lambda x: x[2][-1]
        kind, ordered = mark(m), m[3] is not None
        inside = {"ordered": ordered, **({"start": int(m[3])} if ordered else {}), **({"quoted": True} if within.get("quoted") else {})}
        while i < len(lines):
            m = _BULLET.match(lines[i][1])
            if not m or mark(m) != kind or (m[3] is not None) != ordered or _RULE.match(lines[i][1]):
                break
            pad = len(m[4]) if m[4] and len(m[4]) <= 4 else 1
            width = len(m[1]) + len(m[2]) + pad
            inner = [(lines[i][0], (m[5] or "") if not m[4] or len(m[4]) <= 4 else m[4][1:] + (m[5] or ""))]
            i += 1
            while i < len(lines):
                line = lines[i][1]
                if line.strip() and len(line) - len(line.lstrip(" ")) >= width:
                    inner.append((lines[i][0], line[width:]))
                elif not line.strip():
                    after = next((x for _, x in lines[i + 1 :] if x.strip()), "")
                    if len(after) - len(after.lstrip(" ")) < width and not _BULLET.match(after):
                        break
                    inner.append((lines[i][0], ""))
                elif _starts_block(line) or _BULLET.match(line) or not inner[-1][1].strip():
                    break
                else:
                    inner.append((lines[i][0], line.lstrip()))
                i += 1
            while inner and not inner[-1][1].strip() and len(inner) > 1:
                inner.pop()
            self.read(inner, inside)
        return i


def _starts_block(line: str) -> bool:
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or ((m := _BULLET.match(line)) and (m[5] or "").strip() and (m[3] is None or m[3] == "1")))


def parse_markdown(text: str) -> Iterator[dict]:
    """CommonMark blocks and tables with their lines."""
    blocks = _Blocks(text.splitlines())
    blocks.read(list(enumerate(blocks.source)), {})
    yield from blocks.out

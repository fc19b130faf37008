"""Tables as text: arrays of rows to Markdown and HTML, and Markdown tables to key-value records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _padded(row: Column, header: Column) -> Column:
    """Short rows are filled with empty cells, long ones stay."""
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(F.size(header) - F.size(row), F.lit(0))))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown(rows: Column, pad: bool = True) -> Column:
    """An array of arrays of cells, the header first, as a Markdown table."""
    header = F.element_at(rows, 1)
    rule = _line(F.array_repeat(F.lit("---"), F.size(header)))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: _line(_padded(r, header) if pad else r))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(_line(header), rule), body), "\n")).otherwise("")


def html(rows: Column) -> Column:
    """The same rows as an HTML table, cells unescaped."""
    header = F.element_at(rows, 1)
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), "")
    body = F.transform(
        F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.concat(F.lit("    <tr>"), cells(_padded(r, header), "td"), F.lit("</tr>"))
    )
    head = F.concat(F.lit("  <thead>\n    <tr>"), cells(header, "th"), F.lit("</tr>\n  </thead>"))
    whole = F.concat(F.array(F.lit("<table border='1'>"), head, F.lit("  <tbody>")), body, F.array(F.lit("  </tbody>\n</table>")))
    return F.when(F.size(rows) > 0, F.array_join(whole, "\n")).otherwise("<table></table>")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def records(table: Column) -> Column:
    """Key-value records of a Markdown table whose lines begin with a bar.

    Lines with ``---`` are rules; a row counts only with as many cells as the
    header; empty header cells give no key, and of equal keys the last wins.
    """
    trimmed = F.transform(F.split(table, "\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    held = F.filter(trimmed, lambda x: x.startswith("|"))
    keys = _cells(F.element_at(held, 1))
    rows = F.filter(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), lambda x: ~x.contains("---") & ~x.rlike(r"^\|[\s:\-]+\|$"))
    rows = F.filter(F.transform(rows, _cells), lambda r: F.size(r) == F.size(keys))
    last = F.transform(keys, lambda k, i: (k != "") & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k))
    # A key keeps its first place and takes its last value.
    wanted = F.array_distinct(F.filter(keys, lambda k: k != ""))
    value = lambda r, k: F.element_at(F.filter(F.arrays_zip(keys.alias("k"), r.alias("v"), last.alias("l")), lambda x: (x["k"] == k) & x["l"]), 1)["v"]
    maps = F.transform(rows, lambda r: F.map_from_arrays(wanted, F.transform(wanted, lambda k: value(r, k))))
    none = F.array().cast("array<map<string,string>>")
    return F.when((F.size(held) >= 2) & (F.size(wanted) > 0), maps).otherwise(none)

"""Boxes on pages, and locations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_box(box: Column, width: Column, height: Column) -> Column:
    """[x0, y0, x1, y1] as shares of the page, four decimals; a size of 0 counts as 1."""
    w, h = (F.when(F.coalesce(x, F.lit(0)) == 0, 1.0).otherwise(x.cast("double")) for x in (width, height))
    return F.array(*(F.round(box[k] / (w if k % 2 == 0 else h), 4) for k in range(4)))


def corners_box(points: Column, width: Column, height: Column) -> Column:
    """The box around corner points (arrays of x and y), kept within the page."""
    share = lambda k, size: F.transform(points, lambda p: p[k] / size)
    kept = lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 4)
    xs, ys = share(0, width), share(1, height)
    return F.array(kept(F.array_min(xs)), kept(F.array_min(ys)), kept(F.array_max(xs)), kept(F.array_max(ys)))


def in_margin(box: Column, header: float = 0.15, footer: float = 0.85) -> Column:
    """Whether a box of four numbers touches the page's upper or lower margin."""
    return F.coalesce((F.size(box) == 4) & ((box[1] <= header) | (box[3] >= footer)), F.lit(False))


def is_scanned(page_text: Column, n_images: Column, least: int = 20) -> Column:
    """Whether a page is a scan: hardly any text, and pictures."""
    from .text import strip

    return F.coalesce((F.length(strip(F.coalesce(page_text, F.lit("")))) < least) & (n_images > 0), F.lit(False))


def frame_rate(ratio: Column) -> Column:
    """Frames a second of a ratio like 30000/1001, two decimals; a denominator of 0 counts as 1."""
    parts = F.split(ratio, "/")
    return F.when(F.size(parts) == 2, F.round(parts[0].try_cast("double") / F.greatest(parts[1].try_cast("double"), F.lit(1.0)), 2))


def badge(location: Column) -> Column:
    """A location in a few words: lines, else page and box, else selector, else time."""
    loc = lambda k: location.getField(k)
    number = lambda c: F.regexp_replace(F.format_string("%.2f", F.floor(c * 100 + 0.5) / 100), r"\.?0+$", "")
    span = F.when(loc("end_line").isNotNull(), F.concat(F.lit("L"), loc("start_line"), F.lit("-L"), loc("end_line"))).otherwise(F.concat(F.lit("L"), loc("start_line")))
    box = F.when(loc("bbox").isNotNull(), F.concat(F.lit(" · bbox["), F.array_join(F.transform(loc("bbox"), number), ", "), F.lit("]"))).otherwise("")
    time = lambda c: F.format_string("%.1fs", c)
    times = F.when(loc("end_time").isNotNull(), F.concat(time(loc("start_time")), F.lit(" ~ "), time(loc("end_time")))).otherwise(time(loc("start_time")))
    return (
        F.when(loc("start_line").isNotNull(), span)
        .when(loc("page_number").isNotNull(), F.concat(F.lit("第 "), loc("page_number"), F.lit(" 页"), box))
        .when(F.coalesce(loc("selector"), F.lit("")) != "", loc("selector"))
        .when(loc("start_time").isNotNull(), times)
    )

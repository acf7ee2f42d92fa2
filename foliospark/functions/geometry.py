"""Column functions on boxes (x0, y0, x1, y1 in points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


def width(b) -> Column:
    return b[2] - b[0]


def height(b) -> Column:
    return b[3] - b[1]


def area(b) -> Column:
    return width(b) * height(b)


def center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def aspect(b) -> Column:
    return F.when(height(b) > 0, width(b) / height(b)).otherwise(0.0)


def contains(a, b) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def overlaps(a, b) -> Column:
    return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])


def intersection(a, b) -> Column:
    """Area in common; touching boxes have none."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a, b) -> Column:
    common = intersection(a, b)
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def coverage(a, b) -> Column:
    """Share of a that b covers."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def paper_format(w: Column, h: Column, within: float = 5) -> Column:
    near = lambda x, y: (F.abs(w - x) < within) & (F.abs(h - y) < within)
    return F.when(near(595, 842), "a4").when(near(612, 792), "letter").otherwise("custom")


def line_role(y0: Column, page_height, kind: Column) -> Column:
    rel = y0 / page_height
    role = F.when(rel < 0.15, "header_line").when(rel > 0.9, "footer_line").when(rel < 0.25, "title_underline").otherwise("section_separator")
    return F.when(kind == "horizontal", role).otherwise("decorative")


def box_role(b, page_height) -> Column:
    return F.when((b[1] / page_height < 0.4) & (height(b) / page_height > 0.1), "abstract_box").when((width(b) < 100) & (height(b) / page_height > 0.3), "sidebar").otherwise("decorative")


def image_role(b, page: Column, page_width, page_height, on_figure: Column) -> Column:
    """figure if it meets a detected figure; else logo, icon or figure by place and size."""
    x, y, w, h = b[0] / page_width, b[1] / page_height, width(b) / page_width, height(b) / page_height
    logo = (page == 0) & (((y < 0.15) & (w < 0.3) & (h < 0.1)) | (((x < 0.1) | (x > 0.8)) & (w < 0.2)))
    return F.when(on_figure, "figure").when(logo, "logo").when((w < 0.05) & (h < 0.05), "icon").otherwise("figure")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)

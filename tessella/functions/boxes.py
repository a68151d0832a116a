"""Box geometry, Column to Column.  Coordinates round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return F.greatest(low, F.least(high, x))


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one: on the double itself, not on its decimal form."""
    down = F.floor(x)
    rest = x - down
    return F.when(rest > 0.5, down + 1).when(rest < 0.5, down).otherwise(down + F.pmod(down, F.lit(2)))


def grid_box(x: Column, y: Column, w: Column, h: Column, width: int = 1920, height: int = 1080) -> Column:
    """[x1, y1, x2, y2] on a grid of 0 to 1000, of a box in pixels."""

    def at(value: Column, size: int) -> Column:
        return clip(half_even(value / F.lit(float(size)) * 1000), 0, 1000).cast("int")

    return F.array(at(x, width), at(y, height), at(x + w, width), at(y + h, height))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: int = 1920, height: int = 1080) -> Column:
    """[x1, y1, x2, y2] in whole pixels inside the frame."""
    x1, y1 = clip(half_even(x), 0, width - 2), clip(half_even(y), 0, height - 2)
    return F.array(x1.cast("int"), y1.cast("int"), clip(half_even(x + w), x1 + 1, width).cast("int"), clip(half_even(y + h), y1 + 1, height).cast("int"))


def degenerate(box: Column) -> Column:
    """A pixel box of one pixel or none in a direction."""
    return ~((box[2] > box[0] + 1) & (box[3] > box[1] + 1))


def even(x: Column) -> Column:
    return x - F.pmod(x, F.lit(2))


def crop_square(x1: Column, y1: Column, x2: Column, y2: Column, width: int = 1920, height: int = 1080, padding: float = 0.35) -> tuple[Column, Column, Column]:
    """(side, left, top) of the padded square around a box: even, inside the frame, 96 pixels or more."""
    side = F.greatest(x2 - x1, y2 - y1, F.lit(2))
    side = F.least(F.greatest(half_even(side * (1.0 + max(padding, 0.0) * 2.0)), F.lit(96)), F.lit(width), F.lit(height)).cast("long")
    left = even(clip(half_even((x1 + x2) / 2.0 - side / 2.0).cast("long"), 0, F.lit(width) - side))
    top = even(clip(half_even((y1 + y2) / 2.0 - side / 2.0).cast("long"), 0, F.lit(height) - side))
    side = even(side)
    left = F.when(left + side > width, even(F.greatest(F.lit(0), width - side))).otherwise(left)
    top = F.when(top + side > height, even(F.greatest(F.lit(0), height - side))).otherwise(top)
    return side, left, top


def box_similarity(ax: Column, ay: Column, a_area: Column, bx: Column, by: Column, b_area: Column) -> Column:
    """1 for equal centres and areas, falling with distance (900) and difference of area (500000), 0 at least."""
    distance = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return F.greatest(F.lit(0.0), 1.0 - distance / 900.0 - F.abs(a_area - b_area) / 500000.0)


def example_score(query: dict[str, Column], example: dict[str, Column]) -> Column:
    """How well a caption example fits a query: 100 for the phase, 30 for the view, 12 for the scenario type, 10 and 7 for like boxes.

    Both hold ``phase, view, scenario_type`` and, as structs of ``cx, cy, area``
    or null, ``pedestrian`` and ``vehicle``; nulls of one name are equal.
    """
    score = F.lit(0.0)
    for name, points in (("phase", 100.0), ("view", 30.0), ("scenario_type", 12.0)):
        score = score + F.when(query[name].eqNullSafe(example[name]), points).otherwise(0.0)
    for role, points in (("pedestrian", 10.0), ("vehicle", 7.0)):
        a, b = query[role], example[role]
        score = score + F.coalesce(points * box_similarity(a.cx, a.cy, a.area, b.cx, b.cy, b.area), F.lit(0.0))
    return score

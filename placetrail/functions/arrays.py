"""Column expressions on vectors and images kept as arrays, and on the numbers and texts of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetrail.plans.presets import Preset


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def linf(a: Column, b: Column) -> Column:
    """Chebyshev distance: what the pairwise kernel gives on descriptors that keep trailing axes."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def matches(d: Column, preset: Preset) -> Column:
    """The threshold of a preset, with its strict lower bound if it has one."""
    near = d <= preset.limit
    return near if preset.min_part is None else near & (d > preset.min_part * preset.limit)


def argmax(x: Column) -> Column:
    """Index from 0 of the largest element, the first one on ties."""
    return F.array_position(x, F.array_max(x)) - 1


def scale_pixels(x: Column) -> Column:
    """Levels 0..255 to 0..1."""
    return F.transform(x, lambda v: v.cast("double") / 255)


def normalize(x: Column, mean: float = 0.36, std: float = 0.28) -> Column:
    return F.transform(x, lambda v: (v.cast("double") - mean) / std)


def grid(x: Column, width: int) -> Column:
    """A flat image as an array of rows."""
    rows = F.sequence(F.lit(0), F.floor(F.size(x) / width).cast("int") - 1)
    return F.transform(rows, lambda r: F.slice(x, r * width + 1, F.lit(width)))


def crop(x: Column, size: int, top: int, left: int, height: int, width: int) -> Column:
    """A window of a flat square image, row by row; what lies beyond the image is 0."""
    def pixel(row: Column, column: Column) -> Column:
        inside = (row >= 0) & (row < size) & (column >= 0) & (column < size)
        return F.when(inside, F.get(x, row * size + column).cast("double")).otherwise(0.0)

    rows, columns = F.sequence(F.lit(top), F.lit(top + height - 1)), F.sequence(F.lit(left), F.lit(left + width - 1))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: pixel(r, c))))


def image_number(preset: Preset, chunk: Column, i: Column) -> Column:
    """The number that a report gives to frame ``i`` of ``chunk`` (0-based), as text: ``123`` or, if halved, ``61.0``."""
    if preset.offsets is not None:
        offset = F.get(F.array(*(F.lit(o).cast("int") for o in preset.offsets)), chunk.cast("int"))
        return F.coalesce(F.floor((i + offset) / 2), i).cast("bigint").cast("string")
    raw = (chunk + preset.base) * preset.stride + i
    return F.bround(raw / F.lit(2.0), 0).cast("string") if preset.halve else raw.cast("bigint").cast("string")


def report_record(preset: Preset, number: Column) -> Column:
    """The text of one reported revisit in the preset's format."""
    if preset.report == "a":
        return F.concat(F.lit("\n Found loop\n image: "), number)
    if preset.report == "b":
        return F.concat(F.lit("Found loop\n image: "), number, F.lit("\n"))
    return F.concat(F.lit("\n Found loop\n"), number)

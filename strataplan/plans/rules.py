"""Class, matching and naming rules as Column expressions. The detection, the sinks and the queries call the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a section up to so many times its width is a column, a longer one a wall (EN 1992-1-1 5.3.1(7)).
EC2_RATIO = 4.0


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def is_column_section(length: Column, width: Column) -> Column:
    return length <= EC2_RATIO * width


def column_section_cm(length: Column, width: Column) -> Column:
    """The same on whole centimetres, as clustering sees it."""
    w = F.bround(width * 100)
    return (w > 0) & (F.bround(length * 100) <= EC2_RATIO * w)


def thin_fill(area: Column, perimeter: Column, most: Column) -> Column:
    """Is a bent fill, taken as a strip, no thicker than ``most``?"""
    return 2 * area / perimeter <= most


def wall_like(kind: Column, length: Column, width: Column, usual: Column, dots: Column, piece: Column) -> Column:
    """Hatched areas, set-aside pieces, solids longer than twice their width and not thicker than twice the usual wall,
    and outlines of wall section with a pattern inside."""
    thin = width <= 2 * usual
    return (
        (kind == "cross_hatch") | piece | ((kind == "solid") & thin & (length >= 2 * width))
        | ((kind == "outline") & (width > 0) & ~is_column_section(length, width) & thin & (dots >= 1))
    )


def open_to_wall_rule(cls: Column, key: Column, printed: Column, piece: Column) -> Column:
    """No class, or a wall class that no printed type confirms."""
    return ~printed & (piece | cls.isNull() | (cls == "core_wall") | ((cls == "shear_wall") & key.isNull()))


def wall_class(on_perimeter: Column, on_strip: Column) -> Column:
    """An unlabelled wall: retaining on the building's edge or on a strip, else core."""
    return F.when(on_perimeter | on_strip, "retaining_wall").otherwise("core_wall")


def classes_named(kind: Column, label_class: dict) -> Column:
    """Classes that a label of this kind can name; a compound label names the strip and the wall in it."""
    both = F.array(F.lit("strip_footing"), F.lit("retaining_wall"))
    return F.when(kind == "retaining_wall+strip_footing", both).otherwise(F.array(lookup(label_class, kind)))


def compatibility(agrees: Column, at_home: Column, named: Column, cls: Column, voted: Column, near_family: Column, families: Column, penalty: float) -> Column:
    """Extra cost of a label on an object; null forbids it.

    named: classes the label can name, ``families`` theirs; near_family: of the nearest cluster that labels named.
    """
    return (
        F.when(~agrees | ~at_home, None).when(F.array_contains(named, cls), 0.0).when(voted & cls.isNotNull(), None)
        .when(near_family.isNull() | F.array_contains(families, near_family), penalty)
    )


def checked(cost: Column, length: Column, width: Column, type_length: Column, type_width: Column, tolerance: float, size_penalty: float, own: Column, region: Column, region_penalty: float) -> Column:
    """``cost``, dearer where the object has not its type's size, or stands in another building's region."""
    other = (F.abs(length - type_length) > tolerance) | (F.abs(width - type_width) > tolerance)
    return cost + F.when(F.coalesce(other, F.lit(False)), size_penalty).otherwise(0.0) + F.when(F.coalesce(own != region, F.lit(False)), region_penalty).otherwise(0.0)


def misalignment(direction: Column, text_length: Column, degrees: Column, length: Column, width: Column) -> Column:
    """Sine between a text and a long object; 0 where the text's direction is unknown or the object shorter than the text."""
    long_ = direction.isNotNull() & degrees.isNotNull() & (length >= 2 * width) & (length >= F.coalesce(text_length, F.lit(0.0)))
    return F.when(long_, F.abs(F.sin(direction - F.radians(degrees)))).otherwise(0.0)


def fits_size(length: Column, width: Column, type_length: Column, type_width: Column, width_only: Column, length_tol: float, width_tol: float) -> Column:
    return (F.abs(width - type_width) <= width_tol) & (width_only | (F.abs(length - type_length) <= length_tol))


def building_of(own: Column, dominant: Column, in_region: Column, anywhere: Column) -> Column:
    """An element's building: its own label's, its region's, that of the nearest labels there, that of the nearest at all."""
    return F.coalesce(own, dominant, in_region, anywhere)


def display_text(word: Column, key: Column, inferred: Column, length: Column, width: Column, area: Column, boxy: Column) -> Column:
    """Class in words, type (~ where inferred), size, and the area of what is not a box."""
    size = F.format_string("%.2f × %.2f m", length, width)
    size = F.when(boxy, size).otherwise(F.concat(size, F.format_string(", %.1f m²", area)))
    return F.concat_ws(" ", word, F.when(key != "", F.concat(F.when(inferred, "~").otherwise(""), key)), size)


def group_tag(cluster: Column) -> Column:
    return F.concat(F.lit("C"), F.coalesce(cluster.cast("string"), F.lit("?")))

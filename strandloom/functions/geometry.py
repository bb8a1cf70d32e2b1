"""Geometry as column expressions, so that it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radians by which a line has to differ from the right angle to the view direction.
ANGLE_MARGIN = 0.5235987755982988
HALF_PI = 1.5707963267948966
SAMPLE_PLACES = (0.1, 0.3, 0.5, 0.7, 0.9)


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """The 3 x 3 rotation of a unit quaternion (w, x, y, z), row by row."""
    two = F.lit(2.0)
    return [
        [1 - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)],
        [two * (x * y + w * z), 1 - two * (x * x + z * z), two * (y * z - w * x)],
        [two * (x * z - w * y), two * (y * z + w * x), 1 - two * (x * x + y * y)],
    ]


def quaternion(r: list[list[Column]]) -> list[Column]:
    """The unit quaternion (w, x, y, z) of a rotation, w not negative: sizes from the diagonal, signs from the other entries."""
    two, one = F.lit(0.5), F.lit(1.0)
    size = lambda a, b, c: two * F.sqrt(F.greatest(F.lit(0.0), one + a * r[0][0] + b * r[1][1] + c * r[2][2]))
    w, x, y, z = size(1, 1, 1), size(1, -1, -1), size(-1, 1, -1), size(-1, -1, 1)
    # the largest part is known best; the others follow from it, and then the sign of all
    top = F.greatest(w, x, y, z)
    of = lambda i, j, k: (r[i][j] + k * r[j][i]) / (4 * top)
    wx, wy, wz, xy, xz, yz = of(2, 1, -1), of(0, 2, -1), of(1, 0, -1), of(1, 0, 1), of(0, 2, 1), of(2, 1, 1)
    cases = [(w == top, [w, wx, wy, wz]), (x == top, [wx, x, xy, xz]), (y == top, [wy, xy, y, yz]), (F.lit(True), [wz, xz, yz, z])]
    parts = [F.coalesce(*(F.when(ok, row[i]) for ok, row in cases)) for i in range(4)]
    return [F.when(parts[0] < 0, -p).otherwise(p) for p in parts]


def pose(quaternion: tuple[Column, ...], translation: tuple[Column, ...], scale: float = 1.0) -> tuple[list[list[Column]], list[Column]]:
    """Camera-to-world rotation (the transpose) and camera centre ``-R t / scale``."""
    r = rotation(*quaternion)
    turned = [[r[j][i] for j in range(3)] for i in range(3)]
    centre = [-(turned[i][0] * translation[0] + turned[i][1] * translation[1] + turned[i][2] * translation[2]) / F.lit(float(scale)) for i in range(3)]
    return turned, centre


def moved(r: list[list[Column]], t: list[Column], p: list[Column]) -> list[Column]:
    """``R p + T``."""
    return [r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3)]


def norm(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def angle(a: list[Column], b: list[Column]) -> Column:
    """The angle between two vectors; NULL for a zero vector."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cosine = F.try_divide(dot, norm(a) * norm(b))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def base_name(name: Column) -> Column:
    """A file name up to its first dot, without folders."""
    return F.element_at(F.split(F.substring_index(name, ".", 1), "/"), -1)


def clipped(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(v, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def half_even(v: Column) -> Column:
    return F.bround(v, 0).cast("int")


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance in the plane; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, squared)))
    t = F.when(squared == 0, 0.0).otherwise(t)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def line_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Least of the four endpoint-to-segment distances; it is not 0 for segments that merely cross."""
    return F.least(
        point_segment_distance(a[0], a[1], *b), point_segment_distance(a[2], a[3], *b),
        point_segment_distance(b[0], b[1], *a), point_segment_distance(b[2], b[3], *a),
    )


def colour(key: Column) -> list[Column]:
    """A stable colour for an id, each channel 50 to 255."""
    h = F.xxhash64(key)
    return [(F.pmod(F.shiftrightunsigned(h, 16 * i), F.lit(206)) + 50).cast("int") for i in range(3)]

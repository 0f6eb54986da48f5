"""Scalar numeric functions: geometry, rotation, permissions, dates, durations, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Reversed bounds are swapped."""
    return F.greatest(F.lit(float(min(lo, hi))), F.least(F.lit(float(max(lo, hi))), x))


def map_range(x: Column, lo: float, hi: float, to_lo: float, to_hi: float) -> Column:
    """A degenerate input range gives the start of the output range."""
    return F.lit(float(to_lo)) if lo == hi else F.lit(float(to_lo)) + (x - lo) * (to_hi - to_lo) / (hi - lo)


def points_to_pixels(points: Column, dpi: float, scale: float = 1.0) -> Column:
    return F.greatest(F.ceil(F.abs(points) * (dpi / 72.0) * scale - 1e-9), F.lit(1)).cast("bigint")


def rotation_exact(angle: Column) -> Column:
    """Multiples of 90; anything else is 0."""
    a = F.pmod(angle, F.lit(360))
    return F.when(a.isin(90, 180, 270), a).otherwise(F.lit(0))


def rotation_nearest(angle: Column) -> Column:
    """The nearest multiple of 90 (45, 135, 225 and 315 go up)."""
    a = F.pmod(angle, F.lit(360))
    return F.when(a < 45, 0).when(a < 135, 90).when(a < 225, 180).when(a < 315, 270).otherwise(0)


def worker_budget(workers: Column, in_flight: Column, page: Column) -> Column:
    wanted = F.when(workers <= 0, F.lit(4)).otherwise(workers).cast("bigint")
    limited = F.greatest(F.lit(1), F.least(wanted, F.floor(in_flight / page)))
    return F.when((in_flight <= 0) | (page <= 0), wanted).otherwise(limited).cast("bigint")


def has_permission(permissions: Column, flag: int) -> Column:
    """Any bit of ``flag`` is enough."""
    return permissions.bitwiseAND(F.lit(flag)) != 0


def duration_ms(text: Column) -> Column:
    """``12ms``, ``3.5s``, ``40us``, ``40µs`` as milliseconds; null for anything else."""
    value = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([a-zµ]+)\s*$", 1)
    return F.when(unit == "ms", value).when(unit.isin("us", "µs"), value / 1000).when(unit == "s", value * 1000)


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` with optional tail parts, as UTC; null if malformed."""
    body = F.regexp_replace(F.trim(text), r"^D:", "")
    shape = r"^(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?:?(\d{2})?'?)?$"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(body, shape, i), F.lit("")).try_cast("int"), F.lit(default))
    local = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(1, 0), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0)), F.lit("yyyy-MM-dd HH:mm:ss"))
    shift = (part(9, 0) * 60 + part(10, 0)) * F.when(F.regexp_extract(body, shape, 8) == "-", -1).otherwise(1)
    return F.when(body.rlike(shape), F.timestamp_seconds(F.unix_timestamp(local) - shift * 60))


def matrix_multiply(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Affine matrices of six entries, row vectors on the left."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def apply_matrix(m: Sequence[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def device_points(points: Column, zoom: float) -> Column:
    return F.transform(points, lambda p: F.round(p * zoom).cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def text_advance(width: Column, units: float, size: Column, char_space: Column, word_space: Column, is_space: Column, scale: float) -> Column:
    return (width / units * size + char_space + F.when(is_space, word_space).otherwise(0.0)) * scale


# --- interpolation functions ---


def exponential(x: Column, c0: Sequence[float], c1: Sequence[float], exponent: float, domain: tuple[float, float] | None = None, ranges: Sequence[tuple[float, float]] = ()) -> list[Column]:
    """c0 + (c1 - c0) * x ** exponent a component; a missing coefficient repeats the last one."""
    x = clamp(x, *domain) if domain else x
    pick = lambda values, i: (values[i] if i < len(values) else values[-1]) if values else 0.0
    out = []
    for i in range(max(len(c0), len(c1))):
        a, b = pick(c0, i), pick(c1, i)
        y = F.lit(float(a)) + (x if exponent == 1 else F.pow(x, F.lit(float(exponent)))) * (b - a)
        out.append(clamp(y, *ranges[i]) if i < len(ranges) else y)
    return out


def stitching(x: Column, bounds: Sequence[float], encode: Sequence[tuple[float, float]], functions: Sequence, domain: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Segments [d0, b1), [b1, b2), ..., the last one closed; ``functions`` map an encoded input to a Column."""
    x = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for i in reversed(range(len(functions))):
        lo, hi = edges[i], edges[i + 1]
        e = encode[i] if i < len(encode) else (0.0, 1.0)
        y = functions[i](F.lit(float(e[0])) + (x - lo) * (e[1] - e[0]) / (hi - lo) if hi > lo else F.lit(float(e[0])))
        out = y if out is None else F.when(x < hi, y).otherwise(out)
    return out


def segment(x: Column, bounds: Sequence[float]) -> Column:
    """Index of the segment of x: the number of bounds not above it."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def sampled(x: Column, samples: Sequence[float], domain: tuple[float, float], encode: tuple[float, float] | None = None, decode: tuple[float, float] = (0.0, 1.0), interpolate: bool = True) -> Column:
    """One-dimensional table with optional linear interpolation."""
    n = len(samples)
    encode = encode or (0.0, float(n - 1))
    at = clamp(clamp(map_range(clamp(x, *domain), *domain, *encode), *encode), 0.0, n - 1.0)
    table = F.array(*[F.lit(float(s)) for s in samples])
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.element_at(table, low + 1), F.element_at(table, high + 1)
    return map_range(a + (b - a) * (at - F.floor(at)) if interpolate else a, 0.0, 1.0, *decode)


def text_adjustment(amount: Column, size: Column, scale: float) -> Column:
    """Shift of a number between strings, in thousandths of the size; a size of 0 counts as 12."""
    return -amount / 1000.0 * F.when(size == 0, 12.0).otherwise(size) * scale

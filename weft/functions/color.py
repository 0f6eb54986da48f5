"""Colour conversion and blend modes on byte channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Red, green and blue of the sixteen corners of the CMYK cube (c, m, y, k as bits).
CMYK_CORNERS = {
    "0000": (1.0, 1.0, 1.0),
    "0001": (0.1373, 0.1216, 0.1255),
    "0010": (1.0, 0.9490, 0.0),
    "0011": (0.1098, 0.1020, 0.0),
    "0100": (0.9255, 0.0, 0.5490),
    "0101": (0.1412, 0.0, 0.0),
    "0110": (0.9294, 0.1098, 0.1412),
    "0111": (0.1333, 0.0, 0.0),
    "1000": (0.0, 0.6784, 0.9373),
    "1001": (0.0, 0.0588, 0.1412),
    "1010": (0.0, 0.6510, 0.3137),
    "1011": (0.0, 0.0745, 0.0),
    "1100": (0.1804, 0.1922, 0.5725),
    "1101": (0.0, 0.0, 0.0078),
    "1110": (0.2118, 0.2119, 0.2235),
    "1111": (0.0, 0.0, 0.0),
}
#: Weights of 1, C, M, Y, K, C*K, M*K, Y*K for red, green and blue.
CMYK_POLYNOMIAL = (
    (0.99412, -1.01945, 0.09885, 0.00176, -0.85751, 0.90037, -0.10026, -0.00469),
    (0.98816, -0.32538, -0.73457, 0.00482, -0.86602, 0.27482, 0.69371, -0.00605),
    (0.99914, -0.10143, -0.33403, -0.97694, -0.87181, 0.12979, 0.19228, 0.88703),
)
#: XYZ to RGB for the D50 and D65 white points.
XYZ_D50 = ((3.1339, -1.617, -0.4906), (-0.9785, 1.916, 0.0333), (0.072, -0.229, 1.4057))
XYZ_D65 = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.204, 1.057))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fixed_point(x: Column) -> Column:
    """A component in 1/65536 steps, truncated."""
    return F.floor(_unit(x) * 65536).cast("bigint")


def fixed_to_byte(col: Column) -> Column:
    return F.shiftright(F.shiftleft(col, 8) - col + 0x8000, 16).cast("int")


def component_to_byte(x: Column) -> Column:
    return fixed_to_byte(fixed_point(x))


def _corners(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    out = []
    for channel in range(3):
        total = None
        for bits, rgb in CMYK_CORNERS.items():
            if rgb[channel]:
                weight = None
                for bit, v in zip(bits, (c, m, y, k)):
                    part = v if bit == "1" else 1 - v
                    weight = part if weight is None else weight * part
                term = weight if rgb[channel] == 1.0 else weight * rgb[channel]
                total = term if total is None else total + term
        out.append(_unit(total))
    return out


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Operator colours: components and results pass through 16.16 fixed point."""
    quantised = [fixed_point(v) / 65536.0 for v in (c, m, y, k)]
    return [component_to_byte(v) for v in _corners(*quantised)]


def cmyk_bytes_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Image samples: bytes in, bytes out, halves rounded up."""
    return [F.floor(v * 255.0 + 0.5).cast("int") for v in _corners(*[v / 255.0 for v in (c, m, y, k)])]


def cmyk_polynomial(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    c, m, y, k = (v / 255.0 for v in (c, m, y, k))
    terms = (None, c, m, y, k, c * k, m * k, y * k)
    out = []
    for weights in CMYK_POLYNOMIAL:
        total = F.lit(weights[0])
        for w, t in zip(weights[1:], terms[1:]):
            total = total + t * w
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), F.round(total * 255.0))).cast("int"))
    return out


def lab_to_rgb(lightness: Column, a: Column, b: Column, white: Sequence[float] = (0.9505, 1.0, 1.0888), a_range: tuple[float, float] = (-100, 100), b_range: tuple[float, float] = (-100, 100)) -> list[Column]:
    """The transfer to bytes is a square root."""
    from weft.functions.numeric import clamp

    middle = (lightness + 16) / 116
    levels = (middle + clamp(a, *a_range) / 500, middle, middle - clamp(b, *b_range) / 200)
    # the inverse of the Lab curve: cubic above 6/29, linear below
    curve = lambda t: F.when(t >= 6.0 / 29.0, t * t * t).otherwise((t - 4.0 / 29.0) * (108.0 / 841.0))
    x, y, z = (curve(t) * w for t, w in zip(levels, white))
    rows = XYZ_D50 if white[2] < 1 else XYZ_D65
    return [F.round(F.least(F.lit(255.0), F.sqrt(F.greatest(x * r[0] + y * r[1] + z * r[2], F.lit(0.0))) * 255)).cast("int") for r in rows]


def gray_to_rgb(g: Column) -> list[Column]:
    return [component_to_byte(g)] * 3


def calibrated_gray(value: Column, gamma: float = 1.0, luminance: float = 1.0) -> list[Column]:
    """Gray of a gamma curve; lightness goes to bytes by a cube root, cut to whole numbers; a gamma below 1 counts as 1."""
    level = F.pow(value, F.lit(max(1.0, gamma))) * luminance
    byte = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.cbrt(level) * 295.8 - 40.8))
    return [F.floor(byte).cast("int")] * 3


#: Cone response of XYZ and back, XYZ (D65) to linear RGB, and the D65 white point.
TO_CONES = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
FROM_CONES = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
XYZ_TO_LINEAR = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
WHITE_D65 = (0.95047, 1.0, 1.08883)


def _product(*matrices: Sequence[Sequence[float]]) -> list[list[float]]:
    out = [list(row) for row in matrices[0]]
    for m in matrices[1:]:
        out = [[sum(row[k] * m[k][j] for k in range(3)) for j in range(3)] for row in out]
    return out


def _diagonal(values: Sequence[float]) -> list[list[float]]:
    return [[v if i == j else 0.0 for j in range(3)] for i, v in enumerate(values)]


def calibrated_rgb(values: Sequence[Column], white: Sequence[float] = (1.0, 1.0, 1.0), gamma: Sequence[float] = (1.0, 1.0, 1.0), matrix: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> list[Column]:
    """Linear light of a gamma curve, adapted from its white point to a flat one and on to D65, then to sRGB bytes.

    All steps but the curves are linear, so they are one matrix, made on the driver.  ``matrix`` is by rows of XYZ.
    """
    to_xyz = [matrix[i * 3 : i * 3 + 3] for i in range(3)]
    flat = _diagonal((1.0, 1.0, 1.0)) if white[0] == 1 and white[2] == 1 else _product(FROM_CONES, _diagonal([1.0 / w for w in white]), TO_CONES)
    whole = _product(XYZ_TO_LINEAR, FROM_CONES, _diagonal(WHITE_D65), TO_CONES, flat, to_xyz)
    light = [F.pow(_unit(v), F.lit(float(g))) for v, g in zip(values, gamma)]
    out = []
    for row in whole:
        level = sum(x * w for x, w in zip(light, row))
        curve = F.when(level <= 0.0031308, level * 12.92).when(level >= 0.99554525, F.lit(1.0)).otherwise(F.pow(F.greatest(level, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
        out.append(F.round(_unit(curve) * 255).cast("int"))
    return out


def separation(tint: Column, function, alternate) -> list[Column]:
    """A tint's colour: ``function`` (tint to components) in the ``alternate`` space; without a function, the space's colour of 0."""
    return alternate(*function(tint)) if function is not None else alternate(F.lit(0.0))


#: Named spaces and what they make of their components; more are added with ``register_space``.
SPACES = {"DeviceGray": lambda g: gray_to_rgb(g), "DeviceRGB": lambda r, g, b: [component_to_byte(v) for v in (r, g, b)], "DeviceCMYK": lambda c, m, y, k: cmyk_to_rgb(c, m, y, k)}


def register_space(name: str, convert) -> None:
    SPACES[name] = convert


def color_space(spec):
    """The conversion of a space: a name, ``("Separation", function, alternate)``, ``("Indexed", base, top, table)``, ``("ICCBased", components)`` or ``("DeviceN", ...)``.

    A profile counts as the device space of its number of components, and several colorants as RGB.
    """
    if isinstance(spec, str):
        if spec not in SPACES:
            raise ValueError(f"unknown color space {spec}")
        return SPACES[spec]
    kind, *rest = spec
    if kind == "Separation":
        function, alternate = rest[0], color_space(rest[1])
        return lambda tint: separation(tint, function, alternate)
    if kind == "Indexed":
        base, top, table = color_space(rest[0]), rest[1], rest[2]
        width = len(table) // (top + 1)
        bytes_of = F.array(*[F.lit(float(b) / 255.0) for b in table])
        return lambda index: base(*[indexed(F.greatest(F.lit(0), F.least(F.lit(top), index.cast("int"))) * width + i, bytes_of, len(table) - 1) for i in range(width)])
    if kind == "ICCBased":
        return SPACES[{1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[rest[0]]]
    if kind == "DeviceN":
        return SPACES["DeviceRGB"]
    if kind in ("CalGray", "CalRGB"):
        return SPACES["DeviceGray" if kind == "CalGray" else "DeviceRGB"]
    raise ValueError(f"unknown color space {kind}")


def indexed(index: Column, palette: Column, top: int) -> Column:
    """Palette entry; the index is clamped to 0..top."""
    return F.get(palette, F.greatest(F.lit(0), F.least(F.lit(top), index.cast("int"))))


def color_key_hidden(components: Column, lows: Sequence[int], highs: Sequence[int]) -> Column:
    """True if every component lies within its range; a count that differs is false."""
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(lows, highs)])
    return (F.size(components) == len(lows)) & F.forall(F.zip_with(components, ranges, lambda v, r: (v >= r["a"]) & (v <= r["b"])), lambda ok: F.coalesce(ok, F.lit(False)))


def decode_sample(value: Column, low: float, high: float, most: float, is_indexed: bool) -> Column:
    y = F.lit(float(low)) + value * (high - low) / most if is_indexed else F.lit(most * low) + value * (high - low)
    y = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), y))
    return F.round(y) if is_indexed else y


# --- blending, source over backdrop, bytes 0..255 ---


def div255(x: Column) -> Column:
    """Rounded division by 255 in integers."""
    return F.shiftright(x + F.shiftright(x, 8) + 0x80, 8)


def _int_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def _hard_light(s: Column, d: Column) -> Column:
    return F.when(s <= 127, div255(s * d * 2)).otherwise(s * 2 + d * 2 - div255(s * d * 2) - 255)


def _soft_light(s: Column, d: Column) -> Column:
    cs, cb = s / 255.0, d / 255.0
    lift = F.when(cb <= 0.25, ((cb * 16.0 - 12.0) * cb + 4.0) * cb).otherwise(F.sqrt(cb))
    out = F.when(cs <= 0.5, cb - (1.0 - cs * 2.0) * cb * (1.0 - cb)).otherwise(cb + (cs * 2.0 - 1.0) * (lift - cb))
    return F.floor(_unit(out) * 255.0 + 0.5).cast("int")


SEPARABLE = {
    "normal": lambda s, d: s,
    "multiply": lambda s, d: _int_div(s * d, F.lit(255)),
    "screen": lambda s, d: s + d - div255(s * d),
    "overlay": lambda s, d: _hard_light(d, s),
    "darken": F.least,
    "lighten": F.greatest,
    "color_dodge": lambda s, d: F.when(s == 255, 255).otherwise(F.least(F.lit(255), _int_div(d * 255, F.greatest(255 - s, F.lit(1))))),
    "color_burn": lambda s, d: F.when(s == 0, 0).otherwise(255 - F.least(F.lit(255), _int_div((255 - d) * 255, F.greatest(s, F.lit(1))))),
    "hard_light": _hard_light,
    "soft_light": _soft_light,
    "difference": lambda s, d: F.abs(s - d),
    "exclusion": lambda s, d: s + d - div255(s * d) * 2,
}


def _lum(c: Sequence[Column]) -> Column:
    return c[0] * 0.3 + c[1] * 0.59 + c[2] * 0.11


def _sat(c: Sequence[Column]) -> Column:
    return F.greatest(*c) - F.least(*c)


def _set_sat(c: Sequence[Column], s: Column) -> list[Column]:
    """Stretch the three to span 0..s; a grey becomes black."""
    low, span = F.least(*c), _sat(c)
    return [F.when(span > 0, (v - low) * s / span).otherwise(F.lit(0.0)) for v in c]


def _at_level(c: Sequence[Column], level: Column) -> list[Column]:
    """The colour moved to a luminance, and pulled towards it until no channel is out of 0..1.

    A shift moves a colour's luminance to ``level`` and keeps its channels' distances from it, so both pulls are factors of these distances.
    """
    middle, low, high = _lum(c), F.least(*c), F.greatest(*c)
    below = F.when(low + level - middle < 0, F.when(middle == low, F.lit(0.0)).otherwise(level / (middle - low))).otherwise(F.lit(1.0))
    above = F.when(high + level - middle > 1, F.when(high == middle, F.lit(0.0)).otherwise((1 - level) / (high - middle))).otherwise(F.lit(1.0))
    return [level + (v - middle) * below * above for v in c]


#: colour whose channels are kept, colour that gives the saturation (or none), colour that gives the luminance
NON_SEPARABLE = {"hue": ("s", "d", "d"), "saturation": ("d", "s", "d"), "color": ("s", None, "d"), "luminosity": ("d", None, "s")}


def _non_separable(mode: str, s: Sequence[Column], d: Sequence[Column]) -> list[Column]:
    colour, spread, level = ({"s": s, "d": d}.get(x) for x in NON_SEPARABLE[mode])
    start = _set_sat(colour, _sat(spread)) if spread is not None else list(colour)
    return _at_level(start, _lum(level))


def blend(mode: str, source: Sequence[Column], backdrop: Sequence[Column]) -> list[Column]:
    if mode in SEPARABLE:
        return [SEPARABLE[mode](s, d).cast("int") for s, d in zip(source, backdrop)]
    s, d = [v / 255.0 for v in source], [v / 255.0 for v in backdrop]
    # rounding to 6 places first keeps exact halves apart from what floating point makes of them
    return [F.floor(F.round(_unit(v) * 255.0, 6) + 0.5).cast("int") for v in _non_separable(mode, s, d)]


def composite(mode_value: Column, source_alpha: Column, backdrop: Column) -> Column:
    """One channel of a blended source laid over its backdrop with an alpha byte."""
    return div255(mode_value * source_alpha + backdrop * (255 - source_alpha))

"""Colour arithmetic in columns: OKLab, contrast, colour-vision simulation, palette checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds, and the published matrices of colour-vision deficiency at severity 1.
BAND = {"light": (0.43, 0.77), "dark": (0.48, 0.67)}
CHROMA_FLOOR, CVD_TARGET, CVD_FLOOR, NORMAL_FLOOR, CONTRAST_MIN = 0.10, 8.0, 6.0, 15.0, 3.0
SURFACE = {"light": "#fcfcfb", "dark": "#1a1a19"}
DEFICIENCY = {
    "protan": ((0.152286, 1.052583, -0.204868), (0.114503, 0.786281, 0.099216), (-0.003882, -0.048116, 1.051998)),
    "deutan": ((0.367322, 0.860646, -0.227968), (0.280085, 0.672501, 0.047413), (-0.011820, 0.042940, 0.968881)),
    "tritan": ((1.255528, -0.076749, -0.178779), (-0.078411, 0.930809, 0.147602), (0.004733, 0.691367, 0.303900)),
}
#: The published OKLab matrices.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LUMINANCE = (0.2126, 0.7152, 0.0722)


def _dot(row, xs) -> Column:
    return sum((F.lit(k) * x for k, x in zip(row[1:], xs[1:], strict=True)), F.lit(row[0]) * xs[0])


def expand_gamma(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_rgb(colour: Column) -> tuple[Column, Column, Column]:
    """#rgb or #rrggbb to linear red, green, blue."""
    h = F.regexp_replace(colour, "^#+", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return tuple(expand_gamma(F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255) for i in (1, 3, 5))


def oklab(rgb) -> tuple[Column, Column, Column]:
    lms = [F.cbrt(_dot(row, rgb)) for row in TO_LMS]
    return tuple(_dot(row, lms) for row in TO_LAB)


def oklch(colour: Column) -> tuple[Column, Column, Column]:
    """Lightness, chroma, hue in degrees."""
    lightness, a, b = oklab(linear_rgb(colour))
    return lightness, F.hypot(a, b), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def luminance(colour: Column) -> Column:
    return _dot(LUMINANCE, linear_rgb(colour))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def simulate(colour: Column, kind: str) -> tuple[Column, Column, Column]:
    rgb = linear_rgb(colour)
    return tuple(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(row, rgb))) for row in DEFICIENCY[kind])


def delta_e(a: Column, b: Column, kind: str | None = None) -> Column:
    """100 x the distance in OKLab, as seen with a deficiency if one is named."""
    x, y = (oklab(simulate(c, kind) if kind else linear_rgb(c)) for c in (a, b))
    return 100 * F.sqrt(sum(((p - q) * (p - q) for p, q in zip(x[1:], y[1:], strict=True)), (x[0] - y[0]) * (x[0] - y[0])))


def validate(palette: DataFrame, mode: str = "light", surface: str | None = None, pairs: str = "adjacent") -> DataFrame:
    """(ord, check, status, worst) of palette(pos, colour): lightness band, chroma floor, separation with
    deficiencies, separation without, contrast. The contrast never fails, it only asks for relief.

    A palette is a handful of rows: pairs come from a self-join on positions.
    """
    lo, hi = BAND[mode]
    light, chroma, _ = oklch(F.col("colour"))
    ground = F.lit(surface or SURFACE[mode])
    singles = palette.agg(
        F.sum((~light.between(lo, hi)).cast("int")).alias("band"), F.min(chroma).alias("chroma"), F.min(contrast(F.col("colour"), ground)).alias("contrast"),
    )
    placed = palette.withColumn("k", F.row_number().over(Window.orderBy("pos")))
    a, b = placed.select(F.col("k").alias("i"), F.col("colour").alias("a")), placed.select(F.col("k").alias("j"), F.col("colour").alias("b"))
    cond = F.col("i") < F.col("j") if pairs == "all" else F.col("j") == F.col("i") + 1
    dist = {k: delta_e(F.col("a"), F.col("b"), k) for k in ("protan", "deutan", "tritan")}
    seps = a.join(b, cond).agg(F.coalesce(F.min(F.least(dist["protan"], dist["deutan"])), F.lit(99.0)).alias("cvd"), F.coalesce(F.min(dist["tritan"]), F.lit(99.0)).alias("tritan"), F.coalesce(F.min(delta_e(F.col("a"), F.col("b"))), F.lit(99.0)).alias("normal"))
    one = singles.crossJoin(seps)
    word = lambda cond, bad="fail": F.when(cond, F.lit("pass")).otherwise(F.lit(bad))
    cvd = F.when(F.col("cvd") >= CVD_TARGET, F.lit("pass")).when(F.col("cvd") >= CVD_FLOOR, F.lit("floor")).otherwise(F.lit("fail"))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("check"), s.alias("status"), w.cast("double").alias("worst")) for i, (n, s, w) in enumerate((
        ("lightness band", word(F.col("band") == 0), F.col("band")), ("chroma floor", word(F.col("chroma") >= CHROMA_FLOOR), F.col("chroma")), ("deficiency separation", cvd, F.col("cvd")),
        ("normal separation", word(F.col("normal") >= NORMAL_FLOOR), F.col("normal")), ("contrast", word(F.col("contrast") >= CONTRAST_MIN, "relief"), F.col("contrast")),
    ), 1)))
    return one.select(F.explode(rows).alias("x")).select("x.*")

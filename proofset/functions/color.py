"""Colour of pixels (r, g, b in 0..1 unless said otherwise) and measures of photos from pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# sRGB primaries to XYZ and back, D65 white, Rec. 709 luma, 601 gray, neutral skin.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)
GRAY = (0.299, 0.587, 0.114)
SKIN_HUE, SKIN_CHROMA = (30.0, 75.0), 55.0


def to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def _dot(weights, cols) -> Column:
    return weights[0] * cols[0] + weights[1] * cols[1] + weights[2] * cols[2]


def to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = [to_linear(v) for v in (r, g, b)]
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    x, y, z = (f(_dot(row, lin) / w) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def light_of_lab(L: Column, a: Column, b: Column) -> list[Column]:
    """Linear r, g and b, cut to 0..1."""
    y = (L + 16) / 116
    cube = lambda t: F.when(t > 6 / 29, t * t * t).otherwise((116 * t - 16) * 27 / 24389)
    xyz = [cube(t) * w for t, w in zip((y + a / 500, y, y - b / 200), WHITE, strict=True)]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(row, xyz))) for row in np.linalg.inv(np.array(TO_XYZ)).tolist()]


def from_lab(L: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(from_linear(v) for v in light_of_lab(L, a, b))


def luma(r: Column, g: Column, b: Column) -> Column:
    return _dot(LUMA, (r, g, b))


def gray8(r: Column, g: Column, b: Column) -> Column:
    return F.round(_dot(GRAY, (r, g, b))).cast("int")


def hue_chroma(a: Column, b: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(b, a)), F.hypot(a, b)


def skin_ok(hue: Column, chroma: Column) -> Column:
    return (chroma < 6) | (hue.between(SKIN_HUE[0] - 2, SKIN_HUE[1] + 2) & (chroma <= SKIN_CHROMA + 2))


def cast_fix(L: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """White-balance gains (array of 3, or NULL) that bring skin of this colour back, and the cast's name."""
    hue, chroma = hue_chroma(a, b)
    off, strong = ~hue.between(*SKIN_HUE), chroma > SKIN_CHROMA
    needed = (chroma >= 6) & (off | strong)
    new_hue = F.radians(F.when(off, F.when(hue < SKIN_HUE[0], SKIN_HUE[0] + 4).otherwise(SKIN_HUE[1] - 4)).otherwise(hue))
    new_chroma = F.when(strong, SKIN_CHROMA - 6).otherwise(chroma)
    goal = light_of_lab(L, new_chroma * F.cos(new_hue), new_chroma * F.sin(new_hue))
    now = [F.greatest(v, F.lit(1e-4)) for v in light_of_lab(L, a, b)]
    gain = F.array(*[g / n for g, n in zip(goal, now, strict=True)])
    level = lambda v: F.array(*[F.greatest(F.lit(0.75), F.least(F.lit(1.3), v[i] / _dot(LUMA, v))) for i in range(3)])
    gains = F.transform(F.array(gain), level)[0]  # the gains are named once, so each is worked out once
    name = F.when(~off, "warm/orange").when(hue < SKIN_HUE[0], "magenta/blue").otherwise("yellow-green")
    return F.when(needed, gains), F.when(needed, F.concat(F.lit("fixed a "), name, F.lit(" color cast")))


def in_cheek(x: Column, y: Column, eye: Column, mouth: Column, side: int, eye_distance: Column) -> Column:
    r = F.greatest(F.lit(2), F.floor(0.1 * eye_distance))
    cx, cy = ((eye[0] + mouth[0]) / 2 + side * 0.12 * eye_distance).cast("int"), ((eye[1] + mouth[1]) / 2).cast("int")
    return (x >= cx - r) & (x < cx + r) & (y >= cy - r) & (y < cy + r)


def in_inner_face(x: Column, y: Column, lm: Column, eye_distance: Column) -> Column:
    """Inside the quadrilateral from the brows to below the mouth, edges included."""
    d = eye_distance
    pts = [(lm[i][0] + fx * d, lm[i][1] + fy * d) for i, fx, fy in ((0, -0.35, -0.45), (1, 0.35, -0.45), (4, 0.2, 0.3), (3, -0.2, 0.3))]
    pts = [(px.cast("int"), py.cast("int")) for px, py in pts]
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]], strict=True):
        inside = inside & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
    return inside


def in_backdrop(x: Column, y: Column, width: Column, height: Column) -> Column:
    return (y < F.floor(height / 12)) & ((x < F.floor(width / 5)) | (x >= width - F.ceil(width / 5)))


def pixel_measures(pixels: DataFrame, key: tuple[str, ...] = ("photo_id",)) -> DataFrame:
    """Per photo, from rows of the inner face (x, y, r, g, b in 0..255, and r0, g0, b0 before the edit or NULL):
    face_blown, clipping_added, crushing_added, face_lightness_change over every fifth pixel, black and white."""
    now, was = luma(F.col("r"), F.col("g"), F.col("b")), luma(F.col("r0"), F.col("g0"), F.col("b0"))
    peak, peak0 = F.greatest("r", "g", "b"), F.greatest("r0", "g0", "b0")
    share = lambda c: F.avg(F.when(c.isNotNull(), c.cast("double")))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("y", "x"))
    lab = lambda *c: to_lab(*[F.col(n) / 255 for n in c])[0]
    rows = pixels.withColumn("_fifth", (nth - 1) % 5 == 0)
    return rows.groupBy(*key).agg(
        share(now >= 250).alias("face_blown"),
        share((peak >= 254) & (peak0 < 250)).alias("clipping_added"),
        share((now <= 3) & (was > 10)).alias("crushing_added"),
        F.avg(F.when(F.col("_fifth"), lab("r", "g", "b") - lab("r0", "g0", "b0"))).alias("face_lightness_change"),
        F.least(F.percentile(now / 255, 0.0005), F.lit(0.05)).alias("black_point"),
        F.greatest(F.percentile(peak / 255, 0.9995), F.lit(0.92)).alias("white_point"),
    )


def skin_lab(cheeks: DataFrame, key: tuple[str, ...] = ("photo_id",), least: int = 20) -> DataFrame:
    """Median Lab of cheek pixels with 20 < L < 92; NULL with fewer than `least` of them."""
    L, a, b = to_lab(*[F.col(c) / 255 for c in ("r", "g", "b")])
    rows = cheeks.select(*key, L.alias("L"), a.alias("a"), b.alias("b"))
    fine = (F.col("L") > 20) & (F.col("L") < 92)
    enough = F.count_if(fine) >= least
    return rows.groupBy(*key).agg(*[F.when(enough, F.median(F.when(fine, F.col(c)))).alias(f"skin_{c}") for c in ("L", "a", "b")])


def backdrop_luma(corners: DataFrame, key: tuple[str, ...] = ("photo_id",)) -> DataFrame:
    return corners.groupBy(*key).agg(F.median(gray8(F.col("r"), F.col("g"), F.col("b"))).alias("backdrop_luma"))


def decode_pixels(images: DataFrame, step: int = 1) -> DataFrame:
    """Rows (origin, width, height, x, y, r, g, b) of the image source's upright 8-bit pictures, every step-th pixel
    of every step-th row. The image source keeps bytes as B, G, R."""
    flat = images.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                px = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])[::step, ::step]
                y, x = np.indices(px.shape[:2])
                c = [px[..., min(k, row["channels"] - 1)].ravel().astype(np.int32) for k in ((2, 1, 0) if row["channels"] > 1 else (0, 0, 0))]
                n = x.size
                for at in range(0, n, 65536):
                    part = slice(at, min(n, at + 65536))
                    size = part.stop - part.start
                    yield pa.record_batch([pa.array([row["origin"]] * size), pa.array(np.full(size, row["width"], np.int32)), pa.array(np.full(size, row["height"], np.int32)), *[pa.array(v[part].astype(np.int32)) for v in (x.ravel() * step, y.ravel() * step, *c)]], names=["origin", "width", "height", "x", "y", "r", "g", "b"])

    return flat.mapInArrow(explode, "origin string, width int, height int, x int, y int, r int, g int, b int")

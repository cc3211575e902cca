"""Vectors and perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID_DISTANCE = 999


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector is all zeros."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine distance d in [0, 2] as a similarity 1 - d/2."""
    return (1.0 + cosine(a, b)) / 2.0


def l2_normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length == 0.0, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.transform(a, lambda x: x.cast("double") / length)
    )


def dhash(grey: Column, rows: int = 8, columns: int = 9) -> Column:
    """Difference hash of a row-major grey matrix: one bit per "left is darker than right"."""
    steps = columns - 1
    last = rows * steps - 1

    def add(bits: Column, i: Column) -> Column:
        at = F.floor(i / steps).cast("int") * columns + i % steps
        darker = F.get(grey, at) < F.get(grey, at + 1)
        return F.shiftleft(bits, 1).bitwiseOR(F.when(darker, F.lit(1)).otherwise(0).cast("long"))

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(last)), F.lit(0).cast("long"), add)
    return F.when(grey.isNotNull(), bits)


def hash_hex(value: Column, bits: int = 64) -> Column:
    return F.lpad(F.lower(F.hex(value)), bits // 4, "0")


def hash_value(text: Column) -> Column:
    """64-bit hash from at most 16 hex digits, null when it is not one."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_hex(a: Column, b: Column) -> Column:
    """Distance of two hex hashes of any length; 999 when they cannot be compared."""
    last = F.floor((F.length(a) - 1) / 16).cast("int")

    def chunk(h: Column, i: Column) -> Column:
        return hash_value(F.substring(h, i * 16 + 1, F.lit(16)))

    distance = F.aggregate(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        F.lit(0),
        lambda s, i: s + hamming(chunk(a, i), chunk(b, i)),
    )
    comparable = (
        (F.length(a) == F.length(b)) & a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    )
    return F.when(F.coalesce(comparable, F.lit(False)), distance).otherwise(INVALID_DISTANCE)


def phash_udf(size: int = 32, low: int = 8):
    """pandas UDF: `array<double>` grey matrix (size x size) to its DCT hash as hex.

    Bits tell which of the low x low lowest frequencies lie above their median.
    """

    @F.pandas_udf("string")
    def phash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        k = np.arange(size)
        basis = np.cos((2 * k[None, :] + 1) * k[:low, None] * np.pi / (2 * size))
        basis *= np.sqrt(2.0 / size)
        basis[0] /= np.sqrt(2.0)
        weights = 1 << np.arange(3, -1, -1)
        for grey in batches:
            out = []
            for matrix in grey:
                if matrix is None or len(matrix) != size * size:
                    out.append(None)
                    continue
                x = np.asarray(matrix, dtype="float64").reshape(size, size)
                freq = basis @ x @ basis.T
                bits = (freq > np.median(freq)).reshape(-1, 4)
                out.append("".join(f"{d:x}" for d in bits @ weights))
            yield pd.Series(out, dtype="object")

    return phash


def grey_matrix_udf(columns: int, rows: int):
    """pandas UDF over the image source's struct: mean grey of a rows x columns grid.

    Cells are area means, so this is not bit-equal to a windowed-sinc resize.
    """

    @F.pandas_udf("array<double>")
    def grey(images: pd.DataFrame) -> pd.Series:
        import numpy as np

        def means(plane, parts, axis):
            """Area means along one axis; cells may share a pixel in proportion."""
            n = plane.shape[axis]
            total = np.concatenate(
                [np.zeros_like(plane.take([0], axis)), plane.cumsum(axis)], axis
            )
            edge = np.arange(parts + 1) * n / parts
            base = np.minimum(edge.astype(int), n - 1)
            part = np.expand_dims(edge - base, 1 - axis)
            at_edge = total.take(base, axis) + part * plane.take(base, axis)
            return np.diff(at_edge, axis=axis) * parts / n

        out = []
        for h, w, channels, data in zip(
            images["height"], images["width"], images["nChannels"], images["data"], strict=True
        ):
            if h is None or h <= 0 or w <= 0:
                out.append(None)
                continue
            pixels = np.frombuffer(data, dtype="uint8").reshape(h, w, channels).astype("float64")
            if channels >= 3:  # blue, green, red
                plane = pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])
            else:
                plane = pixels[:, :, 0]
            out.append(means(means(plane, rows, 0), columns, 1).reshape(-1))
        return pd.Series(out)

    return grey


def image_hashes(images: DataFrame) -> DataFrame:
    """(origin, dhash, phash) of images read by `readers.read_images`.

    The grey grids are columns of their own: a Python function cannot run inside a lambda.
    """
    image = F.struct("height", "width", "nChannels", "data")
    grids = images.select(
        "origin",
        grey_matrix_udf(9, 8)(image).alias("_small"),
        grey_matrix_udf(32, 32)(image).alias("_large"),
    )
    return grids.select(
        "origin",
        dhash(F.col("_small")).alias("dhash"),
        phash_udf()(F.col("_large")).alias("phash"),
    )

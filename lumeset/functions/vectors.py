"""Vectors and 64-bit hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit vector; all zeros if the norm is under 1e-8."""
    # the norm is bound as an element, so that it is not summed again for every component
    scaled = lambda n: F.transform(v, lambda x: F.when(n < 1e-8, 0.0).otherwise(x.cast("double") / n))
    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))


def content_vector(tones: Column, colours: Column, entropy: Column, spread: Column, black: Column, white: Column, dominant: Column) -> Column:
    """Unit histogram of tones, then colour features, then the luminance metrics at a scale of one."""
    return F.concat(l2_normalise(tones), F.transform(colours, lambda x: x.cast("double")), F.array(entropy / 8.0, spread / 255.0, black, white, dominant))


def combined_vector(colours: Column, embedding: Column) -> Column:
    """Colour features, then the model's embedding."""
    return F.concat(F.transform(colours, lambda x: x.cast("double")), F.transform(embedding, lambda x: x.cast("double")))


def sign_hash(v: Column, bits: int = 64) -> Column:
    """Signs of the first 64 components, the first as the highest bit."""
    return F.aggregate(F.slice(v, 1, bits), F.lit(0).cast("bigint"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))


def difference_hash(rows: Column) -> Column:
    """Hash of 8 rows of 9 grey values: a bit for each value that is over its left neighbour, row by row, the first as the highest."""
    bits = F.flatten(F.transform(rows, lambda r: F.zip_with(F.slice(r, 2, 8), F.slice(r, 1, 8), lambda b, a: F.when(b > a, 1).otherwise(0))))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(x.cast("bigint")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_text(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hash_number(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("bigint")

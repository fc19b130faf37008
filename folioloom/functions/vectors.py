"""Vectors as arrays of doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text-hash embedding.
DIMENSION = 1536
STRIDE, MODULUS, SCALE = 10007, 20003, 10000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for empty vectors, different lengths or a zero norm.  Norms may be given where they are stored."""
    below = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    sound = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (below > 0)
    return F.when(sound, dot(a, b) / below).otherwise(0.0)


def separation(anchor: Column, like: Column, unlike: Column) -> Column:
    """How much nearer the like text is than the unlike one."""
    return cosine(anchor, like) - cosine(anchor, unlike)


def seed(text: Column) -> Column:
    """The text's md5 modulo ``MODULUS``, folded from eight 16-bit digits so that nothing overflows."""
    digest = F.md5(text.cast("binary"))
    digits = [F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("long") for k in range(8)]
    out = F.lit(0).cast("long")
    for d in digits:
        out = (out * 65536 + d) % MODULUS
    return out


def hashed(seeds: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """The text-hash vectors of these seeds, a row each."""
    return np.round((seeds[:, None] + np.arange(dimension) * STRIDE) % MODULUS / SCALE - 1, 6)


def text_hash_vector(text: Column, dimension: int = DIMENSION) -> Column:
    """A deterministic stand-in for an embedding; not of unit length.  By expressions, as ``hashed`` gives it: no batch of vectors is held."""
    # Within an array of one the seed is worked out once, not for each component.
    each = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: ((s + i * STRIDE) % MODULUS - SCALE) / F.lit(float(SCALE)))
    return F.when(text.isNotNull(), F.transform(F.array(seed(text)), each)[0])

"""Scores, vectors, colours and hash draws as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights of ITU-R BT.601 and the ImageNet channel statistics.
LUMA = (0.299, 0.587, 0.114)
BYTE_LUMA = (19595, 38470, 7471)
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)
GRAY_SATURATION = 8.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def foreground_score(logit0: Column, logit1: Column) -> Column:
    """Two-class softmax, probability of class 1."""
    return 1.0 / (1.0 + F.exp(logit0 - logit1))


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross entropy on logits, in the form that cannot overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(l2_norm(v), F.lit(eps)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def cosine_sim(a: Column, b: Column) -> Column:
    """Cosine of two vectors; the dot product when both are already normalised."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(1e-12)) * F.greatest(l2_norm(b), F.lit(1e-12)))


def hash_bits(seed: int | Column, *keys: Column | str) -> Column:
    """Uniform integer in [0, 2^32) from a seed and key columns, the same on every engine."""
    parts = [F.lit(seed) if not isinstance(seed, Column) else seed, *[F.col(k) if isinstance(k, str) else k for k in keys]]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int | Column, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return hash_bits(seed, *keys).cast("double") / F.lit(4294967296.0)


def hash_int(lo: int | Column, hi: int | Column, u: Column) -> Column:
    """Integer in [lo, hi] from a uniform draw."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo + F.floor(u * (hi - lo + 1))).cast("bigint")


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """Name whose share of the cumulative weights holds the uniform draw ``u``."""
    total = float(sum(weights.values()))
    names = list(weights)
    picked, upto = None, 0.0
    for name in names[:-1]:
        upto += weights[name]
        test = u * total < upto
        picked = F.when(test, F.lit(name)) if picked is None else picked.when(test, F.lit(name))
    return F.lit(names[0]) if picked is None else picked.otherwise(F.lit(names[-1]))


def default_category(col: Column, default: str) -> Column:
    return F.coalesce(col, F.lit(default))


def byte_luma(r: Column, g: Column, b: Column) -> Column:
    """Luma as picture libraries store it: rounded to a byte by 16-bit fixed-point weights."""
    return F.floor((r * BYTE_LUMA[0] + g * BYTE_LUMA[1] + b * BYTE_LUMA[2] + 32768) / 65536).cast("double")


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation on the 0..255 scale; 0 for black."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - low) * 255.0 / top)


def normalize_channel(v: Column, channel: int) -> Column:
    """Pixel value 0..255 to the network's input scale; channel 0, 1, 2 = R, G, B."""
    return (v / 255.0 - IMAGENET_MEAN[channel]) / IMAGENET_STD[channel]


def affine_clip(v: Column, gain: Column, offset: Column) -> Column:
    """Contrast and brightness change, clipped to the byte range."""
    return F.least(F.greatest(v * gain + offset, F.lit(0.0)), F.lit(255.0))


def padded_name(prefix: str, number: Column, digits: int, suffix: str = "") -> Column:
    return F.format_string(f"{prefix}%0{digits}d{suffix}", number)


def strip_aux(key: Column) -> Column:
    return F.regexp_replace(key, "^aux[0-9]*_", "")


def scaled_count(fine: Column, coarse: Column, scale: Column) -> Column:
    """Count between ``coarse`` (scale 0) and ``fine`` (scale 1), half to even."""
    return F.rint(coarse + (fine - coarse) * scale).cast("bigint")

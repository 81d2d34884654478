"""Scalar column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zscore(x: Column, mean: Column, std: Column, what: Column | None = None) -> Column:
    """(x - mean) / std; a zero spread counts as one; an infinite result is an error."""
    z = (x - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    bad = F.abs(z) == F.lit(float("inf"))
    message = F.concat(F.lit("infinite value after scaling"), F.coalesce(what.cast("string"), F.lit("")) if what is not None else F.lit(""))
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(z)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, truncated toward zero."""
    return F.call_function("div", epoch_micros(ts), F.lit(1000000))


def table_key(table: Column, split: Column) -> Column:
    return F.concat_ws(":", table, F.initcap(split))


def label_from_score(z: Column) -> Column:
    return (z > 0).cast("int")


def keyed_hash(*parts: Column) -> Column:
    """A 60-bit integer from the parts; the random source of every sampling step."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


HASH_RANGE = float(1 << 60)


def unit(h: Column) -> Column:
    """A keyed hash as a number in [0, 1)."""
    return h.cast("double") / F.lit(HASH_RANGE)


def text_digest(text: Column) -> Column:
    """Key of a text: equal digests mean equal texts, and it is short and evenly spread."""
    return F.unhex(F.sha2(text, 256))


def bf16(x: Column) -> Column:
    """A float rounded to bfloat16 precision, ties to even, returned as float.

    bfloat16 keeps 8 significant bits. With 2^e <= |x| < 2^(e+1) the grid
    step is 2^(e-7); dividing by a power of two is exact in double.
    """
    d = x.cast("float").cast("double")
    guess = F.floor(F.log2(F.abs(d)))
    low, high = F.pow(F.lit(2.0), guess), F.pow(F.lit(2.0), guess + 1)
    e = guess + F.when(F.abs(d) >= high, 1).when(F.abs(d) < low, -1).otherwise(0)
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-126)) - 7)
    rounded = F.rint(d / step) * step
    limit = F.pow(F.lit(2.0), F.lit(128.0))
    rounded = F.when(F.abs(rounded) >= limit, F.signum(d) * F.lit(float("inf"))).otherwise(rounded)
    special = d.isNull() | F.isnan(d) | (d == 0) | (F.abs(d) == F.lit(float("inf")))
    return F.when(special, d).otherwise(rounded).cast("float")

"""G.711 companding by arithmetic on bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard's bias and clip of mu-law.
BIAS, CLIP = 132, 32635


def _exponent(v: Column, lowest: int) -> Column:
    """floor(log2(v)) - lowest, at least 0 and at most 7."""
    out = F.lit(0)
    for e in range(1, 8):
        out = F.when(v >= 1 << (e + lowest), F.lit(e)).otherwise(out)
    return out


def ulaw_encode(pcm: Column) -> Column:
    sign = F.when(pcm < 0, F.lit(128)).otherwise(F.lit(0))
    m = F.least(F.abs(pcm), F.lit(CLIP)) + BIAS
    e = _exponent(m, 7)
    mantissa = F.floor(m / F.pow(F.lit(2.0), e + 3)).cast("int").bitwiseAND(15)
    return (F.lit(255) - (sign + e * 16 + mantissa)).cast("int")


def ulaw_decode(code: Column) -> Column:
    u = F.lit(255) - code
    e = F.floor(u / 16).cast("int").bitwiseAND(7)
    m = ((u.bitwiseAND(15) * 8 + BIAS) * F.pow(F.lit(2.0), e) - BIAS).cast("int")
    return F.when(u >= 128, -m).otherwise(m)


def alaw_encode(pcm: Column) -> Column:
    sign = F.when(pcm >= 0, F.lit(128)).otherwise(F.lit(0))
    m = F.when(pcm == -32768, F.lit(32767)).otherwise(F.abs(pcm)).cast("int")
    e = _exponent(m, 7)
    mantissa = F.when(e == 0, F.floor(m / 16)).otherwise(F.floor(m / F.pow(F.lit(2.0), e + 3))).cast("int").bitwiseAND(15)
    return (sign + e * 16 + mantissa).cast("int").bitwiseXOR(85)


def alaw_decode(code: Column) -> Column:
    a = code.cast("int").bitwiseXOR(85)
    e = F.floor(a / 16).cast("int").bitwiseAND(7)
    m = a.bitwiseAND(15) * 16
    v = F.when(e == 0, m + 8).otherwise(((m + 264) * F.pow(F.lit(2.0), e - 1)).cast("int"))
    return F.when(a >= 128, v).otherwise(-v)

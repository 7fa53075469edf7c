"""256-bit integers as columns: 64 hex digits, four 64-bit limbs, exact sums and decimal text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def word(hex_text: Column | str) -> Column:
    """Hex with or without 0x as 64 lower-case digits; null beyond 256 bits. The order of these is numeric order."""
    h = F.lower(F.col(hex_text) if isinstance(hex_text, str) else hex_text)
    short = F.ltrim(F.when(F.startswith(h, F.lit("0x")), F.substring(h, 3, 1_000_000)).otherwise(h), F.lit("0"))
    return F.when(F.length(short) <= WORD, F.lpad(short, WORD, "0"))


def limb(w: Column | str, k: int) -> Column:
    """Limb k of a word, 0 the lowest, as DECIMAL(20,0)."""
    w = F.col(w) if isinstance(w, str) else w
    part = F.substring(w, WORD - 16 * (k + 1) + 1, 16)
    return F.when(part == "0" * 16, F.lit(0).cast("decimal(20,0)")).otherwise(F.conv(part, 16, 10).cast("decimal(20,0)"))


def small(w: Column | str) -> Column:
    """A word of up to 126 bits as DECIMAL(38,0), null beyond."""
    w = F.col(w) if isinstance(w, str) else w
    value = limb(w, 1).cast("decimal(38,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + limb(w, 0)
    fits = (F.substring(w, 1, 32) == "0" * 32) & (F.substring(w, 33, 1) < "4")
    return F.when(fits, value.cast("decimal(38,0)"))


def signed_key(w: Column | str) -> Column:
    """A word whose order is the order of the signed number: the top bit flipped."""
    w = F.col(w) if isinstance(w, str) else w
    return F.concat(F.translate(F.substring(w, 1, 1), "0123456789abcdef", "89abcdef01234567"), F.substring(w, 2, WORD - 1))


def _text(limbs: list[Column]) -> Column:
    """The decimal text of limbs, the highest first, as columns alone: each limb is taken into digits of base 10^18, the
    lowest first. A limb may be wider than 64 bits, as sums of limbs are; 90 decimal digits fit."""
    wide = "decimal(38,0)"
    base, step = F.lit(str(10**18)).cast(wide), F.lit(str(2**64)).cast(wide)

    def take(digits: Column, limb: Column) -> Column:
        def carry(so_far: Column, digit: Column) -> Column:
            x = (digit * step + so_far["carry"]).cast(wide)
            low = (x % base).cast(wide)
            return F.struct(F.array_append(so_far["digits"], low).alias("digits"), ((x - low) / base).cast(wide).alias("carry"))

        start = F.struct(F.array().cast(f"array<{wide}>").alias("digits"), limb.alias("carry"))
        return F.aggregate(digits, start, carry, lambda s: s["digits"])

    zeros = F.array_repeat(F.lit(0).cast(wide), 5)
    digits = F.aggregate(F.array(*(x.cast(wide) for x in limbs)), zeros, take)
    text = F.ltrim(F.array_join(F.transform(F.reverse(digits), lambda d: F.lpad(d.cast("string"), 18, "0")), ""), F.lit("0"))
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in limbs]), F.when(text == "", "0").otherwise(text))


def decimal_text(w: Column | str, plus: int = 0) -> Column:
    """A word, plus a small number, in decimal, natively; the digits of words over 126 bits are made one by one."""
    narrow = (small(w) + plus).cast("decimal(38,0)").cast("string")
    return F.when(narrow.isNotNull(), narrow).otherwise(_text([limb(w, 3), limb(w, 2), limb(w, 1), limb(w, 0) + plus]))


def signed_text(w: Column | str) -> Column:
    """A word in two's complement in decimal: of a negative one the magnitude is its complement plus one."""
    w = F.col(w) if isinstance(w, str) else w
    flipped = F.translate(w, "0123456789abcdef", "fedcba9876543210")
    return F.when(F.substring(w, 1, 1) > "7", F.concat(F.lit("-"), decimal_text(flipped, 1))).otherwise(decimal_text(w))


def sums(rows: DataFrame, keys: list[str], w: str, name: str) -> DataFrame:
    """The exact sum of words by keys as decimal text: limbs add up as decimals, before the shuffle; carries are settled
    in the few results."""
    parts = [F.sum(limb(w, k)).alias(f"_l{k}") for k in range(4)]
    return rows.groupBy(*keys).agg(*parts).select(*keys, _text([F.col(f"_l{k}") for k in reversed(range(4))]).alias(name))

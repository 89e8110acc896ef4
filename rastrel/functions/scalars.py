"""Colour, number, text and score functions as plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb in lower case."""
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)]))


def parse_hex_color(text: Column) -> Column:
    """struct(r, g, b) of #rgb or #rrggbb, with or without the sign; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    six = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda k: F.conv(F.substring(six, k, 2), 16, 10).cast("int")
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.aggregate(F.array(F.lit(0)), value, lambda held, _: held, body)


def format_number(value: Column) -> Column:
    """Two decimals by the exact binary value, half to even, no trailing zeros and no negative zero.

    The fraction is split at 2**-20, so that its 200-fold is compared with an odd number without rounding."""
    def cents(v: Column, part: Column) -> Column:
        def rounded(cent: Column, high: Column) -> Column:
            rest, bound = (part * 1048576 - high) * 200, (2 * cent + 1) * 1048576 - high * 200
            return cent + F.when((rest > bound) | (rest == bound) & (cent % 2 == 1), 1).otherwise(0)
        return F.floor(F.abs(v)) * 100 + let(F.floor(part * 100), lambda cent: let(F.floor(part * 1048576), lambda high: rounded(cent, high)))

    def text(v: Column, n: Column) -> Column:
        low = n % 100
        tail = F.when(low == 0, "").when(low % 10 == 0, F.concat(F.lit("."), (low / 10).cast("int").cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(low.cast("string"), 2, "0")))
        return F.concat(F.when((v < 0) & (n > 0), "-").otherwise(""), F.floor(n / 100).cast("string"), tail)

    number = lambda v: F.when(F.abs(v) < 1e-9, F.lit("0")).otherwise(let(let(F.abs(v) - F.floor(F.abs(v)), lambda part: cents(v, part)), lambda n: text(v, n)))
    return let(value.cast("double"), number)


def metadata_float(metadata: Column, key: str, default: float) -> Column:
    """A map's text value as a number, or the default where it is missing or isn't one."""
    return F.coalesce(F.try_element_at(metadata, F.lit(key)).try_cast("double"), F.lit(default))


def svg_valid(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(F.contains(low, F.lit("<svg")) & F.contains(low, F.lit("</svg>")), F.lit(False))


def svg_valid_ratio(text: Column) -> Column:
    """Aggregate: share of texts that hold an opened and a closed svg tag; 0 without texts."""
    return F.coalesce(F.avg(svg_valid(text).cast("double")), F.lit(0.0))


def loss_to_perplexity(loss: Column) -> Column:
    """exp(min(20, loss)); infinite where the loss isn't a finite number."""
    odd = F.isnan(loss) | (F.abs(loss) == F.lit(float("inf")))
    return F.when(odd, F.lit(float("inf"))).otherwise(F.exp(F.least(F.lit(20.0), loss)))


def short_sha1(data: Column) -> Column:
    return F.substring(F.sha1(data), 1, 12)


def rising(value: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, straight between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def falling(value: Column, low: float, high: float) -> Column:
    return F.lit(1.0) - rising(value, low, high)


def confidence(*scores: Column) -> Column:
    """The mean of scores, each held within 0 and 1."""
    held = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)) for s in scores]
    return sum(held[1:], held[0]) / len(held)


def quantize_method(name: Column) -> Column:
    """A known colour-reduction method, median_cut for any other name."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("median_cut", "max_coverage", "fast_octree"), low).otherwise(F.lit("median_cut"))

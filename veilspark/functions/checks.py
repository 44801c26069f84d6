"""Validators and measures on short strings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import fixed_values as fx


def id_card_ok(t: Column) -> Column:
    """18 characters whose last one is the weighted mod-11 check character."""
    total = reduce(
        lambda a, b: a + b,
        [F.substring(t, i + 1, 1).cast("int") * w for i, w in enumerate(fx.ID_WEIGHTS)],
    )
    expected = F.substring(F.lit(fx.ID_CHECK_CHARS), total % 11 + 1, F.lit(1))
    return F.when(F.rlike(t, F.lit("^[0-9]{17}[0-9Xx]$")), F.upper(F.right(t, F.lit(1))) == expected).otherwise(
        F.lit(False)
    )


def luhn_ok(t: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(t, "[^0-9]", ""))


def ipv4_ok(t: Column) -> Column:
    octets = F.split(t, "[.]")
    return (
        ~t.isin(*fx.IP_EXCLUDED)
        & (F.size(octets) == 4)
        & F.forall(octets, lambda o: F.coalesce(o.try_cast("int") <= 255, F.lit(False)))
    )


def shannon_bits(t: Column) -> Column:
    """Bits per character.  Frequencies come from a sort-free count per distinct character."""
    n = F.length(t).cast("double")
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    return F.when(
        F.length(t) > 0,
        F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, c: acc
            - ((F.length(t) - F.length(F.replace(t, c, F.lit("")))) / n)
            * F.log2((F.length(t) - F.length(F.replace(t, c, F.lit("")))) / n),
        ),
    ).otherwise(F.lit(0.0))

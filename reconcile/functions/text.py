"""Small formatting and decoding expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


WHITESPACE = " \t\r\n\f\x0b"


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(col, F.lit(WHITESPACE))


def scaffold_identity(path: Column) -> Column:
    """Basename with the commit segment masked, so names of two runs compare."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)\A([^_]*)_[0-9a-fA-F]{1,40}_(.*)\z", "$1_REV_$2")


def decode_nullable(flag: Column) -> Column:
    return F.coalesce(flag.isin("1", "true"), F.lit(True))


def delta_ms_text(base: Column, run: Column) -> Column:
    """``=``, ``+Nms`` or ``+Nms (+P%)`` for two millisecond values."""
    b, r = F.coalesce(base, F.lit(0)), F.coalesce(run, F.lit(0))
    d = r - b
    pct = F.bround(F.abs(d / b * 100), 0).cast("long")
    sign = F.when(d < 0, "-").otherwise("+")
    ms = F.format_string("%+dms", d)
    return (
        F.when(base.isNull() & run.isNull(), "n/a")
        .when(d == 0, "=")
        .when(b == 0, ms)
        .otherwise(F.concat(ms, F.lit(" ("), sign, pct.cast("string"), F.lit("%)")))
    )


def delta_label_text(base: Column, run: Column) -> Column:
    """``=`` or ``a -> b`` for labels and yes/no flags."""

    def show(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("n/a"))

    both = F.concat(show(base), F.lit(" -> "), show(run))
    return F.when(base.isNull() & run.isNull(), "n/a").when(
        show(base) == show(run), "="
    ).otherwise(both)


def ceiling_ms(base: Column, factor: float, slack_ms: int) -> Column:
    return F.ceil(base * F.lit(float(factor))) + F.lit(slack_ms)


def quoted_list(items: Column) -> Column:
    """``["a", "b"]`` for an array of strings."""
    quoted = F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda s: F.concat(F.lit('"'), s, F.lit('"')),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def number_text(x: float) -> str:
    """3.0 as ``3``, 1.5 as ``1.5``."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))

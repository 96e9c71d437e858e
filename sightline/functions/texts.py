"""Lists with quotes, and hashes of 32 bits as folds over the characters of a text, inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _run(stop: str, times: str) -> str:
    """A pattern of text up to a ``stop`` outside of quotes. In double quotes a backslash takes the next character; open
    quotes reach to the end. Nothing in it goes back, so long texts need neither more stack nor more than one pass."""
    return rf"""(?s)(?:[^"'{stop}]++|"(?:[^"\\]++|\\.?+)*+"?+|'[^']*+'?+){times}+"""


def without_comment(text: Column) -> Column:
    """What stands before the first # outside of quotes, trimmed."""
    return F.trim(F.regexp_extract(text, "^" + _run("#", "*"), 0))


def _bare(t: Column) -> Column:
    n = F.length(t)
    quoted = (n >= 2) & (((F.left(t, F.lit(1)) == '"') & (F.right(t, F.lit(1)) == '"')) | ((F.left(t, F.lit(1)) == "'") & (F.right(t, F.lit(1)) == "'")))
    return F.when(t.isin("", "null", "~"), None).when(quoted, F.substring(t, F.lit(2), n - 2)).otherwise(t)


def plain_value(text: Column) -> Column:
    """A value without its quotes; nothing, null and ~ are null."""
    return _bare(without_comment(text))


def quoted_list(text: Column) -> Column:
    """The values of a comma-separated list, with or without brackets, trimmed and in lower case: commas inside of
    quotes separate nothing, blank values go, and of equal ones the first stays."""
    t = without_comment(text)
    inner = F.when(t.startswith("[") & t.endswith("]") & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    items = F.regexp_extract_all(inner, F.lit(_run(",", "+")), F.lit(0))
    # one step each, as a value that a lambda names several times is made as often
    values = F.transform(F.transform(items, without_comment), lambda x: F.lower(F.trim(_bare(x))))
    return F.when(text.isNotNull(), F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def string_hash(text: Column) -> Column:
    """h = 31 h + code over UTF-16 units, in 32 bits with sign; its absolute value. Wrapping is done by masks, as
    integers that overflow are errors."""
    mask = F.lit(2**32 - 1)
    add = lambda h, code: (h * 31 + code).bitwiseAND(mask)

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        pair = code - 0x10000
        high, low = F.floor(pair / 1024) + 0xD800, pair.bitwiseAND(F.lit(1023)) + 0xDC00
        return F.when(code > 0xFFFF, add(add(h, high), low)).otherwise(add(h, code))

    h = F.aggregate(_characters(text), F.lit(0).cast("long"), step)
    return F.abs(F.when(h >= 2**31, h - 2**32).otherwise(h))


def base36_id(seed: Column, prefix: str = "req_", length: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.left(F.lower(F.conv(seed.cast("string"), 10, 36)), F.lit(length)))

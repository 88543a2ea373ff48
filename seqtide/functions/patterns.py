"""Pattern values and their text: an array of itemsets, written ``<(1 2)(3)>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "array<array<int>>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: str | Column) -> Column:
    """Itemsets sorted and without repeats of an item; order of events stays."""
    return F.transform(_col(c), lambda e: F.array_sort(F.array_distinct(e)))


def render(c: str | Column) -> Column:
    """``<(1 2)(3)>``"""
    events = F.transform(_col(c), lambda e: F.concat(F.lit("("), F.array_join(F.transform(e, lambda x: x.cast("string")), " "), F.lit(")")))
    return F.concat(F.lit("<"), F.array_join(events, ""), F.lit(">"))


def parse(c: str | Column) -> Column:
    """The array of a pattern's text; null where it is not one."""
    c = _col(c)
    inner = F.regexp_replace(c, r"^<\(|\)>$", "")
    parsed = F.transform(F.split(inner, r"\)\("), lambda e: F.transform(F.split(e, " "), lambda x: x.cast("int")))
    return F.when(F.regexp_like(c, F.lit(r"^<(\(\d+( \d+)*\))+>$")), parsed)


def intuitive(c: str | Column) -> Column:
    """``(1 2) 3``: single items without brackets."""
    text = lambda e: F.array_join(F.transform(e, lambda x: x.cast("string")), " ")
    return F.array_join(F.transform(_col(c), lambda e: F.when(F.size(e) > 1, F.concat(F.lit("("), text(e), F.lit(")"))).otherwise(text(e))), " ")


def i_concat(c: str | Column, item: str | Column) -> Column:
    """The item joins the last itemset."""
    c = _col(c)
    head = F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.concat(head, F.array(F.array_append(F.element_at(c, -1), _col(item))))


def s_concat(c: str | Column, item: str | Column) -> Column:
    """The item follows as an itemset of its own."""
    return F.array_append(_col(c), F.array(_col(item)))


def drop_last(c: str | Column) -> Column:
    """Without the last item, and without its itemset if that is then empty."""
    c = _col(c)
    head, last = F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.element_at(c, -1)
    return F.when(F.size(last) > 1, F.concat(head, F.array(F.slice(last, 1, F.size(last) - 1)))).otherwise(head)


def length(c: str | Column) -> Column:
    return F.aggregate(_col(c), F.lit(0), lambda a, e: a + F.size(e))


def path(c: str | Column) -> Column:
    """Extension steps array<struct<ext,item>>: ext 0 joins the itemset, 1 opens one."""
    return F.flatten(F.transform(_col(c), lambda e: F.transform(e, lambda x, k: F.struct(F.when(k == 0, 1).otherwise(0).alias("ext"), x.alias("item")))))


def floor_period(max_inner: str | Column, last_sid: str | Column, n: int | Column) -> Column:
    """The least longest gap that the pattern can still end up with."""
    n = F.lit(n) if isinstance(n, int) else n
    last = _col(last_sid)
    return F.when(last.isNull() | (last < 0), F.lit((1 << 31) - 1).cast("long")).otherwise(F.greatest(_col(max_inner), n - last))

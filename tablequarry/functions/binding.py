"""Compute an expression once and use it many times inside one column."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of named values; each value is computed once per row.

    A value used inside a lambda would otherwise be computed again for every item.
    """
    bound = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(bound), body), F.lit(0))

"""Random draws as seeded hashes of row keys.

A draw depends only on the seed, the name of the draw and the keys of the row, so
results are the same for any partitioning and after a task is run again.
"""

from pyspark.sql import Column, functions as F

_SPAN = 4294967296.0  # 2^32: the draw reads eight hexadecimal digits


def unit(seed, draw: str, *keys) -> Column:
    """A number in [0, 1) for the given keys."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(draw), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(_SPAN)


def pick_number(n, seed, draw: str, *keys) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(unit(seed, draw, *keys) * (F.lit(n) if isinstance(n, int) else n)).cast("int")


def pick_item(items: Column, seed, draw: str, *keys) -> Column:
    """One item of an array; NULL for an empty one."""
    at = pick_number(F.size(items), seed, draw, *keys) + 1
    return F.when(F.size(items) > 0, F.element_at(items, at))

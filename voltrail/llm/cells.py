"""Cells: the pairs within a large group, dealt out in blocks of bounded size.

The members of a group are dealt by hash to ``parts`` parts, and each pair of parts is a cell. Where a group has one class whose
members need no comparison with each other, they are dealt to ``top_parts`` parts of their own, and no cell joins
two of those: the work then grows with the class and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cells_of(member: str, in_top: Column, parts: str = "parts", top_parts: str = "core_parts") -> Column:
    """Array of (x, y, side): the cells of a member. Members of sides 0 and 1 are compared across, those of side 2 with each other.

    ``parts`` is at least 1, ``top_parts`` 0 where there is no such class. Parts x and y are numbered from 0, those of the
    class follow the others.
    """
    part = F.pmod(F.xxhash64(member), F.col(parts)).cast("int")
    top = F.pmod(F.xxhash64(member), F.greatest(F.col(top_parts), F.lit(1))).cast("int") + F.col(parts)
    others = F.sequence(F.lit(0), F.col(parts) - 1)
    beyond = F.when(F.col(top_parts) > 0, F.sequence(F.col(parts), F.col(parts) + F.col(top_parts) - 1)) \
        .otherwise(F.array().cast("array<int>"))
    return F.when(in_top, F.transform(others, lambda x: F.struct(x.alias("x"), top.alias("y"), F.lit(1).alias("side")))) \
        .otherwise(F.concat(
            F.transform(others, lambda x: F.struct(F.least(x, part).alias("x"), F.greatest(x, part).alias("y"),
                                                   F.when(x == part, 2).when(part < x, 0).otherwise(1).alias("side"))),
            F.transform(beyond, lambda y: F.struct(part.alias("x"), y.alias("y"), F.lit(0).alias("side")))))

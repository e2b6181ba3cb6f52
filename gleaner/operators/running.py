"""Running sums and maxima of long groups over many tasks.

A window over a whole group puts the group into one task.  Here its rows are cut into
blocks by their order: each block is summed up, the blocks' totals are carried on, and
each row adds what stands before it in its block.  Only the totals, a row for ``BLOCK``
places, meet by group alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.sources.tables import save

#: Places of a block.
BLOCK = 4_096


def before(rows: DataFrame, key: str, order: str, ties: list[str] = [], stored: bool = False, **values: tuple[Callable, Column]) -> DataFrame:
    """``rows`` with a column for each of ``values``, (F.sum or F.max, what of): that of
    the rows of the same ``key`` before this one, null for the first.  ``order`` is a whole
    number, nulls first; ``ties`` decide between equal ones.  Null keys are one group.

    Totals and rows both come from ``rows``, which are written first, so that steps in a row
    don't double the plan each; ``stored`` says that they are a table already."""
    rows = rows if stored else save(rows, "blocks")
    own = lambda name: f"__{name}_{mark}"
    mark = uuid.uuid4().hex[:12]
    group, block = own("group"), own("block")
    # As structs, nulls are equal in joins too, and one shuffle serves window and join.
    rows = rows.withColumns({group: F.struct(key), block: F.coalesce(F.floor(F.col(order) / BLOCK), F.lit(-(2**62)))} | {own(n): c for n, (_, c) in values.items()})
    totals = rows.groupBy(group, block).agg(*(f(own(n)).alias(own(n)) for n, (f, _) in values.items()))
    ahead = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(group, block, *(f(own(n)).over(ahead).alias(own("c" + n)) for n, (f, _) in values.items()))
    within = Window.partitionBy(group, block).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({own("w" + n): f(own(n)).over(within) for n, (f, _) in values.items()}).join(carried, [group, block])

    def both(n: str, f: Callable) -> Column:
        a, b = F.col(own("w" + n)), F.col(own("c" + n))
        return F.greatest(a, b) if f is F.max else F.coalesce(a + b, a, b)

    out = rows.withColumns({n: both(n, f) for n, (f, _) in values.items()})
    return out.drop(group, block, *(own(x + n) for n in values for x in ("", "c", "w")))

"""Running values over an array, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

# Values of a block. An array that grows by one value is copied, so a running value costs a block's length
# per value inside blocks, and the number of blocks per block between them.
BLOCK = 256


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` folded over each prefix of an array: as many values as the array has.

    ``step`` must be associative, such as a sum: blocks are folded alone, and what came before is put in front.
    """

    def grown(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.array(first), lambda done, x: F.array_append(done, step(F.element_at(done, -1), x)))

    def laid(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, start, lambda x, y: step(x, y)))
        before = F.slice(grown(sums, start), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda block, first: F.slice(grown(block, first), F.lit(2), F.size(block))))

    def cut(items: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.size(items) / BLOCK).cast("int"))
        return F.transform(places, lambda n: F.slice(items, n * BLOCK + 1, F.lit(BLOCK)))

    return let(values, lambda items: let(cut(items), laid))

"""Many rows against many others: they travel in blocks, and two blocks meet where a task reads both from the written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantpanel.sources.scratch import written

C = F.col
#: Files of a table of blocks, at most: a task takes the pairs of two files.
MOST_FILES = 48


def in_blocks(rows: DataFrame, block: str, count: int, series: tuple[str, ...], labels: tuple[str, ...] = (), of: tuple[str, ...] = (), name: str = "blocks") -> DataFrame:
    """``rows`` (``block``, from 0 to ``count`` - 1, ``of`` that all rows of a block share, ``labels`` and arrays ``series`` of one length), a row per block, written.

    A block's labels stand in arrays; its series one after another in one array each, ``sizes`` long.
    """
    held = rows.groupBy(block, *of).agg(F.collect_list(F.struct(*labels, *series)).alias("x"))
    packed = held.select(
        C(block).alias("block"), *of, *(C(f"x.{c}").alias(c) for c in labels), F.transform("x", lambda r: F.size(r[series[0]])).alias("sizes"), *(F.flatten(C(f"x.{c}")).alias(c) for c in series),
    )
    files = max(1, min(count, MOST_FILES))
    return written(packed.repartitionById(files, (C("block") % files).cast("int")), name)


def pairs_of_blocks(blocks: DataFrame, same: str | None = None) -> DataFrame:
    """(left, right): each two rows of a table ``in_blocks`` once, and each with itself; with ``same`` those that agree on this column.

    Nothing is shuffled: a task reads its two parts of the table, so the disk follows the table and not the number of pairs. Of a pair's two
    orders the sum of its numbers decides, which spreads the pairs evenly over the tasks.
    """
    left, right = (blocks.select(F.struct(*blocks.columns).alias(side)) for side in ("left", "right"))
    p, q = C("left.block"), C("right.block")
    wanted = F.when((p + q) % 2 == 0, p <= q).otherwise(p > q)
    if same:
        wanted = wanted & (C(f"left.{same}") == C(f"right.{same}"))
    return left.join(right.hint("shuffle_replicate_nl"), wanted)

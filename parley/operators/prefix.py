"""Running sums over ordered rows without giving one key to one task.

A plain window over a key puts all rows of that key into one task. Here the
rows of a key are cut into blocks by their position. Sums run inside a block;
only one small row per block crosses into a second window that carries the
totals forward. With blocks of 4,096 rows a key that holds a third of a table
sends 1/12,288 of the rows, all of them tiny, through its carrying task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def block_of(position: str, rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"`{position}` div {int(rows)}")


def running_sums(
    df: DataFrame,
    keys: list[str],
    position: str,
    sums: dict[str, Column],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running sums (current row included) per key in the order of ``position``."""
    named = df.select(
        "*",
        block_of(position, block_rows).alias("_block"),
        *[c.alias(f"_in_{name}") for name, c in sums.items()],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        named.groupBy(*keys, "_block")
        .agg(*[F.sum(f"_in_{name}").alias(f"_t_{name}") for name in sums])
        .select(
            *keys,
            "_block",
            *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in sums],
        )
    )
    local = named.select("*", *[F.sum(f"_in_{name}").over(inside).alias(f"_l_{name}") for name in sums])
    return local.join(carried, [*keys, "_block"]).select(
        *df.columns,
        *[(F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.col(f"_c_{name}")).alias(name) for name in sums],
    )

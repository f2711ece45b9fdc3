"""Packing texts into model requests: next-fit over the whole ordered sequence.

A batch takes rows in order until the next one would break the item or the token budget; a row
above the token budget stands alone.  Where a batch starts depends on all rows before it, yet
the work splits: a block of rows is a function from "offset of the first batch start in me" to
"offset of the first batch start in the next block", and an offset is smaller than the item
budget.  Blocks compute their functions independently, the functions are composed in a tree,
and then every block knows where its first batch starts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.operators.ordering import dense_index

_STEP = "_block bigint, _exits array<int>, _counts array<bigint>"
_ENTRY = "_block bigint, _entry int, _batch bigint"


def _next_start(tokens: np.ndarray, items: int, budget: int) -> np.ndarray:
    """For each row: where the batch after one starting at this row starts."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    start = np.arange(len(tokens))
    by_tokens = np.searchsorted(upto, upto[:-1] + budget, side="right") - 1
    return np.minimum(np.maximum(by_tokens, start + 1), start + items)


def _block_function(rows: np.ndarray, tokens: np.ndarray, block_rows: int, items: int, budget: int):
    """Exit offset and batches started, for each entry offset."""
    size = int((rows < block_rows).sum())
    follow = np.arange(block_rows + items)
    follow[:size] = _next_start(tokens, items, budget)[:size]
    started = np.zeros(len(follow), dtype=np.int64)
    started[:size] = 1
    while (follow[:size] < size).any():
        started = started + started[follow]
        follow = follow[follow]
    entries = np.arange(items)
    return np.maximum(follow[entries] - block_rows, 0), started[entries]


def _compose(steps: pd.DataFrame, entry: int, batch: int) -> list[tuple[int, int, int]]:
    out = []
    for block, exits, counts in zip(steps["_block"], steps["_exits"], steps["_counts"]):
        out.append((block, entry, batch))
        batch += int(counts[entry])
        entry = int(exits[entry])
    return [*out, (-1, entry, batch)]


def _merge_steps(steps: DataFrame, fan: int, items: int) -> DataFrame:
    """One function for each run of ``fan`` blocks."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        ends = [_compose(group, entry, 0)[-1] for entry in range(items)]
        return pd.DataFrame({
            "_block": [int(group["_block"].iloc[0]) // fan],
            "_exits": [[end[1] for end in ends]], "_counts": [[end[2] for end in ends]],
        })

    return steps.groupBy(F.floor(F.col("_block") / fan)).applyInPandas(merge, _STEP)


def _entries(steps: DataFrame, blocks: int, fan: int, items: int) -> DataFrame:
    """Where the first batch of each block starts and which number it has.

    No task sees more than ``fan`` blocks: longer sequences go through one more level.
    """
    if blocks <= fan:
        above = steps.sparkSession.range(1).select(
            F.lit(0).cast("bigint").alias("_run"), F.lit(0).alias("_in"), F.lit(0).cast("bigint").alias("_at")
        )
    else:
        merged = _merge_steps(steps, fan, items)
        above = _entries(merged, -(-blocks // fan), fan, items).toDF("_run", "_in", "_at")
    runs = steps.withColumn("_run", F.floor(F.col("_block") / fan)).join(above, "_run")

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        spots = _compose(group, int(group["_in"].iloc[0]), int(group["_at"].iloc[0]))[:-1]
        return pd.DataFrame(spots, columns=["_block", "_entry", "_batch"])

    return runs.groupBy("_run").applyInPandas(spread, _ENTRY)


def pack_batches(
    df: DataFrame, key: str, tokens: str, max_items: int = fv.BATCH_ITEMS,
    max_tokens: int = fv.BATCH_TOKENS, block_rows: int = 50_000, fan: int = 500,
) -> DataFrame:
    """``(key, tokens, batch)`` with batches numbered from 0 in key order.

    Only keys and token estimates travel; join the result to the texts by key.
    """
    if block_rows < max_items:
        raise ValueError("block_rows must not be smaller than max_items")
    indexed = dense_index(df.select(key, tokens), "_index", [key])
    total = indexed.count()
    blocks = max(-(-total // block_rows), 1)
    block = F.floor(F.col("_index") / block_rows)
    placed = indexed.withColumn("_block", block).withColumn("_row", F.col("_index") % block_rows)

    # A batch may reach into the next block, so its first rows are shown to both.
    ahead = (F.col("_row") < max_items) & (F.col("_block") > 0)
    shown = placed.select(
        F.explode(F.when(ahead, F.array(F.col("_block"), F.col("_block") - 1))
                  .otherwise(F.array("_block"))).alias("_block"),
        "_index", F.col(tokens).cast("bigint").alias("_tokens"),
    )

    def function_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_index")
        number = int(group["_block"].iloc[0])
        exits, counts = _block_function(
            group["_index"].to_numpy() - number * block_rows, group["_tokens"].to_numpy(),
            block_rows, max_items, max_tokens,
        )
        return pd.DataFrame({"_block": [number], "_exits": [exits.tolist()], "_counts": [counts.tolist()]})

    entries = _entries(shown.groupBy("_block").applyInPandas(function_of, _STEP), blocks, fan, max_items)

    def number_rows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_index")
        follow = _next_start(group["_tokens"].to_numpy(), max_items, max_tokens)
        starts, at = [], int(group["_entry"].iloc[0])
        while at < len(group):
            starts.append(at)
            at = int(follow[at])
        passed = np.searchsorted(np.asarray(starts, dtype=np.int64), np.arange(len(group)), side="right")
        batch = int(group["_batch"].iloc[0]) + passed - 1
        return pd.DataFrame({key: group[key], tokens: group["_tokens"], "batch": batch})

    key_type = dict(df.dtypes)[key]
    return (
        placed.select("_block", "_index", key, F.col(tokens).cast("bigint").alias("_tokens"))
        .join(entries, "_block")
        .groupBy("_block")
        .applyInPandas(number_rows, f"`{key}` {key_type}, `{tokens}` bigint, batch bigint")
    )

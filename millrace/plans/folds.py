"""Sequential rules with a small state, run block by block.

Some rules must see rows one after the other: a mean that restarts at each stop, an
exclusion that begins at one line and ends at another. Their state is two numbers and
usually forgets the past soon. An ordinary key is walked in one go. The blocks of a hot
key are walked side by side from a guessed state, and again only while the state handed
over by the block before differs from the one used; when nothing changes any more, the
result is that of the row-by-row walk.

Rules see only the columns they name, as pandas values. All others stay in Arrow, so
nothing changes them on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.spec import ident
from millrace.plans.ordered import BLK, HOME, RN, Ordered, join_keys
from millrace.session import cut_lineage

# rows in order and the state before them -> one flag per row and the state after them
Walk = Callable[[pd.DataFrame, float, float], tuple[np.ndarray | list, float, float]]


def _fresh(df: DataFrame) -> DataFrame:
    """New column identities, so that two tables of one origin can be grouped together."""
    return df.select(*[ident(c).alias(c) for c in df.columns])


def with_arrays(table: pa.Table, columns: dict[str, Sequence], kinds: Sequence[T.StructField]) -> pa.Table:
    """The table with new columns at its end; NaN is null."""
    for field in kinds:
        table = table.append_column(field.name, pa.array(columns[field.name], to_arrow_type(field.dataType), from_pandas=True))
    return table


def in_order(o: Ordered, columns: list[str], step: Callable, added: Sequence[T.StructField]) -> DataFrame:
    """Run ``step(rows, state)`` over the rows of every key in order; state is None at a key's start.

    ``rows`` holds ``columns`` only; ``step`` returns the new columns as {name: values} and the next state. Keys are
    hashed to partitions and each partition is sorted and streamed in Arrow batches, so many small keys share a batch
    and a long one never sits in memory.
    """
    kept = [f for f in o.df.schema.fields if f.name != RN]
    df = o.df.drop(RN).withColumn("__g", F.xxhash64(*[ident(k) for k in o.keys]))
    keys = [ident(k) for k in o.keys]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *[k.sort() for k in o.order])
    names, wanted = [f.name for f in kept], list(dict.fromkeys(columns))

    def run(batches):
        group, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, pdf = batch.column("__g").to_numpy(zero_copy_only=False), batch.select(wanted).to_pandas()
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
            parts = {f.name: [] for f in added}
            for a, b in zip(starts[:-1], starts[1:]):
                if ids[a] != group:
                    group, state = ids[a], None
                done, state = step(pdf.iloc[a:b], state)
                for name in parts:
                    parts[name].append(np.asarray(done[name]))
            table = pa.Table.from_batches([batch.select(names)])
            yield from with_arrays(table, {n: np.concatenate(p) for n, p in parts.items()}, added).combine_chunks().to_batches()

    return ordered.mapInArrow(run, T.StructType([*kept, *added]))


def fold(o: Ordered, columns: list[str], walk: Walk, flag: str) -> DataFrame:
    """Append the integer flags of ``walk``, which reads ``columns``; the state starts at (0, 0)."""
    added = T.StructField(flag, T.IntegerType())
    if not o.split:
        def step(pdf: pd.DataFrame, state):
            flags, s, n = walk(pdf, *(state or (0.0, 0.0)))
            return {flag: flags}, (s, n)

        return in_order(o, columns, step, [added]).drop(*o.helpers)

    data = o.blocks().drop(HOME)
    schema = T.StructType([*data.schema.fields, added])
    names = [*o.keys, BLK]
    ids = [f for f in data.schema.fields if f.name in names]
    state = T.StructType([*ids, T.StructField("__s", T.DoubleType()), T.StructField("__n", T.DoubleType())])
    order = [f.name for f in ids]
    by = [ident(n) for n in order]
    seen = list(dict.fromkeys([RN, *columns]))
    rows = cut_lineage(data.select(*by, *[ident(c) for c in seen if c not in order]))

    def walked(block: pa.Table, given: pa.Table):
        """Positions of the rows in order, their flags, and the state after them."""
        pdf = block.select(seen).to_pandas()
        place = np.argsort(pdf[RN].to_numpy(), kind="stable")
        flags, s, n = walk(pdf.iloc[place], given.column("__s")[0].as_py(), given.column("__n")[0].as_py())
        return place, flags, s, n

    def finish(block: pa.Table, given: pa.Table) -> pa.Table:
        _, _, s, n = walked(block, given)
        return with_arrays(given.select(order).slice(0, 1), {"__s": [float(s)], "__n": [float(n)]}, state.fields[-2:])

    def leave(entry: DataFrame) -> DataFrame:
        needed = join_keys(rows, entry.select(*by), order, "left_semi")
        return needed.groupBy(*by).cogroup(_fresh(entry).groupBy(*by)).applyInArrow(finish, state)

    blocks = rows.select(*by).distinct()
    entry = cut_lineage(blocks.withColumns({"__s": F.lit(0.0), "__n": F.lit(0.0)}))
    out = cut_lineage(leave(entry))
    while True:
        handed = out.select(*[(F.col(BLK) + 1).alias(BLK) if n == BLK else ident(n) for n in order],
                            F.col("__s").alias("__s2"), F.col("__n").alias("__n2"))
        both = join_keys(entry, handed, order)
        differs = ~(F.col("__s").eqNullSafe(F.col("__s2")) & F.col("__n").eqNullSafe(F.col("__n2")))
        changed = cut_lineage(both.filter(differs).select(*by, F.col("__s2").alias("__s"), F.col("__n2").alias("__n")))
        if changed.isEmpty():
            break
        entry = cut_lineage(join_keys(entry, changed, order, "left_anti").unionByName(changed))
        out = cut_lineage(join_keys(out, changed, order, "left_anti").unionByName(leave(changed)))

    def final(block: pa.Table, given: pa.Table) -> pa.Table:
        place, flags, _, _ = walked(block, given)
        back = np.empty(len(place), np.int32)
        back[place] = flags
        return with_arrays(block, {flag: back}, [added])

    return data.groupBy(*by).cogroup(_fresh(entry).groupBy(*by)).applyInArrow(final, schema).drop(*o.helpers)

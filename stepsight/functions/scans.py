"""Running values over ordered sessions of any length, and what tells sessions apart.

A window over a whole session puts it into one task. Here a session is cut into chunks of its order; every chunk is a window of its own, a
row of totals for each chunk is carried on along the session, and what a chunk begins with is joined back to it. A task gets chunks, not
sessions, and no row moves but those of totals. Chunks that begin a session need no carry, so few rows are joined. arranged() tells sessions
of several chunks from the others, which are most: these alone are read a second time for their totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

#: Places of a session that make one chunk.
CHUNK = 65_536
#: Sessions of several chunks that are told from the others by a broadcast; beyond, all sessions count as such.
SEVERAL = 100_000


def keys_of(df: DataFrame) -> list[str]:
    """What tells traces apart: trace_key where there is one (trace ids may repeat, many are `unknown`), and trace_id, which goes with it."""
    return [c for c in ("trace_key", "trace_id") if c in df.columns]


def chunked(df: DataFrame, order: str = "seq", size: int | None = None) -> DataFrame:
    """Adds chunk, ascending with order, unless it is there: ranges of an ascending number, or the blocks of a place in a file."""
    if "chunk" in df.columns:
        return df
    if "struct" in dict(df.dtypes)[order]:
        return df.withColumn("chunk", F.col(f"{order}.file_block_start").cast("long"))
    return df.withColumn("chunk", F.floor(F.col(order) / (size or CHUNK)).cast("long"))


def place_of(df: DataFrame) -> list[str]:
    """The columns that running() finds its way by, where df has them: what tells traces apart, chunk and several."""
    return [*keys_of(df), *(c for c in ("chunk", "several") if c in df.columns)]


def arranged(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """df in chunks, dealt out by keys and chunk and sorted, cached on the executors' disks: running() and groups by keys and chunk (or
    more) need no further exchange, however many plans start from it, and each reads its own columns alone. What a lost executor held is
    computed again; spark.catalog.clearCache() frees the rest.

    Adds several: whether the session has more than one chunk. They are counted first, by a job over the keys: where there are none, plans
    have no carry at all. A session of several chunks has more than CHUNK places, so they are few; where not, all count as such."""
    own = kept(chunked(df, order).repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", order))
    long = own.groupBy(*keys).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").select(*keys)
    n = long.limit(SEVERAL + 1).count()
    if 0 < n <= SEVERAL:
        return own.join(F.broadcast(long.withColumn("several", F.lit(True))), keys, "left").withColumn("several", F.coalesce("several", F.lit(False)))
    return own.withColumn("several", F.lit(n > 0))


@dataclass
class Mark:
    """A running value: `sum`, `max` or `last` (non-null) of value, up to each row; before: without the row itself."""

    kind: str
    value: Column
    before: bool = False


def running(df: DataFrame, keys: list[str], marks: dict[str, Mark], order: str = "seq") -> DataFrame:
    """Adds to chunked rows a column for each mark: its value over all rows of the same keys up to this one. Sums begin at 0, all else at null.

    Rows that say by `several` that their session is one chunk are not read for totals."""
    own = df.columns
    rows = df.select(*own, *(m.value.alias(f"{n}__of") for n, m in marks.items()))
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))}
    along = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("several") if "several" in own else rows
    totals = long.groupBy(*keys, "chunk").agg(*(total[m.kind](f"{n}__of").alias(f"{n}__all") for n, m in marks.items()))
    carry = totals.select(*keys, "chunk", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk")).alias("__nth"), *(along[m.kind](F.col(f"{n}__all")).over(before).alias(f"{n}__in") for n, m in marks.items()))
    carry = carry.where("__nth > 1").drop("__nth")
    local = Window.partitionBy(*keys, "chunk").orderBy(order)
    frames = {False: local.rowsBetween(Window.unboundedPreceding, 0), True: local.rowsBetween(Window.unboundedPreceding, -1)}
    rows = rows.select(*own, *(along[m.kind](F.col(f"{n}__of")).over(frames[m.before]).alias(f"{n}__own") for n, m in marks.items()))

    def joined(name: str, kind: str) -> Column:
        mine, carried = F.col(f"{name}__own"), F.col(f"{name}__in")
        if kind == "sum":
            return F.coalesce(mine, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.greatest(mine, carried) if kind == "max" else F.coalesce(mine, carried)

    return rows.join(carry, [*keys, "chunk"], "left").select(*own, *(joined(n, m.kind).alias(n) for n, m in marks.items()))

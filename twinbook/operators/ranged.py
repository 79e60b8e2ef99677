"""Windows over one source's rows that no task holds whole.

Rows are sorted over ranges of (key, order), so that a key with a third of all rows is many ranges; what a window needs from
before a range comes as a few copied rows (``halo``) or as one number a range. Keys that lie in one range need neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbook.session import cut_lineage

PART, HALO = "__part", "__halo"


def ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` in ranges of (key, order), numbered by ``__part``; written once, so that a range is the same whenever it is read."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(parts, key, *order).withColumn(PART, F.spark_partition_id()))


def with_halo(rows: DataFrame, key: str, order: list[str], width: int, kept: Column | None = None) -> DataFrame:
    """Rows of ``ranged`` and, before each range's rows of a key, copies (``__halo``) of the key's last ``width`` rows of the ranges before
    (of those for which ``kept`` holds). At most ``width`` rows a key and range are copied."""
    some = rows if kept is None else rows.where(kept)
    last = F.row_number().over(Window.partitionBy(key, PART).orderBy(*[F.desc(c) for c in order]))
    split = rows.select(key, PART).distinct().groupBy(key).agg(F.array_sort(F.collect_list(PART)).alias("__parts")).where(F.size("__parts") > 1)
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    tails = some.alias("r").join(F.broadcast(split.alias("s")), same).select("r.*", "s.__parts").withColumn("__i", last).where(F.col("__i") <= width)
    older = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    placed = tails.withColumn("__q", older)
    upto = placed.groupBy(key, PART).agg(F.max("__q").alias("__t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(PART).alias("p"), F.col("__t").alias("t")))).alias("__ts"))
    # Rows of a key before a range are those whose rank is at most that of the last tail before it.
    wanted = F.filter("__parts", lambda p: p > F.col(PART))
    near = F.filter(
        wanted, lambda p: F.col("__q") > F.coalesce(F.array_max(F.transform(F.filter("__ts", lambda x: x["p"] < p), lambda x: x["t"])), F.lit(0)) - width
    )
    halo = placed.alias("r").join(F.broadcast(upto.alias("s")), same).select("r.*", "s.__ts").withColumn(PART, F.explode(near)).withColumn(HALO, F.lit(True))
    return rows.withColumn(HALO, F.lit(False)).unionByName(halo.select(*rows.columns, HALO))

"""Ordering at scale: global row numbers, deterministic shuffles and splits, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with row numbers from 1 in a total order, without bringing all rows to one task.

    Rows are dealt by range and sorted there, and written once with their place in
    the range; the counts of the ranges, one for each partition, give every range
    its offset. Rows travel once.
    """
    at = f"{name}_in_range"  # never the name of the number itself
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    dealt = materialise(placed, "ranges")
    # the upper bits are the partition, the lower 33 the row in it
    part = F.shiftright(at, 33)
    counts = sorted((r["k"], r["n"]) for r in dealt.groupBy(part.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for k, n in counts:
        offsets += [F.lit(k), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    number = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1 + start
    return dealt.withColumn(name, number.cast("long")).drop(at)


def order_key(seed: str, label: Column) -> Column:
    """Sort key of a deterministic shuffle."""
    return F.sha2(F.concat_ws("|", F.lit(seed), F.concat(F.lit("order|"), label.cast("string"))), 256)


def uniform(seed: str, label: Column) -> Column:
    """Deterministic number in [0, 1): the first 13 hexadecimal digits of a digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), label.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a partial aggregate, so a hot key costs no more than others."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def stratified_split(df: DataFrame, id_col: str, stratum: str, ratio: float, seed: str) -> DataFrame:
    """``df`` with ``split``: of each stratum max(1, round half even(n ratio)) rows, n - 1 at most, are for evaluation.

    Counts are those of a seeded shuffle of each stratum; the members are the
    first in the order of a digest of seed and id.
    """
    # rows themselves are numbered, over range partitions: no task ranks a whole stratum, and rows that share an id stay one each
    keyed = df.withColumns({"__id": F.col(id_col), "__s": F.col(stratum), "__key": order_key(seed, F.col(id_col))})
    ranked = numbered(keyed, ["__s", "__key", "__id"], "__number")
    strata = ranked.groupBy(F.col("__s").alias("__t")).agg(F.count(F.lit(1)).alias("__n"), (F.min("__number") - 1).alias("__before"))
    wanted = F.when(F.col("__n") < 2, 0).otherwise(F.least(F.greatest(F.lit(1), F.bround(F.col("__n") * ratio)), F.col("__n") - 1))
    chosen = ranked.join(strata, F.col("__s").eqNullSafe(F.col("__t"))).withColumn("split", F.when(F.col("__number") - F.col("__before") <= wanted, "eval").otherwise("train"))
    return chosen.select(*df.columns, "split")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)

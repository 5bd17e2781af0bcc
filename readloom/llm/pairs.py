"""Pairing rows of hot groups without one task holding a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that meet in one block; larger groups are cut into blocks that meet two by two.
BLOCK = 1000


def paired_within(rows: DataFrame, keys: Sequence[str], order: str, per: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Pairs of rows with equal ``keys`` and different ``order``, each once; other columns come as ``<name>_a`` and ``<name>_b``.

    A group of n rows is cut into ``n / per`` blocks by a hash, and every two blocks meet under a key of their own, so no
    task pairs more than ``per`` rows with as many; each row is copied once for every block it meets.  Groups of one
    row leave first.  Null keys pair with nothing.  ``sizes`` (keys and ``_n``) are counted unless given, groups of one may be missing.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    sizes = sizes if sizes is not None else rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.where("_n > 1").select(*keys, F.ceil(F.col("_n") / per).cast("int").alias("_blocks"))
    sized = rows.join(sizes, keys).withColumn("_own", F.expr(f"cast(pmod(xxhash64(`{order}`), _blocks) as int)"))
    left = sized.select(*keys, *(F.col(c).alias(f"{c}_a") for c in rest), F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    right = sized.select(*keys, *(F.col(c).alias(f"{c}_b") for c in rest), F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"))
    met = left.join(right, [*keys, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"{order}_a") < F.col(f"{order}_b")))
    return met.where(F.col(f"{order}_a") != F.col(f"{order}_b")).drop("_i", "_j")


def spread_join(left: DataFrame, members: DataFrame, keys: Sequence[str], order: str, per: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` with the ``members`` of groups, groups of more than ``per`` members in blocks; ``sizes`` as for ``paired_within``."""
    keys = list(keys)
    sizes = sizes if sizes is not None else members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > per).select(*keys, F.ceil(F.col("_n") / per).cast("int").alias("_blocks"))
    if sizes is not None and hot.isEmpty():  # the same join without a second shuffle for blocks
        return left.join(members, keys)
    blocks = F.coalesce("_blocks", F.lit(1))
    each = left.join(hot, keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    own = members.join(hot, keys, "left").withColumn("_block", F.expr(f"cast(pmod(xxhash64(`{order}`), coalesce(_blocks, 1)) as int)")).drop("_blocks")
    return each.join(own, [*keys, "_block"]).drop("_block")

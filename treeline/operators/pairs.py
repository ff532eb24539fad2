"""Pairs of rows of one group with different labels, for the ranking objectives.

All pairs of a group would be quadratic. The pairwise objectives are defined on sampled pairs instead: every
row draws ``pairs_per_row`` partners uniformly from the rows of its group that carry another label. A partner
is addressed by its position in label order, so the join key is unique and a huge group does not skew it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.functions.hashing import digest, hash_int
from treeline.operators.ordering import hash_position


def rank_pairs(
    df: DataFrame, group: str = "group_id", row_id: str = "row_id", label: str = "label",
    carry: tuple[str, ...] = (), pairs_per_row: int = 1, seed: int = 0, round_number: int = 0,
) -> DataFrame:
    """``group, high_id, low_id, high_label, low_label, high_<c>, low_<c>`` with ``high_label > low_label``."""
    rows = df.select(F.col(group).alias("group"), F.col(row_id).alias("id"), F.col(label).alias("label"), *carry)
    rows = rows.withColumn("__hash", digest(seed, F.col("id")))
    placed = hash_position(rows, "__hash", ["id"], keys=["group"], lead=["label"], blocks=True).drop("__hash")
    drawn = placed.where("size > same")
    drawn = drawn.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(pairs_per_row - 1))))
    r = F.pmod(hash_int(seed, round_number, F.col("id"), F.col("pair")), F.col("size") - F.col("same"))
    drawn = drawn.withColumn("r", r)
    partner = F.when(F.col("r") < F.col("start"), F.col("r")).otherwise(F.col("r") + F.col("same"))
    mine = drawn.select("group", "id", "label", *carry, partner.alias("position"))
    theirs = placed.select("group", "position", *[F.col(c).alias(f"o_{c}") for c in ("id", "label", *carry)])
    joined = mine.join(theirs, ["group", "position"])
    up = F.col("label") > F.col("o_label")
    out = []
    for c in ("id", "label", *carry):
        out.append(F.when(up, F.col(c)).otherwise(F.col(f"o_{c}")).alias(f"high_{c}"))
        out.append(F.when(up, F.col(f"o_{c}")).otherwise(F.col(c)).alias(f"low_{c}"))
    return joined.select("group", *out)

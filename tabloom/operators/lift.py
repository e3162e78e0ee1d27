"""Ranking a scored table: decile lift and the reach of its top fractions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.operators.metrics import refuse_unranked
from tabloom.operators.position import DIRECT_ROWS, cuts_at_ranks, segment

DECILES = 10
TOP_FRACTIONS = (0.1, 0.2, 0.3, 0.5)


def lift_deciles(
    df: DataFrame,
    score: str,
    actual: str,
    tie_break: Sequence[str],
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Ten equal parts by falling score: response rate, lift and share of positives reached.

    The first `rows % 10` parts are one row larger. Equal scores are ordered by
    `tie_break`, which must tell rows apart.
    """
    ranked, keys = _ranked(df, score, actual, tie_break)
    rows, positives = _totals(ranked)
    sizes = [rows // DECILES + (part < rows % DECILES) for part in range(DECILES)]
    ends = [sum(sizes[: part + 1]) for part in range(DECILES - 1)]
    cuts = cuts_at_ranks(ranked.select(*keys), keys, ends, rows, direct_rows)
    decile = segment(ranked, keys, [cuts[end] for end in ends]) + 1
    base = positives / rows
    # Ten rows from here on.
    so_far = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.groupBy(decile.cast("int").alias("decile"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("positives"))
        .select(
            "decile",
            "rows",
            "positives",
            (F.col("positives") / F.col("rows")).alias("response_rate"),
            (F.col("positives") / F.col("rows") / F.lit(base)).alias("lift"),
            (F.sum("positives").over(so_far) / F.lit(positives)).alias("cumulative_share"),
        )
    )


def lift_top_fractions(
    df: DataFrame,
    score: str,
    actual: str,
    tie_break: Sequence[str],
    fractions: Sequence[float] = TOP_FRACTIONS,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """What acting on the top of the ranking reaches, per fraction of the rows."""
    ranked, keys = _ranked(df, score, actual, tie_break)
    rows, positives = _totals(ranked)
    ends = {fraction: round(rows * fraction) for fraction in fractions}
    inner = sorted({end for end in ends.values() if 0 < end < rows})
    cuts = cuts_at_ranks(ranked.select(*keys), keys, inner, rows, direct_rows)
    # Parts lie between neighbouring cut-offs; a fraction reaches all parts above its own.
    part = segment(ranked, keys, [cuts[end] for end in inner])
    counted = ranked.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("positives")
    )
    reached = F.array(
        *(
            F.struct(F.lit(float(f)).alias("fraction"), F.lit(sum(e <= end for e in inner)).alias("parts"))
            for f, end in ends.items()
        )
    )
    base = positives / rows
    return (
        counted.select(
            F.explode(F.filter(reached, lambda top: F.col("part") < top["parts"])).alias("top"),
            "rows",
            "positives",
        )
        .select("top.fraction", "rows", "positives")
        .groupBy("fraction")
        .agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))
        .select(
            "fraction",
            "rows",
            "positives",
            (F.col("positives") / F.lit(positives)).alias("reach"),
            (F.col("positives") / F.col("rows")).alias("response_rate"),
            (F.col("positives") / F.col("rows") / F.lit(base)).alias("lift"),
        )
    )


def _ranked(
    df: DataFrame, score: str, actual: str, tie_break: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    refuse_unranked(df, score)
    ranked = df.select(
        (-quoted(score).cast("double")).alias("__rank"),
        quoted(actual).cast("bigint").alias("actual"),
        *(quoted(name) for name in tie_break),
    )
    return ranked, ["__rank", *tie_break]


def _totals(ranked: DataFrame) -> tuple[int, int]:
    found = ranked.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("positives")
    ).first()
    if found["rows"] < DECILES:
        raise ValueError(
            f"{found['rows']} scored rows cannot fill {DECILES} deciles; hold out more"
        )
    if not found["positives"]:
        raise ValueError("none of the scored rows is positive, so lift is undefined")
    return found["rows"], found["positives"]

"""Deciles and top shares of ranked rows against sorting them in plain Python."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tabloom.operators.lift import lift_deciles, lift_top_fractions

from tests.conftest import frame


def melons(seed: int, rows: int, ripe: float, grades: int) -> list[tuple[int, float, int]]:
    """Melons with a sweetness of few grades, so that many tie; sweet ones are ripe more often."""
    pick = np.random.default_rng(seed)
    sweet = pick.integers(0, grades, rows) / grades
    is_ripe = pick.random(rows) < np.clip(ripe + sweet - 0.5, 0, 1)
    keys = pick.permutation(rows)
    return [(int(k), float(s), int(y)) for k, s, y in zip(keys, sweet, is_ripe, strict=True)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "melon int, sweet double, ripe int").repartition(3)


def sorted_out(rows):
    """Ripe flags from the sweetest on, equal ones by their number."""
    return [y for _, _, y in sorted(rows, key=lambda row: (-row[1], row[0]))]


def plain_deciles(rows):
    flags = sorted_out(rows)
    large, small = len(flags) % 10, len(flags) // 10
    out, seen, at = [], 0, 0
    for decile in range(1, 11):
        part = flags[at : at + small + (decile <= large)]
        at, seen = at + len(part), seen + sum(part)
        rate, overall = Fraction(sum(part), len(part)), Fraction(sum(flags), len(flags))
        out.append((decile, len(part), sum(part), float(rate), float(rate / overall), seen / sum(flags)))
    return out


CROPS = {
    "few melons, all grades": (3, 17, 0.5, 17),
    "one grade only": (4, 53, 0.8, 1),
    "two grades": (5, 240, 0.5, 2),
    "a crop that fills deciles evenly": (6, 470, 0.2, 30),
    "hardly any ripe": (7, 333, 0.08, 5),
    "nearly all ripe": (8, 101, 0.97, 9),
}


@pytest.mark.parametrize("crop", CROPS)
def test_deciles_of_a_crop(spark, crop):
    rows = melons(*CROPS[crop])
    found = lift_deciles(table_of(spark, rows), "sweet", "ripe", ["melon"]).orderBy("decile").collect()
    for row, expected in zip(found, plain_deciles(rows), strict=True):
        assert tuple(row) == pytest.approx(expected)


def test_scores_that_tell_all_melons_apart(spark):
    """The sweetest seven are the ripe ones: the best decile holds a seventh of its reach each."""
    rows = [(k, 1 / (k + 1), int(k < 7)) for k in range(64)]
    found = lift_deciles(table_of(spark, rows), "sweet", "ripe", ["melon"]).orderBy("decile").collect()
    for row, expected in zip(found, plain_deciles(rows), strict=True):
        assert tuple(row) == pytest.approx(expected)
    assert [row["positives"] for row in found[:2]] == [7, 0] and found[0]["rows"] == 7


@pytest.mark.parametrize("direct_rows", [16, 10_000])
@pytest.mark.parametrize("crop", CROPS)
def test_top_shares_of_a_crop(spark, crop, direct_rows):
    rows = melons(*CROPS[crop])
    flags = sorted_out(rows)
    found = lift_top_fractions(table_of(spark, rows), "sweet", "ripe", ["melon"], direct_rows=direct_rows)
    for row in found.collect():
        top = flags[: round(len(flags) * row["fraction"])]  # halves to the even number
        assert (row["rows"], row["positives"]) == (len(top), sum(top))
        assert row["reach"] == pytest.approx(sum(top) / sum(flags))
        assert row["lift"] == pytest.approx((sum(top) / len(top)) / (sum(flags) / len(flags)))


def test_a_score_shared_by_half_the_rows_is_cut_in_several_passes(spark):
    rows = [(k, 0.0 if s < 0.5 else s, y) for k, s, y in melons(12, 1900, 0.3, 300)]
    found = lift_deciles(table_of(spark, rows), "sweet", "ripe", ["melon"], 16).orderBy("decile").collect()
    for row, expected in zip(found, plain_deciles(rows), strict=True):
        assert tuple(row) == pytest.approx(expected)


@pytest.mark.parametrize(("rows", "ripe", "refusal"), [(6, 1, "6 scored rows"), (31, 0, "none of")])
def test_crops_that_have_no_lift(spark, rows, ripe, refusal):
    crop = frame(spark, {"k": list(range(rows)), "s": [0.25] * rows, "y": [ripe] * rows}, "k int, s double, y int")
    with pytest.raises(ValueError, match=refusal):
        lift_deciles(crop, "s", "y", ["k"])

"""Placeholders that disagree in one place, and two that get the same filling."""

from .test_leaked_copies import LONG, TWO, _leaks


def test_one_slot_that_disagrees(spark):
    assert _leaks(spark, [LONG], [f"x {LONG[::-1].replace('5', '6', 1)[::-1]} y"]) == {(0, 0): True}


def test_two_slots_with_the_same_filling(spark):
    assert _leaks(spark, [TWO], [f"x {TWO.replace('7', '9').replace('5', '9')} y"]) == {(0, 0): True}

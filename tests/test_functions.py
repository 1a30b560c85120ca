from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from coldtrail.functions import text, timebucket


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("value, shown", [
    (351.5, "351.5"), (350.0, "350"), (0.0, "0"), (0.25, "0.25"), (1234.5678, "1234.57"), (100000.0, "100000"),
    (1234567.0, "1.23457e+006"), (0.00001, "1e-005"), (-2.5, "-2.5"), (None, None)])
def test_number_text(spark, value, shown):
    assert one(spark, text.number_text(F.lit(value).cast("double"))) == shown


@pytest.mark.parametrize("message, inside, before, word", [
    ("0(17)", "17", "0", ""), ("card lost (3)", "3", "card lost ", "card"), ("", "", "", ""), ("plain", "", "plain", "")])
def test_message_parts(spark, message, inside, before, word):
    m = F.lit(message)
    assert one(spark, text.inside_parentheses(m)) == inside
    assert one(spark, text.before_parenthesis(m)) == before
    assert one(spark, text.before_space(m)) == word


def test_rounding_is_half_away_from_zero(spark):
    assert float(one(spark, text.rounded(F.lit(2.25), 8, 1))) == 2.3
    assert float(one(spark, text.rounded(F.lit(-2.25), 8, 1))) == -2.3


def test_weeks_run_sunday_to_saturday_and_are_labelled_by_friday(spark):
    for day in range(400):
        date = dt.datetime(2023, 1, 1) + dt.timedelta(days=day)  # a Sunday
        sunday = date - dt.timedelta(days=(date.weekday() + 1) % 7)
        if day % 29 == 0:
            assert one(spark, timebucket.week_label(F.lit(date))) == sunday + dt.timedelta(days=5)


def test_boundary_diff_counts_crossings(spark):
    a, b = F.lit(dt.datetime(2024, 1, 1, 0, 0, 59)), F.lit(dt.datetime(2024, 1, 1, 0, 1, 1))
    assert one(spark, timebucket.boundary_diff("minute", a, b)) == 1
    assert one(spark, timebucket.boundary_diff("hour", a, b)) == 0


def test_round_second(spark):
    assert one(spark, timebucket.round_second(F.lit(dt.datetime(2024, 1, 1, 0, 0, 0, 500000)))) == dt.datetime(2024, 1, 1, 0, 0, 1)
    assert one(spark, timebucket.round_second(F.lit(dt.datetime(2024, 1, 1, 0, 0, 0, 499999)))) == dt.datetime(2024, 1, 1)


def test_unknown_interval():
    with pytest.raises(ValueError):
        timebucket.bucket(F.lit(1), "Month")

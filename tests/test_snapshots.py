"""Ratings before each of some dates, in slices: what one stream over the four years before gives."""

import datetime as dt

import pytest
from conftest import DATA

from touchline.operators import ratings
from touchline.plans import models


def test_snapshots_in_slices_are_those_of_one_stream(spark):
    m, dates = models.played(spark, DATA), [dt.date(1996, 1, 1), dt.date(1998, 1, 1)]
    one, many = ({(r["at"], r["team"]): r["rating"] for r in ratings.snapshots(m, dates, rows=n).collect()} for n in (1 << 40, 60))
    assert {a for a, _ in one} == set(dates) and len(one) == 40
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(one[k], abs=1e-6) for k in one)
    assert ratings.snapshots(m, []).count() == 0

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareframe.functions import calendar as C
from fareframe.functions import numbers as N
from fareframe.functions import places as P
from fareframe.functions import weather as W

c = F.col


def test_distance_band_edges(column):
    miles = [(0.0,), (2.0,), (2.1,), (5.0,), (10.0,), (20.0,), (20.5,), (None,)]
    got = column(miles, "m double", lambda: N.distance_band(c("m")))
    assert got == ["0-2", "0-2", "2-5", "2-5", "5-10", "10-20", "20+", None]
    short = column(miles, "m double", lambda: N.distance_band(c("m"), (2, 5, 10), "mi", "none"))
    assert short == ["0-2mi", "0-2mi", "2-5mi", "2-5mi", "5-10mi", "10+mi", "10+mi", "none"]


def test_precip_and_wind_bins(column):
    mm = [(0.0,), (1.0,), (2.0,), (3.0,), (5.0,), (10.0,), (10.1,), (None,)]
    assert column(mm, "m double", lambda: N.precip_bin(c("m"))) == [
        "0", "0-2", "0-2", "2-5", "2-5", "5-10", "10+", None,
    ]
    assert column(mm, "m double", lambda: N.precip_bin(c("m"), "fine")) == [
        "0", "0-1", "1-3", "1-3", "3-10", "3-10", ">10", None,
    ]
    kmh = [(5.0,), (5.1,), (20.0,), (21.0,), (None,)]
    assert column(kmh, "m double", lambda: N.wind_bin(c("m"))) == ["0-5", "5-10", "10-20", ">20", None]


def test_temp_bins(column):
    t = [(-2.5,), (-0.1,), (0.0,), (2.4,), (2.5,), (5.0,), (None,)]
    assert column(t, "t double", lambda: N.temp_bin(c("t"))) == [-5, -5, 0, 0, 0, 5, None]
    assert column(t, "t double", lambda: N.temp_bin(c("t"), mode="nearest")) == [-5.0, 0.0, 0.0, 0.0, 5.0, 5.0, None]


def test_measure(column):
    raw = [(" 12 ",), ("",), ("T",), (None,), ("abc",), ("-3.5",)]
    assert column(raw, "s string", lambda: N.measure(c("s"))) == [12.0, None, None, None, None, -3.5]
    assert column(raw, "s string", lambda: N.measure(c("s"), 0.01)) == [12.0, None, 0.01, None, None, -3.5]


def test_yes_no_and_ratios(column):
    assert column([("Y",), ("n",), ("x",), (None,)], "s string", lambda: N.yn(c("s"))) == [True, False, None, None]
    pairs = [(1.0, 4.0), (1.0, 0.0), (1.0, None)]
    assert column(pairs, "a double, b double", lambda: N.ratio(c("a"), c("b"))) == [0.25, 0.0, 0.0]
    assert column(pairs, "a double, b double", lambda: N.safe_pct(c("a"), c("b"))) == [25.0, None, None]


def test_equal_width_bin(column):
    got = column(
        [(0.0,), (4.9,), (5.0,), (10.0,), (11.0,)], "v double",
        lambda: N.equal_width_bin(c("v"), F.lit(0.0), F.lit(10.0), 2),
    )
    assert got == [0, 0, 1, 1, None]


WEEKDAY, WEEKEND = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 6)
RUSH = {
    0: ("late_night", "late_night"), 5: ("late_night", "late_night"), 6: ("off_peak", "weekend"),
    7: ("morning_rush", "weekend"), 9: ("morning_rush", "weekend"), 10: ("business_hours", "weekend"),
    17: ("evening_rush", "weekend"), 19: ("evening_rush", "weekend"), 20: ("off_peak", "weekend"),
    22: ("late_night", "late_night"), 23: ("late_night", "late_night"),
}


@pytest.mark.parametrize("side,day", [(0, WEEKDAY), (1, WEEKEND)])
def test_rush_labels(column, side, day):
    rows = [(day.replace(hour=h),) for h in RUSH]

    def label():
        ts = c("ts")
        return C.rush_label(F.hour(ts), C.weekend(C.day_of_week(ts)))

    assert column(rows, "ts timestamp", label) == [v[side] for v in RUSH.values()]


def test_time_period_and_season(column):
    hours = [(4,), (5,), (11,), (12,), (17,), (18,), (21,), (22,)]
    assert column(hours, "h int", lambda: C.time_period(c("h"))) == [
        "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night",
    ]
    dates = [(dt.date(2024, m, 1),) for m in (12, 2, 3, 6, 9, 11)] + [(None,)]
    assert column(dates, "d date", lambda: C.season(c("d"))) == ["winter", "winter", "spring", "summer", "fall", "fall", None]


def test_month_bounds(column):
    dates = [(dt.date(2024, 2, 1),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 1),), (dt.date(2024, 1, 31),)]
    assert column(dates, "d date", lambda: C.in_month(c("d"), 2024, 2)) == [True, True, False, False]


def test_duration_and_speed(column):
    rows = [(dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 30), 10.0), (WEEKDAY, WEEKDAY, 1.0)]
    schema = "a timestamp_ntz, b timestamp_ntz, m double"
    assert column(rows, schema, lambda: C.duration_seconds(c("a"), c("b"))) == [1800, 0]
    assert column(rows, schema, lambda: C.speed_mph(c("m"), C.duration_seconds(c("a"), c("b")))) == [20.0, None]


def test_cbd_type(column):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0)]
    got = column(rows, "p int, d int", lambda: P.cbd_type(c("p"), c("d")))
    assert got == ["intra_cbd", "outbound_cbd", "inbound_cbd", "non_cbd"]
    assert column(rows[:1], "p int, d int", lambda: P.cbd_type(None, None)) == ["unknown"]


def test_flags_with_missing_boroughs(column):
    rows = [("Manhattan", "Bronx"), ("Queens", "Queens"), ("Queens", None), (None, None), ("Manhattan", None)]
    schema = "p string, d string"
    assert column(rows, schema, lambda: P.cross_borough(c("p"), c("d"))) == [True, False, False, False, False]
    assert column(rows, schema, lambda: P.cross_borough(c("p"), c("d"), None)) == [True, False, None, None, None]
    assert column(rows, schema, lambda: P.involves_borough(c("p"), c("d"))) == [True, False, False, False, True]
    assert column(rows, schema, lambda: P.involves_borough(c("p"), c("d"), null_as=None)) == [True, False, None, None, True]
    ids = [(1, 5), (5, 138), (5, 6)]
    assert column(ids, "p int, d int", lambda: P.involves_airport_ids(c("p"), c("d"))) == [True, True, False]


def test_comfort_edges(column):
    rows = [
        (18.0, 0.0), (24.0, 0.0), (17.9, 0.0), (15.0, 1.0), (27.0, 1.0), (10.0, 5.0), (30.0, 5.0), (0.0, 20.0),
        (35.0, 20.0), (36.0, 0.0), (None, 0.0),
    ]
    got = column(rows, "t double, p double", lambda: W.comfort_index(c("t"), c("p")))
    assert got == [5, 5, 4, 4, 4, 3, 3, 2, 2, 1, 1]
    windy = [(20.0, 0.0, 19.9), (20.0, 0.0, 20.0), (20.0, 5.0, 10.0), (38.0, 0.0, 0.0), (41.0, 0.0, 0.0), (None, 0.0, 0.0)]
    got = column(windy, "t double, p double, w double", lambda: W.comfort_index(c("t"), c("p"), c("w")))
    assert got == [5, 4, 3, 2, 1, 1]


def test_units(column):
    assert column([("212",), ("32",), ("-51",)], "s string", lambda: W.fahrenheit_to_c(c("s"), (-50, 250))) == [100.0, 0.0, None]
    assert column([("T",), ("",), ("-1",), ("2",)], "s string", lambda: W.inches(c("s"), 25.4)) == [0.254, 0.0, 0.0, 50.8]
    assert column([("250",), ("10",), (None,)], "s string", lambda: W.mph_to_kmh(c("s"))) == [None, 16.0934, None]


def test_fog_flag(column):
    rows = [(1, 0), (0, 0), (None, 1), (None, None)]
    assert column(rows, "a int, b int", lambda: W.fog_flag(c("a"), c("b"))) == [1, 0, 1, 0]

"""First dates of all kinds, in the order of the kinds."""

from datetime import date

from pyspark.sql import functions as F

from strataleaf.operators.extract import first_date

CASES = [
    ("in 1999, on 2024-06-01", date(2024, 6, 1)), ("2024-02-30 or June 3, 2021", date(2021, 6, 3)), ("JUNE 01,2024", date(2024, 6, 1)), ("Dec 9, 2020", date(2020, 12, 9)),
    ("1 May 2019", date(2019, 5, 1)), ("30 February 2019", date(2019, 2, 1)), ("45 March 2018", date(2018, 3, 1)), ("sept 2018, October 2017", date(2017, 10, 1)),
    ("Q3 FY2022", date(2022, 7, 1)), ("q4 2021", date(2021, 10, 1)), ("about 1987 or so", date(1987, 1, 1)), ("01/06/2024", date(2024, 1, 1)), ("01/06/2124", date(2124, 6, 1)),
    ("12-31-2124", date(2124, 12, 31)), ("31-31-2124", None), ("May 2150", None), ("June 31, 1850 and Q1 2020", date(2020, 1, 1)), ("0000-01-01", None), ("no date", None), ("", None), (None, None),
    ("x" * 495 + " 2024", date(2024, 1, 1)), ("x" * 496 + " 2024", None), (" " * 496 + "2024", date(2024, 1, 1)), (" " * 497 + "2024", None),
]


def test_first_dates(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.day for r in rows.select("i", first_date(F.col("t")).alias("day")).collect()}
    assert {CASES[i][0]: d for i, d in got.items() if d != CASES[i][1]} == {}

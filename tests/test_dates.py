"""Partial dates of every layout."""

import pytest
from pyspark.sql import functions as F
from tonestream.functions import text

CASES = {
    "2006-01-02T15:04:05Z": "2006-01-02T15:04:05", "2006-01-02T15:04:05.25+07:00": "2006-01-02T15:04:05", "2006-01-02T15:04:05": "2006-01-02T15:04:05",
    "2006-01-02T15:04": "2006-01-02T15:04", "2006-01-02T15": "2006-01-02T15", "2006-01-02": "2006-01-02", "2006-01": "2006-01", "2006": "2006",
    "2006/01/02 15:04:05": "2006-01-02T15:04:05", "2006/01/02 15:04": "2006-01-02T15:04", "2006/01/02 15": "2006-01-02T15", "2006/01/02": "2006-01-02", "2006/01": "2006-01",
    "Mon, 02 Jan 2006 15:04:05 MST": "2006-01-02T15:04:05", "Mon, 02 Jan 2006 15:04:05 -0700": "2006-01-02T15:04:05", "Mon, 02 Jan 2006 15:04:05": "2006-01-02T15:04:05",
    "Mon, 02 Jan 2006 15:04 MST": "2006-01-02T15:04", "Mon, 02 Jan 2006 15:04": "2006-01-02T15:04", "02 Jan 2006 15:04:05 MST": "2006-01-02T15:04:05",
    "02 Jan 2006 15:04 -0700": "2006-01-02T15:04", "02 Jan 2006": "2006-01-02", "02 Jan 06 15:04 MST": "2006-01-02T15:04", "02 Jan 69 15:04:05 -0700": "1969-01-02T15:04:05",
    "02 Jan 68": "2068-01-02", "Jan 06": "2006-01", "January 2, 2006": "2006-01-02", "Dec 12, 2006": "2006-12-12", "december 2006": "2006-12", "May 2006": "2006-05",
    "2024-02-29": "2024-02-29",
}
NONE = ["", "x", "2023-02-29", "2006-13", "2006-1-2", "01/02/2006", "20060102", "2006-01-02 15:04", "02 Jan 2006 15:04", "Mon, 02 Jan 2006", "Janu 2006", "31 Jun 2006", "2006-01-02T24"]


@pytest.mark.parametrize("cases", [CASES, dict.fromkeys(NONE, "")])
def test_dates(spark, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.iso_date(text.partial_date(F.col("t"))).alias("iso")).collect()
    assert {r.t: r.iso for r in rows} == cases

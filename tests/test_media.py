"""Every query on files, tags and encoder decisions gives DuckDB's rows."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tonestream.functions import layouts
from tonestream.plans import media

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(media.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in "customer part orders events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = media.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(media.SQL[name])
    at = [[c[0] for c in r.description].index(c) for c in cols]
    want = sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())
    got = sorted(str(tuple(x[c] for c in cols)) for x in df.collect())
    assert got and got == want


def test_fnv(spark):
    """Published vectors of FNV-1a, with the top bit set."""
    rows = spark.createDataFrame([(b"",), (b"a",), (b"foobar",), (None,)], "x binary").select(layouts.fnv64(F.col("x")).alias("h")).collect()
    known = [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert [r.h for r in rows] == [f"{k | 1 << 63:016x}" for k in known] + [None]

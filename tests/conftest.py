import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        return repr(float(x)) if isinstance(x, float) or type(x).__name__ == "Decimal" else repr(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows), [columns[i] for i in order]


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query with its SQL twin over the smallest tables."""

    def check(query, sql):
        df = query(spark, SF)
        got = canonical([tuple(r) for r in df.collect()], df.columns)
        c = duck.execute(sql)
        assert got == canonical(c.fetchall(), [x[0] for x in c.description])

    return check

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canonical(rows, columns):
    """Rows as sorted strings, columns by name, floats to nine places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out)


def duck(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(sql)
    return canonical(got.fetchall(), [d[0] for d in got.description])


def same_as_duck(df, sql, sf=SF):
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    theirs = duck(sql, sf)
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def same_rows(df, rel):
    """Rows of a Spark frame and a DuckDB relation, in any order, numbers to nine digits."""

    def plain(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, bool):
            return v
        return v

    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    left = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    place = [rel.columns.index(n) for n in names]
    right = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, float) for x in a) else [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in a] == pytest.approx([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in b])

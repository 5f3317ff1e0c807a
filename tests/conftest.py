"""One session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)
    here = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(here / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{here}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function from a scale to a DuckDB connection with the testdata as views."""
    import duckdb

    def at(sf: str):
        con = duckdb.connect()
        for p in sorted((DATA / sf).glob("*.parquet")):
            con.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
        return con

    return at


@pytest.fixture(scope="session")
def compared():
    """Both results as sorted rows of texts, columns by name."""

    def rows(table) -> list[tuple]:
        names = sorted(table.column_names)
        shown = lambda v: f"{v:.10g}" if isinstance(v, float) else str(v)
        return sorted(tuple(map(shown, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))

    def check(frame, con, sql: str) -> None:
        left, right = frame.toArrow(), con.sql(sql).arrow()
        right = right.read_all() if hasattr(right, "read_all") else right
        assert sorted(left.column_names) == sorted(right.column_names)
        assert rows(left) == rows(right)

    return check

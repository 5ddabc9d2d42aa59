import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Run DuckDB SQL over the tables of a folder."""
    import duckdb

    def run(sql: str, sf: str):
        con = duckdb.connect()
        for p in Path(DATA, sf).glob("*.parquet"):
            path = f"{p}/*.parquet" if p.is_dir() else str(p)
            con.execute(f"CREATE VIEW {p.stem} AS FROM '{path}'")
        return con.sql(sql)

    return run


def rows(columns, values):
    """Rows as sorted tuples with columns by name, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)

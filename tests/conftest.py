import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from murmura.session import ship

    ship(session)
    yield session
    session.stop()


def shown(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.8g}"
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return str(v)


@pytest.fixture(scope="session")
def agree(spark):
    """Whether a query and its SQL give the same rows over one of the driver's small folders."""
    def run(query, sql, sf_dir="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        mine = sorted([shown(r[c]) for c in columns] for r in df.collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        theirs = sorted([shown(r[names.index(c)]) for c in columns] for r in found.fetchall())
        assert mine == theirs

    return run

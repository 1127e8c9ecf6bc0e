import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tokenweir.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    import numpy as np
    import pandas as pd

    if isinstance(v, list | tuple | np.ndarray):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float | np.floating):
        return round(float(v), 9)
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    return v


@pytest.fixture(scope="session")
def same():
    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(str([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))

    def check(spark_frame, duck_frame):
        a, b = spark_frame.toPandas(), duck_frame
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check

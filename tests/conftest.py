import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from candela.session import local_session

    session = local_session(4, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def normal(rows, columns):
    """Rows as sorted strings, columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con

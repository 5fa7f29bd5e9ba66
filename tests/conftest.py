import sys
from pathlib import Path

import pytest
from hypothesis import settings

settings.register_profile("steady", deadline=None)
settings.load_profile("steady")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from notelake.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over the smallest tables."""
    import os

    import duckdb

    db = duckdb.connect()
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return lambda sql: db.execute(sql).df()


def same_rows(left, right) -> bool:
    """Whether two pandas frames hold the same rows, in any order."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)

    def rows(frame):
        plain = frame[columns].astype(object).where(frame[columns].notna(), None)
        return sorted(map(repr, ([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r] for r in plain.values.tolist())))

    return rows(left) == rows(right)

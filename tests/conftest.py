"""One Spark session for all tests, and the comparison of a query with its SQL twin."""

from __future__ import annotations

import decimal
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leakscope.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings targets records member_scores structural_records "
    "report_files attack_names report_fields rank_requests source_mix"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


def plain(value):
    """A value that both engines give alike."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def twin():
    """twin(df, sql): assert that the SQL gives the rows of the frame."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")

    def check(df, sql: str) -> None:
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())

    return check

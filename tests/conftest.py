"""Session, fixtures and comparison helpers."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from terraweft.plans.fixtures import Fixtures  # noqa: E402
from terraweft.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "terraweft-tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    # a local session without spark.checkpoint.dir takes a folder of this machine
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fx(spark):
    return Fixtures(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def same_rows(a: pd.DataFrame, b: pd.DataFrame) -> None:
    """Equal columns and equal rows in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def tidy(df):
        df = df[cols].copy()
        for c in cols:
            if df[c].dtype == object or str(df[c].dtype).startswith(("Int", "bool")):
                df[c] = df[c].astype(str) if df[c].map(type).eq(str).any() else df[c].astype(float)
            if df[c].dtype.kind in "iuf":
                df[c] = df[c].astype(float)
        return df.sort_values(cols, na_position="first").reset_index(drop=True)

    left, right = tidy(a), tidy(b)
    assert len(left) == len(right)
    pd.testing.assert_frame_equal(left, right, check_dtype=False, rtol=1e-9, atol=2e-9)

import glob
import os

import duckdb
import pytest

from framelake.plans import media_oracles, oracles
from framelake.plans.queries import QUERIES
from tests.oracle import compare

ORACLES = oracles.ORACLES | media_oracles.ORACLES
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    if name in ORACLES:
        compare(spark, SF, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_rates_of_large_keys(spark, tmp_path):
    for path in glob.glob(f"{SF}/*.parquet"):
        if os.path.basename(path) != "part.parquet":
            os.symlink(path, tmp_path / os.path.basename(path))
    shifted = f"SELECT p_partkey + s AS p_partkey, p_size FROM '{SF}/part.parquet', (VALUES (0), (100_000), (1_180_000), (3_000_000_000), (9_000_000_000_000_000)) c(s)"
    duckdb.sql(f"COPY ({shifted}) TO '{tmp_path}/part.parquet'")
    assert len(compare(spark, str(tmp_path), QUERIES["rate_texts"], ORACLES["rate_texts"])) == 200 * 5 * 8


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import digest, duck

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(SQLS))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(SQLS[key])
    drows, dcols = rel.fetchall(), list(rel.columns)
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["document_id", "redacted_count", "redacted_preview", "proof_id", "engine", "seal"]

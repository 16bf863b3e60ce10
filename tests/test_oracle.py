"""Every query with an oracle gives exactly the oracle's rows."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def con():
    return connect(SF_ORACLE)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = contract.queries()[name](spark, SF_ORACLE)
    frame = con.execute(contract.oracle_sql()[name]).df()
    assert df.toPandas().dtypes.astype(str).to_dict() == frame.dtypes.astype(str).to_dict()
    names, wanted, extra, lacking = compare(df, con, contract.oracle_sql()[name])
    assert names == wanted
    assert not extra and not lacking, (len(extra), extra[:3], len(lacking), lacking[:3])


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 40

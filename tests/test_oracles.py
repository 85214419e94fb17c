"""Every query with a SQL equivalent gives its rows; the others give rows with unique column names."""

import oracle
import pytest

from plumbline.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equal_to_sql(spark, sf_dir, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_flagship(spark, sf_dir):
    rows = registry.flagship(spark, sf_dir).collect()
    assert len(rows) == 200
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert {r["verdict"] for r in rows} <= {"undetermined", "synthetic", "bonafide"}

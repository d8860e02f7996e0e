"""Every query of the library against the SQL that should give the same rows."""

import duckdb
import pandas as pd
import pytest

from leafstack import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df: pd.DataFrame) -> list:
    """Rows with columns by name, in an order of their own, numbers to nine digits."""

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return float(f"{x:.9g}")
        if isinstance(x, pd.Timestamp):
            return str(x)
        return x.item() if hasattr(x, "item") else list(x) if hasattr(x, "tolist") else x

    df = df[sorted(df.columns)]
    return sorted((tuple(repr(float(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in map(plain, r)) for r in df.itertuples(index=False)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_rows_equal(spark, sf_dir, duck, name):
    got, wanted = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_part_that_may_be_absent():
    """The other queries work when the training-data operators can't be imported."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'html_anchors' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("pathlib").Path(__file__).parent.parent)

"""Driver contract: entry smoke check and the query / oracle registry."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25
    assert set(df.columns) == {"fold", "o_orderpriority", "n_heldout", "mean_enc", "mean_abs_err"}


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50

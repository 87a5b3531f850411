"""Driver contract: entry() schema, queries()/oracle_sql() keys."""

import __spark_entry__ as E


def test_contract(spark):
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 100 and set(o) <= set(q)
    assert all(isinstance(sql, str) and sql.strip() for sql in o.values())
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["mtype", "risk_level", "n", "mean_prob", "max_power"]
    assert df.count() > 0

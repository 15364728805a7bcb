"""Queries against their SQL on keys and groups that the small tables don't have."""

import duckdb

from veinlode import catalog


def same_as_sql(spark, name, folder, tables):
    """Writes ``tables`` (name: rows as SQL) to ``folder`` and compares the query with its SQL over them."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.execute(f"create table {table} as {rows}")
        con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    df = catalog.queries()[name](spark, str(folder))
    cur = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
    return want


def test_two_passes_with_long_keys(spark, tmp_path):
    """Paths have five digits of the key, so several files share one; a customer twice and one without key."""
    rows = "select unnest([3, 7, 9, 12345, 99999, 100001, 100002, 123451, 123452, 370353, 1234567, 1234568, 1234568, null])::bigint as c_custkey"
    assert len(same_as_sql(spark, "w5_two_passes", tmp_path, {"customer": rows})) == 22

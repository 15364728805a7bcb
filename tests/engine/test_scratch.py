"""What queries write beside their result: shuffle files and tables of their own."""

import hashlib
import os

from pyspark.sql import functions as F

from veinlode.operators import digests


def written(spark, job):
    """Result of ``job`` and the bytes that it leaves in the scratch folders."""
    folder = spark.conf.get("spark.local.dir")
    size = lambda: sum(os.path.getsize(os.path.join(r, f)) for r, _, files in os.walk(folder) for f in files)
    before = size()
    return job(), size() - before


def test_set_digests_write_little(spark):
    """A member is a hash of 32 bytes, once in its bucket and once more in its block (329 bytes a member before)."""
    n = 100_000
    members = spark.range(0, n, 1, 8).select(F.lit("s").alias("k"), F.format_string("member-%d", "id").alias("t"))
    got, size = written(spark, lambda: digests.set_digests(members, "k", "t").collect())
    level = sorted(hashlib.sha256(f"member-{i}".encode()).hexdigest() for i in range(n))
    level = [hashlib.sha256("".join(level[i : i + 1024]).encode()).hexdigest() for i in range(0, n, 1024)]
    assert [(r.k, r.digest, r.n) for r in got] == [("s", hashlib.sha256("".join(level).encode()).hexdigest(), n)]
    assert size < 130 * n, size / n


def test_snapshot_shuffles_supports_once(spark):
    """Supports and what is effective of them meet their objects by one shuffle (18 exchanges before)."""
    o = spark.range(50).selectExpr("concat('O', id) object_id", "'fact' kind", "'p' payload", "cast(null as string) subject")
    s = spark.range(300).selectExpr("concat('O', id % 60) object_id", "concat('C', id % 7) candidate_id", "if(id % 2 = 0, 'low', 'high') confidence")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = digests.snapshot_sections(o, s, s.where("candidate_id <> 'C3'"), 2)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.text.split("|")[1] for r in df.where("section = 'supports'").collect()} == {f"C{k}" for k in range(7) if k != 3}
    assert plan.count("Exchange ") <= 7, plan.count("Exchange ")

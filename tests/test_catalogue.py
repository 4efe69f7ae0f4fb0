"""Searches of the catalogue over lists of grams, and the pool of clients."""

import time

import pytest
from pyspark.sql import functions as F

from gregale.operators import enrich
from gregale.plans import catalogue


def test_contains_search_equals_a_scan(spark, tmp_path):
    names = ["Ann.Lee@x.org", "ANNA@y.fr", "bob%lee@x.org", "é_À@z.fr", "", None, "an", "leeleelee", "x.or"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, email string")
    catalogue.write_grams(df, "id", "email", str(tmp_path / "g"))
    grams = spark.read.parquet(str(tmp_path / "g"))
    for part in ("ann", "LEE@", "%lee", "x.org", "é_à", "n", "leelee", "zzz", "lee@x.org"):
        want = [i for i, n in enumerate(names) if n is not None and part.lower() in n.lower()]
        assert sorted(r.id for r in catalogue.containing(df, grams, part, "id", "email").collect()) == want
    plan = catalogue.containing(df, grams, "leelee", "id", "email")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan


def asked(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("ask"))


def test_pool_keeps_the_rate_over_all_tasks(spark):
    """Two callers of one kind make 20 calls a second together, whatever the number of partitions."""
    stamp = lambda: lambda prompt: f"{prompt} {time.time()}"
    rows = enrich.pooled(asked(spark, 24).repartition(4), [enrich.Caller(stamp, 2, 20.0)]).collect()
    times = sorted(float(r.said.split()[1]) for r in rows)
    assert len(times) == 24 and times[-1] - times[0] >= 0.9
    assert max(sum(t <= x < t + 0.5 for x in times) for t in times) <= 12


def test_pool_of_several_kinds(spark):
    rows = enrich.pooled(asked(spark, 40), [enrich.Caller(lambda: lambda p: "a"), enrich.Caller(lambda: lambda p: "b", 2)]).collect()
    assert {r.said for r in rows} == {"a", "b"} and len(rows) == 40


def test_a_turn_that_takes_too_long_is_an_error(spark):
    with pytest.raises(Exception, match="wait"):
        enrich.pooled(asked(spark, 4), [enrich.Caller(lambda: lambda p: p, 1, 0.5)], timeout=0.2).collect()

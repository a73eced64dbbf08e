"""Derived tables: what Spark does with the text that DuckDB runs as well."""

from pyspark.sql import functions as F

from checks.derived import TABLES, _bind, _table


def frames(spark):
    """Many memberships of few practices, some of none and one of a practice that is not listed."""
    org = F.when(F.col("id") % 7 == 0, None).when(F.col("id") == 1, F.lit(999)).otherwise(F.col("id") % 5)
    practices = [(0, "P0"), (1, "P1"), (38, "P38"), (7, "P7"), (None, "P8"), (3, "P3"), (3, "P3"), (4, None)]
    names = F.col("id").cast("string")
    return {
        "fact_practice": spark.range(2000).select(F.col("id").alias("patient"), org.alias("org")),
        "organisation": spark.createDataFrame(practices, "org long, org_code string"),
        "nation": spark.range(10).select(F.col("id").alias("n_nationkey"), names.alias("n_name"), (F.col("id") % 2).alias("n_regionkey")),
        "region": spark.range(2).select(F.col("id").alias("r_regionkey"), names.alias("r_name")),
    }


def most_moved(plan):
    """Rows of the plan's largest shuffle, after a run."""
    below = plan.children()
    found = [most_moved(below.apply(i)) for i in range(below.size())]
    if plan.nodeName() == "Exchange":
        found.append(plan.metrics().apply("shuffleRecordsWritten").value())
    return max(found, default=0)


def test_list_of_practices_moves_as_distinct_values(spark):
    known = frames(spark)
    plain = TABLES["pcn"]
    for name in known:
        plain = _bind(plain, name)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        expected = spark.sql(plain, **known)
        got = _table(spark, TABLES["pcn"], known)
        rows = sorted(map(repr, got.collect()))
        assert len(rows) == 5 and rows == sorted(map(repr, expected.collect()))
        assert most_moved(expected._jdf.queryExecution().executedPlan()) == 2000
        assert most_moved(got._jdf.queryExecution().executedPlan()) < 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

from bulletin.sources import scratch


def test_written_tables_leave_plans_short(spark):
    """The driver describes every plan that adaptive execution changes: of wide plans that is megabytes."""
    own, other = spark.newSession(), spark.newSession()
    scratch.forgotten(scratch.written(own.range(3), "short"))
    assert own.conf.get("spark.sql.maxPlanStringLength").rstrip("b") == scratch.DESCRIBED
    other.conf.set("spark.sql.maxPlanStringLength", "50000")
    scratch.forgotten(scratch.written(other.range(3), "own"))
    assert other.conf.get("spark.sql.maxPlanStringLength").rstrip("b") == "50000"

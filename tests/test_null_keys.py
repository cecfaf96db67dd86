"""NULL is a grouping key like any other, and signatures see every kind of white space."""

from pyspark.sql import functions as F

from cinderlog.operators.grouping import join_dealt, join_on
from cinderlog.operators import sessions, statistics as st
from cinderlog.operators.quantiles import exact_percentiles
from cinderlog.operators.security import SIGNATURES


def test_join_on_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 1, 10), ("a", None, 20), ("b", 1, 30)], "k string, l int, x int")
    right = spark.createDataFrame([(None, 1, 5), ("a", None, 6), ("c", 1, 7)], "k string, l int, y int")
    got = join_on(left, right, ["k", "l"])
    assert got.columns == ["k", "l", "x", "y"]
    assert {(r.x, r.y) for r in got.collect()} == {(10, 5), (20, 6)}
    assert {(r.x, r.y) for r in join_on(left, right, ["k", "l"], "left").collect()} == {(10, 5), (20, 6), (30, None)}


def test_percentiles_of_the_null_group(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 7.0)], "k string, v double")
    got = exact_percentiles(rows, ["k"], F.col("v"), {"half": 50.0}).collect()
    assert {(r.k, r.half) for r in got} == {(None, 2.0), ("a", 7.0)}


def test_signatures_see_white_space_beyond_ascii(spark):
    texts = spark.createDataFrame([(t,) for t in ("union select", "union select", "UNION\x1cSELECT", "unionselect")], "t string")
    assert [r.hit for r in texts.select(F.col("t").rlike(SIGNATURES["sqli"]).alias("hit")).collect()] == [True, True, True, False]


def test_dealt_join_is_the_plain_join(spark):
    """A key with most rows goes to several tasks; NULL keys meet; nothing is lost or doubled."""
    rows = [("hot" if i % 3 else ("a", "b", None)[i // 3 % 3], i % 2, i) for i in range(3000)] + [("lone", 0, -1)]
    many = spark.createDataFrame(rows, "k string, l int, x int")
    few = many.where("k is null or k <> 'lone'").groupBy("k", "l").count()
    plain = sorted((str(r.k), r.l, r.x, r["count"]) for r in join_on(many, few, ["k", "l"]).collect())
    for often in (10, 10**9):
        dealt = join_dealt(many, few, ["k", "l"], F.col("count"), often=often, parts=4)
        assert sorted((str(r.k), r.l, r.x, r["count"]) for r in dealt.collect()) == plain and len(plain) == 3000
        assert dealt.columns == ["k", "l", "x", "count"]


def test_measures_of_the_null_key(spark):
    """Shares, size percentiles, sessions, their requests and journeys of the records whose key is NULL."""
    rows = [(i, k, f"10.0.0.{i % 2}", f"/p{i % 3}", 100 + i, i * 60) for i, k in enumerate([None] * 6 + ["a"] * 4)]
    df = spark.createDataFrame(rows, "line_id long, team string, source_ip string, path string, size long, s long")
    df = df.withColumn("timestamp", F.timestamp_seconds("s"))
    keys = ["team"]
    of_null = lambda out: [r for r in out.collect() if r.team is None]
    assert sorted((r.endpoint, r.requests) for r in of_null(st.endpoint_shares(df, keys))) == [("/p0", 2), ("/p1", 2), ("/p2", 2)]
    assert abs(sum(r.share_pct for r in of_null(st.endpoint_shares(df, keys))) - 100.0) < 1e-9
    assert of_null(st.size_percentiles(df, keys))[0].p50 == 102.5
    found = of_null(sessions.sessions_with_paths(df, keys))
    assert sorted((r.client_ip, r.request_count, r.distinct_paths) for r in found) == [("10.0.0.0", 3, 3), ("10.0.0.1", 3, 3)]
    assert len(of_null(sessions.session_requests(df, keys))) == 6
    assert max(r.step for r in of_null(sessions.journey_steps(df, keys))) >= 1
    assert of_null(st.stats_summary(df, keys))[0].total_lines == 6

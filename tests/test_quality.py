"""Data-quality checks (Q2-Q13)."""

from pyspark.sql import functions as F

from relaylake.operators import hashtree, profiles
from relaylake.operators import quality as Q


def test_row_rules_one_pass(spark):
    df = spark.createDataFrame([(1, 5.0, "A"), (None, 60.0, "Z"), (3, None, "N")], "k long, q double, f string")
    rules = [Q.not_null("k"), Q.in_range("q", 1, 50), Q.accepted("f", ["A", "N", "R"])]
    got = {r.check: (r.failed, r.passed, r.severity) for r in Q.row_rules(df, "t", rules).collect()}
    assert got == {"not_null:k": (1, False, "critical"), "range:q": (1, False, "major"), "accepted:f": (1, False, "major")}


def test_unique_and_fk(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1,), (1,), (3,), (3,), (None,)], "pid long")
    u = Q.unique(child, "child", ["pid"]).first()
    assert u.failed == 2 and not u.passed  # 1 and 3 repeat (NULL counts as a key too)
    fk = Q.foreign_key(child, "pid", parent, "id", "child").first()
    assert fk.failed == 2 and not fk.passed  # two orphan rows with key 3; NULL is not checked
    ok = Q.foreign_key(parent, "id", parent, "id", "p").first()
    assert ok.failed == 0 and ok.passed


def test_row_delta_and_smoke(spark):
    cur = spark.range(10)
    prev = spark.range(8)
    d = Q.row_delta(prev, cur, "t", 0.2).first()
    assert (d.prev, d.curr, d.delta, d.passed) == (8, 10, 0.25, False)
    assert Q.smoke_query(spark.range(0), "t").first().passed is False


def test_fingerprint_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    same = spark.createDataFrame([(2, "z"), (1, "y"), (1, "x")], "k long, v string")
    other = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k long, v string")
    assert Q.fingerprint_diff(a, same, "k", "t").first().failed == 0
    assert Q.fingerprint_diff(a, other, "k", "t").first().failed == 2   # key 1 differs, key 3 is new


def test_schema_fit_and_drift(spark):
    contract = [("a", "bigint"), ("b", "date"), ("c", "string")]
    before = spark.createDataFrame([("1", "2024-01-01"), (None, "x")], "a string, b string")
    fit = {r.name: (r.failed, r.passed) for r in Q.schema_fit(before, contract, "t").collect()}
    assert fit == {"a": (0, True), "b": (1, False), "c": (2, False)}  # a missing column fails for every row
    assert Q.table_exists({"empty": before.limit(0)}).first().passed


def test_profiles_and_drift(spark):
    rows = [(1, {"a": "1", "b": "2024-01-01", "c": "x", "d": None}), (1, {"a": "-20", "b": None, "c": "7", "d": None}),
            (2, {"a": "1.5", "b": "2024-01-01 10:00:00", "c": "true", "d": "4"}), (2, {"a": "3", "b": "2024-02-01", "c": "y", "d": "5"}),
            (5, {"a": ".5", "c": "2024-01-01", "e": "TRUE"}), (5, {"a": "1" * 20, "c": "False", "e": "q"})]
    df = spark.createDataFrame(rows, "version int, values map<string,string>")
    p = {(r.version, r.name): (r.type, r.n_rows, r.n_nulls) for r in profiles.column_profiles(df).collect()}
    assert p[1, "a"] == ("bigint", 2, 0) and p[1, "b"] == ("date", 2, 1) and p[1, "c"][0] == "string" and p[1, "d"] == ("void", 2, 2)
    assert p[2, "a"][0] == "decimal" and p[2, "b"][0] == "timestamp" and p[5, "a"][0] == "decimal" and p[5, "c"][0] == "string"
    got = sorted(tuple(r) for r in profiles.drift(profiles.column_profiles(df)).collect())
    assert got == [(2, "a", "retyped", "bigint", "decimal"), (2, "b", "retyped", "date", "timestamp"),
                   (5, "b", "removed", "timestamp", None), (5, "d", "removed", "bigint", None), (5, "e", "added", None, "string")]
    assert profiles.drift(profiles.column_profiles(df.limit(0))).count() == 0


def test_hash_tree_opens_what_differs(spark, tmp_dir):
    a, schema = spark.range(4000).select("id", (F.col("id") % 7).alias("v"), F.lit("x").alias("leaf")), "id long, v long, leaf string"
    a = a.unionByName(a.where("id < 10")).unionByName(spark.createDataFrame([(None, 1, None)], schema))  # copies and nulls
    b = a.where("id IS NULL OR id <> 77").withColumn("v", F.when(F.col("id") == 123, 99).otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(9999, 1, "n"), (5, 5, "x")], schema))
    for name, df in (("a", a), ("b", b), ("c", a.repartition(3))):
        hashtree.write_tree(df, f"{tmp_dir}/{name}", ["id"])
    leaves = hashtree.changed_leaves(spark, f"{tmp_dir}/a", f"{tmp_dir}/b")
    assert leaves.count() == 4  # of 65536: only these rows are read again
    got = sorted(((r.id, r.v, r.leaf, r.change, r.copies) for r in hashtree.changed_rows(spark, f"{tmp_dir}/a", f"{tmp_dir}/b", a.schema).collect()), key=repr)
    assert got == sorted([(77, 0, "x", "removed", 1), (123, 4, "x", "removed", 1), (123, 99, "x", "added", 1), (9999, 1, "n", "added", 1),
                          (5, 5, "x", "added", 1)], key=repr)
    assert hashtree.changed_rows(spark, f"{tmp_dir}/a", f"{tmp_dir}/c", a.schema).count() == 0
    hashtree.write_tree(a.limit(0), f"{tmp_dir}/none", ["id"])
    assert hashtree.changed_rows(spark, f"{tmp_dir}/none", f"{tmp_dir}/a", a.schema).agg(F.sum("copies")).first()[0] == a.count()


def test_percentile_baseline(spark):
    d = spark.createDataFrame([("dev", float(x)) for x in range(1, 101)], "environment string, s double")
    base = spark.createDataFrame([("dev", 96.0)], "environment string, max_seconds double")
    r = Q.performance_baseline(d, "environment", "s", base).first()
    assert r.p_value == 95.05 and r.passed


def test_alert_windows(spark):
    ev = spark.createDataFrame([("2024-01-01 01:00:00", "error"), ("2024-01-01 02:00:00", "view"),
                                ("2024-01-02 01:00:00", "view")], "ts string, kind string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {str(r.window_start)[:10]: (r.n_errors, r.green) for r in Q.alerts_by_window(ev, "ts", "kind", "error").collect()}
    assert got == {"2024-01-01": (1, False), "2024-01-02": (0, True)}


def test_stage_summary(spark):
    checks = spark.createDataFrame([
        ("table_exists", "t", 0, True, "critical"), ("row_count_non_zero", "t", 0, True, "critical"),
        ("schema_validation", "t", 0, True, "critical"), ("dq_rules_passed", "t", 0, True, "critical"),
        ("dq_rules_passed", "u", 1, False, "major")], Q.CHECK_SCHEMA)
    got = {r.stage: (r.passed, r.message) for r in Q.stage_summary(spark, checks, "main.bronze.t").collect()}
    assert got["dev"] == (False, "QA checks failed in dev for main.bronze.t: dq_rules_passed")
    assert got["prod"][0] is False  # its checks are missing, so they do not pass


def test_versions_keep_rows_without_their_hashes(spark, tmp_dir):
    a = spark.createDataFrame([(k, k % 3) for k in range(50)], "id long, v long")
    hashtree.write_tree(a, f"{tmp_dir}/a", ["id"])
    hashtree.write_tree(a.where("id <> 7"), f"{tmp_dir}/b", ["id"])
    assert spark.read.parquet(f"{tmp_dir}/a/rows").columns == ["row", "leaf", "folder"]
    assert [tuple(r) for r in hashtree.changed_rows(spark, f"{tmp_dir}/a", f"{tmp_dir}/b", a.schema).collect()] == [(7, 1, "removed", 1)]

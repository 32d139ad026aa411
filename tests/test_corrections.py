"""Answers that were once wrong: CSV cells, line order, chained maps, label white space, NaN, splits, layouts."""
import pytest
from pyspark.sql import functions as F

from logweave.ml import models as ml
from logweave.ml.predictions import analysis_bundle, prediction_table
from logweave.operators import advisor as adv
from logweave.operators import analysis as an
from logweave.operators import profile as pr
from logweave.operators.cardinality import distinct_counts
from logweave.operators.preprocess import apply_field_mapping
from logweave.operators.selection import feature_matrix, feature_vectors
from logweave.plans.chain import run_features
from logweave.plans.templates import recommend_template
from logweave.sources import readers as rd


def test_csv_cells(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,msg\n" + "".join(f'{k},"row, {k}"\n' for k in range(10, 200)))
    (tmp_path / "a.csv").write_text('id,msg\n1,"say ""hi"", ok"\n2,"two\nlines"\n3,plain\n')
    rows = {r.id: r.msg for r in rd.read_csv(spark, str(tmp_path)).collect()}
    assert rows[1] == 'say "hi", ok' and rows[2] == "two\nlines" and rows[3] == "plain" and rows[10] == "row, 10"
    assert len(rows) == 193


def test_line_order_over_files(spark, tmp_path):
    (tmp_path / "b.log").write_text("".join(f"b{k}\n" for k in range(5000)))
    (tmp_path / "a.log").write_text("a0\n\n a1 \n")
    (tmp_path / "c.log").write_text("c0\nc1\n")
    lines = [r.line for r in rd.read_lines(spark, str(tmp_path), "rid").orderBy("rid").collect()]
    assert lines == ["a0", "a1"] + [f"b{k}" for k in range(5000)] + ["c0", "c1"]


def test_chained_mapping(spark):
    df = spark.createDataFrame([("A", "B")], "a string, b string")
    assert apply_field_mapping(df, {"a": "b", "b": "a"}).first() == ("B", "B")
    assert apply_field_mapping(df, {"x": "a", "y": "x", "z": "missing"}).first().asDict() == {"a": "A", "b": "B", "x": "A", "y": "A"}


def test_label_white_space(spark):
    df = spark.createDataFrame([("anomaly\t", 1), (" True\n", 1), (" yes", 1), ("no", 0), (None, 0)], "l string, y int")
    assert all(r.v == r.y for r in df.select("y", ml.binary_labels(F.col("l")).alias("v")).collect())


def test_nan_is_zero_and_wide_values_pass(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("x"),
                                  F.concat(F.lit("v"), "id").alias("c"))
    mat, names = feature_matrix(df.limit(20), ["x"], keep=[F.col("id")])
    assert all(r.x == (0 if r.id % 2 == 0 else r.id) for r in mat.collect()) and names == ["x"]
    vec = feature_vectors(df, ["x", "c"])
    assert vec.columns == ["id", "x", "c", "features"]
    row = vec.where("id = 7").first().features
    assert len(row) == 3001 and row[0] == 7.0 and sum(row.toArray()) == 8.0


def test_distinct_counts_are_exact(spark):
    df = spark.range(5000).select((F.col("id") % 1003).alias("a"), F.when(F.col("id") > 9, F.col("id").cast("string")).alias("b"),
                                  F.lit(None).cast("string").alias("c"))
    assert distinct_counts(df, {c: F.col(c) for c in "abc"}) == {"a": 1003, "b": 4990, "c": 0}


@pytest.mark.parametrize("share", [0.3, 0.5])
def test_split_is_stratified(spark, share):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 997, "mid")
                                  .when(F.col("id") < 999, "two").otherwise("one").alias("y"))
    got = {(r.y, r.t): r["count"] for r in ml.stratified_split(df, "id", "y", share).groupBy("y", F.col("__is_test").alias("t")).count().collect()}
    assert {k: v for (k, t), v in got.items() if t} == {"big": round(900 * share), "mid": int(97 * share + 0.5), "two": 1}
    assert got["one", False] == 1 and got["two", False] == 1


def test_prediction_table_and_bundle(spark):
    df = spark.range(0, 900, 3).select((F.col("id") + 5).alias("rid"), F.lit("ctx").alias("who"), (F.col("id") % 7).alias("a_count"),
                                       (F.col("id") % 2).alias("spike"), (F.col("id") / 900).alias("anomaly_score"),
                                       F.when(F.col("id") > 800, "anomaly").otherwise("normal").alias("predicted_label"))
    out = prediction_table(df, "rid", ["a_count", "spike"], ["who"])
    assert out.columns == ["sample_index", "source_row_id", "who", "predicted_label", "anomaly_score", "a_count", "spike", "rid"]
    rows = out.orderBy("rid").collect()
    assert [r.sample_index for r in rows] == list(range(300)) and rows[1].source_row_id == "8"
    parts = analysis_bundle(out, ["a_count", "spike"], point_limit=100)
    assert parts["summary"].first().sample_size == 100 and parts["score_points"].count() == 100
    assert parts["score_histogram"].agg(F.sum("normal_count") + F.sum("anomaly_count")).first()[0] == 300
    assert parts["embedding_points"].count() == 100 and parts["spike_signal_summaries"].count() == 1
    with pytest.raises(ValueError):
        analysis_bundle(df.drop("anomaly_score"), [])


def test_every_model_feeds_the_prediction_table(spark):
    df = spark.range(120).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    forest = prediction_table(ml.isolation_forest(df, ["x"], "id", n_trees=5, keep=["x"]), "id", ["x"])
    assert an.stratified_sample(forest, 100).count() == 100
    _, pred, _ = ml.train_supervised(df, ["x"], "y", "logistic_regression", "id")
    made = prediction_table(pred, "__rid", ["x"])
    assert made.columns[:6] == ["sample_index", "source_row_id", "actual_label", "predicted_label", "prediction_proba", "x"]
    with pytest.raises(ValueError):
        ml.train_supervised(df, ["x"], "y", "svm", "id", {"kernel": "precomputed"})


def test_advisor_uses_all_rows(spark):
    """A field that is empty in nearly all rows but for a few beyond any sample."""
    df = spark.range(20000).select("id", F.when(F.col("id") > 19990, 1.0).alias("rare"), (F.col("id") % 2).alias("flag"))
    res = adv.analyze(df, rid="id")
    by = {a["field"]: a for a in res["field_advice"]}
    assert abs(by["rare"]["null_ratio"] - 19991 / 20000) < 1e-9 and by["flag"]["null_ratio"] == 0
    assert res["summary"]["total_fields"] == 2


def test_schema_helpers():
    facts = {c: {"datetime": d, "non_null": 5, "datetime_ratio": r, "numeric": n, "cardinality": k}
             for c, d, r, n, k in [("ts", True, 1, False, 9), ("event_time", False, .95, False, 9), ("note", False, 0, False, 5000),
                                   ("status", False, 0, True, 3), ("path", False, 0, False, 40), ("kind", False, 0, False, 4)]}
    assert adv.find_time_columns(facts, "none") == ["event_time", "ts"]
    assert adv.find_target_columns(facts, {"ts", "event_time"}) == ["path", "status", "kind"]
    assert pr.refresh_field_mapping({"label": "kind", "source_ip": "gone"}, ["kind", "src_ip"])["label"] == "kind"
    assert pr.suggest_dataset_mapping(["Remote_Addr", "my_dst_ip_x", "msg", "status"])["source_ip"] == "Remote_Addr"
    assert pr.suggest_dataset_mapping(["my_dst_ip_x"])["dest_ip"] == "my_dst_ip_x"
    assert rd.clean_header([" a b ", "", "a b", "a  b"]) == ["a_b", "unnamed", "a_b_2", "a_b_3"]
    assert recommend_template is not None


def test_building_a_chain_starts_no_job(spark):
    df = spark.range(100).withColumn("text", F.lit("GET /a"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    run_features(df.groupBy("id").agg(F.max("text").alias("text")),
                 [{"step_id": "s", "step_type": "text_length", "enabled": True,
                   "input_selector": {"mode": "explicit", "columns": ["text"]}, "params": {}, "output_mode": {"mode": "append_new_columns"}}],
                 rid="id")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)


@pytest.mark.parametrize("clusters", [1, 30])
def test_knn_is_exact_and_prunes(spark, clusters):
    import numpy as np

    from logweave.ml import lof
    rng = np.random.default_rng(clusters)
    centre = rng.normal(size=(clusters, 4)) * 50
    x = centre[rng.integers(0, clusters, 2500)] + rng.normal(size=(2500, 4))
    x[100:110] = x[100]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in lof.knn(df, "id", "v", 5).collect():
        got.setdefault(r.rid, {})[r["rank"]] = r.nbr
    for i in range(0, 2500, 61):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i][k] for k in range(1, 6)] == np.lexsort((np.arange(2500), d))[:5].tolist()
    if clusters > 1:
        assert lof.examined_share(df, "id", "v", 5) < 0.5


def test_knn_slices_are_bounded(spark, monkeypatch):
    """Where every block is asked by every point, a call still gets one slice of the asking points; the result is exact."""
    import numpy as np

    from logweave.ml import lof
    monkeypatch.setattr(lof, "SLICE", 100)
    x = np.random.default_rng(4).normal(size=(1500, 24))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    copies, requests, n, blocks = lof._requests(df, "id", "v", 5)
    sizes = [r["count"] for r in requests.groupBy("to", "slice").count().collect()]
    assert n == 1500 and sum(sizes) > 0.95 * 1500 * blocks and max(sizes) < 200
    assert max(r["count"] for r in copies.groupBy("to", "slice").count().collect()) <= 2 * lof.BLOCK
    got = {(r.rid, r["rank"]): r.nbr for r in lof.knn(df, "id", "v", 5).collect()}
    for i in range(0, 1500, 61):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, k] for k in range(1, 6)] == np.lexsort((np.arange(1500), d))[:5].tolist()


def test_access_line_with_the_separator(spark):
    line = '1.2.3.4 - - [10/Oct/2000:13:55:36 +0000] "GET /a\u0001b HTTP/1.0" 200 5 "r\u0001" "ua"'
    row = rd.parse_nginx(spark.createDataFrame([(line,)], "line string")).first()
    assert row.log_type == "nginx_access" and row.status_code == 200 and row.bytes_sent == 5


def test_integer_equality_reaches_the_scan(spark, tmp_path):
    from logweave.operators.preprocess import filter_condition
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = df.where(filter_condition(F.col("id"), "eq", "4", df.schema["id"].dataType))
    assert kept.count() == 1 and "EqualTo(id,4)" in kept._jdf.queryExecution().toString()
    assert df.where(filter_condition(F.col("id"), "eq", "04", df.schema["id"].dataType)).count() == 0


def test_date_texts(spark):
    """Each text is read on its own; numbers that cannot be years are no dates."""
    from pyspark.sql import functions as F

    from logweave.functions.timefn import to_timestamp_any
    day, clock = "2024-01-05 00:00:00", "2024-01-05 10:11:12"
    want = {"2024-01-05": day, "2024-1-5": day, "20240105": day, "2024.01.05": day, "01/05/2024": day, "05-Jan-2024": day,
            "5 January 2024": day, "January 5, 2024": day, "20240105101112": clock, "20240105T101112": clock,
            "Jan 5 2024 10:11:12": clock, "Fri Jan  5 10:11:12 2024": clock, "01/05/2024 10:11:12 AM": clock,
            "Fri, 05 Jan 2024 12:11:12 +0200": clock, "2024/01/05 10:11:12": clock, "13/01/2024": "2024-01-13 00:00:00",
            "2024": "2024-01-01 00:00:00", "404": None, "8080": None, "65535": None, "1704067200": None, "12.5": None,
            "v1999x": None, "2024-13-45": None, "may": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r.t: r.at for r in rows.select("t", to_timestamp_any(F.col("t")).cast("string").alias("at")).collect()}
    assert got == want


def test_explanation_payload_and_stored_classes(spark):
    from logweave.operators.analysis import explanation_payload
    from logweave.plans.lineage import resolve_stored_classes
    pred = spark.createDataFrame([(i, float(i), "anomaly" if i > 2 else "normal") for i in range(5)],
                                 "sample_index long, anomaly_score double, predicted_label string")
    text = explanation_payload(pred, {"mode": "x"}, 2).first().payload
    assert text.startswith("mode: x\nTop rows: [") and '"sample_index":4' in text and '"sample_index":2' not in text
    got = resolve_stored_classes(["a", "b", "c"], {"training_candidate_columns": ["b", "gone"], "business_context_columns": ["a"]})
    assert got == {"training_candidate_columns": ["b"], "business_context_columns": ["a"], "analysis_retained_columns": ["c"]}


def test_projection_axes_have_a_fixed_sign(spark):
    from logweave.operators.analysis import embedding_points
    rows = [(i, float(i), -2.0 * i + (i % 3)) for i in range(30)]
    pred = spark.createDataFrame(rows, "sample_index long, a double, b double")
    pts = {r.sample_index: r for r in embedding_points(pred, ["a", "b"]).collect()}
    assert pts[0].x > pts[29].x  # b has the largest loading on the first axis and falls


def test_white_space_around_dates_does_not_count(spark):
    from logweave.functions.timefn import to_timestamp_any
    texts = ["03/04/2024 10:00:00", "03/04/2024 10:00:00" + " " * 60, "  03/04/2024\t " + " " * 80 + "10:00:00", "03/04/2024 10:00:00" + "x" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.ts for r in df.select("k", to_timestamp_any(F.col("t")).alias("ts")).orderBy("k").collect()]
    assert got[0] is not None and got[0] == got[1] == got[2] and got[3] is None


def test_dense_index_over_many_partitions(spark):
    from logweave.rowid import with_dense_index
    df = spark.range(500, numPartitions=9).withColumn("x", F.xxhash64("id"))
    rows = with_dense_index(df, [F.col("x")], "k").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(500)) and [r.x for r in rows] == sorted(r.x for r in rows)

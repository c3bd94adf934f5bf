import json

import pytest
from pyspark.sql import functions as F

from arborlane.api import Engine
from arborlane.plans import reports
from arborlane.schemas import Hyperparameters, InferenceRequest, TrainingRequest, to_dict, training_request
from arborlane.session import session
from arborlane.sources import files
from arborlane.streaming import state

HEAD = " Flow IAT Std,Flow IAT Mean,Fwd IAT Std,Fwd IAT Mean,SYN Flag Cnt,ACK Flag Cnt,Src IP, label\n"


@pytest.fixture
def csv_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for day, n in (("Friday-02-03-2018", 40), ("Monday-05-03-2018", 60)):
        lines = [f"{k % 7 + 1},{k % 5 + 1},{k % 3 + 1},2,{k % 4},{k % 6},10.0.0.1,{'Benign' if k % 7 < 4 else 'Bot'}\n" for k in range(n)]
        (folder / f"{day}_flows.csv").write_text(HEAD + "".join(lines[: n // 2]) + HEAD.replace(" label", "label").replace(" Flow", "Flow").replace("label", "Label") + "".join(lines[n // 2 :]))
    return folder


def test_requests_are_checked():
    for bad in ({"n_estimators": 0}, {"max_depth": 0}, {"min_samples_split": 1}, {"max_samples": 0}, {"max_samples": 1.5}, {"tree_type": "x"}):
        with pytest.raises(ValueError):
            Hyperparameters(**bad)
    for bad in ({"mode": "x"}, {"dataset_type": "x"}, {"partition_strategy": "x"}, {"tree_allocation_strategy": "x"}, {"environment": "x"}):
        with pytest.raises(ValueError):
            TrainingRequest("p", **bad)
    assert Hyperparameters(tree_type="regressor", class_weight="balanced").class_weight is None
    r = TrainingRequest("p", Hyperparameters(max_samples=1.0))
    assert training_request(json.loads(json.dumps(to_dict(r)))) == r
    with pytest.raises(ValueError):
        training_request({"dataset_path": "p", "other": 1})


def test_files(spark, csv_folder, tmp_path):
    found = files.discover(spark, str(csv_folder))
    assert len(found) == 2 and found == sorted(found)
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        files.scan_csv(spark, str(tmp_path / "none.csv"))
    df = files.load_flows(spark, str(csv_folder))
    assert df.count() == 100 and {r[0] for r in df.select("_capture_day").distinct().collect()} == {"Friday-02-03-2018", "Monday-05-03-2018"}
    assert files.scan_csv(spark, "|".join(found)).count() == 102
    cache = str(tmp_path / "counts")
    assert sorted(files.cached_counts(spark, found[:1], cache).values()) == [41]
    assert sorted(files.cached_counts(spark, found, cache).values()) == [41, 61] == sorted(files.cached_counts(spark, found, cache).values())
    assert sorted(r.n for r in files.count_rows(spark, found).collect()) == [41, 61]
    mirror = str(tmp_path / "mirror")
    assert files.mirrored(spark, found, mirror).count() == 100 == files.mirrored(spark, found, mirror).count()
    assert {files.mirrored(spark, [f], mirror).count() for f in found} == {40, 60}  # other sources, another table
    with pytest.raises(FileNotFoundError):
        files.mirrored(spark, ["gone"], mirror)
    numbers = files.numbered_csv(spark, found).groupBy("source").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.countDistinct("row").alias("n")).collect()
    assert sorted((r.a, r.b, r.n) for r in numbers) == [(0, 40, 41), (0, 60, 61)]
    files.write_json(spark, str(tmp_path / "doc"), {"a": [1]})
    assert files.read_json(spark, str(tmp_path / "doc")) == {"a": [1]}
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, str(tmp_path / "no"))
    assert files.content_length(spark, found[0]) > 0


def test_sinks(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 2).alias("shard_id"), F.lit("train").alias("split"))
    files.write_shards(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=train" / "shard_id=1")).count() == 10
    table = str(tmp_path / "t")
    for k in range(3):
        files.append_part(spark.range(k, k + 2), table, k)
    files.append_part(spark.range(5), table, 2)
    assert files.complete_parts(spark, table) == [0, 1, 2] and spark.read.parquet(table).count() == 9
    assert files.purge_parts(spark, table, 1) == 2 and files.complete_parts(spark, table) == [0] and files.purge_parts(spark, str(tmp_path / "u"), 0) == 0
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 20


def test_chunk_sample(spark):
    df = spark.range(105).select(F.lit("f").alias("source"), F.col("id").alias("row"))
    got = files.chunk_sample(df, "source", "row", 0.5, chunk=50).groupBy(F.floor(F.col("row") / 50).alias("c")).count().collect()
    assert {r.c: r["count"] for r in got} == {0: 25, 1: 25, 2: 2}


@pytest.mark.parametrize("mode", ["centralized", "federated"])
def test_job_to_result(spark, csv_folder, tmp_path, mode):
    engine = Engine(spark, str(tmp_path / "home"))
    h = Hyperparameters(n_estimators=3, max_depth=4)
    request = TrainingRequest(str(csv_folder), h, mode=mode)
    assert engine.status(request.job_id) is None
    engine.submit(request)
    assert engine.status(request.job_id) == "QUEUED"
    manifest = engine.train(request)
    assert engine.status(request.job_id) == "COMPLETED" and manifest["n_estimators"] == 3 and engine.train(request) == manifest
    assert engine.details(request.job_id)["trees"] == 3 and engine.history().count() == 1
    inference = InferenceRequest(request.job_id)
    found = engine.infer(inference)
    assert found["rows"] > 0 and 0 <= found["accuracy"] <= 1 and engine.result(inference.inference_id) == found == engine.infer(inference)
    engine.export(request.job_id, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() > 0


def test_federated_job_by_day(spark, csv_folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    request = TrainingRequest(str(csv_folder), Hyperparameters(n_estimators=5, max_depth=4), mode="federated", partition_strategy="by_day", num_workers=2)
    engine.train(request)
    data = spark.read.parquet(str(tmp_path / "home" / "models" / request.job_id / "data"))
    days = {(r[0], r[1]) for r in data.select("shard_id", "_capture_day").distinct().collect()}
    assert len(days) == 2 == len({d for _, d in days}) == len({s for s, _ in days})
    assert {r[0] for r in data.select("part").distinct().collect()} == {"train", "validation", "test"}
    assert data.select("row_id").distinct().count() == data.count()  # repeated flow rows have keys of their own
    nodes = engine.model(request.job_id).nodes
    assert {r[0]: r[1] for r in nodes.groupBy("shard_id").agg(F.countDistinct("tree_id")).collect()} == {0: 2, 1: 3}
    found = engine.infer(InferenceRequest(request.job_id))
    assert set(found["shards"]) == {"0", "1"} and found["rows"] == data.where("part = 'test'").count()


def test_jobs_go_on_after_a_loss(spark, csv_folder, tmp_path, monkeypatch):
    """A driver lost after the first round: the job ends with the trees of that round as they were."""
    from arborlane.operators import cart

    engine = Engine(spark, str(tmp_path / "home"))
    request = TrainingRequest(str(csv_folder), Hyperparameters(n_estimators=45, max_depth=2), num_workers=1)
    whole, calls = cart.grow, []

    def dies(rows, h, features, key, trees, **more):
        calls.append(len(trees))
        if len(calls) == 2:
            raise KeyboardInterrupt
        return whole(rows, h, features, key, trees, **more)

    monkeypatch.setattr(cart, "grow", dies)
    with pytest.raises(KeyboardInterrupt):
        engine.train(request)
    part = str(tmp_path / "home" / "models" / request.job_id / "nodes" / "part=0")
    before = sorted(spark.read.parquet(part).collect())
    engine.train(request)
    assert calls == [20, 20, 20, 5] and sorted(spark.read.parquet(part).collect()) == before
    assert engine.model(request.job_id).nodes.select("tree_id").distinct().count() == 45


def test_inference_on_new_data_as_training_takes_it(spark, csv_folder, tmp_path):
    from arborlane import session

    engine = Engine(spark, str(tmp_path / "home"))
    request = TrainingRequest(str(csv_folder), Hyperparameters(n_estimators=2, max_depth=3))
    engine.train(request)
    csv = engine.infer(InferenceRequest(request.job_id, data_url=str(csv_folder)))
    table = engine.load(request)
    table.drop("row_id", "Label").write.parquet(str(tmp_path / "new"))
    raw = engine.infer(InferenceRequest(request.job_id, data_url=str(tmp_path / "new")))
    assert csv["rows"] == raw["rows"] == table.count() and "f1" in csv and "f1" not in raw
    table.drop(engine.model(request.job_id).features[0]).write.parquet(str(tmp_path / "less"))
    with pytest.raises(ValueError, match="lack"):
        engine.infer(InferenceRequest(request.job_id, data_url=str(tmp_path / "less")))
    assert not [f for f in session._made if request.job_id in f]


def test_failed_jobs_say_so(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    request = TrainingRequest(str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        engine.train(request)
    assert engine.status(request.job_id) == "FAILED"


def test_synthetic_regression_job_and_baseline(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"))
    request = TrainingRequest("-", Hyperparameters(tree_type="regressor", n_estimators=4, max_depth=5, n_samples=400, n_features=6), dataset_type="synthetic")
    assert engine.train(request)["threshold"] is None
    assert engine.infer(InferenceRequest(request.job_id))["r2"] > 0.2
    tune = TrainingRequest("-", Hyperparameters(n_estimators=2, max_depth=3, n_samples=400, n_features=6), dataset_type="synthetic")
    assert engine.baseline(tune, 1, {"n_estimators": [2], "criterion": ["gini"]}, 3)["hyperparameters"] == {"n_estimators": 2, "criterion": "gini"}
    kept = files.read_json(spark, str(tmp_path / "home" / "baseline" / tune.job_id))["features"]
    assert kept and engine.train(tune)["features"] == kept


def test_lock_safety(spark):
    """Twenty rounds of five candidates: one winner each."""
    rows = [(f"round{r}", f"c{c}", "acquire", 100.0, float((c * 7 + r) % 5)) for r in range(20) for c in range(5)]
    history = state.lock_history(spark.createDataFrame(rows, "lock_key string, owner string, action string, ttl double, at_s double"))
    assert {r["n"] for r in history.groupBy("lock_key").agg(F.count_if("granted").alias("n")).collect()} == {1}


def test_job_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"job_id": "j", "status": "QUEUED", "at_s": 1.0}\n{"job_id": "j", "status": "PROCESSING", "at_s": 2.0}\n')
    stream = state.job_stream(spark, str(inbox), "job_id string, status string, at_s double")
    state.latest_jobs(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert [r.status for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["PROCESSING"]
    state.latest_jobs(state.job_stream(spark, str(inbox), "job_id string, status string, at_s double"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_alarm_rates_as_a_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") > 50).cast("int").alias("yhat"))
    events.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = state.alarm_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "y", "yhat")
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.start, r.n, r.fp) for r in state.alarm_rates(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "y", "yhat").collect()}
    assert {(r.start, r.n, r.fp) for r in spark.table("rates").collect()} == want


def test_report_scan(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "federated_1.json").write_text('{"performance": {"status": "SUCCESS",\n "duration_seconds": 3.5}}')
    df = reports.scan_reports(spark, str(tmp_path), "performance struct<status:string,duration_seconds:double>")
    assert [(r.mode, r.s) for r in df.select(reports.mode_of(F.col("path")).alias("mode"), F.col("performance.duration_seconds").alias("s")).collect()] == [("federated", 3.5)]


def test_session_settings(spark):
    assert session().conf.get("spark.sql.adaptive.enabled") == "true"

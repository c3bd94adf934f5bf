"""Jobs by name: submit, train, infer, status, details, export, result, baseline, history.

Everything lies in one folder of any store that Spark reads: `jobs` (events,
append only), `tables/<job>` (numbered rows), `models/<job>` (data, node tables
by round or shard, manifest last), `results/<id>`.  A job that was lost goes on
from the last part that is complete.
"""

from __future__ import annotations

import json
import time
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import unused
from .operators import clean, forest, metrics, sampling, selection
from .plans import federated, training
from .schemas import JOB_EVENTS, InferenceRequest, TrainingRequest, to_dict
from .session import purge_scratch, scratch_mark
from .sources import files, pmml, synthetic
from .streaming import state


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _record(self, request: TrainingRequest, status: str, trees: int = 0) -> None:
        row = (request.job_id, status, request.dataset_path, request.mode, request.dataset_type, json.dumps(to_dict(request.hyperparameters), sort_keys=True), "driver", trees, time.time())
        self.spark.createDataFrame([row], JOB_EVENTS).coalesce(1).write.mode("append").json(self._path("jobs"))

    def jobs(self) -> DataFrame:
        """All job events."""
        path = self._path("jobs")
        reader = self.spark.read.schema(JOB_EVENTS)
        return reader.json(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], JOB_EVENTS)

    def submit(self, request: TrainingRequest) -> str:
        """Queues a job; one that is known already is left as it is."""
        if not self.jobs().where(F.col("job_id") == request.job_id).limit(1).count():
            self._record(request, "QUEUED")
        return request.job_id

    def status(self, job_id: str) -> str | None:
        row = state.job_states(self.jobs().where(F.col("job_id") == job_id)).first()
        return row["status"] if row else None

    def details(self, job_id: str) -> dict | None:
        """The job's latest row, whole."""
        row = state.latest(self.jobs().where(F.col("job_id") == job_id), "job_id").first()
        return row.asDict() if row else None

    def history(self) -> DataFrame:
        return state.latest(self.jobs(), "job_id").orderBy("at_s")

    def load(self, request: TrainingRequest) -> DataFrame:
        """The request's table with a unique `row_id`; CSV folders are prepared, `synthetic` data are made."""
        h = request.hyperparameters
        if request.dataset_type == "synthetic":
            make = synthetic.friedman if h.tree_type == "regressor" else synthetic.classification
            options = {"n_samples": h.n_samples or 300_000, "n_features": h.n_features or 30, "seed": request.seed}
            if h.tree_type == "regressor":
                options["noise"] = 0.5 if h.noise is None else h.noise
            return make(self.spark, **options).withColumnRenamed("id", "row_id")
        return self._numbered(self._read(request.dataset_path, request.partition_strategy == "by_day"), request.job_id)

    def _read(self, path: str, days: bool = False) -> DataFrame:
        """A Parquet table as it is, or CSV sources prepared."""
        if PurePosixPath(path).suffix == ".parquet" or (files.exists(self.spark, f"{path}/_SUCCESS") and not files.listed(self.spark, path, ".csv")):
            return self.spark.read.parquet(path)
        df = files.load_flows(self.spark, path)
        df = df.withColumn("Label", clean.binarise("Label")) if "Label" in df.columns else df
        return clean.process(df if days else df.drop(clean.DAY))

    def unseen(self, path: str, name: str, features: list[str]) -> DataFrame:
        """New data in the form that training took: Parquet as it is or CSV prepared, with a `row_id`.

        Columns that the model needs and the data lack raise ValueError; text
        columns among them are read as numbers.
        """
        df = self._numbered(self._read(path), name)
        if missing := [c for c in features if c not in df.columns]:
            raise ValueError(f"the data lack {', '.join(missing)}")
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in features if kinds[c] == "string"})

    def _numbered(self, df: DataFrame, name: str) -> DataFrame:
        if "row_id" in df.columns:
            return df
        table = self._path("tables", name)  # numbered once; a scan's numbers hold only for itself
        if not files.exists(self.spark, f"{table}/_SUCCESS"):
            df.withColumn("row_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(table)
        return self.spark.read.parquet(table)

    def train(self, request: TrainingRequest, ratio: float = 1.0, shard: str | None = None) -> dict:
        """Runs a job to its manifest; a job whose manifest is there isn't run again."""
        base = self._path("models", request.job_id)
        if files.exists(self.spark, f"{base}/manifest"):
            return files.read_json(self.spark, f"{base}/manifest")
        self.submit(request)
        self._record(request, "PROCESSING")
        mark = scratch_mark()
        try:
            manifest = self._train(request, base, ratio, shard)
        except Exception:
            self._record(request, "FAILED")
            raise
        finally:
            purge_scratch(self.spark, mark)
        self._record(request, "COMPLETED", request.hyperparameters.n_estimators)
        return manifest

    def _train(self, request: TrainingRequest, base: str, ratio: float, shard: str | None) -> dict:
        h, key = request.hyperparameters, "row_id"
        spread = request.mode == "federated"
        df = self.load(request)
        features = [c for c, k in df.dtypes if c not in (key, h.target, shard, "shard_id") and k in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        if files.exists(self.spark, tuned := self._path("baseline", request.job_id)):
            features = [c for c in files.read_json(self.spark, tuned)["features"] if c in features]
        if not files.exists(self.spark, f"{base}/data/_SUCCESS"):  # prepared once; later steps, and a job that goes on, read it
            if spread:
                pieces = max(8, df.rdd.getNumPartitions() // request.num_workers)
                files.write_shards(federated.prepare_job(df, request, key, ratio, shard), f"{base}/data", "shard_id", "part", pieces)
            elif h.tree_type == "regressor":
                sampling.random_split(df, key, seed=request.seed).withColumnRenamed("split", "part").write.mode("overwrite").parquet(f"{base}/data")
            else:
                training.prepare(df, key, h.target, ratio, request.seed).write.mode("overwrite").parquet(f"{base}/data")
        parts = self.spark.read.parquet(f"{base}/data")
        rows, threshold = parts.where("part = 'train'"), None
        if spread:
            nodes = federated.train_shards(rows, h, features, key, "shard_id", request.seed, request.tree_allocation_strategy == "equal", f"{base}/nodes").nodes
        else:
            nodes = training.train_rounds(rows, h, features, key, request.num_workers, request.seed, f"{base}/nodes")
        if h.tree_type == "classifier":
            held = parts.where("part = 'validation'")
            if spread:
                found, pooled = federated.thresholds(held, nodes, features, key, "shard_id", h.target)
                found.write.mode("overwrite").parquet(f"{base}/thresholds")
                best = pooled.first()
            else:
                best = metrics.f1_threshold(metrics.curve(training.scores(held, nodes, features, key, h.target))).first()
            threshold = best["threshold"] if best else None
        manifest = {"job_id": request.job_id, "n_estimators": h.n_estimators, "features": features, "target": h.target, "tree_type": h.tree_type, "threshold": threshold, "mode": request.mode}
        files.write_json(self.spark, f"{base}/manifest", manifest)  # last: its presence means complete
        return manifest

    def model(self, job_id: str) -> training.Trained:
        base = self._path("models", job_id)
        m = files.read_json(self.spark, f"{base}/manifest")
        return training.Trained(self.spark.read.parquet(f"{base}/nodes"), m["features"], m["target"], m["threshold"], m["tree_type"], m["mode"] == "federated")

    def infer(self, request: InferenceRequest) -> dict:
        """Scores the job's test part, or data_url, and saves predictions and metrics; done once for each inference_id.

        A federated job's trees vote by leaf support.  On its own test part each
        shard's threshold decides (its own, else the pooled one, else the larger
        class), and metrics come by shard and as their macro average too.
        """
        out = self._path("results", request.inference_id)
        if files.exists(self.spark, f"{out}/metrics"):
            return files.read_json(self.spark, f"{out}/metrics")
        mark = scratch_mark()
        trained = self.model(request.job_id)
        df = self.unseen(request.data_url, f"infer-{request.inference_id}", trained.features) if request.data_url else self.spark.read.parquet(self._path("models", request.job_id, "data")).where("part = 'test'")
        shards = trained.weighted and trained.task == "classifier" and "shard_id" in df.columns
        (y,) = unused(df, "y")
        carry = (("shard_id",) if shards else ()) + ((y,) if trained.target in df.columns else ())
        if trained.target in df.columns:
            df = df.withColumn(y, F.col(f"`{trained.target}`").cast("double" if trained.task == "regressor" else "long"))
        rows = training.predict(df, trained, "row_id", carry).withColumnRenamed(y, "y")
        if shards:
            own = self.spark.read.parquet(self._path("models", request.job_id, "thresholds"))
            found = metrics.resolved_thresholds(df.select("shard_id").distinct(), own, trained.threshold, None, "shard_id")
            rows = federated.by_shard(rows, found, "shard_id")
        rows.write.mode("overwrite").parquet(f"{out}/predictions")
        purge_scratch(self.spark, mark)
        rows = self.spark.read.parquet(f"{out}/predictions")
        found: dict = {"inference_id": request.inference_id, "job_id": request.job_id, "rows": rows.count()}
        if "y" in rows.columns:
            m = metrics.regression_metrics(rows).first() if trained.task == "regressor" else metrics.binary_metrics(rows).first()
            found |= {k: v for k, v in m.asDict().items()}
            if trained.task == "classifier":
                found["auc"] = metrics.auc(rows).first()["auc"]
            if shards:
                each = metrics.worker_metrics(rows, "shard_id")
                found["shards"] = {str(r["shard_id"]): {k: r[k] for k in ("accuracy", "precision", "recall", "f1", "auc")} for r in each.collect()}
                found["macro"] = metrics.macro_average(each, ["accuracy", "precision", "recall", "f1", "auc"], "smallest").first().asDict()
        files.write_json(self.spark, f"{out}/metrics", found)
        return found

    def result(self, inference_id: str) -> dict:
        return files.read_json(self.spark, self._path("results", inference_id, "metrics"))

    def export(self, job_id: str, path: str, form: str = "json") -> None:
        """The model as a JSON table of nodes, or as PMML with a document for each tree; its manifest beside it."""
        base = self._path("models", job_id)
        nodes, manifest = self.spark.read.parquet(f"{base}/nodes").drop("part"), files.read_json(self.spark, f"{base}/manifest")
        if form == "pmml":
            pmml.write_pmml(nodes, manifest["features"], manifest["target"], f"{path}/nodes", manifest["tree_type"] == "classifier")
        else:
            nodes.write.mode("overwrite").json(f"{path}/nodes")
        files.write_json(self.spark, f"{path}/manifest", manifest)

    def baseline(self, request: TrainingRequest, trials: int = 5, space: dict | None = None, depth: int | None = None, select: bool = False) -> dict:
        """Tunes on the request's table, out of bag; a job of the same id trains on the features kept.

        Trials are kept as a table; a search that was lost goes on after them.

        select: each max_features has features of its own, chosen by out-of-bag
        permutation importance, which scores all rows once for each feature.
        """
        df = self.load(request)
        h = request.hyperparameters
        features = [c for c, k in df.dtypes if c not in ("row_id", h.target) and k in ("double", "float", "int", "bigint")]
        chooser, mark = selection.Selector() if select else None, scratch_mark()
        ranked = forest.search(df, features, "row_id", h.target, trials, request.seed, space, depth, chooser, self._path("trials", request.job_id))
        purge_scratch(self.spark, mark)
        found = chooser.cache[ranked[0][1].get("max_features", "sqrt")] if chooser else None
        manifest = {"hyperparameters": ranked[0][1], "f1": ranked[0][0], "features": (found and found["kept"]) or features, "selection": found}
        files.write_json(self.spark, self._path("baseline", request.job_id), manifest)
        return manifest

"""Requests, checked when they are made, and the schemas of state tables."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field, fields

TASKS = ("classifier", "regressor")
MODES = ("centralized", "federated")
ENVIRONMENTS = ("local", "cloud")
DATASETS = ("real", "synthetic")
PARTITIONS = ("iid", "by_day")
ALLOCATIONS = ("proportional", "equal")
TARGETS = {"classifier": "Label", "regressor": "Target"}


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Hyperparameters:
    n_estimators: int = 100
    max_depth: int | None = None
    min_samples_split: int = 2
    class_weight: str | None = None
    max_samples: float | int = 1.0
    bootstrap: bool = True
    tree_type: str = "classifier"
    target_column: str | None = None
    max_features: str | float | None = None
    criterion: str | None = None
    n_samples: int | None = None
    n_features: int | None = None
    noise: float | None = None
    n_informative_reg: int | None = None

    def __post_init__(self) -> None:
        _one_of("tree_type", self.tree_type, TASKS)
        if self.n_estimators <= 0:
            raise ValueError("n_estimators must be positive")
        if self.max_depth is not None and self.max_depth <= 0:
            raise ValueError("max_depth must be positive or None")
        if self.min_samples_split < 2:
            raise ValueError("min_samples_split must be 2 or more")
        if not 0 < self.max_samples <= 1:
            raise ValueError("max_samples must be above 0 and at most 1")
        if self.tree_type == "regressor" and self.class_weight is not None:
            object.__setattr__(self, "class_weight", None)

    @property
    def target(self) -> str:
        return self.target_column or TARGETS[self.tree_type]

    @property
    def features_each_split(self) -> str:
        """MLlib's name for max_features: sqrt for classifiers and a third for regressors by default."""
        if self.max_features is None:
            return "sqrt" if self.tree_type == "classifier" else "onethird"
        return str(self.max_features)


@dataclass(frozen=True)
class TrainingRequest:
    dataset_path: str
    hyperparameters: Hyperparameters = field(default_factory=Hyperparameters)
    job_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    environment: str = "local"
    mode: str = "centralized"
    dataset_type: str = "real"
    seed: int = 123
    partition_strategy: str = "iid"
    tree_allocation_strategy: str = "proportional"
    num_workers: int = 4

    def __post_init__(self) -> None:
        _one_of("environment", self.environment, ENVIRONMENTS)
        _one_of("mode", self.mode, MODES)
        _one_of("dataset_type", self.dataset_type, DATASETS)
        _one_of("partition_strategy", self.partition_strategy, PARTITIONS)
        _one_of("tree_allocation_strategy", self.tree_allocation_strategy, ALLOCATIONS)
        if self.num_workers < 1:
            raise ValueError("num_workers must be 1 or more")


@dataclass(frozen=True)
class InferenceRequest:
    job_id: str
    inference_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    request_type: str = "INFERENCE"
    data_url: str | None = None
    environment: str = "local"
    dataset_type: str = "real"
    hyperparameters: Hyperparameters = field(default_factory=Hyperparameters)

    def __post_init__(self) -> None:
        _one_of("environment", self.environment, ENVIRONMENTS)
        _one_of("dataset_type", self.dataset_type, DATASETS)


def to_dict(request) -> dict:
    return asdict(request)


def training_request(data: dict) -> TrainingRequest:
    """From the dictionary of a JSON message; unknown names are refused."""
    data = dict(data)
    data["hyperparameters"] = Hyperparameters(**data.get("hyperparameters", {}))
    if unknown := set(data) - {f.name for f in fields(TrainingRequest)}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return TrainingRequest(**data)


JOB_EVENTS = "job_id string, status string, dataset_path string, mode string, dataset_type string, hyperparameters string, owner string, trees long, at_s double"
TASK_EVENTS = "task_id string, job_id string, worker_name string, status string, at_s double"
LOCK_EVENTS = "lock_key string, owner string, action string, ttl double, at_s double"

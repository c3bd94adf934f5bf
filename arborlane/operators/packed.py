"""Trees in files: executors read the node tables that they need themselves, as flat arrays.

A node table is published once, as Parquet sorted by tree, in the folder that
the cluster shares.  A task reads the trees of its group (bounded by nodes) and
keeps them for the tasks after it; neither nodes nor rows of them come to the
driver, which knows trees by number and size only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

#: Nodes of a group of trees at most (one tree at least), and of a published file.
NODES_AT_ONCE = 2_000_000
#: The group that this worker read last.
_kept: dict[tuple, "Trees"] = {}


def dataset(paths: Sequence[str]) -> ds.Dataset:
    """Parquet folders written by Spark, in any store that Arrow reads; read by a task, not by the driver."""
    first = paths[0]
    if "://" in first:
        store, _ = fs.FileSystem.from_uri(first)
        places = [fs.FileSystem.from_uri(p)[1] for p in paths]
    else:
        store, places = fs.LocalFileSystem(), [p.removeprefix("file:") for p in paths]
    files = [f.path for p in places for f in store.get_file_info(fs.FileSelector(p)) if f.path.endswith(".parquet")]
    return ds.dataset(files, format="parquet", filesystem=store)


class Trees:
    """Trees as arrays, all rows of a batch walking down one level at a time; a row that reached its leaf is left out of further steps."""

    def __init__(self, table: pa.Table):
        """table: tree_id, node_id, feature, threshold, left, right and, if asked for, support and dist."""
        get = lambda name, kind: table.column(name).fill_null(-1 if kind is np.int64 else 0.0).to_numpy().astype(kind)
        tree, node = get("tree_id", np.int64), get("node_id", np.int64)
        order = np.lexsort((node, tree))
        self.tree, self.node = tree[order], node[order]
        self.feature, self.threshold = get("feature", np.int64)[order], get("threshold", np.float64)[order]
        ids, dense = np.unique(self.node, return_inverse=True)
        trees, at = np.unique(self.tree, return_inverse=True)
        place = at * np.int64(max(len(ids), 1)) + dense  # ascending, as rows are

        def child(name: str) -> np.ndarray:
            to = get(name, np.int64)[order]
            inner = self.feature >= 0
            out = np.full(len(to), -1, np.int64)
            out[inner] = np.searchsorted(place, at[inner] * np.int64(len(ids)) + np.searchsorted(ids, to[inner]))
            return out

        self.left, self.right = child("left"), child("right")
        first = np.concatenate([[0], np.flatnonzero(np.diff(self.tree)) + 1]) if len(self.tree) else []
        self.roots = dict(zip(trees.tolist(), np.asarray(first, np.int64).tolist(), strict=True))
        self.support = self.dist = None
        if "dist" in table.column_names:
            self.support = np.maximum(get("support", np.int64)[order], 0)
            lists = table.column("dist").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
            sizes = np.zeros(len(order), np.int64) if not len(order) else lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(sizes.max()) if len(sizes) else 0
            flat = np.zeros((len(order), width))
            if width:
                starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
                flat[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - starts] = lists.flatten().to_numpy(zero_copy_only=False)
            self.dist = flat[order]

    def leaf(self, tree: int, x: np.ndarray) -> np.ndarray:
        """Where each row of x ends."""
        at = np.full(len(x), self.roots[tree], np.int64)
        some = np.arange(len(x)) if self.feature[self.roots[tree]] >= 0 else np.zeros(0, np.int64)
        while len(some):
            node = at[some]
            to = np.where(x[some, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            at[some] = to
            some = some[self.feature[to] >= 0]
        return at

    def features_used(self, tree: int) -> set[int]:
        own = self.feature[self.tree == tree]
        return set(own[own >= 0].tolist())


COLUMNS = ["tree_id", "node_id", "feature", "threshold", "left", "right", "support", "dist"]


def publish(nodes: DataFrame) -> str:
    """The folder of the node table, written by tree so that a group of trees lies in few files."""
    folder = scratch(nodes.sparkSession, "trees")
    nodes.select(*COLUMNS).repartitionByRange("tree_id", "node_id").sortWithinPartitions("tree_id", "node_id").write.option("maxRecordsPerFile", NODES_AT_ONCE).parquet(folder)
    return folder


def groups(nodes: DataFrame, limit: int | None = None) -> list[list[int]]:
    """Tree numbers in groups of at most so many nodes; a tree at least.  The driver sees a number and a size of each tree."""
    limit = limit or NODES_AT_ONCE
    out, size = [[]], 0
    for tree, n in sorted((r[0], r[1]) for r in nodes.groupBy("tree_id").count().collect()):
        if out[-1] and size + n > limit:
            out.append([])
            size = 0
        out[-1].append(tree)
        size += n
    return out if out[0] else []


def trees(folder: str, group: list[int]) -> Trees:
    """The group's trees, in a task; kept until the worker is asked for others."""
    name = (folder, tuple(group))
    if name not in _kept:
        _kept.clear()
        _kept[name] = Trees(dataset([folder]).to_table(columns=COLUMNS, filter=ds.field("tree_id").isin(group)))
    return _kept[name]


def matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """n columns of doubles from `first` on, as rows."""
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(n)]) if n else np.zeros((batch.num_rows, 0))


def inputs(features: Sequence[str]) -> list:
    """The features as doubles f0, f1, ...; null counts as 0."""
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]

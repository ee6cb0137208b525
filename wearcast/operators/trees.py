"""Trees as a table (S8, L2): one row per node, for any number of trees.

``label, kind, node, feature, threshold, strict, left, right, value``: the
nodes of a tree are numbered from 1 at the root, the children of node n are 2n
and 2n + 1; a leaf has no feature.  A row goes left where ``feature <=
threshold`` (``<`` where ``strict``); NaN goes right.  ``value`` is the class a
row gets that ends there, as text; ``kind`` is ``boolean`` or ``string``.

A ``TreeModel`` is such a table of one model in memory (ten trees of depth 4
have at most 310 rows).  It is written and read as one small Parquet table, and
its predictions are nested CASE expressions over the feature columns, so
scoring is a projection inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.feature import Bucketizer, IndexToString, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wearcast import schema as S

NODE_SCHEMA = "label string, kind string, node bigint, feature string, threshold double, strict boolean, left bigint, right bigint, value string"


@dataclass(frozen=True)
class Node:
    label: str
    kind: str
    node: int
    feature: str | None
    threshold: float | None
    strict: bool
    left: int | None
    right: int | None
    value: str | None


@dataclass(frozen=True)
class TreeModel:
    """The trees of one model: ``features`` it reads, and its nodes."""

    features: tuple[str, ...]
    nodes: tuple[Node, ...]

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys(n.label for n in self.nodes))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(n.__dict__.values()) for n in self.nodes], NODE_SCHEMA)


def model_of_rows(rows: Iterable[Row], features: Sequence[str] = S.FEATURES) -> TreeModel:
    """The model held in rows of a node table, labels in the schema's order;
    every child must be there."""
    names = list(Node.__dataclass_fields__)
    place = {label: i for i, label in enumerate(S.LABELS)}
    nodes = sorted((Node(**{k: r[k] for k in names}) for r in rows), key=lambda n: (place.get(n.label, len(place)), n.label, n.node))
    there = {(n.label, n.node) for n in nodes}
    if len(there) != len(nodes):
        raise ValueError("a node is listed twice: the rows hold more than one model")
    for n in nodes:
        if n.feature is not None and not {(n.label, n.left), (n.label, n.right)} <= there:
            raise ValueError(f"children of node {n.node} of {n.label} are missing")
        if n.feature is not None and n.feature not in features:
            raise ValueError(f"unknown feature {n.feature!r}")
    for label in {n.label for n in nodes}:
        if (label, 1) not in there:
            raise ValueError(f"the tree of {label} has no root")
    return TreeModel(tuple(features), tuple(nodes))


# -- from a fitted pipeline ---------------------------------------------------
def _bins(model: PipelineModel) -> list[tuple[str, list[float] | None]]:
    """(feature, its bins' bounds or None) for each input of the trees."""
    cut = next((st for st in model.stages if isinstance(st, Bucketizer)), None)
    known = {} if cut is None else {o: (i, list(b)) for o, i, b in zip(cut.getOutputCols(), cut.getInputCols(), cut.getSplitsArray())}
    names = next(st for st in model.stages if isinstance(st, VectorAssembler)).getInputCols()
    return [known.get(n, (n, None)) for n in names]


def _pipeline_nodes(tree: DecisionTreeClassificationModel, label: str, kind: str, values: list[str], bins) -> list[Node]:
    """A fitted tree's nodes.  A split of a binned feature becomes one at the
    bound that its threshold stands for.  ValueError on a categorical split."""
    out: list[Node] = []

    def visit(n, number: int) -> None:
        value = values[int(n.prediction())]
        if n.subtreeDepth() == 0:
            out.append(Node(label, kind, number, None, None, False, None, None, value))
            return
        split = n.split()
        if not split.getClass().getSimpleName().startswith("Continuous"):
            raise ValueError("only continuous splits have a native form")
        feature, bounds = bins[split.featureIndex()]
        at = float(split.threshold())
        bound = at if bounds is None else bounds[math.floor(at) + 1]
        out.append(Node(label, kind, number, feature, bound, bounds is not None, 2 * number, 2 * number + 1, value))
        visit(n.leftChild(), 2 * number)
        visit(n.rightChild(), 2 * number + 1)

    visit(tree._call_java("rootNode"), 1)
    return out


def model_of_pipeline(model: PipelineModel) -> TreeModel | None:
    """The trees of a fitted pipeline as nodes; None when it has a stage that
    nodes cannot express."""
    stages = list(model.stages)
    if stages and isinstance(stages[0], Bucketizer):
        stages = stages[1:]
    if not stages or not isinstance(stages[0], VectorAssembler):
        return None
    bins = _bins(model)
    trees = {st.getPredictionCol(): st for st in stages if isinstance(st, DecisionTreeClassificationModel)}
    nodes: list[Node] = []
    try:
        for st in stages[1:]:
            if isinstance(st, IndexToString):
                label = st.getOutputCol().removeprefix("pred_")
                nodes += _pipeline_nodes(trees.pop(st.getInputCol()), label, "string", list(st.getLabels()), bins)
            elif isinstance(st, SQLTransformer):
                for name in [p for p in trees if f"CAST({p} = 1.0 AS BOOLEAN)" in st.getStatement()]:
                    label = name.removeprefix("_").removesuffix("_pred")
                    nodes += _pipeline_nodes(trees.pop(name), label, "boolean", ["false", "true"], bins)
            elif not isinstance(st, DecisionTreeClassificationModel):
                return None
    except (ValueError, KeyError):
        return None
    if trees:
        return None
    return TreeModel(tuple(f for f, _ in bins), tuple(nodes))


# -- predictions --------------------------------------------------------------
def predictions(model: TreeModel, features: dict | None = None) -> dict[str, Column]:
    """``pred_<label>`` columns: each tree as a nested CASE, NULL where any
    feature is NULL.  ``features`` may give a Column per feature name."""
    given = {f: (features or {}).get(f, F.col(f)).cast("double") for f in model.features}
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in given.values()])
    by_label: dict[str, dict[int, Node]] = {}
    for n in model.nodes:
        by_label.setdefault(n.label, {})[n.node] = n

    def column(tree: dict[int, Node], number: int) -> Column:
        n = tree[number]
        if n.feature is None:
            return F.lit(n.value if n.kind == "string" or n.value is None else n.value == "true")
        x, at = given[n.feature], F.lit(n.threshold)
        return F.when(x < at if n.strict else x <= at, column(tree, n.left)).otherwise(column(tree, n.right))

    return {f"pred_{label}": F.when(complete, column(tree, 1)) for label, tree in by_label.items()}


# -- storage ------------------------------------------------------------------
def write_nodes(nodes: DataFrame, path: str) -> None:
    """One Parquet table of nodes; it must not exist yet."""
    nodes.write.parquet(path)


def read_model(spark: SparkSession, path: str, features: Sequence[str] = S.FEATURES) -> TreeModel:
    """One read of the node table of one model (bounded: one row a node)."""
    return model_of_rows(spark.read.schema(NODE_SCHEMA).parquet(path).collect(), features)

"""Gradient-boosted trees: loading, scoring as generated column expressions or vectorised in Arrow batches, and training."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More nodes than this in a label's trees are scored in Arrow batches: generated code has a size limit a method.
EXPRESSION_NODES = 600


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 at leaves), threshold, the two children, and the leaf's value."""

    feature: np.ndarray
    threshold: np.ndarray
    yes: np.ndarray
    no: np.ndarray
    leaf: np.ndarray

    @classmethod
    def parse(cls, root: dict[str, Any] | list) -> Tree:
        rows: list[list[float]] = []

        def add(node: dict[str, Any]) -> int:
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, float(node.get("leaf", 0.0))])
            if "leaf" not in node:
                rows[at][0], rows[at][1] = int(str(node["split"]).lstrip("f")), float(node["split_condition"])
                rows[at][2], rows[at][3] = (add(c) for c in node["children"][:2])
            return at

        add(root[0] if isinstance(root, list) else root)
        f, t, y, n, v = zip(*rows, strict=True)
        return cls(np.array(f, int), np.array(t, float), np.array(y, int), np.array(n, int), np.array(v, float))

    def dump(self, k: int = 0, depth: int = 0) -> dict[str, Any]:
        if self.feature[k] < 0:
            return {"nodeid": k, "depth": depth, "leaf": float(self.leaf[k])}
        a, b = int(self.yes[k]), int(self.no[k])
        return {"nodeid": k, "depth": depth, "split": f"f{self.feature[k]}", "split_condition": float(self.threshold[k]), "yes": a, "no": b, "children": [self.dump(a, depth + 1), self.dump(b, depth + 1)]}

    def column(self, columns: list[str], k: int = 0) -> Column:
        if self.feature[k] < 0:
            return F.lit(float(self.leaf[k]))
        test = F.col(columns[self.feature[k]]) < float(self.threshold[k])
        return F.when(test, self.column(columns, int(self.yes[k]))).otherwise(self.column(columns, int(self.no[k])))

    def values(self, x: np.ndarray) -> np.ndarray:
        """All rows go down a level at a time; NaN goes to the second child, as it is less than nothing."""
        at = np.zeros(len(x), int)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            k = at[live]
            at[live] = np.where(x[live, self.feature[k]] < self.threshold[k], self.yes[k], self.no[k])
            live = live[self.feature[at[live]] >= 0]
        return self.leaf[at]


@dataclass
class Model:
    """Trees under the label they belong to. Labels may have different numbers of trees."""

    trees: dict[str, list[Tree]]

    @classmethod
    def load(cls, text: str, labels: list[str] | None = None) -> Model:
        """{label: [tree, ...]}, or a flat list of trees that is split evenly over `labels`."""
        raw = json.loads(text)
        if isinstance(raw, dict):
            return cls({k: [Tree.parse(t) for t in v] for k, v in raw.items()})
        if not labels or len(raw) % len(labels):
            raise ValueError("a flat list needs labels that divide its length")
        n = len(raw) // len(labels)
        return cls({x: [Tree.parse(t) for t in raw[i * n : (i + 1) * n]] for i, x in enumerate(labels)})

    def features(self) -> set[int]:
        """The places of the features that some tree looks at."""
        return {int(f) for v in self.trees.values() for t in v for f in t.feature if f >= 0}

    def dump(self) -> str:
        return json.dumps({k: [[t.dump()] for t in v] for k, v in self.trees.items()})

    def logits(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: sum((t.values(x) for t in v), np.zeros(len(x))) for k, v in self.trees.items()}


def score(df: DataFrame, model: Model, columns: list[str], logits: bool = False, expressions: bool | None = None) -> DataFrame:
    """df with a column a label: the sigmoid of the summed leaves, or the sum itself. Only columns that some tree looks at are read."""
    if expressions is None:
        expressions = max(sum(len(t.feature) for t in v) for v in model.trees.values()) <= EXPRESSION_NODES
    if expressions:
        out = df
        for label, trees in model.trees.items():
            z = sum((t.column(columns) for t in trees[1:]), trees[0].column(columns)) if trees else F.lit(0.0)
            out = out.withColumn(label, z if logits else 1 / (1 + F.exp(-z)))
        return out
    labels, used = list(model.trees), sorted(model.features()) or [0]

    @F.pandas_udf(", ".join(f"`{x}` double" for x in labels))
    def run(*series: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(series[0]), len(columns)))
        for k, s in zip(used, series, strict=True):
            x[:, k] = s.to_numpy(float)
        z = model.logits(x)
        return pd.DataFrame({k: v if logits else 1 / (1 + np.exp(-v)) for k, v in z.items()})

    return df.withColumn("_scores", run(*[F.col(columns[k]).cast("double") for k in used])).select(*df.columns, *[F.col("_scores")[x].alias(x) for x in labels])


def predictions(df: DataFrame, labels: list[str], threshold: float = 0.5) -> DataFrame:
    return df.withColumns({f"pred_{x}": (F.col(x) >= threshold).cast("int") for x in labels})


def node_table(model: Model, spark) -> DataFrame:
    """(label, tree, node, feature, threshold, yes, no, leaf)."""
    rows = [(x, i, k, int(t.feature[k]), float(t.threshold[k]), int(t.yes[k]), int(t.no[k]), float(t.leaf[k])) for x, ts in model.trees.items() for i, t in enumerate(ts) for k in range(len(t.feature))]
    return spark.createDataFrame(rows, "label string, tree int, node int, feature int, threshold double, yes int, no int, leaf double")


def train(df: DataFrame, label: str, columns: list[str], rounds: int = 20, depth: int = 5, rate: float = 0.1, most_weight: float = 20.0, bins: int = 64):
    """Spark's boosted trees for one label, positives weighted by the class ratio (at most `most_weight`)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    n, pos = df.agg(F.count("*"), F.sum(F.col(label).cast("int"))).first()
    weight = min((n - (pos or 0)) / max(pos or 0, 1), most_weight)
    ready = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(df).withColumn("_y", F.col(label).cast("double")).withColumn("_w", F.when(F.col(label) == 1, weight).otherwise(1.0))
    return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=bins, seed=42).fit(ready)


def from_spark(model, label: str) -> Model:
    """A trained Spark model as ours. Spark's margin is twice the sum, and its tests are <=, so thresholds move up by one step."""

    def tree(dt, weight: float) -> Tree:
        rows: list[list[float]] = []

        def add(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, 0.0])
            if node.numDescendants() == 0:
                rows[at][4] = 2 * weight * node.prediction()
            else:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), float(np.nextafter(split.threshold(), np.inf))]
                rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
            return at

        add(dt._call_java("rootNode"))
        f, t, y, n, v = zip(*rows, strict=True)
        return Tree(np.array(f, int), np.array(t), np.array(y, int), np.array(n, int), np.array(v))

    return Model({label: [tree(t, w) for t, w in zip(model.trees, model.treeWeights, strict=True)]})


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


__all__ = ["Model", "Tree", "from_spark", "importances", "node_table", "predictions", "score", "train"]

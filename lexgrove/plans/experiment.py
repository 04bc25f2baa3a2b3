"""Role labelling from sentence tables to scores in one call: features, split, training, labelling, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.operators import evaluation, learners
from lexgrove.operators import relational as rel
from lexgrove.plans import role_features
from lexgrove.sources.shared import cut

KEY = "instance"
STEPS = ("prune", "argrec", "arglab", "all")


@dataclass(frozen=True)
class RoleRun:
    """table: all rows with dataset; models: of both steps; labelled: rows of the test part with argrec and arglab."""

    table: DataFrame
    models: DataFrame
    labelled: DataFrame

    def by_class(self, step: str = "all", group: str = "frame") -> DataFrame:
        """Precision, recall and F of each group and class."""
        return evaluation.group_class_prf(evaluation.step_labels(self.labelled, step, role_features.NOVAL), group=group)

    def overall(self, step: str = "all") -> DataFrame:
        """Accuracy over all rows of the test part."""
        return evaluation.overall(evaluation.step_labels(self.labelled, step, role_features.NOVAL))


def featurized(t: dict[str, DataFrame], percent: int = 90, seed: str = "split", language: str = "en", height: int | None = None) -> DataFrame:
    """The feature table as learners read it, with a key and dataset: train or test, by frame and sentence."""
    rows = role_features.at_boundary(role_features.build(t, language, height)).withColumn(KEY, F.concat_ws(" ", "sentid", "nodeID"))
    return cut(rel.split(rows, "sentid", percent, seed))


def run_roles(table: DataFrame, features: Sequence[str] | None = None, xwise: Sequence[str] = ("frame",), kind: str = "maxent") -> RoleRun:
    """Recognition of role fillers, then their labelling, with a model for each value of xwise.

    table: as featurized gives it. Pruned rows train nothing and get no value; labelling trains on
    rows with gold and sees what recognition found.
    """
    used = list(features) if features is not None else [c for c in role_features.model_features(table) if c not in (KEY, "dataset")]
    kept, test = table.where("dataset = 'train' and prune <> 0"), table.where("dataset = 'test'")
    models = {step: cut(learners.train(kept, list(xwise), used, "gold", step, kind, role_features.NOVAL)) for step in ("argrec", "arglab")}
    found = learners.apply(models["argrec"], test.where("prune <> 0"), KEY, list(xwise), used, role_features.NOVAL)
    recognized = cut(learners.with_prediction(test, found, KEY, "argrec", role_features.NOVAL))
    asked = learners.for_labelling(recognized, "argrec", role_features.NOVAL)
    named = learners.apply(models["arglab"], asked, KEY, list(xwise), used, role_features.NOVAL)
    return RoleRun(table, models["argrec"].unionByName(models["arglab"]), cut(learners.with_prediction(recognized, named, KEY, "arglab", role_features.NOVAL)))

"""One classifier for each group of rows: training, application, pruning and combination."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("maxent", "knn", "majority")
_MODEL = "grp string, step string, kind string, model string"


def _onehot(values: pd.DataFrame, vocabulary: dict[str, int]) -> list[list[int]]:
    columns = [[vocabulary.get(f"{i}={v}") for v in values[c].astype(str)] for i, c in enumerate(values.columns)]
    return [[j for j in row if j is not None] for row in zip(*columns, strict=True)] if len(values) else []


def _maxent(rows: list[list[int]], labels: np.ndarray, width: int, classes: int, times: np.ndarray | None = None, rounds: int = 80, prior: float = 1.0) -> np.ndarray:
    """Weights of a multinomial logistic model on sparse indicator rows, by scaled gradient steps with a Gaussian prior.

    times: how often each row occurs; without it once.
    """
    times = np.ones(len(rows)) if times is None else times
    every = max(1, times.sum())
    weights = np.zeros((width + 1, classes))
    step = np.full_like(weights, 1.0)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, int) for r in rows]) if len(rows) else np.zeros(0, int)
    owner = np.repeat(np.arange(len(rows)), lengths)
    target = np.eye(classes)[labels]
    last = np.zeros_like(weights)
    for _ in range(rounds):
        score = np.column_stack([np.bincount(owner, weights[flat, c], len(rows)) for c in range(classes)]) + weights[-1]
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slip = (p - target) * times[:, None]
        slope = np.column_stack([np.bincount(flat, slip[owner, c], width + 1) for c in range(classes)])
        slope[-1] = slip.sum(0)
        slope = slope / every + weights * prior / every * 0.1
        same = np.sign(slope) * np.sign(last)
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 5)
        weights -= step * np.sign(slope) * np.minimum(np.abs(slope) * 4, 1)
        last = slope
    return weights


def train_one(values: pd.DataFrame, labels: pd.Series, kind: str, times: np.ndarray | None = None) -> dict:
    """A model of rows that occur so many times each; without times once."""
    times = np.ones(len(labels), np.int64) if times is None else times
    names = sorted(labels.astype(str).unique())
    place = {n: i for i, n in enumerate(names)}
    y = labels.astype(str).map(place).to_numpy()
    model: dict = {"labels": names, "counts": np.bincount(y, times, len(names)).astype(np.int64).tolist()}
    if kind == "maxent":
        vocabulary = {k: i for i, k in enumerate(sorted({f"{i}={v}" for i, c in enumerate(values.columns) for v in values[c].astype(str)}))}
        model |= {"vocabulary": vocabulary, "weights": _maxent(_onehot(values, vocabulary), y, len(vocabulary), len(names), times).round(6).tolist()}
    elif kind == "knn":
        model |= {"rows": np.repeat(values.astype(str).to_numpy(), times, 0).tolist(), "y": np.repeat(y, times).tolist()}
    return model


def apply_one(model: dict, values: pd.DataFrame, kind: str, k: int = 5) -> list[list[tuple[str, float]]]:
    """For each row labels with confidences, best first; equal rows are scored once."""
    if len(values) and len(values.columns):
        values = values.astype(str)
        place = values.groupby(list(values.columns), sort=False).ngroup().to_numpy()
        kinds = np.unique(place, return_index=True)[1]
        if len(kinds) < len(values):
            found = apply_one(model, values.iloc[kinds], kind, k)
            return [found[i] for i in place]
    names, n = model["labels"], len(values)
    if kind == "majority":
        scores = np.tile(np.array(model["counts"], float) / max(1, sum(model["counts"])), (n, 1))
    elif kind == "knn":
        known, y = np.array(model["rows"], object), np.array(model["y"])
        scores = np.zeros((n, len(names)))
        for i, row in enumerate(values.astype(str).to_numpy()):
            distance = (known != row).sum(1)
            near = np.flatnonzero(distance <= np.sort(distance)[min(k, len(distance)) - 1])
            np.add.at(scores[i], y[near], 1.0)
        scores /= np.maximum(scores.sum(1, keepdims=True), 1)
    else:
        weights = np.array(model["weights"])
        scores = np.array([weights[r].sum(0) + weights[-1] for r in _onehot(values, model["vocabulary"])]).reshape(n, len(names))
        scores = np.exp(scores - scores.max(1, keepdims=True)) if n else scores
        scores = scores / scores.sum(1, keepdims=True) if n else scores
    return [sorted(((names[j], float(s[j])) for j in range(len(names))), key=lambda x: (-x[1], x[0])) for s in scores]


def train(rows: DataFrame, group: list[str], features: list[str], label: str, step: str, kind: str = "maxent", noval: str = "NONE") -> DataFrame:
    """(grp, step, kind, model): a model for each group; labels are FE or no-value for argrec, roles for arglab.

    Equal rows are counted first, so that a group's task gets its distinct rows only.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if step == "argrec":
        rows = rows.withColumn(label, F.when(F.col(label) == noval, noval).otherwise("FE"))
    elif step == "arglab":
        rows = rows.where(F.col(label) != noval)
    slim = rows.select(F.concat_ws("+", *group).alias("grp"), *features, F.col(label).alias("_label"))
    slim = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("_times"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model = train_one(pdf[features], pdf["_label"], kind, pdf["_times"].to_numpy())
        return pd.DataFrame({"grp": [key[0]], "step": [step], "kind": [kind], "model": [json.dumps(model)]})

    return slim.groupBy("grp").applyInPandas(run, _MODEL)


def apply(models: DataFrame, rows: DataFrame, key: str, group: list[str], features: list[str], noval: str = "NONE") -> DataFrame:
    """(key, candidates): labels with confidences, best first; rows of groups without a model get no-value."""
    named = rows.select(key, F.concat_ws("+", *group).alias("grp"), *features)
    kind = dict(rows.dtypes)[key]

    def run(k: tuple, own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({key: [], "candidates": []})
        if len(own):
            found = apply_one(json.loads(own["model"].iloc[0]), pdf[features], own["kind"].iloc[0])
        else:
            found = [[(noval, 1.0)]] * len(pdf)
        return pd.DataFrame({key: pdf[key], "candidates": [[{"label": a, "conf": b} for a, b in f] for f in found]})

    return models.groupBy("grp").cogroup(named.groupBy("grp")).applyInPandas(run, f"{key} {kind}, candidates array<struct<label:string,conf:double>>")


def with_prediction(rows: DataFrame, applied: DataFrame, key: str, name: str, noval: str = "NONE") -> DataFrame:
    """rows with the best label; pruned rows and rows without one get no-value."""
    best = applied.select(key, F.col("candidates")[0]["label"].alias("_best"))
    joined = rows.join(best, key, "left")
    kept = F.col("prune") != 0 if "prune" in rows.columns else F.lit(True)
    return joined.withColumn(name, F.when(kept, F.coalesce("_best", F.lit(noval))).otherwise(noval)).drop("_best")


def for_labelling(rows: DataFrame, recognized: str, noval: str = "NONE", perfect: bool = False, gold: str = "gold") -> DataFrame:
    """Rows that role labelling sees: those recognized, or with gold if recognition is taken as perfect."""
    return rows.where(F.col(gold if perfect else recognized) != noval)


def trainable(instances: DataFrame, group: str, label: str) -> DataFrame:
    """Instances of groups with more than one label."""
    several = instances.groupBy(group).agg(F.count_distinct(label).alias("_n")).where("_n > 1").select(group)
    return instances.join(several, group, "left_semi")


def single_sense(instances: DataFrame, inventory: DataFrame) -> DataFrame:
    """(instance_id, sense, confidence 1.0) of instances whose lemma has one sense; inventory: (lemma, senses)."""
    only = inventory.where(F.size("senses") == 1).select("lemma", F.col("senses")[0].alias("sense"))
    return instances.join(only, "lemma").select("instance_id", "sense", F.lit(1.0).alias("confidence"))


def join_binary(results: DataFrame, negative: str = "NONE") -> DataFrame:
    """(instance_id, candidates) from binary classifiers' (instance_id, classifier, label, conf, rank).

    Of each classifier its first label that isn't the negative mark; best first; an instance
    without any gets the negative mark.
    """
    order = Window.partitionBy("instance_id", "classifier").orderBy("rank")
    firsts = results.where(F.col("label") != negative).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "label")))
    joined = firsts.groupBy("instance_id").agg(F.transform(ordered, lambda x: F.struct(x["label"].alias("label"), (-x["c"]).alias("conf"))).alias("candidates"))
    none = F.array(F.struct(F.lit(negative).alias("label"), F.lit(0.0).alias("conf")))
    return results.select("instance_id").distinct().join(joined, "instance_id", "left").withColumn("candidates", F.coalesce("candidates", none))


def combine(results: list[DataFrame]) -> DataFrame:
    """Results of the classifiers of one step; a single one is supported."""
    if len(results) != 1:
        raise ValueError("exactly one classifier can be combined")
    return results[0]


def sweep(run, toggles: dict[str, list], slides: dict[str, list]) -> tuple[dict, float]:  # noqa: ANN001
    """The setting with the largest score of all combinations; the first of equals."""
    from itertools import product

    names = [*toggles, *slides]
    settings = [dict(zip(names, values, strict=True)) for values in product(*toggles.values(), *slides.values())]
    scored = [(run(**s), s) for s in settings]
    best = max(score for score, _ in scored)
    return next(s for score, s in scored if score == best), best

"""Models behind the engine's extension points: which artefact runs, and running it over Arrow batches."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import GREY_WEIGHTS, grey_features

ENVIRONMENT = {"STANDARDIZER": "GOLDLEAF_STANDARDIZER_MODEL", "CROSS_ENCODER": "GOLDLEAF_CROSS_ENCODER_MODEL"}


class ModelRefused(RuntimeError):
    """An artefact that must not run, with the reason."""


def digest(path: str | Path) -> str:
    """SHA-256 of a model file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def choose(kind: str, path: str | None = None, registered: Mapping[str, str] | None = None) -> str | None:
    """The artefact to run: a given path, else the active registered one, else the environment's; None: the built-in rules.

    A registered artefact (``path`` and ``digest``) that has changed since is refused.
    """
    if path:
        return path
    if registered:
        if not os.path.exists(registered["path"]):
            raise ModelRefused(f"{registered['path']} is registered and isn't there")
        if digest(registered["path"]) != registered["digest"]:
            raise ModelRefused(f"{registered['path']} has changed since it was registered")
        return registered["path"]
    return os.environ.get(ENVIRONMENT[kind])


def onnx_scorer(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of a feature matrix by an ONNX graph; its session is made once in each Python worker."""
    held: list = []

    def score(matrix: np.ndarray) -> np.ndarray:
        if not held:
            import onnxruntime

            held.append(onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]))
        session = held[0]
        return np.asarray(session.run(None, {session.get_inputs()[0].name: matrix.astype(np.float32)})[0]).reshape(-1)

    return score


def model_scores(scored: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], accept: float, features: Sequence[str] = tuple(GREY_WEIGHTS)) -> DataFrame:
    """left_id, right_id, ai_score, ai_decision of the grey pairs by a model, in place of the weighted features.

    Only pairs that the scorer left open reach Python, as Arrow batches.
    """
    grey = grey_features(scored.where("zone = 'GREY'")).select("left_id", "right_id", *features)
    ids = [T.StructField(c, grey.schema[c].dataType) for c in ("left_id", "right_id")]
    schema = T.StructType([*ids, T.StructField("ai_score", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = np.clip(scorer(part[list(features)].to_numpy(np.float64)), 0.0, 1.0)
            yield part[["left_id", "right_id"]].assign(ai_score=found.astype(np.float64))

    return grey.mapInPandas(run, schema).withColumn("ai_decision", F.when(F.col("ai_score") >= accept, "MATCH").otherwise("NO_MATCH"))


def with_verdicts(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scored pairs with a model's verdicts; pairs without one have none."""
    return scored.drop("ai_score", "ai_decision").join(verdicts, ["left_id", "right_id"], "left")

"""Scoring of streams by a fitted model: stateless, one lazy plan per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terraquant.plans.model import Fitted


def score_stream(model: Fitted, stream: DataFrame) -> DataFrame:
    """stream with the model's predictions; new points take the spatial effect of the nearest unit."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return model.transform(stream)

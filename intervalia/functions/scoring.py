"""Scores and clamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def decibels(x: Column, eps: float = 1e-12) -> Column:
    return 20 * F.log10(x + F.lit(eps))


def confidence_penalty(confidence: Column) -> Column:
    """Of a word that holds a point: 0.5 where unknown, 1 from 0.85, else 0.3."""
    return F.when(confidence.isNull(), 0.5).when(confidence >= 0.85, 1.0).otherwise(0.3)

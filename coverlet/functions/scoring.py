"""Scores of a passage for a topic: Column in, Column out."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from .fuzzy import token_set_ratio_column


def _columns(places: pa.Array, n: int, kind: pa.DataType) -> np.ndarray:
    """One row a place, from the places of vectors of length n laid end to end."""
    return np.ascontiguousarray(pc.cast(places, kind).to_numpy(zero_copy_only=False).reshape(-1, n).T)


@F.arrow_udf(T.DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    real = pc.fill_null(pc.equal(pc.list_value_length(a), pc.list_value_length(b)), False).to_numpy(zero_copy_only=False).copy()
    out = np.zeros(len(a))
    for n in np.unique(size[real & (size > 0)]):
        rows = np.flatnonzero(real & (size == n))
        x, y = (c.take(pa.array(rows)).flatten() for c in (a, b))
        known = _columns(pc.and_(x.is_valid(), y.is_valid()), n, pa.bool_()).all(0)
        total = np.zeros(len(rows))
        for p, q in zip(*(_columns(pc.fill_null(c, 0), n, pa.float64()) for c in (x, y)), strict=True):
            total += p * q
        out[rows], real[rows] = total, known
    return pa.array(out, mask=~real)


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision, summed in order; of unit vectors the cosine.

    Null vectors, null places and vectors of unequal length give null. Batches of pairs pass to Python as they are laid
    out in memory: functions of higher order, the other way, are interpreted for each place of each pair.
    """
    return _dot(a, b)


def rescale_semantic(similarity: Column, config: EngineConfig = DEFAULT) -> Column:
    """A raw similarity's place between floor and ceiling, within 0 and 1."""
    lo, hi = config.similarity_floor, config.similarity_ceiling
    place = (similarity - lo) / (hi - lo) if hi > lo else similarity
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))


def keyword_score(topic: Column, title: Column, body: Column) -> Column:
    """Overlap of stem sets: a topic's stem in the title counts two, in the body alone one, of two each."""
    n = F.size(topic)
    hits = 2 * F.size(F.array_intersect(topic, title)) + F.size(F.array_intersect(topic, F.array_except(body, title)))
    return F.when(n > 0, F.least(F.lit(1.0), hits / (2 * n))).otherwise(0.0)


def fuzzy_score(topic: Column, title: Column) -> Column:
    """Token-set likeness from 0 to 1, with case; 0 if either is empty."""
    return F.when((topic != "") & (title != ""), token_set_ratio_column(topic, title) / 100).otherwise(0.0)


def metadata_score(*fields: Column) -> Column:
    """The share of the fields that are not empty."""
    return sum((F.coalesce(f, F.lit("")) != "").cast("int") for f in fields) / F.lit(float(len(fields)))


@F.pandas_udf(T.DoubleType())
def _python_round(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else round(v, 1))


def round1(c: Column, config: EngineConfig = DEFAULT) -> Column:
    return _python_round(c) if config.parity_rounding else F.round(c, 1)


def combine_scores(semantic: Column, keyword: Column, fuzzy: Column, metadata: Column, config: EngineConfig = DEFAULT) -> Column:
    """The weighted sum as a percentage with one decimal."""
    total = config.weight_semantic * semantic + config.weight_keyword * keyword + config.weight_fuzzy * fuzzy + config.weight_metadata * metadata
    return round1(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) * 100, config)


def allows_unit(units: Column, number: Column) -> Column:
    return (F.size(units) == 0) | number.isNull() | F.array_contains(units, number)


def allows_section(sections: Column, label: Column) -> Column:
    return (F.size(sections) == 0) | F.array_contains(sections, label)


def status(percent: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.when(percent >= config.found_percent, "Found").when(percent >= config.tentative_percent, "Tentative").otherwise("Not Found")

"""What users can add: indicators, calendars (see operators.calendars), own buckets, aggregates, finality and inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import indicators
from .operators.calendars import CALENDARS, register_calendar

__all__ = ["CALENDARS", "IndicatorSpec", "SPECS", "apply_finality", "compute", "register_calendar", "register_indicator"]


@dataclass(frozen=True)
class IndicatorSpec:
    name: str
    version: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    params: dict = field(default_factory=dict)
    warm_up: int = 0


SPECS: dict[str, IndicatorSpec] = {}


def register_indicator(spec: IndicatorSpec, fn: Callable[..., DataFrame]) -> None:
    """fn(bars, **params) -> bars with the spec's outputs."""
    if spec.name in indicators.REGISTRY:
        raise ValueError(f"there is an indicator {spec.name!r}")
    SPECS[spec.name] = spec
    indicators.REGISTRY[spec.name] = fn
    indicators.WARM_UP[spec.name] = lambda **_: spec.warm_up


def compute(bars: DataFrame, name: str, **params) -> DataFrame:
    """The indicator with its defaults; ValueError for unknown parameters or missing inputs or outputs."""
    spec = SPECS.get(name)
    if spec:
        if unknown := set(params) - set(spec.params):
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
        if missing := set(spec.inputs) - set(bars.columns):
            raise ValueError(f"{name} needs {sorted(missing)}")
        params = spec.params | params
    out = indicators.REGISTRY[name](bars, **params)
    if spec and (missing := set(spec.outputs) - set(out.columns)):
        raise ValueError(f"{name} did not make {sorted(missing)}")
    return out


def apply_finality(bars: DataFrame, rule: Callable[[], Column]) -> DataFrame:
    """is_closed by a rule of the user's."""
    return bars.withColumn("is_closed", F.coalesce(rule(), F.lit(False)))

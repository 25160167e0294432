"""Settings of the inference and detection operators, from an INI file. No secrets live here."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from ..operators.evidence import WEIGHTS


@dataclass(frozen=True)
class Propagation:
    """How label propagation explores and stops."""

    min_mentions: int = 3
    max_depth: int = 3
    req_locations: int = 1
    max_iterations: int = 4


@dataclass(frozen=True)
class Detection:
    """Radius in km, times in minutes, and the counts of the population curve."""

    cluster_radius: float = 10.0
    cluster_timediff: float = 30.0
    cluster_maxage: float = 360.0
    mincount: int = 10
    mediancount: int = 30


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    propagation: Propagation = Propagation()
    detection: Detection = Detection()


def load(path: str, spark: SparkSession | None = None) -> Settings:
    """Settings of a local file or, with a session, of any path that Spark can read."""
    if spark is not None:
        return loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path) as f:
        return loads(f.read())


def loads(text: str) -> Settings:
    """Sections multiindicator (weights by name), slp and events; what is absent keeps its default, unknown keys are errors."""
    given = configparser.ConfigParser()
    given.optionxform = str
    given.read_string(text)

    def part(kind: type, section: str):
        own = dict(given[section]) if given.has_section(section) else {}
        known = {f.name: f.type for f in fields(kind)}
        if extra := own.keys() - known.keys():
            raise ValueError(f"unknown settings in {section}: {', '.join(sorted(extra))}")
        return kind(**{k: (int if known[k] == "int" else float)(v) for k, v in own.items()})

    weights = {k: float(v) for k, v in given["multiindicator"].items()} if given.has_section("multiindicator") else {}
    return Settings(dict(WEIGHTS) | weights, part(Propagation, "slp"), part(Detection, "events"))

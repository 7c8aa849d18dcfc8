"""All registered queries and the DuckDB SQL that states each result independently."""

from __future__ import annotations

from . import comparing, modelling, profile, relations, scalars, sequences, series
from .register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "comparing", "modelling", "profile", "relations", "scalars", "sequences", "series"]

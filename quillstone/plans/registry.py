"""Every query of the library outside llm, with its SQL."""

from __future__ import annotations

from . import brief_plans, event_plans, kept_plans, more_plans, series_plans, sink_plans, source_plans, text_plans, view_plans
from .base import ORACLE, QUERIES

__all__ = ["MODULES", "ORACLE", "QUERIES"]
MODULES = (series_plans, event_plans, text_plans, view_plans, more_plans, source_plans, brief_plans, sink_plans, kept_plans)

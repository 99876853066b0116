"""Imports every plan module so that its queries are registered."""

from . import coverage_plans, ingest_plans, report_plans, similarity_plans, stream_plans, text_plans  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES  # noqa: F401

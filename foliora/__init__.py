"""Extraction and clean-up of bilingual leaflet text on Spark."""

from foliora.plans.pipeline import extract, read_regions
from foliora.session import build_session

__all__ = ["build_session", "extract", "read_regions"]

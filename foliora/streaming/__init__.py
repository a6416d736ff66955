"""Streams."""

from foliora.streaming.watch import read_jobs, upsert_jobs, watch_regions

__all__ = ["read_jobs", "upsert_jobs", "watch_regions"]

"""Files, reference lists, recognition and tables."""

from foliora.sources.files import load_names, render_pages, scan_files, uploaded
from foliora.sources.recognition import all_available, health, recognise
from foliora.sources.tables import once, table

__all__ = ["all_available", "health", "load_names", "once", "recognise", "render_pages", "scan_files", "table", "uploaded"]

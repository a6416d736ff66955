"""Operators on DataFrames."""

from foliora.operators.document import assemble, export_document, last_jobs, latest_jobs, layout, markdown, page_boxes, response, route, with_matches, write_documents
from foliora.operators.imaging import display_order, merge_images, png, preprocess, searchable_pdf
from foliora.operators.matching import match_all, match_one, match_substring, match_tokens
from foliora.operators.units import common_amounts

__all__ = ["assemble", "common_amounts", "display_order", "export_document", "last_jobs", "latest_jobs", "layout", "markdown", "match_all", "match_one", "match_substring", "match_tokens", "merge_images", "page_boxes", "png", "preprocess", "response", "route", "searchable_pdf", "with_matches", "write_documents"]

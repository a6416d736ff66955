"""Column functions."""

from foliora.functions.text import arabic_units, clean, clean_region, confidence_of, extract_strengths, has_arabic, merge_scripts, normalize_digits, normalize_numerals, normalize_units, script_hint, script_of, tokens

__all__ = ["arabic_units", "clean", "clean_region", "confidence_of", "extract_strengths", "has_arabic", "merge_scripts", "normalize_digits", "normalize_numerals", "normalize_units", "script_hint", "script_of", "tokens"]

"""Subpackage of foliora."""

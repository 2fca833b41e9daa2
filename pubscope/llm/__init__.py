"""Operators for text corpora and names typed by people; nothing outside of this subpackage imports it."""

from pubscope.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

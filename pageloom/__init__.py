"""Structured extraction from pages at scale: schemas of CSS and XPath selectors over DataFrames of pages."""

from pageloom.functions import Plan, check, detect_encoding, extract, extract_column, extract_grouped, node_identity, register, resolve_label, terminals
from pageloom.page import Item, Page, re_first
from pageloom.plans.verdict import FieldReport, GroupReport, SchemaReport, UnsupportedSelector

__all__ = [
    "FieldReport", "GroupReport", "Item", "Page", "Plan", "SchemaReport", "UnsupportedSelector", "check", "detect_encoding",
    "extract", "extract_column", "extract_grouped", "node_identity", "re_first", "register", "resolve_label", "terminals",
]

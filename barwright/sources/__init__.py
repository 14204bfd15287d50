"""Readers with explicit schemas."""
from barwright.sources.files import read_csv_text, read_or_empty, read_table
from barwright.sources.landing import (
    landing_path,
    parse_landing,
    parsed_documents,
    parsed_schema,
    quarantined,
    read_landing,
    read_stock_documents,
    rejected_landings,
)

__all__ = [
    "landing_path",
    "parse_landing",
    "parsed_documents",
    "parsed_schema",
    "quarantined",
    "read_csv_text",
    "read_landing",
    "read_or_empty",
    "read_stock_documents",
    "read_table",
    "rejected_landings",
]

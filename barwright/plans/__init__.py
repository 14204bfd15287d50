"""The batch jobs."""
from barwright.plans.jobs import (
    Layout,
    adjust,
    adjust_changes,
    check_landing,
    curate,
    daily,
    detect,
    detect_changes,
    land,
    load_contacts,
    parse_landed,
    stocks,
)

__all__ = [
    "Layout",
    "adjust",
    "adjust_changes",
    "check_landing",
    "curate",
    "daily",
    "detect",
    "detect_changes",
    "land",
    "load_contacts",
    "parse_landed",
    "stocks",
]

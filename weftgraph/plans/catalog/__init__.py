"""Registered queries and their DuckDB counterparts, grouped by subject."""

from __future__ import annotations

import importlib

SUBJECTS = ("graph", "reports", "linking", "searching", "metering", "extraction", "planning", "storing")


def load() -> tuple[dict, dict]:
    """All queries and all oracle texts by name."""
    runs, texts = {}, {}
    for subject in SUBJECTS:
        book = importlib.import_module(f"weftgraph.plans.catalog.{subject}").BOOK
        clash = runs.keys() & book.runs.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        runs.update(book.runs)
        texts.update(book.texts)
    return runs, texts

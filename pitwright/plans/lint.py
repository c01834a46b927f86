"""Checks of plans: features must not look ahead."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pitwright.functions.checks import PointInTimeError


def looks_ahead(df: DataFrame) -> list[str]:
    """What in the analysed plan reads later rows: lead, lag by a negative number (shown as a positive one), frames that end after the row."""
    plan = df._jdf.queryExecution().analyzed().toString()
    found = re.findall(r"\blead\([^)]*\)|\blag\([^)]*, \d+[^)]*\)", plan)
    found += [f for f in re.findall(r"specifiedwindowframe\([^)]*\)+", plan) if re.search(r", (?:unboundedfollowing\$|[1-9]\d*)\s*\)", f)]
    return found


def require_causal(df: DataFrame) -> DataFrame:
    if found := looks_ahead(df):
        raise PointInTimeError(f"the plan looks ahead: {found[0]}")
    return df

"""Thresholds that turn numbers into labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

INFO, WARNING, CRITICAL = "info", "warning", "critical"


def volatility_label(ratio: Column) -> Column:
    """Label of a p95 / median ratio."""
    return (
        F.when(ratio >= 3.0, "volatile").when(ratio >= 2.0, "spiky").when(ratio >= 1.3, "variable").otherwise("stable")
    )


def rank_severity(rank: Column) -> Column:
    """Severity of a percentile rank."""
    return F.when(rank >= 99.0, CRITICAL).when(rank >= 95.0, WARNING).otherwise(INFO)


def failure_severity(rate: Column) -> Column:
    return F.when(rate >= 0.20, CRITICAL).when(rate >= 0.05, WARNING).otherwise(INFO)


def shift_severity(p_value: Column, pct_change: Column, abs_delta_s: Column) -> Column:
    """Severity of a change point: tiny absolute changes never matter, large significant ones do."""
    size = F.abs(pct_change)
    return (
        F.when(abs_delta_s < 10.0, INFO)
        .when((p_value < 0.01) & (size >= 20.0), CRITICAL)
        .when((p_value < 0.05) & (size >= 10.0), WARNING)
        .otherwise(INFO)
    )


def severity_order(severity: Column) -> Column:
    return F.when(severity == CRITICAL, 2).when(severity == WARNING, 1).otherwise(0)


def severity_of_order(order: Column) -> Column:
    return F.when(order == 2, CRITICAL).when(order == 1, WARNING).otherwise(INFO)


def half_even(value: Column, digits: int = 0) -> Column:
    """Text of a number rounded half to even, as C-style ``%.0f`` and ``%.4f`` print it."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))

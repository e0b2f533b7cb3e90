"""Column functions over job and step names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first group holding a part of the lower-cased step name decides its category.
STEP_WORDS = {
    "test": ["test", "e2e", "integration", "spec", "jest", "pytest"],
    "build": ["compile", "lint", "build", "format"],
    "infra": ["setup", "runner", "checkout", "cache", "install", "docker compose"],
}


def matrix_base(name: Column) -> Column:
    """``test`` of ``test (ubuntu, 20)``; a name without parentheses is its own base."""
    return F.when(name.contains("("), F.trim(F.substring_index(name, "(", 1))).otherwise(name)


def matrix_variant(name: Column) -> Column:
    """``ubuntu, 20`` of ``test (ubuntu, 20)``; ``''`` without parentheses."""
    rest = F.substring(name, F.instr(name, "(") + F.lit(1), F.length(name))
    return F.when(name.contains("("), F.regexp_replace(rest, r"\)$", "")).otherwise(F.lit(""))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, " / ", -1)


def step_category(step: Column) -> Column:
    name = F.lower(step)
    out = F
    for category, words in STEP_WORDS.items():
        out = out.when(name.rlike("|".join(words)), F.lit(category))
    return out.otherwise(F.lit("other"))


def common_prefix(lowest: Column, highest: Column) -> Column:
    """Longest prefix of two names, without trailing blanks, slashes and opening parentheses.

    For the first and last of a sorted set it is the prefix of the whole set.
    """
    shared = F.filter(
        F.sequence(F.length(lowest), F.lit(0)),
        lambda n: highest.startswith(F.substring(lowest, F.lit(1), n)),
    )
    return F.regexp_replace(F.substring(lowest, F.lit(1), F.element_at(shared, 1)), r"[ /(]+$", "")


def stage_label(size: Column, firsts: Column, lowest: Column, highest: Column) -> Column:
    """Readable name of ``size`` jobs starting together, from the first three and the extreme names."""
    prefix = common_prefix(lowest, highest)
    ends = F.transform(firsts, last_segment)
    return (
        F.when(size == 1, F.element_at(firsts, 1))
        .when(F.length(prefix) >= 3, F.format_string("%s (%d variants)", prefix, size))
        .when(size <= 3, F.array_join(ends, ", "))
        .otherwise(F.format_string("%s, +%d more", F.array_join(F.slice(ends, 1, 2), ", "), size - 2))
    )


def stage_name(names: Column) -> Column:
    return stage_label(F.size(names), F.slice(names, 1, 3), F.array_min(names), F.array_max(names))

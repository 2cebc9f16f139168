"""Path arithmetic as Catalyst expressions (paths are root-relative with ``/``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; empty for a path without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def repository(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def join_path(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def normalize_path(path: Column) -> Column:
    """Fold ``.``, ``..`` and doubled slashes; a ``..`` above the root is dropped."""

    def fold(seen: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), seen)
            .when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
            .otherwise(F.concat(seen, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    return F.array_join(parts, "/")


def dotted_depth(spec: Column) -> Column:
    """Number of leading dots of a relative package name."""
    return F.length(F.regexp_extract(spec, r"^(\.*)", 1))


def tail(text: Column, start: int) -> Column:
    """All of a text from a position on, counted from one."""
    return F.substring(text, F.lit(start), F.length(text))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path that start at a segment, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )


def path_ancestors(path: Column) -> Column:
    """All folders above a path, nearest first, ending with the root ``''``."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )

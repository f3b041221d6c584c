"""Paths with ``/`` separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column, mark: str = "/") -> Column:
    """After the last mark; the whole value if it ends with the mark or has none."""
    return F.when(path.endswith(mark), path).otherwise(F.substring_index(path, mark, -1))


def parent(path: Column, mark: str = "/") -> Column:
    """Before the last mark, null if there is none or nothing before it."""
    before = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, mark, -1)) - 1)
    return F.when(path.contains(mark) & (F.length(before) > 0), before)


def prefixes(path: Column, mark: str = "/") -> Column:
    """All proper prefixes that end before a mark, shortest first."""
    parts = F.split(path, f"[{mark}]")
    n = F.size(parts)
    some = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), mark))
    return F.when(n > 1, some).otherwise(F.array().cast("array<string>"))


def module_root(path: Column) -> Column:
    """``src/main/x`` or ``src/test/x`` at the repository's root, else the first segment."""
    parts = F.split(path, "/")
    deep = (F.size(parts) >= 3) & (parts[0] == "src") & parts[1].isin("main", "test")
    return F.when(deep, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(parts[0])


def resolved(source: Column, label: Column) -> Column:
    """A relative label against the folder of a source path, with ``.`` and ``..`` taken; null without a folder."""
    folder = parent(source)
    steps = F.split(F.concat(folder, F.lit("/"), label), "/")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != "..")
        return F.when(part.isin(".", ""), done).when(back, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.when(folder.isNotNull(), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/"))


def has_segment(path: Column, names: list[str]) -> Column:
    """Whether any segment is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)))

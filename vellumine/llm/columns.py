"""Names of helper columns that no table at hand uses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Each name, with underscores before it until nothing in ``taken`` is called so, whatever the case."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame, names: Iterable[str] | None = None) -> list[Column]:
    """Columns by their names, in which points mean nothing."""
    return [col(c) for c in (df.columns if names is None else names)]


def col(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")

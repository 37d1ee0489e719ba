"""Keeping the columns of a caller apart from those that an operator adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def set_aside(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns called as one of ``names`` renamed (case ignored, those in ``keep`` not), and what gives them their names and places back.

    What comes back has the columns of ``df`` only.
    """
    columns = df.columns
    used, renamed = {x.lower() for x in (*columns, *names)}, []
    for name in columns:
        new = name
        if name.lower() in {x.lower() for x in names} and name not in keep:
            while new.lower() in used:
                new = f"own_{new}"
            used.add(new.lower())
        renamed.append(new)
    back = lambda out: out.select(*(f"`{x}`" for x in renamed)).toDF(*columns)
    return (df.toDF(*renamed) if renamed != columns else df), back

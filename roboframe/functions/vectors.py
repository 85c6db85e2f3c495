"""Fields inside wide vectors and maps of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_action_vector(v: Column, ends: dict[str, int]) -> dict[str, Column]:
    """Split a vector into named fields by cumulative ends; ends must grow, a shorter vector raises."""
    last, out = 0, {}
    for name, end in ends.items():
        if end <= last:
            raise ValueError("ends must be strictly increasing")
        short = F.raise_error(F.lit(f"the vector does not reach {name}"))
        out[name] = F.when(F.size(v) >= end, F.slice(v, last + 1, end - last)).otherwise(short)
        last = end
    return out


def concat_action_vector(fields: dict[str, Column], order: list[str]) -> Column:
    missing = [n for n in order if n not in fields]
    if missing:
        raise KeyError(f"missing fields: {missing}")
    return F.concat(*[fields[n] for n in order])


def remap_indices(v: Column, targets: dict[str, list]) -> dict[str, Column]:
    """New fields from positions of a vector: whole numbers, or (start, end, step) ranges, not both in one field."""
    out = {}
    for name, items in targets.items():
        kinds = {isinstance(i, int) for i in items}
        if len(kinds) != 1:
            raise ValueError(f"{name} mixes positions and ranges")
        flat = items if kinds == {True} else [i for r in items for i in range(*r)]
        out[name] = F.transform(F.array(*[F.lit(i) for i in flat]), lambda i: F.element_at(v, i + 1))
    return out

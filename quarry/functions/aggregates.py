"""Aggregate functions of one's own, made of built-in ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """``parts``: built-in aggregates over the ``inputs``, by name; ``finish``: an expression over the parts.

    The planner sees the parts, so groups are combined before the exchange and no group is held in one task's
    memory, as a Python function over whole groups would need.
    """

    inputs: tuple[str, ...]
    parts: dict[str, str]
    finish: str

    def sql(self, *arguments: str) -> str:
        if len(arguments) != len(self.inputs):
            raise ValueError(f"{len(self.inputs)} arguments, not {len(arguments)}")
        fill = lambda text, values: re.sub(r"('(?:[^']|'')*')|\b([A-Za-z_]\w*)\b(?!\s*\()", lambda m: m[1] or (f"({values[m[2]]})" if m[2] in values else m[2]), text)
        given = dict(zip(self.inputs, arguments))
        return fill(self.finish, {n: fill(p, given) for n, p in self.parts.items()})

    def __call__(self, *arguments: str) -> Column:
        return F.expr(self.sql(*arguments))

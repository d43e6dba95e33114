"""WITH RECURSIVE ... UNION: repeat a step until it gives nothing new."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from larkspur.session import cut


PARTS = 16


class TooDeep(RuntimeError):
    """The recursion went past its limit."""


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """Rows of ``seed`` and of ``step`` of what is new, each once, until nothing is new.

    Cycles end, as rows met before are not new (NULLs equal). What a round adds is
    checkpointed reliably, so lineage stays short and a lost executor costs no
    recomputation; a round writes its new rows only. Parts are put together when there
    are more than PARTS of them. Whether there are new rows comes to the driver.
    """
    new = cut(seed.distinct())
    known = [new]
    for _ in range(limit):
        new = cut(step(new).select(*seed.columns).subtract(reduce(DataFrame.unionAll, known)))
        if new.isEmpty():
            return reduce(DataFrame.unionAll, known)
        known.append(new)
        if len(known) > PARTS:
            known = [cut(reduce(DataFrame.unionAll, known))]
    raise TooDeep(f"no end after {limit} rounds")

"""The one loop of the library: grow a set of rows to its fixpoint, new rows only in each round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wardlight.session import by_key, checkpointed

COMPACT_EVERY = 8


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int | None = None,
             on: list[str] | None = None, large: bool = False) -> DataFrame:
    """Least set that holds ``seed`` and is closed under ``step`` (applied to the rows found last).

    Rows are compared on the columns ``on`` (all by default); the other columns must be equal for equal keys within
    one round, as a depth is. Every round is written to the shared checkpoint folder, so lineage stays one
    round long and a lost executor costs a re-read, not a restart. Without ``max_rounds`` the loop runs until nothing
    new appears; with it the rounds beyond are not computed (for depth-limited searches). ``large`` is for seeds whose
    size Spark takes too low (``by_key``).
    """
    cols = seed.columns
    fresh = checkpointed(seed.distinct())
    known = fresh
    rounds = 0
    while (max_rounds is None or rounds < max_rounds) and not fresh.isEmpty():
        rounds += 1
        fresh = checkpointed(step(fresh).select(*cols).distinct().join(by_key(known) if large else known, on or cols, "left_anti"))
        known = known.unionByName(fresh)
        if rounds % COMPACT_EVERY == 0:
            known = checkpointed(known)
    return known

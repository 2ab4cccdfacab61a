"""What a query moves between tasks, read off its plan."""

import re

from __spark_entry__ import queries


def test_steps_of_a_finding_are_not_shuffled(spark):
    df = queries()["taint_trace_build"](spark, "/root/testdata/sf0.001")
    lines = str(df._jdf.queryExecution().executedPlan().toString()).splitlines()
    moved = [i for i, line in enumerate(lines) if re.search(r"\bExchange\b", line)]
    steps = [i for i, line in enumerate(lines) if re.search(r"\bGenerate\b", line)]
    assert len(moved) == 1 and "hashpartitioning(seq" in lines[moved[0]]
    assert steps and max(steps) < moved[0]  # findings are moved, the steps come after

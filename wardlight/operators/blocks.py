"""Control flow from statement lines: blocks, merge points and edges.

Node numbers are ``4 * line`` for the block that starts at a line, ``4 * line + 1`` for the end of the block a header
opens and ``4 * line + 2`` for the merge point behind an if chain, a loop or a try chain. Sequence, branches with and
without else, loops with their back edge and try/except are covered; ``break``, ``continue`` and ``return`` fall
through, which can only add paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.operators.extract import header

LEAD = r"^\}?\s*"
ROLES = [
    ("elif", LEAD + r"(elif\b|else\s+if\b)"), ("else", LEAD + r"else\b"), ("if", LEAD + r"if\b"),
    ("loop", LEAD + r"(async\s+for|for|foreach|while)\b"), ("except", LEAD + r"(except|catch|finally)\b"), ("try", LEAD + r"try\b"),
]
CONTINUES = ["elif", "else", "except"]


def _role(language_text, opens) -> Column:
    """Role of a statement by its text; only lines that open a block are more than plain statements."""
    expr = F.when(header(language_text, 0) != "", "func")
    for name, pattern in ROLES:
        expr = expr.when(opens & language_text.rlike(pattern), name)
    return expr.when(opens, "plain").otherwise("stmt")


def roles(stmts: DataFrame) -> DataFrame:
    """Add ``role`` and ``parent_role``, read off the row's own texts."""
    s = stmts.withColumn("role", _role(F.col("text"), F.col("end_line") > F.col("line")))
    return s.withColumn("parent_role", F.when(F.col("parent") > 0, _role(F.col("parent_text"), F.lit(True))))


def with_roles(stmts: DataFrame) -> DataFrame:
    """Add ``role``, ``parent_role``, next and previous sibling, ``next_child``, block leader and chain start."""
    return linked(roles(stmts))


def linked(s: DataFrame) -> DataFrame:
    """What ``with_roles`` adds from other statements; texts are not needed any more.

    All windows run inside one file and are as large as its statements; one shuffle by file serves them all.
    """
    in_file = W.partitionBy("file").orderBy("line")
    s = s.withColumn("_nl", F.lead("line").over(in_file)).withColumn("_np", F.lead("parent").over(in_file))
    s = s.withColumn("next_child", F.when(F.col("_np") == F.col("line"), F.col("_nl"))).drop("_nl", "_np")
    kids = W.partitionBy("file", "parent").orderBy("line")
    s = (
        s.withColumn("next", F.lead("line").over(kids)).withColumn("next_role", F.lead("role").over(kids))
        .withColumn("prev_role", F.lag("role").over(kids))
    )
    simple = F.col("role").isin("stmt", "func")
    leads = ~simple | F.col("prev_role").isNull() | ~F.col("prev_role").isin("stmt", "func")
    upto = kids.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        s.withColumn("block", F.max(F.when(leads, F.col("line"))).over(upto))
        .withColumn("chain", F.max(F.when(~F.col("role").isin(CONTINUES), F.col("line"))).over(upto))
    )


def block_edges(roled: DataFrame) -> DataFrame:
    """``(file, src, dst, condition)`` over block nodes; every row of ``with_roles`` writes its own edges."""
    return roled.select("file", F.explode(own_edges()).alias("e")).select("file", "e.*").distinct()


def own_edges() -> Column:
    """The edges that a row of ``with_roles`` writes, as an array."""
    node, end, merge = F.col("line") * 4, F.col("line") * 4 + 1, F.col("chain") * 4 + 2
    block = F.col("block") * 4
    child = F.col("next_child") * 4
    simple = F.col("role").isin("stmt", "func")
    more = F.coalesce(F.col("next_role").isin(CONTINUES), F.lit(False))
    inner = F.col("parent_role").isNotNull() & (F.col("parent_role") != "func")
    after = F.when(F.col("next").isNotNull(), F.col("next") * 4).when(inner, F.col("parent") * 4 + 1)

    def edge(when, src, dst, cond=""):
        return F.when(when & dst.isNotNull(), F.struct(src.alias("src"), dst.alias("dst"), F.lit(cond).alias("condition")))

    role = F.col("role")
    last_simple = simple & (F.col("next").isNull() | ~F.coalesce(F.col("next_role").isin("stmt", "func"), F.lit(False)))
    edges = [
        edge(last_simple, block, after),
        edge(~simple, node, F.coalesce(child, end), "true"),
        edge(role == "loop", end, node, "loop_back"),
        edge(~simple & (role != "loop"), end, merge),
        edge(role == "loop", node, merge, "false"),
        edge(role.isin("if", "elif") & more, node, F.col("next") * 4, "false"),
        edge(role.isin("if", "elif") & ~more, node, merge, "false"),
        edge(role.isin("try", "except") & more, node, F.col("next") * 4, "error"),
        edge((role == "try") & more, end, F.col("next") * 4, "error"),
        edge(~simple & ~more, merge, after),
    ]
    return F.filter(F.array(*edges), lambda e: e.isNotNull())

"""Taint over code facts: definitions, uses, block flow, calls between functions.

State is a set of rows. A definition (target at a line) is a node; a variable at the entry of a block is a node. Static
edges lead from a node to the definitions that use it inside the block; block edges carry a variable on while the
block does not define it. The fixpoint over these edges gives the tainted nodes, uses at sinks give the hits.

Chosen semantics: a definition without tainted input is clean (also after a branch on all paths); assigning to an
element or attribute taints the container and does not clean it; a variable directly wrapped by a sanitizer, or passed
behind a placeholder of a parameterised statement, does not flow. Any source of the language or of the file's
framework taints; any sink of the language reports.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.catalog.fixed import PARAMETER_MARKS, PARAMETER_MARKS_LOWER, RECEIVER_NAMES
from wardlight.functions.cols import contains_any, let
from wardlight.functions.walk import READ_COLUMNS, READ_TYPE, reader
from wardlight.operators import blocks, extract
from wardlight.operators.extract import ASSIGN, by_language, header
from wardlight.operators.framework import framework_detect, framework_sources
from wardlight.operators.iterate import fixpoint
from wardlight.operators.patterns import PatternSet
from wardlight.operators.rules_match import sanitizer_exclude, sink_candidates
from wardlight.session import by_key, checkpointed, written

# text of a file up to which one task follows it; larger ones go by joins
FILE_CHARS = 64 * 1024
IDENT = r"[A-Za-z_$][\w$]*"


def identifiers(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENT), F.lit(0)))


def wrapped_identifiers(text, sanitizers) -> Column:
    """Identifiers that are the first argument of a sanitizer call: ``san(name``, ``x.san( name``."""
    pattern = F.lit(r"([\w.$]+)\s*\((?=\s*([\w$]+))")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("c"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))

    def wraps(names):
        return F.filter(pairs, lambda p: let(F.lower(p["c"]), lambda c: F.exists(names, lambda s: F.endswith(c, s))))

    hit = F.when(F.contains(text, F.lit("(")), let(F.transform(sanitizers, lambda s: F.rtrim(s, F.lit("("))), wraps))
    return F.coalesce(F.transform(hit, lambda p: p["v"]), F.array().cast("array<string>"))


def parameterised_identifiers(text) -> Column:
    """Identifiers that a parameterised statement makes safe: a placeholder is present and they stand behind the first comma."""
    marks = contains_any(text, PARAMETER_MARKS) | contains_any(F.lower(text), PARAMETER_MARKS_LOWER)
    return F.when(marks, F.array_except(identifiers(text), identifiers(F.substring_index(text, ",", 1)))).otherwise(F.array().cast("array<string>"))


def safe_identifiers(text, sanitizers) -> Column:
    return F.array_union(wrapped_identifiers(text, sanitizers), parameterised_identifiers(text))


ACCESS = IDENT + r"""(?:\[\s*(?:"[^"\]]*"|'[^'\]]*'|\d+)\s*\]|\.[A-Za-z_$][\w$]*(?![\w$]|\s*\())?"""


def accesses(text) -> Column:
    """Names in a text with the member that is read of them: an array of ``(base, member)``, the member empty for a whole
    value, a computed index or a method call."""
    member = lambda m: F.regexp_extract(m, r"""^[\w$]+(?:\.|\[\s*["']?)(.*?)["']?\s*\]?$""", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, IDENT, 0).alias("base"), member(m).alias("member"))))


def tainted_in_text(texts: DataFrame, tainted: DataFrame, text: str = "text", key: str = "file") -> DataFrame:
    """Rows of ``texts`` with each tainted location that occurs in them: an equality join on the names of the text.

    A location is a ``base`` and, if ``tainted`` has that column, a ``member``. A tainted member is found where it or the
    whole value is used, and a tainted whole value (member empty) wherever its name stands; other members are left alone.
    """
    if "member" not in tainted.columns:
        words = texts.withColumn("base", F.explode(identifiers(F.col(text))))
        return words.join(tainted.select(key, "base").distinct(), [key, "base"])
    used = texts.withColumn("_a", F.explode(accesses(F.col(text)))).withColumns({"base": F.col("_a.base"), "_m": F.col("_a.member")}).drop("_a")
    hit = used.join(tainted.select(key, "base", "member").distinct(), [key, "base"]).filter("member = '' or _m = '' or member = _m")
    return hit.drop("_m").distinct()


class CodeFacts:
    """The facts of a set of code files that the taint operators share.

    Statement rows carry their function, their framework and their place in the control flow, so definitions, calls
    and uses are read off the same rows without joins. They are written once to the shared folder, when first asked for.
    ``patterns`` are those of other facts with the same rules.
    """

    def __init__(self, files: DataFrame, rules: DataFrame, patterns: dict[str, PatternSet] | None = None):
        self.files = files
        self.rules = rules
        if patterns:
            self.patterns = patterns
            return
        cleaners = rules.select("language", "rule_id", F.transform("sanitizers", lambda s: F.rtrim(s, F.lit("("))).alias("sanitizers"))
        self.patterns = {"sources": PatternSet(rules, "sources"), "sinks": PatternSet(rules, "sinks"), "sanitizers": PatternSet(cleaners, "sanitizers")}

    def told(self) -> DataFrame:
        """Statements with the framework of their file, row-local."""
        return extract.statements(framework_detect(self.files.select("file", "language", "content")), keep=("framework",))

    @cached_property
    def stmts(self) -> DataFrame:
        return by_key(written(blocks.with_roles(self.told()).drop("parent_text"), "stmts"))

    @cached_property
    def functions(self) -> DataFrame:
        return extract.extract_functions(self.stmts)

    @cached_property
    def calls(self) -> DataFrame:
        return extract.extract_calls(self.stmts, keep=("func",))

    @cached_property
    def assignments(self) -> DataFrame:
        return extract.extract_assignments(self.stmts, keep=("framework", "func", "func_start", "block"))

    def has_source(self, text, left=None) -> Column:
        """True when a source of the row's language or framework occurs in ``text``, and still in its part ``left`` if given."""
        part = text if left is None else left
        found = self.patterns["sources"].inside(text)
        still = F.size(found) > 0 if left is None else let(
            F.struct(F.lower(left).alias("low"), found.alias("known")), lambda b: F.exists(b["known"], lambda s: F.contains(b["low"], s)))
        return still | let(F.lower(part), lambda low: F.exists(framework_sources(F.col("framework")), lambda s: F.contains(low, F.lower(s))))

    def sanitizers(self, text) -> Column:
        """Sanitizers of the row's language, without their bracket, that occur in ``text``; no other can stand around a name of it."""
        return self.patterns["sanitizers"].inside(text)

    def safe(self, text) -> Column:
        """Names of ``text`` that a sanitizer or a placeholder of the row's language makes safe."""
        return safe_identifiers(text, self.sanitizers(text))

    def definitions(self) -> DataFrame:
        """Assignments with their place in the program: ``(…, func, func_start, block, kind, base, member, weak, from_source)``."""
        loc = extract.taint_location(F.col("target"))
        a = self.assignments.select("file", "line", "language", "framework", "func", "func_start", "block", "target", "value", *[c.alias(k) for k, c in loc.items()])
        return a.withColumn("from_source", self.has_source(F.col("value"))).withColumn("weak", F.col("kind") != "var")

    def sink_calls(self) -> DataFrame:
        """Calls with a candidate sink: ``(file, line, col, full_text, function_name, rule_id)``, written once.

        A sink inside a call stands in the statement as well, so statements without any sink text of their language
        are dropped before their calls are taken apart.
        """
        if not hasattr(self, "_sink_calls"):
            sinks = self.patterns["sinks"]
            stmts = self.stmts.filter(F.size(sinks.inside(F.col("text"))) > 0)
            found = sink_candidates(extract.extract_calls(stmts), self.rules, keep=("file", "line", "col", "full_text"), sinks=sinks)
            self._sink_calls = by_key(checkpointed(found))
        return self._sink_calls

    def sinks(self) -> DataFrame:
        """Statements with a candidate sink: ``(file, line, rule_id)``."""
        return self.sink_calls().select("file", "line", "rule_id").distinct()


def taint_gen_kill(facts: CodeFacts) -> DataFrame:
    """Effects of assignments: ``gen`` from a source, ``kill`` of wrapped names, ``flow`` from a name to the target."""
    d = facts.definitions()
    safe = d.withColumn("_safe", facts.safe(F.col("value")))
    gen = d.filter("from_source").select("file", "line", F.lit("gen").alias("effect"), F.lit("").alias("name"), "kind", "base", "member")
    open_ = safe.filter("not from_source")
    kill = open_.select("file", "line", F.lit("kill").alias("effect"), F.explode(F.array_intersect("_safe", identifiers(F.col("value")))).alias("name"),
                        F.lit("").alias("kind"), F.lit("").alias("base"), F.lit("").alias("member"))
    flow = open_.select("file", "line", F.lit("flow").alias("effect"), F.explode(F.array_except(identifiers(F.col("value")), "_safe")).alias("name"), "kind", "base", "member")
    return gen.unionByName(kill).unionByName(flow)


class DefUse:
    """Nodes and static edges for the fixpoint.

    Only files with both a place where taint starts and a candidate sink can report, so everything else is dropped
    before the edges are built. The edge tables are partitioned once on the columns they are joined by; a round of the
    fixpoint then moves its new rows only. Calls are followed by ``flows``.
    """

    def __init__(self, facts: CodeFacts):
        self.facts = facts
        self.handlers = handler_param_seed(facts)
        d = facts.definitions()
        starts = d.filter("from_source").select("file").unionByName(self.handlers.select("file")).distinct()
        files = by_key(checkpointed(facts.sinks().select("file").distinct().join(starts, "file", "left_semi")))
        d = d.join(files, "file", "left_semi").withColumn("_safe", facts.safe(F.col("value")))
        d = d.withColumn("uses", F.when(F.col("from_source"), F.array().cast("array<string>")).otherwise(F.array_except(identifiers(F.col("value")), "_safe")))
        d = d.withColumn("uses", F.when(F.col("weak"), F.array_union("uses", F.array("base"))).otherwise(F.col("uses")))
        self.defs = by_key(checkpointed(d.select("file", "line", "func", "func_start", (F.col("block") * 4).alias("b"), "base", "from_source", "uses")))
        stmts = by_key(facts.stmts.join(files, "file", "left_semi"))
        # text uses matter at sink statements only
        text = stmts.join(facts.sinks().select("file", "line").distinct(), ["file", "line"], "left_semi").select(
            "file", "line", (F.col("block") * 4).alias("b"), F.array_except(identifiers(F.col("text")), facts.safe(F.col("text"))).alias("uses"))
        # every use finds the last definition before its own line in the same block, or the block entry (0)
        uses = self.defs.select("file", "b", F.explode("uses").alias("base"), "line", F.lit("def").alias("role"), F.col("base").alias("target")).unionByName(
            text.select("file", "b", F.explode("uses").alias("base"), "line", F.lit("text").alias("role"), F.lit("").alias("target")))
        points = uses.select("file", "b", "base", "line", "role", "target", F.lit(None).cast("bigint").alias("_d"), F.lit(0).alias("_o")).unionByName(
            self.defs.select("file", "b", "base", "line", F.lit("point").alias("role"), F.lit("").alias("target"), F.col("line").alias("_d"), F.lit(1).alias("_o")))
        before = W.partitionBy("file", "b", "base").orderBy("line", "_o").rowsBetween(W.unboundedPreceding, -1)
        resolved = by_key(checkpointed(points.withColumn("from", F.coalesce(F.max("_d").over(before), F.lit(0))).filter("role <> 'point'")))
        node = ["file", "b", "base", "line"]
        self.flow = by_key(checkpointed(resolved.filter("role = 'def'").select(
            "file", "b", "base", F.col("from").alias("line"), F.col("line").alias("_l"), F.col("target").alias("_v")), by=node))
        self.text_uses = resolved.filter("role = 'text'").select("file", "b", "base", F.col("from").alias("line"), F.col("line").alias("sink_line"))
        self.exits = by_key(checkpointed(self.defs.groupBy("file", "b", "base").agg(F.max("line").alias("_last")), by=node[:3]))
        self.block_edges = by_key(checkpointed(blocks.block_edges(stmts).select("file", F.col("src").alias("b"), F.col("dst").alias("_t")), by=node[:2]))
        # first block of every function body
        self.entries = stmts.filter(F.col("parent") == F.col("func_start")).groupBy("file", F.col("func_start").alias("start_line")).agg((F.min("block") * 4).alias("b"))

    def source_nodes(self) -> DataFrame:
        """Definitions from a source: state rows ``(file, b, base, line)``; ``line`` 0 means the entry of block ``b``."""
        return self.defs.filter("from_source").select("file", "b", "base", "line")

    def param_nodes(self, params: DataFrame) -> DataFrame:
        """Entry state for ``(…, file, start_line, base)``: the parameter at the first block of the function body."""
        return params.join(self.entries, ["file", "start_line"]).withColumn("line", F.lit(0).cast("bigint"))

    def step(self, tag: list[str]):
        """One round over the state ``(tag…, file, b, base, line)``."""

        def run(front: DataFrame) -> DataFrame:
            inside = front.join(self.flow, ["file", "b", "base", "line"]).select(*tag, "file", "b", F.col("_v").alias("base"), F.col("_l").alias("line"))
            leaving = front.join(self.exits, ["file", "b", "base"], "left").filter(F.coalesce("_last", F.lit(0)) == F.col("line"))
            moved = leaving.join(self.block_edges, ["file", "b"]).select(*tag, "file", F.col("_t").alias("b"), "base", F.lit(0).cast("bigint").alias("line"))
            return inside.unionByName(moved)

        return run

    def reach(self, seed: DataFrame, tag: list[str] | None = None) -> DataFrame:
        tag = tag or []
        return fixpoint(seed.select(*tag, "file", "b", "base", "line"), self.step(tag), large=True)

    def sink_hits(self, state: DataFrame, tag: list[str] | None = None) -> DataFrame:
        """Tainted names in statements that hold a sink: ``(tag…, file, rule_id, sink_line, var)``."""
        tag = tag or []
        at = state.join(self.text_uses, ["file", "b", "base", "line"]).select(*tag, "file", "sink_line", F.col("base").alias("var"))
        return at.join(self.facts.sinks().withColumnRenamed("line", "sink_line"), ["file", "sink_line"]).select(*tag, "file", "rule_id", "sink_line", "var").distinct()


def handler_param_seed(facts: CodeFacts) -> DataFrame:
    """Parameters of route handlers: ``(file, start_line, base)``; decorators are statement lines of their own."""
    flagged = extract.route_handler_flag(facts.functions, facts.stmts.select("file", "line", "text"))
    p = flagged.filter("is_handler").select("file", "start_line", F.explode("params").alias("base"))
    return p.filter(~F.col("base").isin(RECEIVER_NAMES))


def taint_fixpoint(facts: CodeFacts, du: DefUse | None = None) -> DataFrame:
    """Source-to-sink hits inside functions and at module level: ``(file, func, rule_id, sink_line, var, origin_line, sink_text)``.

    No step leaves its file, so the statements of a file are laid together once and followed there; files with more than
    ``FILE_CHARS`` of text, and all of a given ``du``, go by joins that move new rows only, with the same result.
    """
    if du:
        return by_rounds(facts, du)
    size = F.length("content")
    if (facts.files.agg(F.max(size)).first()[0] or 0) <= FILE_CHARS:
        return in_files(facts)
    part = lambda large: CodeFacts(facts.files.filter((size > FILE_CHARS) == large), facts.rules, facts.patterns)
    few = part(True)
    return in_files(part(False)).unionByName(by_rounds(few, DefUse(few)))


def in_files(facts: CodeFacts) -> DataFrame:
    """``taint_fixpoint`` with one shuffle of the statements.

    What a statement defines, uses and may hand to a sink comes out of its own row before the shuffle, its edges behind
    it. Calls are taken apart and meet the rules only where a tainted name was read beside a sink text.
    """
    none = F.array().cast("array<string>")
    calls = F.when(F.contains("text", F.lit("(")), F.col("text"))
    s = blocks.roles(facts.told()).withColumn("_a", F.when(F.contains("text", F.lit("=")), F.filter(extract.assigned(F.col("text")), lambda a: a["target"] != "")))
    value = F.when(F.size("_a") > 0, let(F.get("_a", F.lit(0)), lambda a: extract.assigned_value(a["target"], a["op"], a["rhs"])))
    where = F.transform("_a", lambda a: F.struct(*[c.alias(k) for k, c in extract.taint_location(a["target"]).items()]))
    s = s.withColumns({"value": value, "_a": where, "_sinks": facts.patterns["sinks"].inside(calls), "_cleaners": facts.sanitizers(calls)})
    s = s.withColumn("fresh", F.coalesce(facts.has_source(F.col("value")), F.lit(False)))
    unsafe = lambda text: F.array_except(identifiers(text), safe_identifiers(text, F.col("_cleaners")))
    sink = F.size("_sinks") > 0
    own = F.filter(extract.param_names(F.col("language"), header(F.col("text"), 2)), lambda p: ~p.isin(RECEIVER_NAMES))
    s = s.select(
        "file", "language", "line", "parent", "func", "func_start", "role", "parent_role", F.when(sink, F.col("text")).alias("text"),
        F.transform("_a", lambda a: a["base"]).alias("bases"), F.transform("_a", lambda a: a["kind"] != "var").alias("weak"), "fresh",
        F.when(F.col("value").isNull() | F.col("fresh"), none).otherwise(unsafe(F.col("value"))).alias("uses"), F.when(sink, unsafe(F.col("text"))).alias("reads"),
        extract.route_mark(F.col("text")).alias("route"), F.when(F.col("role") == "func", own).alias("params"))
    s = blocks.linked(s.repartition("file")).withColumn("_e", blocks.own_edges())
    end = lambda side: F.transform("_e", lambda e: e[side]).alias(side)
    says = (F.size("_e") > 0) | (F.size("bases") > 0) | (F.size("reads") > 0) | F.col("route") | (F.size("params") > 0)
    first = (F.col("parent") == F.col("func_start")) & F.col("prev_role").isNull()  # its block is where a function begins
    s = s.filter("file is not null").filter(says | first).withColumn("block", F.col("block") * 4).select(*READ_COLUMNS[:-2], end("src"), end("dst"))
    hits = s.sortWithinPartitions("file").mapInArrow(reader(), READ_TYPE)
    keep = ("file", "func", "line", "text", "found")
    found = sink_candidates(extract.extract_calls(hits, keep=keep[1:2] + keep[3:]), facts.rules, keep=keep, sinks=facts.patterns["sinks"]).drop("function_name").distinct()
    return found.withColumn("found", F.explode("found")).select(
        "file", "func", "rule_id", F.col("line").alias("sink_line"), "found.var", "found.origin_line", F.col("text").alias("sink_text"))


def by_rounds(facts: CodeFacts, du: DefUse) -> DataFrame:
    """``taint_fixpoint`` by joins: every round moves its new rows."""
    seed = du.source_nodes().unionByName(du.param_nodes(du.handlers).select("file", "b", "base", "line"))
    state = du.reach(seed)
    hits = du.sink_hits(state)
    place = facts.stmts.select("file", F.col("line").alias("sink_line"), "func", "func_start", F.col("text").alias("sink_text"))
    located = hits.join(place, ["file", "sink_line"])
    # where the name was tainted first inside the function; the header line for a parameter
    tainted_defs = state.filter("line > 0").join(du.defs.select("file", "line", F.col("base"), "func_start"), ["file", "line", "base"])
    origin = tainted_defs.groupBy("file", "func_start", F.col("base").alias("var")).agg(F.min("line").alias("_o"))
    return located.join(origin, ["file", "func_start", "var"], "left").select(
        "file", "func", "rule_id", "sink_line", "var", F.coalesce("_o", "func_start").alias("origin_line"), "sink_text")


def taint_sinks(facts: CodeFacts, tainted: DataFrame) -> DataFrame:
    """Statements with a sink and a tainted, unsanitized name, whatever the path: ``tainted`` is ``(file, base)``."""
    t = facts.stmts.filter(F.contains("text", F.lit("("))).select("file", "line", "text", F.explode(F.array_except(identifiers(F.col("text")), facts.safe(F.col("text")))).alias("base"))
    hit = t.join(tainted.select("file", "base").distinct(), ["file", "base"])
    return hit.join(facts.sinks(), ["file", "line"]).select("file", "line", "rule_id", F.col("base").alias("var"), F.col("text").alias("sink_text"))


# ---------------------------------------------------------------------------- calls between functions
def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """``(file, caller, callee, line, col, args, full_text)`` for calls (with their ``func``) of functions defined in the same file."""
    placed = calls.withColumn("callee", F.trim(F.element_at(F.split("function_name", r"\.|->|::"), -1)))
    known = functions.select("file", F.col("name").alias("callee")).distinct()
    return placed.join(known, ["file", "callee"]).select("file", F.col("func").alias("caller"), "callee", "line", "col", "args", "full_text")


def callers_callees(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Per function: number of call sites, distinct callers and callees, and whether nobody in the file calls it.

    An edge counts for both of its ends in one grouping, so edges and functions are read once.
    """
    role = lambda n, c: (F.lit(n).alias("_r"), c.cast("string").alias("_o"))
    known = functions.select("file", "name", *role(0, F.lit(None)))
    both = F.array(F.struct(F.col("callee").alias("name"), *role(1, F.col("caller"))), F.struct(F.col("caller").alias("name"), *role(2, F.col("callee"))))
    rows = known.unionByName(edges.select("file", F.explode(both).alias("e")).select("file", "e.*"))
    names = lambda r: F.array_join(F.array_sort(F.collect_set(F.when(F.col("_r") == r, F.col("_o")))), ",")
    found = rows.groupBy("file", "name").agg(
        F.min("_r").alias("_f"), F.count_if(F.col("_r") == 1).alias("n_sites"), names(1).alias("callers"), names(2).alias("callees"))
    return found.filter("_f = 0").select("file", "name", "n_sites", "callers", "callees", (F.col("n_sites") == 0).alias("uncalled"))


def positional(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Arguments beside parameters: ``(file, caller, callee, line, pos, arg, param)``, receivers not counted."""
    names = F.filter("params", lambda p: ~p.isin(RECEIVER_NAMES))
    p = functions.select("file", F.col("name").alias("callee"), F.posexplode(names).alias("pos", "param"))
    a = edges.select("file", "caller", "callee", "line", F.posexplode("args").alias("pos", "arg"))
    return a.join(p, ["file", "callee", "pos"])


def param_seed(edges: DataFrame, functions: DataFrame, tainted: DataFrame) -> DataFrame:
    """Parameters that receive a tainted name: ``(file, callee, line, param, via)``; ``tainted`` is ``(file, base)``."""
    hit = tainted_in_text(positional(edges, functions), tainted, "arg")
    return hit.groupBy("file", "callee", "line", "param").agg(F.min("base").alias("via"))


def module_taint(facts: CodeFacts) -> DataFrame:
    """Module-level variables assigned from a source: ``(file, base, line)``."""
    d = facts.definitions().filter("func_start = 0 and from_source")
    return d.groupBy("file", "base").agg(F.min("line").alias("line"))


# ---------------------------------------------------------------------------- flow-insensitive line order
def function_returns_taint(facts: CodeFacts) -> DataFrame:
    """Functions with a source in a return or an assignment of their span: ``(file, name)``.

    A statement counts for its innermost function and for the ones around it, which are the parents of its function.
    """
    value = F.coalesce(F.nullif(by_language(ASSIGN, F.col("text"), 3), F.lit("")), F.nullif(F.regexp_extract("text", extract.RETURN, 1), F.lit("")))
    s = facts.stmts.withColumn("_v", value).filter("_v is not null")
    hit = s.filter(facts.has_source(F.col("_v"))).filter("func_start > 0").select("file", F.col("func_start").alias("start_line"))
    heads = by_key(checkpointed(facts.stmts.filter(header(F.col("text"), 0) != "").select("file", F.col("line").alias("start_line"), "func_start")))
    # from a function to the one around it, one nesting level per round
    around = lambda f: f.join(heads, ["file", "start_line"]).filter("func_start > 0").select("file", F.col("func_start").alias("start_line"))
    return fixpoint(hit, around, large=True).join(facts.functions.select("file", "start_line", "name"), ["file", "start_line"]).select("file", "name").distinct()


def line_taint_flow(facts: CodeFacts) -> DataFrame:
    """Line-order propagation over file-wide names, parameters seeded, returns of tainting functions followed.

    State is the first line from which a name is tainted; a round keeps the least line per name, so a name of a hot
    file is one row. Hits: ``(file, rule_id, function_name, line, var)``.
    """
    d = facts.definitions().select("file", "line", "base", "value", "from_source")
    returns = function_returns_taint(facts)
    words = d.select("file", "line", "base", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("name"))
    by_return = words.join(returns, ["file", "name"]).select("file", "base", F.col("line").alias("since"))
    params = facts.functions.select("file", F.explode("params").alias("base"), F.lit(0).cast("bigint").alias("since")).filter(~F.col("base").isin(RECEIVER_NAMES))
    seed = d.filter("from_source").select("file", "base", F.col("line").alias("since")).unionByName(by_return).unionByName(params)
    uses = by_key(checkpointed(d.select("file", "line", F.col("base").alias("_t"), F.explode(identifiers(F.col("value"))).alias("base"))))
    state = checkpointed(seed.groupBy("file", "base").agg(F.min("since").alias("since")))
    front = state
    while not front.isEmpty():
        found = front.join(uses, ["file", "base"]).filter(F.col("line") > F.col("since")).groupBy("file", F.col("_t").alias("base")).agg(F.min("line").alias("since"))
        old = by_key(state.withColumnRenamed("since", "_old"))
        front = checkpointed(found.join(old, ["file", "base"], "left").filter(F.col("_old").isNull() | (F.col("since") < F.col("_old"))).select("file", "base", "since"))
        state = checkpointed(state.unionByName(front).groupBy("file", "base").agg(F.min("since").alias("since")))
    open_ = sanitizer_exclude(facts.sink_calls(), facts.rules)
    named = open_.withColumn("base", F.explode(identifiers(F.col("full_text")))).join(by_key(state), ["file", "base"]).filter(F.col("since") <= F.col("line"))
    return named.groupBy("file", "rule_id", "function_name", "line").agg(F.min("base").alias("var"))


def alias_propagation(facts: CodeFacts) -> DataFrame:
    """Names a source value can reach through assignments, order ignored: ``(file, base)``."""
    d = facts.definitions()
    edges = by_key(checkpointed(d.select("file", F.col("base").alias("_t"), F.explode(identifiers(F.col("value"))).alias("base")).distinct()))
    seed = d.filter("from_source").select("file", "base")
    return fixpoint(seed, lambda f: f.join(edges, ["file", "base"]).select("file", F.col("_t").alias("base")), large=True)


# ---------------------------------------------------------------------------- SSA names
def ssa_rewrite(facts: CodeFacts) -> DataFrame:
    """Assignments with versioned names, the right side read before the target gets its new version.

    ``(file, line, target, value)``; a name never assigned before keeps its plain form.
    """
    from wardlight.operators.ordered import last_before, running_number

    a = facts.assignments.select("file", "line", "target", "value")
    numbered = running_number(a, ["file", "target"], "line", "version")
    versions = numbered.select("file", F.col("target").alias("name"), "line", F.col("version").alias("_v"))
    tok = a.select("file", "line", "target", F.posexplode(F.regexp_extract_all("value", F.lit(IDENT + r"|[^A-Za-z_$]+"), F.lit(0))).alias("pos", "name"))
    # the reference number of a name before this line: versions grow with the lines
    points = tok.select("file", "name", "line").distinct().withColumn("_v", F.lit(None).cast("bigint")).unionByName(versions).groupBy("file", "name", "line").agg(F.max("_v").alias("_v"))
    seen = last_before(points, ["file", "name"], "line", F.col("_v"), "_before").select("file", "name", "line", "_before")
    text = tok.join(seen, ["file", "name", "line"], "left").withColumn("t", F.when(F.col("_before").isNotNull(), F.concat("name", F.lit("_"), F.col("_before").cast("string"))).otherwise(F.col("name")))
    rhs = text.groupBy("file", "line", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("r"))
    return rhs.join(numbered.select("file", "line", "version"), ["file", "line"]).select(
        "file", "line", F.concat("target", F.lit("_"), F.col("version").cast("string")).alias("target"), F.array_join(F.col("r.t"), "").alias("value"))

"""Many rule patterns in many texts.

``PatternSet`` finds all patterns of a rule set in a text in one pass over it, so the time does not depend on the number
of rules: the patterns are sent to the workers once, as one Arrow table, and every worker builds an automaton a language.
The rows stay where they are. The table is broadcast only if its size, which Spark sums up first, is within
``AUTOMATON_BYTES``; a larger rule set meets the texts in an equality join on the rarest gram of each pattern.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.cols import explode_once, let

AUTOMATON_BYTES = 4 * 1024 * 1024
GRAM = 4
KEPT_SETS = 8
_built: dict[str, tuple[dict, dict, pa.Array]] = {}


def patterns_of(rules: DataFrame, kind: str) -> DataFrame:
    """``(language, rule_id, pattern)`` of one kind of a rule set, in lower case; null patterns are left out."""
    rows = explode_once(rules, ["language", "rule_id"], F.filter(kind, lambda p: p.isNotNull()), "pattern")
    return rows.select("language", "rule_id", F.lower("pattern").alias("pattern")).filter("language is not null").distinct()


def _automata(key: str, table: pa.Table) -> tuple[dict, dict, pa.Array]:
    """Per language an automaton whose values are places in ``words``, and the place of its empty pattern, if any."""
    import ahocorasick

    if key not in _built:
        if len(_built) >= KEPT_SETS:
            _built.clear()
        machines, empty = {}, {}
        for i, (language, word) in enumerate(zip(table["language"].to_pylist(), table["pattern"].to_pylist())):
            if word:
                machines.setdefault(language, ahocorasick.Automaton()).add_word(word, i)
            else:
                empty[language] = i
        for machine in machines.values():
            machine.make_automaton()
        _built[key] = machines, empty, table["pattern"].combine_chunks()
    return _built[key]


def _find(key: str, table: pa.Table, languages: pa.Array, texts: pa.Array) -> pa.Array:
    machines, empty, words = _automata(key, table)
    ends, take = [0], []
    for language, text in zip(languages.to_pylist(), texts.to_pylist()):
        if text is not None:
            found = {i for _, i in machines[language].iter(text)} if language in machines else set()
            if language in empty:
                found.add(empty[language])
            take.extend(sorted(found))
        ends.append(len(take))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(take, pa.int64())))


class PatternSet:
    """The distinct patterns of one kind; a pattern matches rows of its own language (column ``language``).

    Matching is by substring in lower case. A null text holds nothing, an empty pattern lies in every other text, and a
    language without rules has no matches.
    """

    def __init__(self, rules: DataFrame, kind: str):
        self.rows = patterns_of(rules, kind)
        self.each = self.rows.select("language", "pattern").distinct()
        octets = self.rows.groupBy("language", "pattern").agg((F.octet_length("pattern") + F.octet_length("language")).alias("n"), F.sum(F.octet_length("rule_id")).alias("ids"))
        size, ids = octets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") + F.col("ids")), F.lit(0))).first()
        self.fits = size <= AUTOMATON_BYTES
        # many hits share few patterns: a shuffle by pattern would send them to as few tasks
        self.looked_up = F.broadcast(self.rows) if self.fits and ids <= 4 * AUTOMATON_BYTES else self.rows
        if self.fits:
            self.key = uuid.uuid4().hex
            self.table = rules.sparkSession.sparkContext.broadcast(self.each.orderBy("language", "pattern").toArrow())

    def inside(self, text, language="language") -> Column:
        """Array of the patterns that occur in ``text``, for the row's language; needs a set within ``AUTOMATON_BYTES``."""
        if not self.fits:
            raise ValueError(f"more than {AUTOMATON_BYTES} bytes of patterns: use contained() or matches(), which join")
        key, table = self.key, self.table

        @F.arrow_udf("array<string>")
        def find(language: pa.Array, low: pa.Array) -> pa.Array:
            return _find(key, table.value, language, low)

        return find(language, F.lower(text))

    def contained(self, df: DataFrame, text) -> DataFrame:
        """``df`` with one row per pattern in ``text`` (column ``pattern``); row-local within the size, else a join."""
        if self.fits:
            return explode_once(df, df.columns, self.inside(text), "pattern")
        return self._by_gram(df, text)

    def matches(self, df: DataFrame, text) -> DataFrame:
        """``df`` with one row per rule and pattern in ``text`` (columns ``rule_id``, ``pattern``)."""
        return self.contained(df, text).join(self.looked_up, ["language", "pattern"]).select(*df.columns, "rule_id", "pattern")

    def _by_gram(self, df: DataFrame, text) -> DataFrame:
        """Every pattern waits under one of its grams, the one that the fewest patterns share; short ones are their own gram."""
        grams = explode_once(self.each, ["language", "pattern"], F.array_distinct(_grams(F.col("pattern"), F.least(F.length("pattern"), F.lit(GRAM)))), "_gram")
        often = grams.groupBy("language", "_gram").agg(F.count("*").alias("n"))
        anchors = grams.join(often, ["language", "_gram"]).groupBy("language", "pattern").agg(F.min(F.struct("n", "_gram")).getField("_gram").alias("_gram"))
        sizes = [r.n for r in self.each.select(F.least(F.length("pattern"), F.lit(GRAM)).alias("n")).distinct().collect()]
        low = df.withColumn("_low", F.lower(text))
        own = F.array_distinct(F.concat(*[_grams(F.col("_low"), F.lit(n)) for n in sorted(sizes)])) if sizes else F.array().cast("array<string>")
        return explode_once(low, low.columns, own, "_gram").join(anchors, ["language", "_gram"]).filter(F.contains("_low", F.col("pattern"))).select(*df.columns, "pattern")


def _grams(text, n) -> Column:
    """All runs of ``n`` characters of a text (the empty one for 0), from one split of it."""
    runs = lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    some = let(chars, lambda c: F.when(F.size(c) >= n, runs(c)).otherwise(F.array().cast("array<string>")))
    return F.when(n == 0, F.array(F.lit(""))).otherwise(some)

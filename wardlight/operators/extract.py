"""Facts of code files: assignments, calls, functions, returns, strings.

The work is lexical: per-language regular expressions on statements, evaluated row by row without a shuffle. A statement
may span several lines. Targets in Python unpacking (``a, b = f()``) each take the whole value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.catalog.fixed import ROUTE_WORDS
from wardlight.functions.code import calls_udf, outline_udf
from wardlight.functions.cols import contains_any, explode_once

_TARGET = r"[A-Za-z_$][\w.$]*(?:\[[^\]=]*\])?"
_OP = r"([-+*/%|&.]?)"
ASSIGN = {
    "python": rf"^\s*({_TARGET})\s*(?::\s*[A-Za-z_][\w\[\], .]*)?\s*{_OP}=\s*([^=\s].*?)\s*$",
    "javascript": rf"^\s*(?:export\s+)?(?:(?:let|const|var)\s+)?({_TARGET})\s*{_OP}=\s*([^=\s>].*?);?\s*$",
    "go": rf"^\s*(?:var\s+)?({_TARGET})(?:\s*,\s*[A-Za-z_]\w*)*(?:\s+[A-Za-z_*\[\].]+)?\s*(:|[-+*/%|&]?)=\s*([^=\s].*?)\s*$",
    "php": rf"^\s*(\$\w+(?:->\w+)*(?:\[[^\]=]*\])?)\s*{_OP}=\s*([^=\s>].*?);?\s*$",
    "typed": rf"^\s*(?:[A-Za-z_][\w<>\[\],.:]*[\s*&]+)*\*?({_TARGET})\s*{_OP}=\s*([^=\s].*?);?\s*$",
}
HEADER = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\((.*?)\)\s*(?:->.*)?:",
    "javascript": r"(?:^|[^\w$])function\s*(\w*)\s*\(([^)]*)\)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)",
    "php": r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)\s*\(([^)]*)\)",
    "typed": r"^\s*(?:(?:public|private|protected|static|final|async|override|virtual)\s+)*(?!(?:return|new|else|throw|await|yield|case|if|for|while|switch|catch|using|lock)\b)"
             r"[\w<>\[\],.?]+\s+(\w+)\s*\(([^)]*)\)(?:\s*throws\s[\w.,\s]+)?\s*\{?\s*$",
    "c": r"^[A-Za-z_][\w\s*&:<>]*?[\s*&](?:[A-Za-z_]\w*::)*([A-Za-z_]\w*)\s*\(([^;{]*)\)\s*(?:const\s*)?\{?\s*$",
}
TYPED = ["java", "csharp", "c", "cpp"]
# arrow functions with a body, rewritten to plain headers before they are looked at
ARROW = r"(?:(?:const|let|var)\s+)?(?:(?:[\w$]+\.)*([A-Za-z_$][\w$]*)\s*[=:]\s*)?(?:async\s+)?(?:\(([^()]*)\)|([A-Za-z_$][\w$]*))\s*=>(?=\s*\{\s*$)"
UNPACKED = r"^\s*\(?\s*(\*?[A-Za-z_][\w.]*(?:\s*,\s*\*?[A-Za-z_][\w.]*)+)\s*,?\s*\)?\s*=\s*([^=].*?)\s*$"
INDENTED = ["python"]
STRING = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`"""
RETURN = r"^\s*return\s+(.+?)\s*$"
ANONYMOUS = "<anonymous>"
MODULE = "<module>"


def by_language(table: dict[str, str], text, group: int) -> Column:
    """Group of the language's own expression; one of them runs per row."""
    expr = None
    for lang, pattern in table.items():
        if lang == "typed":
            langs = [x for x in TYPED if x not in table and (x != "cpp" or "c" not in table)]
        else:
            langs = ["c", "cpp"] if lang == "c" else [lang]
        test = F.col("language").isin(langs)
        value = F.regexp_extract(text, pattern, group)
        expr = F.when(test, value) if expr is None else expr.when(test, value)
    return expr.otherwise(F.lit(""))


def header(text, group: int) -> Column:
    """Group of the function header in a statement, empty where there is none; arrow functions with a body count."""
    plain = F.when((F.col("language") == "javascript") & F.contains(text, F.lit("=>")), F.regexp_replace(text, ARROW, "function $1($2$3)")).otherwise(text)
    return by_language(HEADER, plain, group)


def statements(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(file, language, keep…, line, depth, parent, end_line, text, parent_text, func, func_start)`` per statement line.

    ``func`` is the innermost function around the line (``<module>`` outside of any), found among the headers above it.
    Everything comes out of the file's own row; there is no shuffle.
    """
    heads = {lang: HEADER["c"] if lang in ("c", "cpp") else HEADER.get(lang, HEADER["typed"]) for lang in [*HEADER, *TYPED] if lang != "typed"}
    rows = outline_udf(heads, (ARROW, r"function \1(\2\3)"), ANONYMOUS, MODULE)(F.col("content"), ~F.col("language").isin(INDENTED), F.col("language"))
    return files.select("file", "language", *keep, F.explode(rows).alias("s")).select(
        "file", "language", *keep, "s.line", "s.depth", "s.parent", "s.end_line", "s.text", "s.parent_text", "s.func", "s.func_start")


def extract_assignments(stmts: DataFrame, subscripts: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(file, language, keep…, line, target, op, value)``; ``t += v`` has the value ``t + v``.

    With ``subscripts=False`` only names and attributes count as targets, as for Python syntax trees.
    """
    s = stmts.filter(F.contains("text", F.lit("=")))
    s = s.select("file", "language", *keep, "line", F.explode(assigned(F.col("text"))).alias("a"))
    s = s.select("file", "language", *keep, "line", "a.*").filter("target <> ''")
    if not subscripts:
        s = s.filter(~F.contains("target", F.lit("[")))
    return s.select("file", "language", *keep, "line", "target", "op", assigned_value(F.col("target"), F.col("op"), F.col("rhs")).alias("value"))


def assigned(text) -> Column:
    """Assignments of a statement with ``=``: an array of ``(target, op, rhs)``, the target empty where there is none. Only
    Python unpacking gives several, which all have the same right side and no operator."""
    several = F.when(F.col("language") == "python", F.regexp_extract(text, UNPACKED, 1)).otherwise("")
    names = F.transform(F.split(several, r"\s*,\s*"), lambda t: F.regexp_replace(t, r"^\*", ""))
    one = F.array(F.struct(by_language(ASSIGN, text, 1).alias("target"), by_language(ASSIGN, text, 2).alias("op"), by_language(ASSIGN, text, 3).alias("rhs")))
    each = F.transform(names, lambda t: F.struct(t.alias("target"), F.lit("").alias("op"), F.regexp_extract(text, UNPACKED, 2).alias("rhs")))
    return F.when(several != "", each).otherwise(one)


def assigned_value(target, op, rhs) -> Column:
    return F.when(op.isin("", ":"), rhs).otherwise(F.concat_ws(" ", target, op, rhs))


def extract_calls(stmts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(file, language, keep…, line, col, function_name, full_text, args)``, nested calls included, headers left out."""
    s = stmts.filter(F.contains("text", F.lit("("))).withColumn("_h", header(F.col("text"), 1))
    c = s.select("file", "language", *keep, "line", "_h", F.explode(calls_udf()(F.col("text"))).alias("c"))
    return c.filter((F.col("_h") == "") | (F.col("c.name") != F.col("_h"))).select(
        "file", "language", *keep, "line", "c.col", F.col("c.name").alias("function_name"), "c.full_text", "c.args"
    )


def split_args(df: DataFrame, text: str = "text") -> DataFrame:
    """Top-level arguments of the first call in ``text``.

    The first call is exploded, not taken by index, so that a filter on ``args`` does not take the text apart again.
    """
    first = df.select("*", F.explode_outer(F.slice(calls_udf()(F.col(text)), 1, 1)).alias("_c"))
    return first.withColumn("args", F.col("_c.args")).drop("_c")


def param_names(language, params) -> Column:
    """Parameter names of a header: defaults, annotations, types and stars removed."""
    parts = F.transform(F.split(params, ","), lambda p: F.trim(F.regexp_replace(p, r"\s*=.*$", "")))
    name = lambda p: (
        F.when(language.isin("python", "javascript"), F.regexp_replace(F.regexp_replace(p, r"\s*:.*$", ""), r"^[*.\s]+", ""))
        .when(language == "go", F.regexp_extract(p, r"^(\w+)", 1))
        .otherwise(F.regexp_extract(p, r"([$\w]+)(?:\[\])?$", 1))
    )
    return F.filter(F.transform(parts, name), lambda p: p != "")


def extract_functions(stmts: DataFrame) -> DataFrame:
    """``(file, language, name, params, start_line, end_line)``."""
    s = stmts.select(
        "file", "language", "line", "end_line", header(F.col("text"), 0).alias("_all"),
        header(F.col("text"), 1).alias("_n"), header(F.col("text"), 2).alias("_p"),
    ).filter("_all <> ''")
    return s.select(
        "file", "language", F.when(F.col("_n") == "", ANONYMOUS).otherwise(F.col("_n")).alias("name"),
        param_names(F.col("language"), F.col("_p")).alias("params"), F.col("line").alias("start_line"), "end_line",
    )


def extract_returns(stmts: DataFrame, languages: tuple[str, ...] = ("python",)) -> DataFrame:
    s = stmts.filter(F.col("language").isin(list(languages)))
    return s.select("file", "line", F.regexp_extract("text", RETURN, 1).alias("value")).filter("value <> ''")


def extract_strings(lines: DataFrame, keep: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """String literals with their quotes."""
    quoted = lines.filter(F.col("text").rlike("[\"'`]"))
    return explode_once(quoted, list(keep), F.regexp_extract_all("text", F.lit(STRING), F.lit(0)), "literal")


def taint_location(text) -> dict[str, Column]:
    """Kind, base and member of a target: ``a[k]`` index, ``a.b`` field, anything else a variable."""
    t = F.trim(text)
    index = F.contains(t, F.lit("[")) & F.endswith(t, F.lit("]"))
    field = F.contains(t, F.lit(".")) & ~F.startswith(t, F.lit('"'))
    inner = F.regexp_extract(t, r"^[^\[]*\[(.*)\]$", 1)
    return {
        "kind": F.when(index, "index").when(field, "field").otherwise("var"),
        "base": F.when(index, F.substring_index(t, "[", 1)).when(field, F.trim(F.substring_index(t, ".", 1))).otherwise(t),
        "member": F.when(index, F.regexp_replace(F.regexp_replace(inner, "^['\"]+", ""), "['\"]+$", ""))
        .when(field, F.trim(F.regexp_replace(t, r"^[^.]*\.", ""))).otherwise(F.lit("")),
    }


def route_mark(text) -> Column:
    """True for a decorator that makes the function below it a route handler."""
    trimmed = F.trim(text)
    return F.startswith(trimmed, F.lit("@")) & contains_any(trimmed, ROUTE_WORDS)


def route_handler_flag(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Mark functions with a route decorator on one of the four lines above the header.

    Decorator lines are few; each is offered to the four line numbers below it, an equality join on ``(file, line)``.
    """
    marks = lines.filter(route_mark(F.col("text"))).select(
        "file", F.explode(F.sequence(F.col("line") + 1, F.col("line") + 4)).alias("start_line")
    ).distinct().withColumn("_m", F.lit(True))
    return functions.join(marks, ["file", "start_line"], "left").withColumn("is_handler", F.coalesce("_m", F.lit(False))).drop("_m")

"""Two small Arrow-batched helpers for what regular expressions cannot express: nesting and balanced brackets.

Both work on one value at a time inside a task. They are built by factory functions so that they travel to the
workers by value and need no installed package there.

A batch from Spark holds up to 10,000 rows and every row becomes many. Rows are therefore taken apart in runs of
``RUN_ROWS``: the Python values of a run become Arrow arrays, column by column, before the next run starts, so that only
one run's values live at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

OUTLINE_TYPE = "array<struct<line:bigint,depth:int,parent:bigint,end_line:bigint,text:string,parent_text:string,func:string,func_start:bigint>>"
CALLS_TYPE = "array<struct<col:int,name:string,full_text:string,args:array<string>>>"

RUN_ROWS = 256


def in_runs(rows: int):
    """``(each, fields, columns…)`` to a list array with one list of structs per row of the columns; ``each`` turns the values
    of one row into one list per field."""

    def run(each, fields, *columns):
        import pyarrow as pa

        names = [pa.field(n, t) for n, t in fields]
        parts = []
        for at in range(0, max(len(columns[0]), 1), rows):
            ends, flat = [0], [[] for _ in fields]
            for values in zip(*(c.slice(at, rows).to_pylist() for c in columns)):
                for whole, own in zip(flat, each(*values)):
                    whole.extend(own)
                ends.append(len(flat[0]))
            arrays = [pa.array(v, f.type) for v, f in zip(flat, names)]
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=names)))
        return pa.concat_arrays(parts)

    return run


def template_scanner():
    """``(text, at)`` to the end of the template that opens at ``at``; its holes may hold strings and templates of their own."""
    import re

    in_template = re.compile(r"\\.|`|\$\{", re.DOTALL)
    in_hole = re.compile(r"""[`{}]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")

    def template_end(text, at):
        stack, pos = ["`"], at + 1
        while stack:
            m = (in_template if stack[-1] == "`" else in_hole).search(text, pos)
            if not m:
                return len(text)
            pos = m.end()
            if stack[-1] == "`":
                if m[0] == "`":
                    stack.pop()
                elif m[0] == "${":
                    stack.append("{")
            elif m[0] == "}":
                stack.pop()
            elif m[0] in "`{":
                stack.append(m[0])
        return pos

    return template_end


def outline_udf(headers: dict[str, str], arrow: tuple[str, str], anonymous: str, module: str):
    """``(content, by_braces, language)`` to statements with depth, parent line, last line of the block they open, the text
    of the parent and the innermost function around them.

    A first pass over the text finds its structure: strings (triple-quoted ones and templates with nested templates too),
    comments, patterns between slashes, and which braces belong to objects rather than to bodies. Indentation or body
    braces then give the depth; blank lines, comments and lone opening braces are left out. A statement runs on over the
    following lines while a bracket, an object or a string is open, or the line ends in a backslash; its text is then one
    line. ``headers`` has the expression of function headers by language, ``arrow`` a rewriting of arrow functions to
    plain headers.
    """

    template_end = template_scanner()
    listed = in_runs(RUN_ROWS)

    @F.arrow_udf(OUTLINE_TYPE)
    def outline(content: pa.Array, by_braces: pa.Array, language: pa.Array) -> pa.Array:
        import re

        import pyarrow as pa

        heads = {k: re.compile(v) for k, v in headers.items()}
        rewrite = re.compile(arrow[0])
        marks = {True: re.compile(r"""["'`/(){}\[\]#]"""), False: re.compile(r"""["'#(){}\[\]]""")}
        quoted = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}") for q in "\"'"}
        triple = {q: re.compile(rf"{q}(?:\\.|(?!{q})[\s\S])*(?:{q}|\Z)") for q in ('"""', "'''")}
        pattern = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
        block = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)")
        not_line = re.compile(r"[^\n]")

        def structure(text, braces, lang):
            """The text with strings and comments blanked and object braces as round ones; the text without comments."""
            shape, plain, done, pos, open_, last = [], [], 0, 0, [], -1

            def put(start, end, form, shown):
                nonlocal done
                shape.extend((text[done:start], form))
                plain.extend((text[done:start], shown))
                done = end

            while True:
                m = marks[braces].search(text, pos)
                if not m:
                    break
                c, at = m[0], m.start()
                end = at + 1
                gap = at - 1
                while gap >= 0 and text[gap].isspace():
                    gap -= 1
                gap = max(gap, last)  # comments between do not count as text before
                if c in "\"'" or c == "`":
                    if c == "`":
                        end = template_end(text, at)
                    elif not braces and text.startswith(c * 3, at):
                        end = triple[c * 3].match(text, at).end()
                    else:
                        whole = quoted[c].match(text, at)
                        end = whole.end() if whole else end
                    if end > at + 1:
                        inner = text[at:end]
                        if "\n" in inner:
                            put(at, end, "(" + not_line.sub("_", inner[1:-1]) + ")", inner)
                        else:
                            put(at, end, '"' + "_" * (end - at - 2) + '"', inner)
                elif c == "#" or c == "/" and text.startswith("//", at):
                    if c == "/" or not braces or lang == "php":
                        end = text.find("\n", at)
                        end = len(text) if end < 0 else end
                        if c == "/" or at == 0 or text[at - 1].isspace():
                            put(at, end, " " * (end - at), " " * (end - at))
                        else:
                            end = at + 1
                elif c == "/":
                    if text.startswith("/*", at):
                        end = block.match(text, at).end()
                        blank = not_line.sub(" ", text[at:end])
                        put(at, end, blank, blank)
                    elif lang == "javascript" and (gap < 0 or text[gap] in "(,=:[!&|?{};"):
                        whole = pattern.match(text, at)
                        if whole:
                            end = whole.end()
                            put(at, end, '"' + "_" * (end - at - 2) + '"', text[at:end])
                elif c in "([":
                    open_.append(c)
                elif c == "{":
                    before = text[gap] if gap >= 0 else ""
                    body = before == ")" or text[max(gap - 1, 0) : gap + 1] == "=>"
                    nested = bool(open_) and open_[-1] != "{"
                    word = re.search(r"\w+$", text[max(gap - 9, 0) : gap + 1]) if before.isalnum() else None
                    value = before and before in "=(,[?&|]" or (word and word[0] == "return") or lang == "go" and gap == at - 1 and before.isalnum()
                    if not body and (nested or value):
                        open_.append("o")
                        if braces:
                            put(at, end, "(", "{")
                    else:
                        open_.append("{")
                elif open_:
                    top = open_.pop()
                    if top == "o" and c == "}" and braces:
                        put(at, end, ")", "}")
                pos = end
            put(len(text), len(text), "", "")
            return "".join(shape).split("\n"), "".join(plain).split("\n")

        def each(text, braces, lang):
            rows, stack, level, still_open = [], [], 0, 0
            head = heads.get(lang)
            braces = bool(braces)
            for n, (bare, body) in enumerate(zip(*structure((text or "").replace("\r\n", "\n"), braces, lang)), 1):
                bare, body = bare.rstrip(), body.rstrip()
                lead = bare.strip()
                if not lead:
                    continue
                brackets = sum(map(bare.count, "([" if braces else "([{")) - sum(map(bare.count, ")]" if braces else ")]}"))
                turn = bare.count("{") - bare.count("}") if braces else 0
                if still_open > 0:
                    top = rows[-1]
                    top["text"] = f"{top['text'].removesuffix(chr(92)).rstrip()} {body.strip()}"
                    top["_last"] = n
                    level += turn
                    still_open = max(0, still_open - (top["_slash"] or 0) + brackets)
                else:
                    depth = level - (1 if lead.startswith("}") else 0) if braces else len(bare) - len(bare.lstrip())
                    level += turn
                    if braces and lead == "{":
                        continue
                    closes = braces and lead.startswith("}")
                    while stack and rows[stack[-1]]["_d"] >= depth:
                        top = rows[stack.pop()]
                        top["end_line"] = n if closes and top["_d"] == depth else rows[-1]["_last"]
                    rows.append({"line": n, "depth": len(stack), "parent": rows[stack[-1]]["line"] if stack else 0, "end_line": n, "text": body.strip(),
                                 "_d": depth, "_last": n, "_up": stack[-1] if stack else None, "_slash": 0})
                    stack.append(len(rows) - 1)
                    still_open = max(0, brackets)
                slash = 1 if not braces and lead.endswith("\\") else 0
                rows[-1]["_slash"] = slash
                still_open += slash
                if braces and lead.endswith("{"):
                    still_open = 0
            for i in stack:
                rows[i]["end_line"] = rows[-1]["_last"]
            for r in rows:
                up = rows[r["_up"]] if r["_up"] is not None else None
                r["parent_text"] = up["text"] if up else None
                r["func"], r["func_start"] = up["_inside"] if up else (module, 0)
                line = rewrite.sub(arrow[1], r["text"]) if lang == "javascript" and "=>" in r["text"] else r["text"]
                m = head.search(line) if head else None
                r["_inside"] = ((m[1] or anonymous), r["line"]) if m else (r["func"], r["func_start"])
            return [[r[name] for r in rows] for name, _ in fields]

        number, word = pa.int64(), pa.string()
        fields = [("line", number), ("depth", pa.int32()), ("parent", number), ("end_line", number), ("text", word), ("parent_text", word), ("func", word), ("func_start", number)]
        return listed(each, fields, content, by_braces, language)

    return outline


def calls_udf():
    """One statement to its calls, nested ones included: column, dotted name, text and top-level arguments.

    One pass from left to right with a stack of open brackets finds where every call ends, so the time grows with the
    length of the statement (and with the text that is returned). Calls inside a string or a template are taken apart within it.
    """

    template_end = template_scanner()
    listed = in_runs(RUN_ROWS)

    @F.arrow_udf(CALLS_TYPE)
    def calls(texts: pa.Array) -> pa.Array:
        import re

        import pyarrow as pa

        head = re.compile(r"(?<![\w$])(?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*\s*\(")
        token = re.compile(r"""(["'])(?:\\.|(?!\1)[^\\])*\1|[`()\[\]{},]""", re.DOTALL)
        words = {"if", "while", "for", "switch", "catch", "return", "function", "def", "func", "elif", "and", "or", "not", "in"}

        def ends(s, opened, low, high, found):
            """Fill ``found`` (position of a call's bracket to its end and argument cuts) for the part ``low:high``."""
            stack, pos = [], low
            while m := token.search(s, pos, high):
                c, j, pos = m[0], m.start(), m.end()
                if c == "`":
                    pos = min(template_end(s, j), high)
                    c = s[j:pos]
                if len(c) > 1:
                    if "(" in c:
                        ends(s, opened, j + 1, pos - 1, found)
                elif c in "([{":
                    stack.append((j, [j]))
                elif c == ",":
                    if stack:
                        stack[-1][1].append(j)
                elif stack:
                    at, cuts = stack.pop()
                    if at in opened:
                        found[at] = (j + 1, cuts + [j])
            for at, cuts in stack:
                if at in opened:
                    found[at] = (high, cuts + [high])

        def each(s):
            cols, names, full, parts = [], [], [], []
            heads = [(m.start(), m.end() - 1, re.sub(r"\s*\($", "", m[0])) for m in head.finditer(s or "")]
            heads = [h for h in heads if h[2] not in words]
            found = {}
            if heads:
                ends(s, {h[1] for h in heads}, 0, len(s), found)
            for start, bracket, name in heads:
                end, cuts = found.get(bracket, (len(s), [bracket, len(s)]))
                args = [s[a + 1:b].strip() for a, b in zip(cuts, cuts[1:])]
                cols.append(start + 1)
                names.append(name)
                full.append(s[start:end])
                parts.append([] if args == [""] else args)
            return cols, names, full, parts

        fields = [("col", pa.int32()), ("name", pa.string()), ("full_text", pa.string()), ("args", pa.list_(pa.string()))]
        return listed(each, fields, texts)

    return calls

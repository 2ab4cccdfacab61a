"""Column helpers shared by the operators; everything here is built from Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_map(d: dict) -> Column:
    """Literal map column of a small fixed dictionary."""
    flat: list[Column] = []
    for k, v in d.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def contains_any(text, words: list[str]) -> Column:
    """True when one of the given words occurs in ``text``."""
    return any_of([F.contains(text, F.lit(w)) for w in words])


def first_contained(text, words: list[str]) -> Column:
    """First word (in list order) that occurs in ``text``, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])


def quoted(text) -> Column:
    """``text`` as a literal inside a regular expression built from data."""
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def let(value, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda every captured expression is computed again for each element; as the single element of an array it
    becomes a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df, keep: list, array, name: str):
    """``df.select(keep…, explode(array) as name)`` with the array computed once per row.

    For a plain explode the optimizer adds a filter on the array's size and so computes the expression again; the outer
    form is left alone, and rows of empty arrays are dropped afterwards. Elements must not be null.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def entropy_bits(text) -> Column:
    """Shannon entropy of a string in bits per character, ``log2 n - sum(c * log2 c) / n``.

    Row-local: in the sorted characters the count of each distinct one is the distance to the start of the next.
    """

    def from_chars(chars):
        n = F.size(chars)

        def from_starts(starts):
            ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array((n + 1).cast("bigint")))
            counts = F.zip_with(starts, ends, lambda a, b: (b - a).cast("double"))
            total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
            return F.greatest(F.lit(0.0), F.log2(n.cast("double")) - total / n)

        starts = F.transform(F.array_distinct(chars), lambda c: F.array_position(chars, c))
        return F.when(n > 0, let(starts, from_starts)).otherwise(F.lit(0.0))

    return let(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")), from_chars)


# ---------------------------------------------------------------------------- URLs
def url_part(url, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def host_of(url) -> Column:
    return url_part(url, "AUTHORITY")


def endpoint_url(url) -> Column:
    """``scheme://host/path`` without a trailing slash, query and fragment."""
    base = F.concat(url_part(url, "PROTOCOL"), F.lit("://"), host_of(url), url_part(url, "PATH"))
    return F.regexp_replace(base, "/+$", "")


def endpoint_key(method, url) -> Column:
    return F.concat(F.upper(method), F.lit(":"), endpoint_url(url))


def without_dots(path) -> Column:
    """A rooted path with its ``.`` and ``..`` steps taken; steps above the root stay at the root."""

    def take(done, step):
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    taken = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), take), "/")
    folder = path.rlike(r"/\.\.?$")
    return F.when(~path.rlike(r"/\.\.?(/|$)"), path).otherwise(F.concat(taken, F.when(folder, "/").otherwise("")))


def resolve_url(base, href) -> Column:
    """Absolute address of ``href`` seen on page ``base`` (absolute, protocol-relative, rooted, query and plain paths); steps
    with dots are taken."""
    origin = F.concat(url_part(base, "PROTOCOL"), F.lit("://"), host_of(base))
    path = url_part(base, "PATH")
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    plain = F.regexp_extract(href, "^[^?#]*", 0)
    rest = F.substring(href, F.length(plain) + 1, F.length(href))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(url_part(base, "PROTOCOL"), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, without_dots(plain), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .when(href == "", base)
        .otherwise(F.concat(origin, without_dots(F.concat(folder, plain)), rest))
    )


def query_pairs(query) -> Column:
    """Array of ``(name, value)`` of a query string: decoded, blank values dropped, first value per name."""

    def decode(x):
        return F.coalesce(F.try_url_decode(x), x)

    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            decode(F.regexp_replace(p, "^[^=]*=", "")).alias("value"),
        ),
    )

    def first_per_name(ps):
        names = F.transform(ps, lambda p: p["name"])
        return let(names, lambda ns: F.filter(ps, lambda p, i: F.array_position(ns, p["name"]) == i + 1))

    return let(pairs, first_per_name)

"""Scalar expressions that have no single built-in."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: inside the lambdas of array functions, Spark would work it out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def title_case(c: Column) -> Column:
    """Upper case for the first letter of each run of letters, lower case for the rest ('ART/HIV care-plan' becomes 'Art/Hiv Care-Plan')."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("(\\p{L}+|[^\\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def capitalised(c: Column) -> Column:
    """A word with its first letter in upper case and the rest in lower case. A letter that has no single one, as a German sharp s,
    stays; F.initcap would begin the word with two letters."""
    first = F.substring(c, 1, 1)
    return F.concat(F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first), F.lower(F.substring(c, 2, 1 << 30)))


def words(c: Column) -> Column:
    """Words between white space; none for empty text."""
    return F.filter(F.split(c, "\\s+"), lambda w: w != "")


def trimmed(texts: Column) -> Column:
    """An array's texts without spaces around them. F.trim itself takes what to trim as a second argument, so F.transform would hand
    it each text's place and '10' would lose its 0."""
    return F.transform(texts, lambda t: F.trim(t))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def squeeze_spaces(c: Column) -> Column:
    """Form feeds to line ends, runs of other space to one space, three or more line ends to two, hyphenation joined."""
    steps = (("\\f", "\n"), ("[^\\S\\n]+", " "), ("\\n{3,}", "\n\n"), ("- \\n", ""))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def canonical_url(c: Column) -> Column:
    """Lower case, without trailing slashes, then without the fragment."""
    return F.split_part(F.regexp_replace(F.lower(F.trim(c)), "/+$", ""), F.lit("#"), F.lit(1))


def without_query(c: Column) -> Column:
    return F.split_part(F.split_part(c, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def content_id(c: Column) -> Column:
    return F.sha2(c, 256)


def guarded_int(c: Column) -> Column:
    """Padded integers with a sign; null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))


def clamp(c: Column, low, high) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def age_days(now, then: Column) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(86_400_000_000.0)


def first_match(text: Column, rules, default=None) -> Column:
    """The label of the first (marker, label) whose marker is in text; markers may be lists of alternatives."""
    out = F.lit(default)
    for markers, label in reversed(list(rules)):
        markers = [markers] if isinstance(markers, str) else markers
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers]), F.lit(label)).otherwise(out)
    return out


def first_prefix(c: Column, rules, default=None) -> Column:
    """The value of the first (prefix, value) that the text begins with; a value may be empty."""
    out = F.lit(default)
    for prefix, value in reversed(list(rules)):
        out = F.when(F.startswith(c, F.lit(prefix)), F.lit(value)).otherwise(out)
    return out


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Lookup in a small constant table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None)
    return F.coalesce(found, default) if default is not None else found


def needle(pattern: str) -> str | None:
    """The longest lower-case text that every match of a pattern has, in any case; None where none is seen."""
    if not pattern.isascii() and pattern != pattern.lower():
        return None
    rest = re.sub(r"\(\?:[^()]*\)[+*?]?|\[[^\]]*\][+*?]?|\\.[+*?]?|[^\\][*?]|[.+]", "\0", pattern.removeprefix("(?i)"))
    found = max(rest.split("\0"), key=len).lower()
    return found if found and not re.search(r"[()\[\]{}|^$\\]", rest) else None


def found(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern is found in text, whose lower-case form is low: held against the pattern only where it has its needle, as
    looking for a text takes a small part of the time."""
    own = needle(pattern)
    return F.contains(low, F.lit(own)) & text.rlike(pattern) if own else text.rlike(pattern)


def tags(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Names whose patterns are found, in the table's order."""
    hits = lambda t, low: F.array(*[F.when(reduce(lambda a, b: a | b, [found(t, low, p) for p in ps]), F.lit(name)) for name, ps in patterns.items()])
    return F.filter(let(text, lambda t: let(F.lower(t), lambda low: hits(t, low))), lambda x: x.isNotNull())


def citation_marks(c: Column) -> Column:
    """The numbers of [n] marks, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda x: x.cast("int"))

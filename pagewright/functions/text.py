"""Text rules as column expressions; white space, digits and word boundaries are Unicode's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once a row, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """All lines, blank ones too; null has none."""
    return F.coalesce(F.split(c, BREAKS), F.array().cast("array<string>"))


def normal_line(c: Column) -> Column:
    """The line collapsed and trimmed, or '' where it says nothing: one character, no word character, or a page number."""
    t = collapse(c)
    empty = (F.length(t) <= 1) | t.rlike(r"(?U)\A[^\w]+\z") | t.rlike(r"(?U)\A[-–—]?\d+[-–—]?\z")
    return F.when(empty, "").otherwise(t)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def words(terms: Sequence[str]) -> Column:
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def found(c: Column, terms: Sequence[str]) -> Column:
    """The terms that the text holds anywhere, in the order of the list."""
    low = F.lower(c)
    return F.filter(words(terms), lambda t: F.contains(low, t))


def holds(c: Column, terms: Sequence[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return out


def first_found(c: Column, terms: Sequence[str]) -> Column:
    return F.get(found(c, terms), F.lit(0))


def page_key(doc: Column, page: Column) -> Column:
    return F.format_string("%s:%04d", doc, page)


def page_path(root: str, doc: Column, page: Column) -> Column:
    return F.format_string("%s/%s/page_%04d.png", F.lit(root), doc, page)


def preview(c: Column, n: int = 300) -> Column:
    return F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" | "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / norm)


def json_list(c: Column, item: str) -> Column:
    """A JSON list in a string cell; blank and null are empty."""
    return F.coalesce(F.from_json(F.nullif(F.trim(c), F.lit("")), f"array<{item}>"), F.array().cast(f"array<{item}>"))


def confidence(c: Column, default: float = 0.2) -> Column:
    """The number within ten non-digits after 'confidence', as a share of one."""
    said = F.regexp_extract(c, r"(?i)confidence[^0-9]{0,10}([0-9]+(?:\.[0-9]+)?)", 1)
    x = said.try_cast("double")
    return F.when(F.coalesce(said, F.lit("")) == "", F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))))

"""Text functions as column expressions. Patterns use (?U) so that classes cover all letters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    """Runs of white space as one space, without leading and trailing."""
    return F.trim(F.regexp_replace(col(c), f"{_SPACE}+", " "))


def lowered(c) -> Column:
    return F.lower(collapse(c))


def slug(c, empty: str | None = "unnamed") -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends; ``empty`` for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty)) if empty else s


def entity_slug(c) -> Column:
    return slug(lowered(c))


def source_slug(c) -> Column:
    """Slug of what follows the first colon (or of all, without one)."""
    return slug(F.regexp_replace(col(c), "(?s)^[^:]*:", ""), None)


def source_node_id(c) -> Column:
    """Node id of a source: paper_, markdown_ or repo_ before the slug; null for other kinds."""
    kind = F.substring_index(col(c), ":", 1)
    prefix = F.when(kind == "pdf", "paper").when(kind == "md", "markdown").when(kind == "github", "repo")
    return F.concat(prefix, F.lit("_"), source_slug(c))


@F.pandas_udf(T.StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; the one step that no built-in function gives."""
    return s.map(lambda x: None if x is None else x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalized(c) -> Column:
    """Comparable name: no accents, possessive, leading article, punctuation or trailing legal form."""
    s = F.lower(decomposed(col(c)))
    s = F.regexp_replace(s, "(?U)['’]s\\b", "")
    s = F.regexp_replace(s, r"(?U)^\s*(?:(?:the|an?)\s+)+", "")
    s = collapse(F.regexp_replace(s, r"(?U)[^\w\s]|_", " "))
    return F.regexp_replace(s, "(?<=[^ ])(?: (?:inc|ltd|llc|co))+$", "")


def name_forms(norm: Column) -> Column:
    """The normalized name and, if at least two longer tokens stay and one goes, itself without one-letter tokens."""
    tokens = F.split(norm, " ")
    longer = F.filter(tokens, lambda t: F.length(t) > 1)
    both = (F.size(longer) >= 2) & (F.size(longer) < F.size(tokens))
    return F.when(norm == "", F.array().cast("array<string>")).when(both, F.array(norm, F.array_join(longer, " "))).otherwise(F.array(norm))


BLOCK_KINDS = ("first_token", "last_token", "initials")


def block_keys(form: Column) -> Column:
    """(kind, value) of the blocks of a name form: first token, last token, sorted initials."""
    t = F.split(form, " ")
    initials = F.array_join(F.array_sort(F.transform(t, lambda x: F.substring(x, 1, 1))), "")
    return F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in zip(BLOCK_KINDS, (F.element_at(t, 1), F.element_at(t, -1), initials), strict=True)])


def has_stutter(norm: Column) -> Column:
    """Two equal tokens in a row, or a sequence of tokens written twice."""
    t = F.split(norm, " ")
    n = F.size(t)
    pairs = F.exists(F.arrays_zip(F.slice(t, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(t, 2, F.greatest(n - 1, F.lit(0))).alias("b")), lambda x: x["a"] == x["b"])
    half = (n / 2).cast("int")
    return pairs | ((n >= 2) & (n % 2 == 0) & (F.slice(t, 1, F.greatest(half, F.lit(1))) == F.slice(t, half + 1, F.greatest(half, F.lit(1)))))


def is_risky(norm: Column) -> Column:
    """At most three tokens, or initials only."""
    t = F.split(norm, " ")
    return (F.size(t) <= 3) | F.forall(t, lambda x: F.length(x) == 1)


def is_noise(c) -> Column:
    """Fewer than two ASCII letters, or the start of a web address."""
    s = F.trim(col(c))
    return (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) < 2) | F.lower(s).startswith("http") | F.lower(s).startswith("www.")


def clean_markdown(c) -> Column:
    """Text without code, images, link targets, tags, heading marks and emphasis marks."""
    s = F.regexp_replace(col(c), "(?s)```.*?```", "")
    for pattern, to in (("`[^`\n]+`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), ("<[^>\n]+>", ""), (r"(?md)^#{1,6}\s*", ""), (r"(?d)(\*{1,3}|_{1,3})(\S(?:.*?\S)?)\1", "$2")):
        s = F.regexp_replace(s, pattern, to)
    return s


def display_name(*cols) -> Column:
    """The first column that is neither null nor empty; else the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def escape_query(c) -> Column:
    """Backslash before each character that the query syntax reserves."""
    return F.regexp_replace(col(c), r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def split_names(raw) -> Column:
    """Names in a comma-separated author field, without leading "and" and membership grades."""
    # fixed values: grades that stand among the names of bylines
    grades = ("ieee", "member", "senior member", "life fellow", "fellow", "student member", "life member", "senior fellow")
    parts = F.transform(F.split(col(raw), ","), lambda x: F.regexp_replace(collapse_ends(x), r"(?i)^\s*and\s+", ""))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin(*grades))


def collapse_ends(c) -> Column:
    return F.regexp_replace(col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def byline(text) -> Column:
    """Candidate names on the first page: lines after the running header up to the abstract."""
    page = F.element_at(F.split(col(text), "--- Page 2 ---"), 1)
    lines = F.filter(F.transform(F.split(page, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), collapse_ends), lambda x: (x != "") & ~x.startswith("---"))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda x: F.lower(x).startswith("abstract")), True).cast("int")
    body = F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest)
    return split_names(F.array_join(body, ", "))

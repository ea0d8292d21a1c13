"""Text functions on columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of white space in Unicode, with the four separators U+001C to U+001F.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)
#: The same as a class of characters for regular expressions.
WHITE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def entity_key(c: Column | str) -> Column:
    """How entities are compared: trimmed, upper case."""
    return F.upper(trimmed(c))


def clean_cell(c: Column | str) -> Column:
    """Tabs as blanks, then without blanks at both ends; null as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t", " "))


def is_upper(c: Column) -> Column:
    """True if there is a cased letter and no lower case one."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def capitalized(c: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def normalized_url(c: Column) -> Column:
    """A URL as a template: without query, numbers and long hexadecimal parts of the path named, without trailing slashes, lower case."""
    for pattern, by in ((r"\?.*$", ""), (r"/[0-9]+(?=/|$)", "/{id}"), (r"/[0-9a-fA-F-]{16,}(?=/|$)", "/{hex}"), (r"/+$", "")):
        c = F.regexp_replace(c, pattern, by)
    return F.lower(c)


def msisdn_of(name: Column) -> Column:
    """The number at the end of a file name ``..._<msisdn>.txt``, else the empty text."""
    return F.regexp_extract(name, r"_([^_/]+)\.txt$", 1)


def literals_of(rule: Column) -> Column:
    """The texts between single or double quotes in a rule, in order."""
    quoted = F.regexp_extract_all(rule, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    return F.transform(quoted, lambda q: q.substr(F.lit(2), F.length(q) - 2))

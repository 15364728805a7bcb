"""Identity and name functions: digests, ids, name keys, dotted segments, locations."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def uid(prefix: str, text: Column) -> Column:
    """Prefix and the first 24 hex digits of the text's digest."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest(text), 1, 24))


def ascii_name_key(name: Column) -> Column:
    """``name_key`` for plain ASCII names without quotes, as an expression."""
    return F.lower(F.trim(F.regexp_replace(name, r"[\s\x1c-\x1f]+", " ")))


def name_key_text(name: str) -> str:
    """NFC, case folded, runs of white space as one blank and none at the ends of a part; text in double quotes (doubled
    ones belong to it) is a part that is left alone."""
    outside = lambda part: " ".join(part.split()).casefold()
    out, at, text = [], 0, unicodedata.normalize("NFC", name)
    for m in re.finditer(r'"(?:""|[^"])*"', text):
        out += [outside(text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, outside(text[at:])])


def _name_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else name_key_text(x))


def name_key(name: Column) -> Column:
    """The ASCII form stays in the JVM; only names that need Unicode folding or hold quotes go to Python."""
    plain = name.rlike(r'^[\x00-\x21\x23-\x7F]*$')
    folded = F.pandas_udf(_name_keys, "string")
    return F.when(plain, ascii_name_key(name)).otherwise(folded(F.when(~plain, name)))


def segments(name: Column, fold: str = "upper") -> Column:
    """Dotted parts; parts in double quotes, backticks or brackets keep case and dots."""
    found = F.regexp_extract_all(name, F.lit(r'("[^"]*"|`[^`]*`|\[[^\]]*\]|[^.]+)'), F.lit(1))
    case = {"upper": F.upper, "lower": F.lower, "none": lambda x: x}[fold]
    return F.transform(found, lambda s: F.when(s.rlike(r'^(".*"|`.*`|\[.*\])$'), F.substring(s, 2, F.length(s) - 2)).otherwise(case(F.trim(s))))


def suffixes(parts: Column) -> Column:
    """All suffixes of an array of segments, the whole array included."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def lines_before(text: Column, offset: Column) -> Column:
    """1-based line of a character offset (0-based)."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


#: Fixed value: what counts as a placeholder, in any letter case; TBD, TODO and PLACEHOLDER only as the whole text.
PLACEHOLDER = r"(?i)\$\{[^}]+\}|\{\{[^}]+\}\}|\bREPLACE_[A-Z0-9_]+\b|^(?:TBD|TODO|PLACEHOLDER)$|<<[^>]+>>"


def is_placeholder(text: Column) -> Column:
    return text.rlike(PLACEHOLDER)

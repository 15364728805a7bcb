"""Canonical JSON in the JVM: keys in order at every depth, no blanks, so that equal values have equal text and hash.

Values go through VARIANT, whose objects keep their fields in the order of their names. Numbers are written by value
(``1.0`` and ``1`` are the same); text that isn't JSON gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veinlode.functions.identity import digest


def parsed(json: Column) -> Column:
    """A JSON text as a variant; null for anything that isn't one whole value.

    Spark's parser stops after the first value and passes over what follows, so the text is read as one of two members
    of an object whose other one, a hash of the text, has to be found behind it."""
    mark = F.md5(json.cast("binary"))
    both = F.try_parse_json(F.concat(F.lit('{"value":'), json, F.lit(',"mark":"'), mark, F.lit('"}')))
    members = F.try_variant_get(both, "$", "map<string,variant>")
    whole = (F.size(members) == 2) & (F.try_variant_get(both, "$.mark", "string") == mark)
    return F.when(whole, F.try_variant_get(both, "$.value", "variant"))


def canonical(json: Column) -> Column:
    """Canonical text of a JSON text."""
    return F.to_json(parsed(json))


def quoted(text: Column) -> Column:
    """A string as JSON; null as JSON's null."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def json_object(**fields: Column) -> Column:
    """JSON object of JSON texts, its keys in order; a field that is null is left out."""
    parts = [F.when(fields[k].isNotNull(), F.concat(F.lit(f'"{k}":'), fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def field(value: Column, path: str) -> Column:
    """Canonical text of what a variant has at ``path``: null where it has nothing, ``null`` where it has a null."""
    found = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.to_json(found), F.when(F.is_variant_null(found), "null"))


def text_at(value: Column, *paths: str) -> Column:
    """The first non-null string of a variant at the given paths."""
    return F.coalesce(*[F.try_variant_get(value, p, "string") for p in paths])


def canonical_id(prefix: Column, canonical_text: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.substring(digest(canonical_text), 1, 24))

"""Who a publisher is: authority, type and level of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import col, contains_any


def _known() -> dict[str, tuple]:
    """Feeds by lower-case name, id and alias; the first feed that has a key keeps it."""
    found: dict[str, tuple] = {}
    for f in rules.FEEDS:
        for k in (f[1].lower(), f[0], *(a.lower() for a in rules.words(f[9]))):
            found.setdefault(k, f)
    return found


def catalogue_value(name: Column | str, field: int, kind: str) -> Column:
    """A field of the feed that a name, id or alias names; null if none does."""
    key = F.lower(F.trim(col(name)))
    pairs = F.create_map(*[x for k, f in _known().items() for x in (F.lit(k), F.lit(f[field]))])
    return F.try_element_at(pairs, key).cast(kind)


def ladder(text: Column, steps: tuple, otherwise: str) -> Column:
    found = None
    for name, parts in steps:
        test = contains_any(text, parts)
        found = F.when(test, F.lit(name)) if found is None else found.when(test, F.lit(name))
    return found.otherwise(F.lit(otherwise))


def evidence_level(name: Column | str) -> Column:
    """The catalogue's level, else the first step of the ladder that the name fits; null counts as industry media."""
    n = F.lower(F.trim(F.coalesce(col(name), F.lit(""))))
    return F.coalesce(catalogue_value(n, 10, "string"), ladder(n, rules.EVIDENCE_LADDER, "industry_media"))


def source_type(name: Column | str) -> Column:
    n = F.lower(col(name))
    return F.coalesce(catalogue_value(n, 4, "string"), ladder(n, rules.TYPE_LADDER, "media"))


def type_authority(kind: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in rules.TYPE_AUTHORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, kind), F.lit(rules.DEFAULT_AUTHORITY))


def authority(name: Column | str, kind: Column | None = None) -> Column:
    """The first known publisher that is part of the name, else the catalogue, else the type's default."""
    n = F.lower(F.trim(col(name)))
    found = None
    for k, v in rules.PUBLISHER_AUTHORITY.items():
        found = F.when(n.contains(k), F.lit(v)) if found is None else found.when(n.contains(k), F.lit(v))
    return F.coalesce(found, catalogue_value(n, 5, "int"), type_authority(kind if kind is not None else F.lit("media")))


def exact_authority(name: Column | str) -> Column:
    """The known authority of exactly this publisher, else null."""
    pairs = F.create_map(*[F.lit(x) for kv in rules.PUBLISHER_AUTHORITY.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(col(name))))

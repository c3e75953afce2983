"""Canonical entities: names, groups and families, for columns and for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import col


def entity_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *e[:4], rules.words(e[4])) for i, e in enumerate(rules.ENTITIES)]
    return spark.createDataFrame(rows, "rank int, name string, id string, kind string, parent_group string, aliases array<string>")


def alias_keys() -> dict[str, int]:
    """Alias to the entity's position; of two that share an alias the later has it."""
    keys: dict[str, int] = {}
    for i, e in enumerate(rules.ENTITIES):
        for k in (e[0].lower(), e[1].lower(), *(a.lower() for a in rules.words(e[4]))):
            keys[k] = i
    return keys


def alias_table(spark: SparkSession) -> DataFrame:
    """alias, name, id, parent_group: for joins."""
    rows = [(k, rules.ENTITIES[i][0], rules.ENTITIES[i][1], rules.ENTITIES[i][3]) for k, i in alias_keys().items()]
    return spark.createDataFrame(rows, "alias string, name string, id string, parent_group string")


def _lookup(name: Column | str, field: int) -> Column:
    key = F.lower(F.trim(col(name)))
    pairs = [x for k, i in alias_keys().items() if rules.ENTITIES[i][field] is not None for x in (F.lit(k), F.lit(rules.ENTITIES[i][field]))]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_name(name: Column | str) -> Column:
    return _lookup(name, 0)


def canonical_id(name: Column | str) -> Column:
    return _lookup(name, 1)


def parent_group(name: Column | str) -> Column:
    return _lookup(name, 3)


def same_entity(a: Column | str, b: Column | str) -> Column:
    """Equal ids where both are known, else equal names."""
    x, y = canonical_id(a), canonical_id(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(F.trim(col(a))) == F.lower(F.trim(col(b))))


def same_group(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.lower(parent_group(a)) == F.lower(parent_group(b)), F.lit(False))


def family(name: Column | str) -> Column:
    """Sorted names of the entities of one parent group; the entity itself without one; the given name if unknown."""
    groups: dict[str, list[str]] = {}
    for e in rules.ENTITIES:
        if e[3]:
            groups.setdefault(e[3], []).append(e[0])
    pairs = F.create_map(*[x for g, names in groups.items() for x in (F.lit(g), F.array(*map(F.lit, sorted(names))))])
    return F.coalesce(F.try_element_at(pairs, parent_group(name)), F.array(F.coalesce(canonical_name(name), col(name))))

"""Defensive extraction from JSON, XML and URLs: what is missing or of another shape becomes null or a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_at(v: Column, path: str = "$") -> Column:
    """The string at a path of a variant; null if there is none or it is no string."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))


def localized(v: Column, path: str = "$") -> Column:
    """A display string: the value itself, its name, its name or itself by locale, or its first string."""
    by_locale = lambda p: [text_at(v, f"{p}.en_US"), text_at(v, f"{p}.en_GB")]
    values = F.map_values(F.try_variant_get(v, path, "map<string,variant>"))
    first = F.get(F.filter(F.transform(values, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda s: s.isNotNull()), F.lit(0))
    return F.coalesce(text_at(v, path), text_at(v, f"{path}.name"), *by_locale(f"{path}.name"), *by_locale(path), first)


def millis(v: Column) -> Column:
    """A timestamp from epoch milliseconds; null for what is no number."""
    n = F.try_variant_get(v, "$", "double")
    return F.when(F.schema_of_variant(v).isin("STRING", "BOOLEAN"), None).otherwise(F.timestamp_millis(F.floor(n).cast("long")))


def number(v: Column, default: int = 0) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "long"), F.lit(default).cast("long"))


def pruned(facts: Column, dropped: tuple[str, ...] = ("_links", "key")) -> Column:
    """A map of strings without link keys and without null or empty values."""
    return F.map_filter(facts, lambda k, v: ~k.isin(*dropped) & v.isNotNull() & ~v.isin("", "[]", "{}"))


def percent(value: Column, most: Column) -> Column:
    """value in percent of most, one decimal; null if most is 0 or missing."""
    return F.round(value / F.nullif(most, F.lit(0)) * 100, 1)


def namespace(category: Column, region: Column) -> Column:
    return F.concat_ws("-", category, F.lower(region))


def host(region: Column) -> Column:
    r = F.lower(region)
    return F.when(r == "cn", "gateway.example.cn").otherwise(F.concat(r, F.lit(".api.example.com")))


def entity_slug(region: Column, realm: Column, name: Column) -> Column:
    return F.lower(F.replace(F.replace(F.concat_ws("-", region, realm, name), F.lit(" "), F.lit("-")), F.lit("'"), F.lit("")))


def has_scope(scopes: Column, wanted: str) -> Column:
    return F.array_contains(F.split(F.coalesce(scopes, F.lit("")), " "), wanted)


#: Longer names of roles by how a specialization is called.
ROLE_OF_SPEC = {"guardian": "tank", "protection": "tank", "blood": "tank", "restoration": "healer", "holy": "healer", "mistweaver": "healer"}


def role_of(spec: Column, default: str = "damage") -> Column:
    roles = F.create_map(*[F.lit(x) for pair in ROLE_OF_SPEC.items() for x in pair])
    return F.coalesce(F.try_element_at(roles, F.lower(F.coalesce(spec, F.lit("")))), F.lit(default))


def sentence(*parts: Column) -> Column:
    """The non-null parts, with blanks between."""
    return F.array_join(F.array_compact(F.array(*parts)), " ")

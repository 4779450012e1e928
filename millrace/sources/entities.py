"""Entities of an outside catalogue, each kind described by a spec: which list of its index names the ids, and how a
record is told as text.

The index of a kind is one payload; details are fetched in windows of ids, and a detail that fails or is
missing leaves out its own document only.  All kinds are rendered in one pass over (entity, id, payload)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import semistructured as S
from millrace.sources.connectors import batched, patiently

Part = Callable[[Column], Column]


def _local(v: Column, path: str) -> Column:
    return F.coalesce(S.localized(v, path), F.lit(""))


def _shape(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _objects(v: Column, path: str) -> Column:
    got = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(got, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def said(path: str) -> Part:
    """The display string at a path, if it is not empty."""
    return lambda v: F.nullif(_local(v, path), F.lit(""))


def named(path: str, form: str) -> Part:
    """The name of the object at a path put into ``form``; nothing if there is no object or it is empty."""
    there = lambda v: F.startswith(_shape(v, path), F.lit("OBJECT")) & (_shape(v, path) != "OBJECT<>")
    return lambda v: F.when(there(v), F.format_string(form, _local(v, f"{path}.name")))


def flagged(path: str, text: str) -> Part:
    return lambda v: F.when(F.try_variant_get(v, path, "boolean"), text)


def counted(path: str, form: str, unit: int = 1) -> Part:
    """The number at a path in whole units, unless it is 0 or missing."""
    n = lambda v: F.try_variant_get(v, path, "long")
    return lambda v: F.when(n(v) != 0, F.format_string(form, F.floor(n(v) / unit).cast("long")))


def listed(path: str, item: str, form: str, between: str = ", ", most: int | None = None, empty: bool = True) -> Part:
    """The names found in the objects of a list, the first ``most`` of them; a list without names gives a part only if ``empty``."""

    def part(v: Column) -> Column:
        entries = _objects(v, path)
        names = F.filter(F.transform(entries if most is None else F.slice(entries, 1, most), lambda x: _local(x, item)), lambda s: s != "")
        return F.when(F.size(entries if empty else names) > 0, F.format_string(form, F.array_join(names, between)))

    return part


def sections(path: str, most: int) -> Part:
    """Bodies of sections under their titles; those without a body are left out."""

    def one(s: Column) -> Column:
        title, body = _local(s, "$.title"), _local(s, "$.body_text")
        return F.when(body != "", F.when(title != "", F.concat(F.lit("\n\n== "), title, F.lit(" ==\n"), body)).otherwise(body))

    return lambda v: F.nullif(F.array_join(F.array_compact(F.transform(F.slice(_objects(v, path), 1, most), one)), " "), F.lit(""))


@dataclass(frozen=True)
class EntitySpec:
    entity: str
    index_key: str
    parts: tuple[Part, ...]


#: The kinds, the lists of their indexes, and the wording of their texts.
SPECS = (
    EntitySpec("mount", "mounts", (said("$.description"), named("$.source", "Source: %s."), named("$.faction", "Faction: %s."), flagged("$.should_exclude_if_uncollected", "Not obtainable through normal play."))),
    EntitySpec("pet", "pets", (said("$.description"), named("$.battle_pet_type", "Battle pet type: %s."), named("$.source", "Source: %s."), flagged("$.is_capturable", "Can be captured in the wild."), flagged("$.is_tradable", "Tradable."))),
    EntitySpec("achievement", "achievements", (said("$.description"), named("$.category", "Category: %s."), counted("$.points", "Worth %d achievement points."), listed("$.criteria.child_criteria", "$.description", "Criteria: %s.", "; ", 12, empty=False))),
    EntitySpec("profession", "professions", (said("$.description"), named("$.type", "Type: %s."), listed("$.skill_tiers", "$.name", "Skill tiers: %s."))),
    EntitySpec("quest", "quests", (said("$.description"), counted("$.requirements.min_character_level", "Minimum level %d."), named("$.area", "Area: %s."), counted("$.rewards.money.value", "Rewards %d gold.", 10_000), counted("$.rewards.experience", "Rewards %d experience."))),
    EntitySpec("raid", "instances", (said("$.description"), named("$.location", "Location: %s."), named("$.expansion", "Expansion: %s."), listed("$.modes", "$.mode.name", "Difficulties: %s."), listed("$.encounters", "$.name", "Encounters: %s."))),
    EntitySpec("boss", "encounters", (said("$.description"), named("$.instance", "Found in %s."), sections("$.sections", 8))),
    EntitySpec("reputation", "factions", (said("$.description"), named("$.reputation_tiers", "Reputation tiers: %s."), flagged("$.is_paragon", "Supports paragon reputation."))),
)

#: The fields kept as facts.
FACTS = ("points", "faction", "type", "category", "expansion", "location", "quality", "level", "required_level", "is_capturable", "is_tradable", "is_battlepet", "source", "battle_pet_type")
WINDOW = 96


def index_ids(indexes: DataFrame, specs: tuple[EntitySpec, ...] = SPECS) -> DataFrame:
    """(entity, id) of index payloads (entity, payload); entries without an id are skipped, repeated ids are one."""
    v = indexes.withColumn("__v", F.try_parse_json("payload"))
    key = F.lit(None).cast("array<variant>")
    for s in specs:
        key = F.when(F.col("entity") == s.entity, _objects(F.col("__v"), f"$.{s.index_key}")).otherwise(key)
    ids = v.select("entity", F.explode(key).alias("e")).select("entity", F.try_variant_get("e", "$.id", "long").alias("id"))
    return ids.where("id is not null").distinct()


def windows(ids: DataFrame, size: int = WINDOW) -> DataFrame:
    """(entity, batch, ids): what is asked for at a time."""
    return batched(ids, "entity", "id", size)


def named_details(ids: DataFrame, details: DataFrame) -> DataFrame:
    """(entity, id, payload) of the details (entity, id, payload) that an index names (entity, id).

    Both grow with the catalogue, and files say little about the size of what is made of them; so Spark is told
    to merge them and not to guess that one is small enough to be broadcast."""
    return details.join(ids.hint("merge"), ["entity", "id"], "left_semi")


def fetched(asked: DataFrame, ask: Callable[[str, int], str | None], tries: int = 3) -> DataFrame:
    """(entity, id, payload) of windows (entity, ids), each a row of work; what still fails after ``tries`` is a null payload."""

    def one(entity: str, i: int) -> str | None:
        try:
            return patiently(lambda: ask(entity, i), tries)
        except Exception:  # noqa: BLE001 - a source may fail in any way, which costs one record
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entity, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([entity] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array([one(entity, i) for i in ids], pa.string())], ["entity", "id", "payload"])

    return asked.select("entity", "ids").mapInArrow(run, "entity string, id long, payload string")


def documents(details: DataFrame, specs: tuple[EntitySpec, ...] = SPECS) -> DataFrame:
    """(entity, source_id, title, body, facts) of (entity, id, payload).

    Payloads that are null or no JSON, kinds without a spec and records without a name give no document.
    A raid whose category has the type dungeon is one.  Facts are strings, without empty ones.
    A payload is parsed once: what is exploded is not put into the places that read it."""
    v = F.col("__v")
    body = F.lit(None).cast("string")
    for s in specs:
        body = F.when(F.col("entity") == s.entity, S.sentence(*[p(v) for p in s.parts])).otherwise(body)
    dungeon = (F.col("entity") == "raid") & (F.upper(_local(v, "$.category.type")) == "DUNGEON")
    fact = lambda k: F.when(F.try_variant_get(v, f"$.{k}.name", "variant").isNotNull(), _local(v, f"$.{k}.name")).otherwise(F.try_variant_get(v, f"$.{k}", "string"))
    facts = F.create_map(F.lit("id"), F.col("id").cast("string"), *[x for k in FACTS for x in (F.lit(k), fact(k))])
    parsed = details.where(F.col("entity").isin(*[s.entity for s in specs])).select("entity", "id", F.explode(F.array(F.try_parse_json("payload"))).alias("__v"))
    out = parsed.select(F.when(dungeon, "dungeon").otherwise(F.col("entity")).alias("entity"), F.col("id").cast("string").alias("source_id"), _local(v, "$.name").alias("title"), body.alias("body"), S.pruned(facts).alias("facts"))
    return out.where("title <> ''")

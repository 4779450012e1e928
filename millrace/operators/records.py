"""Records from JSON payloads, one payload a row: (key, payload string).  A payload that is no JSON gives no
list rows and null or default fields; entries that are no objects are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import semistructured as S


def _v(df: DataFrame, payload: str) -> DataFrame:
    return df.withColumn("__v", F.try_parse_json(payload))


def _list(path: str, v: str = "__v") -> Column:
    """The array at a path as array<variant>, empty if it is missing, without entries that are no objects."""
    got = F.coalesce(F.try_variant_get(F.col(v), path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.filter(got, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def summaries(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    v = F.col("__v")
    at = lambda p, t: F.try_variant_get(v, p, t)
    return _v(df, payload).select(
        key, at("$.id", "long").alias("id"), S.text_at(v, "$.name").alias("name"), F.coalesce(S.localized(v, "$.realm"), S.text_at(v, "$.realm.slug")).alias("realm"), at("$.level", "long").alias("level"),
        F.lower(S.text_at(v, "$.faction.type")).alias("faction"), S.localized(v, "$.character_class").alias("class"), S.role_of(S.localized(v, "$.active_spec")).alias("role"),
        F.coalesce(at("$.equipped_item_level", "long"), F.lit(0)).cast("long").alias("item_level"), S.localized(v, "$.guild").alias("guild"), S.millis(F.try_variant_get(v, "$.last_login_timestamp", "variant")).alias("last_login"),
    )


def equipment(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    rows = _v(df, payload).select(key, F.explode(_list("$.equipped_items")).alias("e"))
    e = F.col("e")
    enchants = F.filter(F.transform(F.coalesce(F.try_variant_get(e, "$.enchantments", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda x: S.text_at(x, "$.display_string")), lambda x: x.isNotNull() & (x != ""))
    return rows.select(key, S.text_at(e, "$.slot.type").alias("slot"), F.try_variant_get(e, "$.item.id", "long").alias("item_id"), S.localized(e, "$.name").alias("name"), F.try_variant_get(e, "$.level.value", "long").alias("item_level"), enchants.alias("enchantments"))


def loadouts(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, spec, pos, is_active, code, talents): every loadout of every specialization."""
    specs = _v(df, payload).select(key, F.posexplode(_list("$.specializations")).alias("sp", "s"))
    loads = specs.select(key, "sp", S.localized(F.col("s"), "$.specialization").alias("spec"), F.posexplode(_list("$.loadouts", "s")).alias("pos", "l"))
    talents = F.transform(_list("$.selected_class_talents", "l"), lambda n: S.localized(n, "$.tooltip.talent"))
    return loads.select(key, "sp", "spec", "pos", F.coalesce(F.try_variant_get("l", "$.is_active", "boolean"), F.lit(False)).alias("is_active"), S.text_at(F.col("l"), "$.talent_loadout_code").alias("code"), talents.alias("talents"))


def active_loadouts(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """The first active loadout of each key."""
    first = loadouts(df, key, payload).where("is_active").groupBy(key).agg(F.min_by(F.struct("spec", "code"), F.struct("sp", "pos")).alias("l"))
    return first.select(key, "l.spec", "l.code")


def professions(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, kind, name, n_tiers, max_skill, recipes) of the primary and secondary professions."""
    v = _v(df, payload)
    rows = v.select(key, F.lit("primary").alias("kind"), F.explode(_list("$.primaries")).alias("p")).unionByName(v.select(key, F.lit("secondary").alias("kind"), F.explode(_list("$.secondaries")).alias("p")))
    tiers = rows.withColumn("t", _list("$.tiers", "p"))
    skill = F.transform("t", lambda t: F.coalesce(F.try_variant_get(t, "$.skill_points", "long"), F.lit(0)))
    known = F.transform("t", lambda t: F.size(F.coalesce(F.try_variant_get(t, "$.known_recipes", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    return tiers.select(key, "kind", S.localized(F.col("p"), "$.profession").alias("name"), F.size("t").cast("long").alias("n_tiers"), F.coalesce(F.array_max(skill), F.lit(0)).cast("long").alias("max_skill"), F.aggregate(known, F.lit(0), lambda a, b: a + b).cast("long").alias("recipes"))


def reputations(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    r = F.col("r")
    value, most = F.coalesce(F.try_variant_get(r, "$.standing.value", "double"), F.lit(0.0)), F.coalesce(F.try_variant_get(r, "$.standing.max", "double"), F.lit(0.0))
    rows = _v(df, payload).select(key, F.explode(_list("$.reputations")).alias("r"))
    return rows.select(key, S.localized(r, "$.faction").alias("faction"), value.alias("value"), S.percent(value, most).alias("percent"))


def achievements(df: DataFrame, key: str, payload: str = "payload", keep: int = 100) -> DataFrame:
    """(key, total, ids): completed achievements, and the ids of the ``keep`` newest."""
    done = F.filter(_list("$.achievements"), lambda a: F.try_variant_get(a, "$.completed_timestamp", "double").isNotNull())
    pairs = F.transform(done, lambda a: F.struct(F.negative(F.try_variant_get(a, "$.completed_timestamp", "double")).alias("t"), F.try_variant_get(a, "$.id", "long").alias("id")))
    got = _v(df, payload).select(key, F.array_sort(pairs).alias("p"))
    return got.select(key, F.size("p").cast("long").alias("total"), F.transform(F.slice("p", 1, keep), lambda x: x["id"]).alias("ids"))


def pets(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, total, max_level, at_25, first): counts, and the names of the three highest, then by name."""
    level = lambda p: F.coalesce(F.try_variant_get(p, "$.level", "long"), F.lit(0)).cast("long")
    ps = F.transform(_list("$.pets"), lambda p: F.struct(F.negative(level(p)).alias("l"), S.localized(p, "$.species").alias("name")))
    got = _v(df, payload).select(key, F.array_sort(ps).alias("p"))
    return got.select(key, F.size("p").cast("long").alias("total"), F.coalesce(F.negative(F.get("p.l", F.lit(0))), F.lit(0)).cast("long").alias("max_level"), F.size(F.filter("p", lambda x: x["l"] == -25)).cast("long").alias("at_25"), F.array_join(F.slice(F.col("p.name"), 1, 3), ",").alias("first"))


def accounts(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, account, character_id, name, level): the characters of every account of a profile."""
    a = _v(df, payload).select(key, F.explode(_list("$.accounts")).alias("a"))
    c = a.select(key, F.try_variant_get("a", "$.id", "long").alias("account"), F.explode(_list("$.characters", "a")).alias("c"))
    return c.select(key, "account", F.try_variant_get("c", "$.id", "long").alias("character_id"), S.text_at(F.col("c"), "$.name").alias("name"), F.try_variant_get("c", "$.level", "long").alias("level"))


def sitemap_urls(df: DataFrame, xml: str, fragments: list[str], limit: int | None = None, ordered: bool = True) -> DataFrame:
    """(url): the distinct page addresses of sitemaps that hold one of the fragments, in order if asked, up to limit.
    Sitemaps that do not parse have none; indexes are read by giving their pages as rows."""
    well = df.where(F.coalesce(F.startswith(F.trim(xml), F.lit("<urlset")) & F.endswith(F.trim(xml), F.lit("</urlset>")), F.lit(False)))
    urls = well.select(F.explode(F.xpath(F.col(xml), F.lit("//url/loc/text()"))).alias("url"))
    wanted = F.lit(False)
    for f in fragments:
        wanted |= F.contains("url", F.lit(f))
    found = urls.where(wanted if fragments else F.lit(True)).distinct()
    found = found.orderBy("url") if ordered else found
    return found if limit is None else found.limit(limit)


def sitemap_pages(roots: DataFrame, sitemaps: DataFrame, fragments: list[str]) -> DataFrame:
    """(url): the distinct page addresses under root sitemaps (url, xml), with one of the fragments.  Roots that are
    indexes lead to the sitemaps (url, xml) they name; an index named by an index is not followed."""
    text = F.trim("xml")
    is_index = F.coalesce(F.startswith(text, F.lit("<sitemapindex")) & F.endswith(text, F.lit("</sitemapindex>")), F.lit(False))
    named = roots.where(is_index).select(F.explode(F.xpath("xml", F.lit("//sitemap/loc/text()"))).alias("url")).distinct()
    found = sitemaps.join(named, "url").select("xml").unionByName(roots.where(~is_index).select("xml"))
    return sitemap_urls(found, "xml", fragments, ordered=False)

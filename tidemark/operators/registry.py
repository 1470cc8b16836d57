"""Maintenance jobs on the server registry and its aliases. Tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scale import lookup

SERVER_KEY = ["game", "name", "region", "version"]


@dataclass
class Registry:
    servers: DataFrame
    aliases: DataFrame


def generate_aliases(servers: DataFrame, oce_listed: tuple[str, ...] = ()) -> DataFrame:
    """One bracket title per realm and faction, one listing label per realm.

    The bracket is the locale in the notes ('XX-localised'), else the region. EU and RU
    realms share the EU page set, US realms have their own; of OCE only the listed ones.
    """
    factions = F.explode(F.array(F.lit("Alliance"), F.lit("Horde")))
    suffix = "-localised"
    notes = F.coalesce(F.col("notes"), F.lit(""))
    bracket = F.when(notes.endswith(suffix), F.replace(notes, F.lit(suffix), F.lit(""))) \
        .otherwise(F.col("region"))
    titles = (servers.withColumn("_f", factions)
              .select(F.concat("name", F.lit(" ["), bracket, F.lit(" - "), "version", F.lit("] - "), "_f")
                      .alias("alias"), F.col("id").alias("server_id"), F.lit("g2g").alias("source")))
    page = (F.when(F.col("region").isin("EU", "RU"), "EU").when(F.col("region") == "US", "US")
            .when((F.col("region") == "OCE") & F.col("name").isin(*oce_listed), "US"))
    labels = (servers.withColumn("_p", page).filter("_p IS NOT NULL")
              .select(F.concat(F.lit("("), "_p", F.lit(") "), "version", F.lit(" - "), "name")
                      .alias("alias"), F.col("id").alias("server_id"), F.lit("funpay").alias("source")))
    return titles.unionByName(labels)


def insert_absent(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus batch rows with a new key, one per key."""
    rest = [c for c in batch.columns if c not in keys]
    fresh = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(fresh.join(existing.select(*keys), keys, "left_anti"))


def seeded(servers: DataFrame, seed: DataFrame) -> DataFrame:
    """Adds new realms; a realm that exists and is inactive in the seed becomes inactive."""
    off = seed.filter("NOT is_active").select(*SERVER_KEY).distinct().withColumn("_off", F.lit(True))
    kept = (lookup(servers, off, SERVER_KEY)
            .withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off"))
    return insert_absent(kept.select(*servers.columns), seed.select(*servers.columns), SERVER_KEY)


def twins(servers: DataFrame, old_version: str, new_version: str) -> DataFrame:
    """old_id -> new_id of the realm with the same name and region under the new version."""
    old = servers.filter(F.col("version") == old_version).select(F.col("id").alias("old_id"), "name", "region")
    new = (servers.filter(F.col("version") == new_version).groupBy("name", "region")
           .agg(F.min("id").alias("new_id")))
    return old.join(new, ["name", "region"]).select("old_id", "new_id")


def repoint(aliases: DataFrame, mapping: DataFrame, source: str | None = None) -> DataFrame:
    """Moves aliases of old ids to their new ids, optionally of one source only."""
    moved = F.col("new_id") if source is None else F.when(F.col("source") == source, F.col("new_id"))
    out = lookup(aliases, mapping.withColumnRenamed("old_id", "server_id"), "server_id")
    return out.withColumn("server_id", F.coalesce(moved, "server_id")).select(*aliases.columns)


def repoint_different(aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """redirects(alias_key, target_id): updates only aliases whose target differs; tells which."""
    out = lookup(aliases.withColumn("alias_key", F.lower("alias")), redirects, "alias_key")
    change = F.col("target_id").isNotNull() & ~F.col("server_id").eqNullSafe(F.col("target_id"))
    return (out.withColumn("updated", change)
            .withColumn("server_id", F.when(change, F.col("target_id")).otherwise(F.col("server_id")))
            .select(*aliases.columns, "updated"))


def rename_free(servers: DataFrame, old_version: str, new_version: str) -> DataFrame:
    """Renames a version where no realm has the same name and region under the new one."""
    taken = (servers.filter(F.col("version") == new_version).select("name", "region").distinct()
             .withColumn("_taken", F.lit(True)))
    free = (F.col("version") == old_version) & F.col("_taken").isNull()
    return (lookup(servers, taken, ["name", "region"])
            .withColumn("version", F.when(free, new_version).otherwise(F.col("version")))
            .select(*servers.columns))


def without_servers(facts: DataFrame, subset: DataFrame) -> DataFrame:
    """Facts whose server_id is not in ``subset`` (id)."""
    return lookup(facts, subset.select(F.col("id").alias("server_id")).distinct(), "server_id", "left_anti")


def purge_before(facts: DataFrame, servers: DataFrame, chosen: Column, time: str, cut) -> DataFrame:
    """Deletes facts of the chosen realms older than ``cut``."""
    marked = servers.filter(chosen).select(F.col("id").alias("server_id")).distinct() \
        .withColumn("_purge", F.lit(True))
    return (lookup(facts, marked, "server_id")
            .filter(F.col("_purge").isNull() | (F.col(time) >= F.lit(cut))).drop("_purge"))


def without_collisions(aliases: DataFrame, servers: DataFrame, version: str) -> DataFrame:
    """Drops aliases of a version whose text also belongs to a realm of another version."""
    versions = servers.select(F.col("id").alias("server_id"), (F.col("version") == version).alias("_mine"))
    tagged = lookup(aliases, versions, "server_id")
    others = tagged.filter("NOT _mine").select("alias").distinct().withColumn("_clash", F.lit(True))
    return (tagged.join(others, "alias", "left")
            .filter(~(F.coalesce("_mine", F.lit(False)) & F.col("_clash").isNotNull()))
            .select(*aliases.columns))


def merge_versions(reg: Registry, facts: DataFrame, old_version: str, new_version: str
                   ) -> tuple[Registry, DataFrame]:
    """Merges one version into another: aliases, names, dependent facts, leftovers."""
    aliases = repoint(reg.aliases, twins(reg.servers, old_version, new_version))
    servers = rename_free(reg.servers, old_version, new_version)
    left_over = servers.filter(F.col("version") == old_version)
    return (Registry(servers.filter(F.col("version") != old_version), aliases),
            without_servers(facts, left_over))


def register_alias(reg: Registry, batch: DataFrame, unresolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds aliases that are new; their titles leave the unresolved list."""
    aliases = insert_absent(reg.aliases, batch, ["alias"])
    rest = unresolved.join(aliases.select(F.col("alias").alias("raw_title")), "raw_title", "left_anti")
    return aliases, rest


def drop_by_pattern(aliases: DataFrame, pattern: str, source: str) -> DataFrame:
    return aliases.filter(~(F.col("alias").like(pattern) & (F.col("source") == source)))


def remodel_hardcore(reg: Registry, target_version: str, hardcore_version: str = "Hardcore") -> Registry:
    """Turns the hardcore *version* into a property of the realm.

    With a twin under the target version the twin becomes Hardcore, takes over the aliases
    and the old row is deactivated; without one the row itself changes version.
    """
    pairs = twins(reg.servers, hardcore_version, target_version)
    old = pairs.select(F.col("old_id").alias("id")).distinct().withColumn("_old", F.lit(True))
    new = pairs.select(F.col("new_id").alias("id")).distinct().withColumn("_new", F.lit(True))
    tagged = lookup(lookup(reg.servers, old, "id"), new, "id")
    alone = (F.col("version") == hardcore_version) & F.col("_old").isNull()
    servers = tagged.withColumns({
        "realm_type": F.when(alone | F.col("_new").isNotNull(), "Hardcore").otherwise(F.col("realm_type")),
        "version": F.when(alone, target_version).otherwise(F.col("version")),
        "is_active": F.col("is_active") & F.col("_old").isNull(),
    }).select(*reg.servers.columns)
    return Registry(servers, repoint(reg.aliases, pairs))


def with_game(servers: DataFrame, game: str = "wow_classic") -> DataFrame:
    """Adds the constant game column that widens the key."""
    return servers.withColumn("game", F.lit(game))


def names_in_many_regions(servers: DataFrame) -> DataFrame:
    return (servers.groupBy("name").agg(F.count_distinct("region").alias("regions"))
            .filter("regions > 1"))


def duplicate_keys(servers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return servers.groupBy(*(keys or SERVER_KEY)).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")

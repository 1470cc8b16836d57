"""Resolving free-text titles to registry ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, text
from tidemark.operators.scale import lookup


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases (any case) that point to more than one server."""
    return (aliases.groupBy(F.lower("alias").alias("alias_key"))
            .agg(F.min("server_id").alias("low_id"), F.max("server_id").alias("high_id"))
            .filter("low_id <> high_id"))


def alias_index(aliases: DataFrame, servers: DataFrame) -> DataFrame:
    """alias_key -> alias_id and its registry version; no id for an alias in conflict."""
    clash = F.min("server_id") != F.max("server_id")
    index = aliases.groupBy(F.lower("alias").alias("alias_key")).agg(
        F.when(~clash, F.min("server_id")).alias("alias_id"), clash.alias("alias_conflict"))
    versions = servers.select(F.col("id").alias("alias_id"), F.col("version").alias("alias_version"))
    return index.join(versions, "alias_id", "left")


def name_index(servers: DataFrame) -> DataFrame:
    """(lower name, region, lower version) -> id, active or not; the lowest id of duplicates."""
    return servers.groupBy(F.lower("name").alias("p_name"), F.col("region").alias("p_region"),
                           F.lower("version").alias("p_version")).agg(F.min("id").alias("parsed_id"))


def with_alias(offers: DataFrame, aliases: DataFrame, servers: DataFrame,
               key: str = "alias_text") -> DataFrame:
    """Adds ``alias_id``, ``alias_version`` and ``alias_conflict`` for the trimmed, lower-cased key."""
    keyed = offers.withColumn("alias_key", F.lower(text.strip(F.col(key))))
    return (lookup(keyed, alias_index(aliases, servers), "alias_key")
            .withColumn("alias_conflict", F.coalesce("alias_conflict", F.lit(False)))
            .drop("alias_key"))


def guard_version(game_version: Column) -> Column:
    """The version an alias must agree with, '' when any will do."""
    return F.when(game_version.isin(*fixed.PER_1K_VERSIONS), game_version).otherwise("")


def guarded(offers: DataFrame) -> DataFrame:
    """Keeps an alias hit only if its registry version equals the required one."""
    need = F.lower(guard_version(F.col("game_version")))
    ok = (need == "") | (F.lower("alias_version") == need)
    return offers.withColumn("alias_id", F.when(ok, F.col("alias_id"))).drop("alias_version")


def parsed_title(title: Column, game_version: Column) -> Column:
    """struct(name, region, version) read from the title; four shapes in fixed order.

    A required game version replaces the one in the title. All null when nothing fits.
    """
    gv = guard_version(game_version)
    versioned = gv != ""

    def part(t: Column, pattern: str, i: int) -> Column:
        return text.strip(F.regexp_extract(t, pattern, i))

    def found(name: Column, region: Column, version: Column) -> Column:
        return F.struct(F.lower(name).alias("p_name"), text.registry_region(region).alias("p_region"),
                        F.lower(F.when(versioned, gv).otherwise(version)).alias("p_version"))

    def listed(t: Column) -> Column:
        return text.let(part(t, fixed.REGION_LABEL, 2), lambda body: F.when(
            body.contains(" - "),
            found(text.strip(text.last_dash_right(body)), F.regexp_extract(t, fixed.REGION_LABEL, 1),
                  text.registry_version(text.last_dash_left(body)))))

    def by_word(t: Column) -> Column:
        # realm in front of the region word, trailing dashes removed
        front = part(t, r"(?is)^(.*?)\b(?:EU|US|NA|OCE|KR|TW|SEA|RU)\b", 1)
        front = text.blank_to_null(text.strip(F.regexp_replace(front, r"-+$", "")))
        return found(front, F.regexp_extract(t, fixed.REGION_WORD, 1),
                     text.first_rule(t, fixed.VERSION_RULES, F.lit(None).cast("string")))

    def shapes(t: Column) -> Column:
        return (F.when(t.rlike(fixed.BRACKET_TITLE),
                       found(part(t, fixed.BRACKET_TITLE, 1), part(t, fixed.BRACKET_TITLE, 2),
                             text.registry_version(F.regexp_extract(t, fixed.BRACKET_TITLE, 3))))
                .when(versioned & t.rlike(fixed.BRACKET_REGION_TITLE),
                      found(part(t, fixed.BRACKET_REGION_TITLE, 1),
                            part(t, fixed.BRACKET_REGION_TITLE, 2), gv))
                .when(t.rlike(fixed.REGION_LABEL), listed(t))
                .when(t.rlike(fixed.REGION_WORD), by_word(t)))
    return text.let(text.strip(title), shapes)


def with_parsed(offers: DataFrame, servers: DataFrame, key: str = "alias_text") -> DataFrame:
    """Adds ``parsed_id`` from the title; rows that already have an alias are not parsed."""
    parse = parsed_title(F.col(key), F.col("game_version"))
    if "alias_id" in offers.columns:
        parse = F.when(F.col("alias_id").isNull(), parse)
    keyed = offers.withColumn("_p", parse).withColumns(
        {c: F.col(f"_p.{c}") for c in ("p_name", "p_region", "p_version")})
    return (lookup(keyed, name_index(servers), ["p_name", "p_region", "p_version"])
            .drop("_p", "p_name", "p_region", "p_version"))


def resolved(offers: DataFrame, aliases: DataFrame, servers: DataFrame) -> DataFrame:
    """Sets ``server_id``: as given, else the guarded alias, else the parsed title.

    Keeps ``alias_text`` and ``alias_conflict``. A conflicting alias resolves to nothing.
    """
    key = text.alias_key(F.col("source"), F.col("raw_title"), F.col("display_server"),
                         F.col("server_name"), F.col("faction"))
    out = with_alias(offers.withColumn("alias_text", key), aliases, servers)
    out = with_parsed(guarded(out), servers)
    found = F.when(~F.col("alias_conflict"), F.coalesce("alias_id", "parsed_id"))
    return (out.withColumn("server_id", F.coalesce(F.col("server_id"), found.cast("int")))
            .drop("alias_id", "parsed_id"))


def enriched(offers: DataFrame, servers: DataFrame) -> DataFrame:
    """Overwrites label, realm and realm type from the registry.

    Adds ``slug`` (the lower-cased label, null for unknown ids) and ``server_active``;
    ``source_region`` and ``canonical_region`` are kept for the region override report.
    """
    label = text.canonical_label(F.col("region"), F.col("version"), F.col("realm_type"))
    registry = servers.select(
        F.col("id").alias("server_id"), label.alias("_label"), F.col("name").alias("_name"),
        F.col("region").alias("canonical_region"), F.col("version").alias("registry_version"),
        F.col("realm_type").alias("_type"), F.col("is_active").alias("server_active"))
    region = F.upper(F.regexp_extract(text.strip(F.col("display_server")), r"(?i)^\(([A-Z]{2,})\)", 1))
    return lookup(offers.withColumn("source_region", region), registry, "server_id").withColumns({
        "display_server": F.coalesce("_label", "display_server"),
        "slug": F.lower("_label"),
        "server_name": F.coalesce("_name", "server_name"),
        "realm_type": F.coalesce("_type", F.lit("Normal")),
    }).drop("_label", "_name", "_type")


def realm_versions(servers: DataFrame) -> DataFrame:
    """All active versions per (lower name, region)."""
    return (servers.filter("is_active").groupBy(F.lower("name").alias("realm"), "region")
            .agg(F.sort_array(F.collect_set(F.struct("version", "id"))).alias("versions")))


def alias_coverage(offers: DataFrame, aliases: DataFrame, rows: Column | None = None) -> DataFrame:
    """Alias keys of offers that the alias table lacks, with the number of offers.

    ``rows`` is the number of offers that a row stands for, one unless given.
    """
    weight = F.lit(1) if rows is None else rows
    key = text.alias_key(F.col("source"), F.col("raw_title"), F.col("display_server"),
                         F.col("server_name"), F.col("faction"))
    wanted = (offers.withColumn("_rows", weight.cast("long")).withColumn("alias_text", key)
              .filter("alias_text IS NOT NULL")
              .groupBy(F.lower("alias_text").alias("alias_key"))
              .agg(F.min("alias_text").alias("alias_text"), F.sum("_rows").alias("offers")))
    known = aliases.select(F.lower("alias").alias("alias_key")).distinct()
    return wanted.join(known, "alias_key", "left_anti")

"""Parsing and building of titles, labels, numbers and keys. All native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim all white space, not just blanks."""
    return F.regexp_replace(or_blank(c), r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, "’‘", "''")


def capitalize(c: Column) -> Column:
    """First letter upper case, all others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def first_rule(text: Column, rules, default: Column) -> Column:
    """Value of the first pattern found in ``text``."""
    def branches(t: Column) -> Column:
        branch = F
        for pattern, value in rules:
            branch = branch.when(t.rlike(pattern), F.lit(value))
        return branch.otherwise(default)
    return let(text, branches)


def _sql_map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")"


def canonical_version(c: Column) -> Column:
    """Version name behind an alias; an unknown text stays as it is."""
    names = F.expr(_sql_map(fixed.VERSION_ALIASES))
    return let(c, lambda v: F.coalesce(names[F.lower(strip(v))], v))


def detect_version(c: Column) -> Column:
    return let(clean(c), lambda t: F
               .when(t.contains("season of discovery") | t.rlike(r"\bsod\b|\bseasonal\b"),
                     "Season of Discovery")
               .when(t.contains("anniversary"), "Anniversary")
               .when(t.contains("mop classic") | t.contains("mists of pandaria"), "MoP Classic")
               .when(t.contains("classic era"), "Classic Era")
               .when(t.contains("hardcore"), "Hardcore")
               .otherwise("Classic"))


def registry_version(c: Column) -> Column:
    return first_rule(c, fixed.VERSION_RULES, strip(c))


def registry_region(c: Column) -> Column:
    return let(F.upper(strip(c)), lambda region: F.when(region == "NA", "US").otherwise(region))


def faction_or_default(c: Column) -> Column:
    """Exact faction name, else Alliance when the text hints at it, else Horde."""
    return (F.when(c.isin(*fixed.FACTIONS), c)
            .when(F.lower(or_blank(c)).contains("alli"), "Alliance").otherwise("Horde"))


def stored_faction(c: Column) -> Column:
    return F.when(F.lower(c) == "all", fixed.ALL).otherwise(capitalize(c))


# --- titles -----------------------------------------------------------------------------

def bracket_title(title: Column) -> Column:
    """'Realm [REG - Version] - Faction' -> struct(server, region, version, faction).

    Looser shapes: realm up to the bracket or up to the trailing faction, region from any
    bracket or region word, version from key words.
    """
    return let(strip(title), _bracket_parts)


def _bracket_parts(t: Column) -> Column:
    low = F.lower(t)
    part = lambda i: F.regexp_extract(t, fixed.BRACKET_TITLE, i)
    hint = F.when(low.contains("alliance"), "Alliance").otherwise("Horde")
    strict_faction = F.coalesce(blank_to_null(capitalize(part(4))), hint)
    strict = F.struct(strip(part(1)).alias("server"), F.upper(part(2)).alias("region"),
                      strip(part(3)).alias("version"), strict_faction.alias("faction"))

    end_faction = F.coalesce(
        blank_to_null(capitalize(F.regexp_extract(t, fixed.FACTION_END, 1))), hint)
    dashed = F.regexp_extract(t, r"(?is)^(.*?)\s+-\s+(?:.*\s+-\s+)?(?:alliance|horde)\s*$", 1)
    loose_server = F.coalesce(
        blank_to_null(F.when(t.contains("["), strip(F.substring_index(t, "[", 1)))
                      .otherwise(strip(dashed))), t)
    loose_region = F.upper(F.when(t.rlike(fixed.BRACKET_REGION),
                                  F.regexp_extract(t, fixed.BRACKET_REGION, 1))
                           .otherwise(F.regexp_extract(t, fixed.REGION_WORD, 1)))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    loose = let(loose_region, lambda region: F.struct(
        loose_server.alias("server"), region.alias("region"),
        F.when(low.contains("classic era"), "Classic")
        .when(low.contains("seasonal") | low.contains("season of discovery")
              | padded.contains(" sod "), "Seasonal")
        .when(low.contains("anniversary"), "Anniversary")
        .when(low.contains("hardcore"), "Hardcore")
        .when(region != "", "Classic").otherwise("").alias("version"),
        end_faction.alias("faction")))
    empty = F.struct(F.lit("").alias("server"), F.lit("").alias("region"), F.lit("").alias("version"),
                     F.lit("Horde").alias("faction"))
    return F.when(t == "", empty).when(t.rlike(fixed.BRACKET_TITLE), strict).otherwise(loose)


def last_dash_left(c: Column) -> Column:
    """Text before the last ' - ', or null without one."""
    return F.when(c.contains(" - "), F.regexp_extract(c, r"(?s)^(.*) - ", 1))


def last_dash_right(c: Column) -> Column:
    return F.when(c.contains(" - "), F.substring_index(c, " - ", -1))


def listing_label(display: Column, server: Column) -> Column:
    """'(REG) Version - Realm' -> struct(label, server).

    Without a region the label is cleared; a label equal to the realm is cleared too.
    """
    pattern = r"(?s)^\(([A-Za-z]{2,})\)\s*(.*)$"

    def from_body(raw: Column, body: Column) -> Column:
        version = canonical_version(detect_version(
            F.coalesce(blank_to_null(last_dash_left(body)), body)))
        label = F.concat(F.lit("("), F.upper(F.regexp_extract(raw, pattern, 1)), F.lit(") "), version)
        realm = strip(F.coalesce(last_dash_right(body), body))
        name = let(realm, lambda r: F.when(r != "", r).otherwise(server))
        return let(F.struct(label.alias("label"), name.alias("server")), lambda p: F.struct(
            F.when(p["label"].eqNullSafe(p["server"]), "").otherwise(p["label"]).alias("label"),
            p["server"].alias("server")))

    return let(strip(display), lambda raw: F.when(
        raw.rlike(pattern),
        let(strip(F.regexp_extract(raw, pattern, 2)), lambda body: from_body(raw, body)))
        .otherwise(F.struct(F.lit("").alias("label"), server.alias("server"))))


def title_label(raw_title: Column, display: Column) -> Column:
    """'(REG) Version - Realm - Faction' -> '(REG) Version'; other shapes keep ``display``."""
    pattern = r"(?s)^\(([A-Za-z]{2,})\)\s*(.+)$"
    head = lambda body: F.coalesce(last_dash_left(body), body)
    return let(strip(raw_title), lambda raw: F.when(
        raw.rlike(pattern),
        F.concat(F.lit("("), F.upper(F.regexp_extract(raw, pattern, 1)), F.lit(") "),
                 canonical_version(strip(F.substring_index(
                     let(strip(F.regexp_extract(raw, pattern, 2)), head), " - ", 1)))))
        .otherwise(display))


def group_label(display: Column, server: Column) -> Column:
    """'(reg) version' -> canonical label; a label equal to the realm is cleared."""
    def relabel(ds: Column) -> Column:
        version = canonical_version(strip(F.regexp_extract(ds, fixed.REGION_LABEL, 2)))
        same = (ds != "") & (F.lower(ds) == F.lower(or_blank(server)))
        return (F.when(ds.rlike(fixed.REGION_LABEL),
                       F.concat(F.lit("("), F.upper(F.regexp_extract(ds, fixed.REGION_LABEL, 1)),
                                F.lit(") "), version))
                .when(same, "").otherwise(ds))
    return let(or_blank(display), relabel)


def inject_version(title: Column, game_version: Column) -> Column:
    """'[US]' or '[EU/RU]' -> '[US - version]' for versions other than the default one."""
    injected = F.regexp_replace(title, F.lit(fixed.BRACKET_CODE),
                                F.concat(F.lit("[$1 - "), game_version, F.lit("]")))
    return F.when(game_version != fixed.DEFAULT_GAME_VERSION, injected).otherwise(title)


def latin_title(title: Column, game_version: Column) -> Column:
    """'local (Latin) - Faction' -> 'Latin [RU - Retail] - Faction' for bracketless Retail titles."""
    part = lambda i: strip(F.regexp_extract(title, fixed.BILINGUAL_TITLE, i))
    applies = ((game_version == "Retail") & ~title.contains("[")
               & title.rlike(fixed.BILINGUAL_TITLE))
    return F.when(applies, F.concat(part(1), F.lit(" [RU - Retail] - "), capitalize(part(2)))) \
        .otherwise(title)


def realm_faction(c: Column) -> Column:
    """Split at the last ' - ', else at the last '- '; without either the faction is blank."""
    loose = r"(?s)^(.*)- (.*)$"

    def split(text: Column) -> Column:
        server = (F.when(text.contains(" - "), last_dash_left(text))
                  .when(text.contains("- "), F.regexp_extract(text, loose, 1)).otherwise(text))
        faction = (F.when(text.contains(" - "), last_dash_right(text))
                   .when(text.contains("- "), F.regexp_extract(text, loose, 2)).otherwise(""))
        return F.struct(strip(server).alias("server"), strip(faction).alias("faction"))
    return let(or_blank(c), split)


def first_token_region(c: Column) -> Column:
    first = F.split_part(F.regexp_replace(strip(c), r"\s+", " "), F.lit(" "), F.lit(1))
    return F.when(first == "Oceania", "OC").otherwise(first)


def rebuilt_label(raw_title: Column) -> Column:
    """Bracket title -> struct(label, server); null label when the title has another shape."""
    def rebuild(raw: Column) -> Column:
        part = lambda i: F.regexp_extract(raw, fixed.BRACKET_TITLE, i)
        label = F.concat(F.lit("("), registry_region(part(2)), F.lit(") "),
                         canonical_version(strip(part(3))))
        return F.when(raw.rlike(fixed.BRACKET_TITLE),
                      F.struct(label.alias("label"), strip(part(1)).alias("server")))
    return let(strip(raw_title), rebuild)


def prefixed_label(display: Column, page_region: Column, game_version: Column,
                   page_set: Column) -> Column:
    """'(REG) Version - Realm' for bare realm names of single-region page sets.

    Page set 2 mixes in a fixed list of realms that belong to RU.
    """
    bare = strip(display)
    russian = (page_set == 2) & (game_version == "Retail") & bare.isin(*fixed.RU_RETAIL_REALMS)
    region = F.when((bare != "") & russian, "RU").otherwise(page_region)
    head = F.concat(F.lit("("), region, F.lit(") "), game_version)
    return (F.when(page_region.contains("+"), display)
            .when(bare != "", F.concat(head, F.lit(" - "), bare)).otherwise(head))


# --- labels -----------------------------------------------------------------------------

def canonical_label(region: Column, version: Column, realm_type: Column) -> Column:
    suffix = F.when(realm_type == "Hardcore", fixed.HARDCORE_SUFFIX).otherwise("")
    return F.concat(F.lit("("), region, F.lit(") "), version, suffix)


def is_group_label(c: Column) -> Column:
    return c.rlike(fixed.GROUP_LABEL)


def game_version_of(label: Column) -> Column:
    ds = strip(label)
    body = F.when(ds.rlike(fixed.REGION_LABEL),
                  strip(F.regexp_extract(ds, fixed.REGION_LABEL, 2))).otherwise(ds)
    body = strip(F.replace(body, F.lit(fixed.HARDCORE_SUFFIX), F.lit("")))
    return F.when(body.isin("MoP Classic", "Retail"), body).otherwise("Classic Era")


def version_rank(label: Column) -> Column:
    """Rank of the longest version name in the label."""
    def rank(low: Column) -> Column:
        branch = F
        for name in sorted(fixed.VERSION_RANKS, key=len, reverse=True):
            branch = branch.when(low.contains(name.lower()), F.lit(fixed.VERSION_RANKS[name]))
        return branch.otherwise(F.lit(fixed.UNKNOWN_VERSION_RANK))
    return let(F.lower(strip(label)), rank)


def split_label(label: Column) -> Column:
    """'(REG) Version' -> struct(region, version), both null for another shape."""
    matched = label.rlike(fixed.REGION_LABEL)
    return F.struct(
        F.when(matched, F.upper(F.regexp_extract(label, fixed.REGION_LABEL, 1))).alias("region"),
        F.when(matched, strip(F.regexp_extract(label, fixed.REGION_LABEL, 2))).alias("version"))


def without_region(label: Column) -> Column:
    return F.regexp_replace(label, r"^\([^)]*\)\s*", "")


def server_slug(raw: Column) -> Column:
    """Any listing title -> struct(slug, display): realm name, with '(REGION)' behind it."""
    def named(text: Column) -> Column:
        name = strip(F.regexp_replace(text, r"^\([^)]+\)\s*", ""))
        name = strip(F.regexp_replace(strip(F.substring_index(name, " - ", -1)), r"#\S+\s*", ""))
        return F.struct(F.coalesce(blank_to_null(name), text).alias("name"),
                        strip(F.regexp_extract(text, r"^\(([^)]+)\)\s*", 1)).alias("region"))

    def shown(p: Column) -> Column:
        full = F.concat(p["name"], F.lit(" ("), p["region"], F.lit(")"))
        return F.struct(F.lower(p["name"]).alias("slug"),
                        F.when(p["region"] != "", full).otherwise(p["name"]).alias("display"))

    unknown = F.struct(F.lit("unknown").alias("slug"), F.lit("unknown").alias("display"))
    return let(strip(raw), lambda t: F.when(t == "", unknown).otherwise(let(named(t), shown)))


# --- keys -------------------------------------------------------------------------------

def alias_key(source: Column, raw_title: Column, display: Column, server: Column,
              faction: Column) -> Column:
    """Text under which a listing is looked up in the alias table, or null."""
    name = fold_apostrophes(or_blank(server))

    def key(ds: Column) -> Column:
        labelled = ds.rlike(r"(?i)^\([A-Z]{2,}\)\s*.+$")
        region = F.upper(F.regexp_extract(ds, fixed.REGION_LABEL, 1))
        version = fold_apostrophes(strip(F.regexp_extract(ds, fixed.REGION_LABEL, 2)))
        rebuilt = F.when(labelled & (name != ""),
                         F.concat(name, F.lit(" ["), region, F.lit(" - "), version,
                                  F.lit("] - "), faction))
        tail = F.when(name != "", F.concat(F.lit(" - "), name)).otherwise("")
        return (F.when(source == "g2g", F.coalesce(blank_to_null(raw_title), rebuilt))
                .when(source.isin("funpay", "playerauctions") & labelled,
                      F.concat(F.lit("("), region, F.lit(") "), version, tail)))
    return let(strip(display), key)


# --- numbers and small lookups ----------------------------------------------------------

def parse_number(raw: Column) -> Column:
    """Number in any locale; the last separator is the decimal one."""
    def number(kept: Column) -> Column:
        comma, dot = F.instr(F.reverse(kept), ","), F.instr(F.reverse(kept), ".")
        one_kind = F.translate(F.regexp_replace(kept, r"[.,](?=.*[.,])", ""), ",", ".")
        comma_last = F.translate(F.translate(kept, ".", ""), ",", ".")
        dot_last = F.translate(kept, ",", "")
        return (F.when((comma == 0) | (dot == 0), one_kind)
                .when(comma < dot, comma_last).otherwise(dot_last)).try_cast("double")
    return let(F.regexp_replace(raw, r"[^\d.,]", ""), number)


def parse_amount(raw: Column) -> Column:
    """Digits of the text as a number; nothing or zero counts as 1."""
    digits = F.regexp_replace(or_blank(raw), r"\D", "").try_cast("long")
    return F.when(digits > 0, digits).otherwise(F.lit(1).cast("long"))


def seller_name(*candidates: Column) -> Column:
    """First usable candidate, else 'unknown'."""
    def usable(c: Column) -> Column:
        name = F.trim(F.regexp_replace(or_blank(c), r"[\u200b\u00a0\s]+", " "))
        return F.when(~F.lower(name).isin(*fixed.BLANK_SELLERS), name)
    return F.coalesce(*[usable(c) for c in candidates], F.lit("unknown"))


def currency_code(symbol: Column) -> Column:
    return F.coalesce(F.expr(_sql_map(fixed.CURRENCY_SYMBOLS))[symbol], F.lit("USD"))


def flat_list(c: Column) -> Column:
    """Null -> empty array; nested arrays flattened one level."""
    flat = F.flatten(F.transform(c, lambda x: F.coalesce(x, F.array())))
    return F.coalesce(flat, F.array().cast("array<string>"))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""Queries for title resolution, validation and quarantine."""

from pyspark.sql import functions as F

from tidemark.functions import text, times
from tidemark.operators import extended, quality, resolve
from tidemark.operators.scale import lookup
from tidemark.plans.catalog import query, view
from tidemark.session import materialize
from tidemark.sources.tables import normal_offers

_TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ') AS {0}"
_REGISTRY_VERSION = """CASE WHEN regexp_matches({0}, '(?i)season\\s+of\\s+discovery|\\bseasonal\\b|\\bsod\\b')
      THEN 'Season of Discovery' WHEN lower({0}) LIKE '%anniversary%' THEN 'Anniversary'
      WHEN regexp_matches({0}, '(?i)classic\\s+era') THEN 'Classic Era'
      WHEN regexp_matches({0}, '(?i)\\bclassic\\b') THEN 'Classic' ELSE trim({0}) END"""

# phase 0: the label per source, and the price
view("sql_labels", r"""
SELECT id, source, raw_title, game_version, amount_gold, fetched_at, arrival,
       CASE WHEN trim(faction) = '' THEN 'Horde' ELSE faction END AS faction,
       CASE WHEN lower(trim(faction)) NOT IN ('', 'horde', 'alliance')
              THEN concat('unknown_faction:', chr(39), faction, chr(39))
            WHEN trim(server_name) = '' AND label = '' THEN 'empty_server_title'
            WHEN price_per_1k <= 0 THEN 'zero_price' END AS own_reason,
       label, server_name, price_per_1k
FROM (SELECT id, source, raw_title, game_version, amount_gold, fetched_at, arrival, faction,
        CASE WHEN raw_price > 0 THEN round(CASE raw_price_unit WHEN 'per_lot' THEN raw_price / lot_size * 1000
               WHEN 'per_1k' THEN raw_price ELSE raw_price * 1000 END, 6) ELSE price_per_1k END AS price_per_1k,
        CASE WHEN source = 'funpay' AND display_server LIKE '(%) % - %' THEN
               concat('(', regexp_extract(display_server, '^\(([A-Z]+)\)', 1), ') ',
                 replace(regexp_extract(display_server, '^\([A-Z]+\) (.*) - ', 1), 'Retail', 'Classic'))
             WHEN source = 'playerauctions' THEN
               regexp_extract(raw_title, '^(\([A-Z]+\) [^-]*[^ -]) - ', 1) ELSE '' END AS label,
        CASE WHEN source = 'funpay' THEN CASE WHEN display_server LIKE '(%) % - %'
               THEN regexp_extract(display_server, '.* - (.*)$', 1) ELSE server_name END
             ELSE server_name END AS server_name
      FROM listings)
""")

view("sql_alias_index", """
SELECT lower(alias) AS alias_key, CASE WHEN min(server_id) = max(server_id) THEN min(server_id) END AS alias_id,
       min(server_id) <> max(server_id) AS clash FROM aliases GROUP BY 1
""")

view("sql_names", """
SELECT lower(name) AS p_name, region AS p_region, lower(version) AS p_version, min(id) AS parsed_id
FROM servers GROUP BY 1, 2, 3
""")

view("sql_keys", r"""
SELECT *, CASE WHEN game_version IN ('MoP Classic', 'Retail') THEN lower(game_version) ELSE '' END AS gv,
       CASE source WHEN 'g2g' THEN nullif(raw_title, '')
         ELSE CASE WHEN label <> '' THEN concat(label, ' - ', replace(server_name, '’', chr(39))) END END AS alias_text
FROM sql_labels
""")

view("sql_resolved", f"""
SELECT k.*, coalesce(clash, FALSE) AS alias_conflict, alias_id, guarded_id, parsed_id,
       CASE WHEN NOT coalesce(clash, FALSE) THEN coalesce(guarded_id, parsed_id) END AS server_id
FROM (SELECT *, CASE WHEN source = 'g2g' THEN lower(regexp_extract(alias_text, '^(.+?)\\s*\\[', 1))
               ELSE lower(regexp_extract(alias_text, '.* - (.*)$', 1)) END AS k_name,
             CASE WHEN source = 'g2g' THEN replace(regexp_extract(alias_text, '\\[([A-Z]+)', 1), 'NA', 'US')
               ELSE regexp_extract(alias_text, '^\\(([A-Z]+)\\)', 1) END AS k_region,
             CASE WHEN gv <> '' THEN gv
               WHEN source = 'g2g' THEN lower({_REGISTRY_VERSION.format(
                   "regexp_extract(alias_text, ' - (.*)\\]', 1)")})
               ELSE lower({_REGISTRY_VERSION.format("regexp_extract(alias_text, '^\\([A-Z]+\\) (.*) - ', 1)")})
               END AS k_version,
             CASE WHEN gv = '' OR lower(sv_version) = gv THEN alias_id END AS guarded_id
      FROM (SELECT * FROM sql_keys LEFT JOIN sql_alias_index ON alias_key = lower(trim(alias_text)))
      LEFT JOIN server_names ON sv_id = alias_id) k
LEFT JOIN sql_names ON p_name = k_name AND p_region = k_region AND p_version = k_version AND guarded_id IS NULL
""")

view("sql_tagged", """
SELECT id, source, faction, raw_title, game_version, amount_gold, fetched_at, arrival, price_per_1k, alias_text,
       alias_conflict, label AS given_label, server_id,
       CASE WHEN s.sid IS NOT NULL THEN concat('(', region, ') ', version,
              CASE WHEN realm_type = 'Hardcore' THEN ' · Hardcore' ELSE '' END) ELSE label END AS display_server,
       CASE WHEN s.sid IS NOT NULL THEN s.name ELSE server_name END AS server_name,
       CASE WHEN label LIKE '(%' THEN regexp_extract(label, '^\\(([A-Z]+)\\)', 1) ELSE '' END AS source_region,
       region AS canonical_region, version AS registry_version,
       CASE WHEN own_reason IS NOT NULL THEN own_reason
            WHEN server_id IS NULL AND alias_conflict THEN 'alias_conflict'
            WHEN server_id IS NULL THEN 'unresolved_server'
            WHEN NOT is_active THEN 'deprecated_version' END AS reason
FROM sql_resolved LEFT JOIN (SELECT id AS sid, name, region, version, realm_type, is_active FROM servers) s
  ON s.sid = server_id
""", lambda t: quality.normalize(normal_offers(t.listings), t.aliases, t.servers).tagged)

view("sql_rejected", """
SELECT id AS raw_id, source, reason, coalesce(nullif(raw_title, ''), given_label) AS raw_title,
       price_per_1k AS price, fetched_at AS ts,
       CASE reason WHEN 'unresolved_server' THEN concat('server_name=', server_name, ' display_server=', display_server)
         WHEN 'deprecated_version' THEN concat('server=', server_name, ' version=', registry_version) ELSE '' END
         AS details
FROM sql_tagged WHERE reason IS NOT NULL
""", lambda t: quality.Normalized(t.sql_tagged).rejected)


def _rejects(t, reason: str):
    return t.sql_rejected.filter(F.col("reason").startswith(reason)).select(
        "raw_id", "source", "reason", "raw_title", "price", "details")


def _rejects_sql(reason: str) -> str:
    return ("SELECT raw_id, source, reason, raw_title, price, details FROM sql_rejected "
            f"WHERE reason LIKE '{reason}%'")


# --- joins ------------------------------------------------------------------------------

def _keyed_titles(t, listings=None):
    """One row per different title with its alias key; text is parsed once per title. ``offers`` counts its rows."""
    rows = quality.with_plain_titles(normal_offers(t.listings)) if listings is None else listings
    titles = rows.groupBy(*quality.TITLE).agg(F.count(F.lit(1)).alias("offers"))
    titles = quality.with_default_faction(quality.relabelled(titles.withColumn("title_key", quality.title_key())))
    return titles.withColumn("alias_text", text.alias_key(
        F.col("source"), F.col("raw_title"), F.col("display_server"), F.col("server_name"), F.col("faction")))


def _with_aliases(t, *columns):
    """id and columns of every listing, with the alias of its title."""
    listings = quality.with_plain_titles(normal_offers(t.listings))
    titles = materialize(resolve.guarded(resolve.with_alias(
        _keyed_titles(t, listings), t.aliases, t.servers).withColumn("found_id", F.col("alias_id")))
        .select("title_key", *columns), "alias-titles")
    return lookup(listings.select("id", quality.title_key().alias("title_key")), titles, "title_key").select("id", *columns)


@query("j1_alias_lookup", "SELECT id, alias_text, alias_id, alias_conflict FROM sql_resolved")
def _(t):
    return _with_aliases(t, "alias_text", "found_id", "alias_conflict").withColumnRenamed("found_id", "alias_id")


@query("j2_guarded_alias", "SELECT id, game_version, guarded_id AS alias_id FROM sql_resolved")
def _(t):
    return _with_aliases(t, "game_version", "alias_id")


@query("j3_parsed_title", f"""
SELECT order_no, line_no, parsed_id FROM (
  SELECT order_no, line_no, CASE WHEN shape IN (0, 3, 4, 6) OR (shape = 1 AND gv <> '')
           THEN CASE WHEN shape = 4 AND realm LIKE '%Aman%' THEN NULL ELSE lower(realm) END END AS k_name,
         CASE shape WHEN 6 THEN 'US' ELSE region END AS k_region,
         CASE WHEN gv <> '' THEN lower(gv) WHEN shape = 3 THEN 'season of discovery'
              WHEN shape = 6 THEN 'classic era' ELSE lower({_REGISTRY_VERSION.format("version")}) END AS k_version
  FROM (SELECT *, (order_no + line_no) % 8 AS shape,
               CASE WHEN game_version <> 'Classic Era' THEN game_version ELSE '' END AS gv FROM titles))
LEFT JOIN sql_names ON p_name = k_name AND p_region = k_region AND p_version = k_version""")
def _(t):
    return resolve.with_parsed(t.titles, t.servers, "title").select("order_no", "line_no", "parsed_id")


@query("j4_registry_enrichment", """
SELECT id, concat('(', sv_region, ') ', sv_version, CASE WHEN sv_type = 'Hardcore' THEN ' · Hardcore' ELSE '' END)
         AS display_server, sv_name AS server_name, sv_type AS realm_type, sv_region AS canonical_region
FROM raw_offers JOIN server_names ON server_id = sv_id""")
def _(t):
    rows = t.raw_offers.withColumns({"display_server": F.lit(""), "server": F.lit(""), "server_name": F.lit("?")})
    return resolve.enriched(rows, t.servers).select("id", "display_server", "server_name", "realm_type",
                                                    "canonical_region")


@query("j13_alias_coverage", """
SELECT lower(alias_text) AS alias_key, min(alias_text) AS alias_text, count(*) AS offers FROM sql_keys
WHERE alias_text IS NOT NULL AND lower(alias_text) NOT IN (SELECT lower(alias) FROM known_aliases) GROUP BY 1""")
def _(t):
    return resolve.alias_coverage(_keyed_titles(t), t.known_aliases, F.col("offers"))


@query("u4_except", """
SELECT DISTINCT lower(alias_text) AS alias_key FROM sql_keys WHERE alias_text IS NOT NULL
EXCEPT SELECT lower(alias) FROM known_aliases""")
def _(t):
    keys = _keyed_titles(t).filter("alias_text IS NOT NULL").select(F.lower("alias_text").alias("alias_key"))
    return keys.subtract(t.known_aliases.select(F.lower("alias")))


@query("j14_realm_versions", """
SELECT lower(name) AS realm, region, string_agg(concat(version, '=', id), ',' ORDER BY version, id) AS versions
FROM servers WHERE is_active GROUP BY 1, 2""")
def _(t):
    listed = F.transform("versions", lambda v: F.concat_ws("=", v["version"], v["id"]))
    return resolve.realm_versions(t.servers).withColumn("versions", F.array_join(listed, ","))


@query("a20_alias_conflicts", """
SELECT lower(alias) AS alias_key, min(server_id) AS low_id, max(server_id) AS high_id FROM aliases
GROUP BY 1 HAVING min(server_id) <> max(server_id)""")
def _(t):
    return resolve.alias_conflicts(t.aliases)


# --- quarantine -------------------------------------------------------------------------

@query("v1_unknown_faction", _rejects_sql("unknown_faction"))
def _(t):
    return _rejects(t, "unknown_faction")


@query("v2_empty_title", _rejects_sql("empty_server_title"))
def _(t):
    return _rejects(t, "empty_server_title")


@query("v3_zero_price", _rejects_sql("zero_price"))
def _(t):
    return _rejects(t, "zero_price")


@query("v4_unresolved", _rejects_sql("unresolved_server"))
def _(t):
    return _rejects(t, "unresolved_server")


@query("v5_degraded", """
SELECT id, CASE WHEN own_reason IS NOT NULL THEN own_reason
             WHEN source = 'g2g' AND regexp_matches(raw_title, '\\[[A-Z]+ - ') THEN NULL
             WHEN source <> 'g2g' AND label <> '' THEN NULL ELSE 'unresolved_server' END AS reason,
       CASE WHEN source <> 'g2g' THEN label WHEN regexp_matches(raw_title, '\\[[A-Z]+ - ')
         THEN concat('(', replace(regexp_extract(raw_title, '\\[([A-Z]+) - ', 1), 'NA', 'US'), ') ',
                     regexp_extract(raw_title, '\\[[A-Z]+ - ([^\\]]*)\\]', 1)) ELSE '' END AS display_server
FROM sql_labels""")
def _(t):
    out = quality.normalize(normal_offers(t.listings), t.aliases, t.servers, registry_available=False)
    return out.tagged.select("id", "reason", "display_server")


@query("v6_deprecated", _rejects_sql("deprecated_version"))
def _(t):
    return _rejects(t, "deprecated_version")


@query("v7_region_override", """
SELECT id, source, source_region, canonical_region, server_name FROM sql_tagged
WHERE server_id IS NOT NULL AND source_region <> '' AND source_region <> canonical_region""")
def _(t):
    return quality.Normalized(t.sql_tagged).region_overrides


@query("v8_row_accounting", """
SELECT (SELECT count(*) FROM listings) AS input, (SELECT count(*) FROM sql_rejected) AS rejected,
       (SELECT count(DISTINCT (source, id)) FROM sql_tagged WHERE reason IS NULL) AS clean,
       (SELECT count(*) FROM sql_tagged WHERE reason IS NULL)
         - (SELECT count(DISTINCT (source, id)) FROM sql_tagged WHERE reason IS NULL) AS duplicates""")
def _(t):
    return quality.Normalized(t.sql_tagged).accounting


@query("v9_alias_conflict", _rejects_sql("alias_conflict"))
def _(t):
    return _rejects(t, "alias_conflict")


@query("v_clean_offers", """
SELECT id, source, server_id, display_server, server_name, faction, price_per_1k, amount_gold, arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY arrival) AS rn FROM sql_tagged
  WHERE reason IS NULL) WHERE rn = 1""")
def _(t):
    return quality.Normalized(t.sql_tagged).clean_of(
        "id", "source", "server_id", "display_server", "server_name", "faction", "price_per_1k", "amount_gold",
        "arrival")


@query("a18_unresolved_titles", f"""
SELECT alias_text AS raw_title, arg_min(source, (fetched_at, source)) AS source,
       strftime(min(fetched_at), '%Y-%m-%dT%H:%M:%SZ') AS first_seen, count(*) AS count
FROM sql_tagged WHERE reason = 'unresolved_server' AND alias_text IS NOT NULL GROUP BY 1""")
def _(t):
    return quality.unresolved_titles(t.sql_tagged).withColumn("first_seen", times.utc_text(F.col("first_seen")))


@query("a19_quarantine_summary", "SELECT source, reason, count(*) AS rows FROM sql_rejected GROUP BY 1, 2")
def _(t):
    return quality.quarantine_summary(t.sql_rejected)


@query("l6_quarantine_tail", f"""
SELECT raw_id, source, reason, {_TIME.format('ts')} FROM (
  SELECT * FROM sql_rejected ORDER BY ts DESC, raw_id, source, reason, price, raw_title LIMIT 500)""")
def _(t):
    return quality.quarantine_tail(t.sql_rejected).select("raw_id", "source", "reason",
                                                          times.utc_text(F.col("ts")).alias("ts"))


@query("d8_kpis", """
SELECT round(avg(CASE WHEN reason IS NOT NULL THEN 1.0 ELSE 0 END), 8) AS quarantine_rate,
       round(avg(CASE WHEN server_id IS NOT NULL THEN 1.0 ELSE 0 END), 8) AS alias_coverage,
       (SELECT count(*) FROM (SELECT server_id FROM sql_tagged WHERE reason IS NULL GROUP BY 1 HAVING count(*) > 2))
         AS liquid_entities,
       (SELECT count(DISTINCT server_id) FROM sql_tagged WHERE reason IS NULL) AS entities,
       round((SELECT count(*) FROM (SELECT server_id FROM sql_tagged WHERE reason IS NULL AND source = 'g2g'
              INTERSECT SELECT server_id FROM sql_tagged WHERE reason IS NULL AND source = 'funpay'))
         / (SELECT count(DISTINCT server_id) FROM sql_tagged WHERE reason IS NULL), 8) AS cross_source_overlap
FROM sql_tagged""")
def _(t):
    out = extended.kpis(t.sql_tagged)
    return out.withColumns({c: F.round(c, 8) for c in ("quarantine_rate", "alias_coverage",
                                                       "cross_source_overlap")})

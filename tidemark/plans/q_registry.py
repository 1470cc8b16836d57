"""Queries for registry maintenance jobs. Each returns a table as it is after the job."""

from pyspark.sql import functions as F

from tidemark.operators import registry
from tidemark.operators.registry import Registry
from tidemark.plans.catalog import query, view

OCE = ("Realm 4", "Realm 9", "Realm 14", "Realm 21")

# realms that exist under two versions
view("sql_twins", """
SELECT o.id AS old_id, min(n.id) AS new_id FROM servers o JOIN servers n ON o.name = n.name
   AND o.region = n.region AND n.version = 'Classic' AND o.version = 'Anniversary' GROUP BY 1
""", lambda t: registry.twins(t.servers, "Anniversary", "Classic"))

OLD, NEW = "Anniversary", "Classic"
_COLLIDING = "SELECT old_id FROM sql_twins"


def _reg(t):
    return Registry(t.servers, t.aliases)


@query("j19_alias_generation", "SELECT alias, server_id, source FROM aliases")
def _(t):
    return registry.generate_aliases(t.servers, OCE)


@query("j10_repoint", """
SELECT alias, coalesce(new_id, server_id) AS server_id, source FROM aliases LEFT JOIN sql_twins ON old_id = server_id
""")
def _(t):
    return registry.repoint(t.aliases, t.sql_twins)


@query("j10_repoint_one_source", """
SELECT alias, CASE WHEN source = 'g2g' THEN coalesce(new_id, server_id) ELSE server_id END AS server_id, source
FROM aliases LEFT JOIN sql_twins ON old_id = server_id""")
def _(t):
    return registry.repoint(t.aliases, t.sql_twins, "g2g")


@query("j8_rename_free", f"""
SELECT id, name, region, CASE WHEN version = '{OLD}' AND id NOT IN ({_COLLIDING}) THEN '{NEW}' ELSE version END
  AS version FROM servers""")
def _(t):
    return registry.rename_free(t.servers, OLD, NEW).select("id", "name", "region", "version")


@query("j9_delete_dependent", """
SELECT id, server_id FROM offers WHERE server_id NOT IN (SELECT id FROM servers WHERE version = 'Classic Era')""")
def _(t):
    return registry.without_servers(t.offers, t.servers.filter("version = 'Classic Era'")).select("id", "server_id")


@query("j11_purge_before", """
SELECT id, server_id FROM offers WHERE fetched_at >= TIMESTAMP '1998-06-01 00:00:00' OR server_id NOT IN
  (SELECT id FROM servers WHERE game = 'wow_retail' OR (game = 'wow_classic' AND version = 'MoP Classic'))""")
def _(t):
    chosen = (F.col("game") == "wow_retail") | ((F.col("game") == "wow_classic")
                                                & (F.col("version") == "MoP Classic"))
    cut = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return registry.purge_before(t.offers, t.servers, chosen, "fetched_at", cut).select("id", "server_id")


# aliases without the version in the text, so that realms of several versions collide
view("short_aliases", """
SELECT concat(name, ' [', region, '] - ', side) AS alias, id AS server_id, 'g2g' AS source
FROM servers, (VALUES ('Alliance'), ('Horde')) AS f(side)
""", lambda t: t.servers.withColumn("side", F.explode(F.array(F.lit("Alliance"), F.lit("Horde")))).select(
    F.concat("name", F.lit(" ["), "region", F.lit("] - "), "side").alias("alias"),
    F.col("id").alias("server_id"), F.lit("g2g").alias("source")))


@query("j12_alias_collisions", """
SELECT alias, server_id, source FROM short_aliases WHERE NOT (
  server_id IN (SELECT id FROM servers WHERE version = 'Anniversary')
  AND alias IN (SELECT alias FROM short_aliases WHERE server_id IN
                (SELECT id FROM servers WHERE version <> 'Anniversary')))""")
def _(t):
    return registry.without_collisions(t.short_aliases, t.servers, "Anniversary")


@query("a21_names_in_many_regions", """
SELECT name, count(DISTINCT region) AS regions FROM servers GROUP BY 1 HAVING count(DISTINCT region) > 1""")
def _(t):
    return registry.names_in_many_regions(t.servers)


@query("a21_duplicate_keys", """
SELECT game, name, region, version, count(*) AS rows FROM servers GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def _(t):
    return registry.duplicate_keys(t.servers)


@query("m1_merge_versions", f"""
SELECT 'server' AS kind, CAST(id AS BIGINT) AS id, version AS label FROM servers WHERE version <> '{OLD}' UNION ALL
SELECT 'server', id, '{NEW}' FROM servers WHERE version = '{OLD}' AND id NOT IN ({_COLLIDING}) UNION ALL
SELECT 'alias', coalesce(new_id, server_id), alias FROM aliases LEFT JOIN sql_twins ON old_id = server_id UNION ALL
SELECT 'offer', server_id, id FROM offers WHERE server_id NOT IN ({_COLLIDING})""")
def _(t):
    reg, facts = registry.merge_versions(_reg(t), t.offers, OLD, NEW)
    part = lambda df, kind, key, label: df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
    return (part(reg.servers, "server", "id", "version").unionByName(part(reg.aliases, "alias", "server_id", "alias"))
            .unionByName(part(facts, "offer", "server_id", "id")))


@query("m2_register_alias", """
SELECT alias, server_id, source FROM aliases UNION ALL
SELECT alias, min(server_id), 'admin' FROM (SELECT concat('new ', name) AS alias, id AS server_id FROM servers)
WHERE alias NOT IN (SELECT alias FROM aliases) GROUP BY 1""")
def _(t):
    batch = t.servers.select(F.concat(F.lit("new "), "name").alias("alias"), F.col("id").alias("server_id"),
                             F.lit("admin").alias("source"))
    again = t.aliases.limit(0).unionByName(batch).unionByName(t.aliases.withColumn("server_id", F.lit(0)))
    return registry.register_alias(_reg(t), again, batch.select(F.col("alias").alias("raw_title")))[0]


@query("m2_unresolved_left", """
SELECT alias AS raw_title FROM short_aliases WHERE alias NOT IN (
  SELECT alias FROM aliases UNION SELECT alias FROM short_aliases WHERE server_id % 2 = 0)""")
def _(t):
    batch = t.short_aliases.filter("server_id % 2 = 0")
    return registry.register_alias(_reg(t), batch, t.short_aliases.select(F.col("alias").alias("raw_title")))[1]


@query("m3_repoint_different", """
SELECT alias, coalesce(target_id, server_id) AS server_id, source,
       target_id IS NOT NULL AND target_id IS DISTINCT FROM server_id AS updated
FROM aliases LEFT JOIN (SELECT lower(alias) AS alias_key, CASE WHEN server_id % 2 = 0 THEN min(server_id)
       ELSE min(server_id) + 1 END AS target_id FROM aliases WHERE server_id % 3 = 0 GROUP BY 1, server_id % 2)
  ON alias_key = lower(alias)""")
def _(t):
    redirects = (t.aliases.filter("server_id % 3 = 0")
                 .groupBy(F.lower("alias").alias("alias_key"), (F.col("server_id") % 2).alias("odd"))
                 .agg(F.min("server_id").alias("low"))
                 .select("alias_key", (F.col("low") + F.col("odd")).alias("target_id")))
    return registry.repoint_different(t.aliases, redirects)


@query("m4_drop_by_pattern", """
SELECT alias, server_id, source FROM aliases WHERE NOT (alias LIKE '% - Retail] - %' AND source = 'g2g')""")
def _(t):
    return registry.drop_by_pattern(t.aliases, "% - Retail] - %", "g2g")


@query("m5_remodel_hardcore", f"""
SELECT 'server' AS kind, id, concat(CASE WHEN version = '{OLD}' AND id NOT IN ({_COLLIDING}) THEN '{NEW}'
         ELSE version END, '/', CASE WHEN (version = '{OLD}' AND id NOT IN ({_COLLIDING}))
           OR id IN (SELECT new_id FROM sql_twins) THEN 'Hardcore' ELSE realm_type END, '/',
         CASE WHEN is_active AND id NOT IN ({_COLLIDING}) THEN 'on' ELSE 'off' END) AS label FROM servers UNION ALL
SELECT 'alias', coalesce(new_id, server_id), alias FROM aliases LEFT JOIN sql_twins ON old_id = server_id""")
def _(t):
    reg = registry.remodel_hardcore(_reg(t), NEW, OLD)
    label = F.concat("version", F.lit("/"), "realm_type", F.lit("/"),
                     F.when(F.col("is_active"), "on").otherwise("off"))
    return (reg.servers.select(F.lit("server").alias("kind"), "id", label.alias("label"))
            .unionByName(reg.aliases.select(F.lit("alias").alias("kind"), F.col("server_id").alias("id"),
                                            F.col("alias").alias("label"))))


@query("m6_add_game", "SELECT id, 'wow_classic' AS game, name, region, version FROM servers")
def _(t):
    return registry.with_game(t.servers.drop("game")).select("id", "game", "name", "region", "version")


@query("s14_seed_load", """
SELECT game, name, region, version, is_active FROM servers WHERE id % 2 = 0 AND (game, name, region, version)
  NOT IN (SELECT (game, name, region, version) FROM servers WHERE id % 4 = 0) UNION ALL
SELECT game, name, region, version, FALSE FROM servers WHERE id % 2 = 0 AND (game, name, region, version)
  IN (SELECT (game, name, region, version) FROM servers WHERE id % 4 = 0) UNION ALL
SELECT 'wow_classic', name, 'XX', 'Classic', TRUE FROM servers GROUP BY name""")
def _(t):
    seed = (t.servers.filter("id % 4 = 0").withColumn("is_active", F.lit(False))
            .unionByName(t.servers.withColumns({"game": F.lit("wow_classic"), "region": F.lit("XX"),
                                                "version": F.lit("Classic"), "is_active": F.lit(True)})))
    return registry.seeded(t.servers.filter("id % 2 = 0"), seed).select("game", "name", "region", "version",
                                                                        "is_active")

"""Views that give the driver's retail tables the columns of the market model.

The SQL is plain enough for Spark and for the checking engine; views that exercise an
operator are built with that operator on Spark.
"""

from tidemark.functions import prices
from tidemark.operators import registry
from tidemark.plans.catalog import VIEWS, view

view("servers", """
SELECT CAST(s_suppkey AS INT) AS id,
       CASE WHEN (n_nationkey + 3 * (s_suppkey % 2)) % 6 = 5 THEN 'wow_retail' ELSE 'wow_classic' END AS game,
       concat(CASE WHEN CAST(floor(s_suppkey / 2) AS BIGINT) % 10 = 3 THEN concat('Aman', chr(39), 'Realm ')
              ELSE 'Realm ' END, CAST(floor(s_suppkey / 2) AS BIGINT)) AS name,
       CASE r_regionkey WHEN 0 THEN 'EU' WHEN 1 THEN 'US' WHEN 2 THEN 'RU' WHEN 3 THEN 'OCE' ELSE 'KR' END
         AS region,
       CASE (n_nationkey + 3 * (s_suppkey % 2)) % 6 WHEN 0 THEN 'Anniversary' WHEN 1 THEN 'Season of Discovery'
         WHEN 2 THEN 'Classic Era' WHEN 3 THEN 'Classic' WHEN 4 THEN 'MoP Classic' ELSE 'Retail' END AS version,
       CASE WHEN s_suppkey % 7 = 3 THEN 'Hardcore' ELSE 'Normal' END AS realm_type,
       s_suppkey % 11 <> 5 AS is_active,
       CASE WHEN s_suppkey % 9 = 0 THEN 'DE-localised' ELSE '' END AS notes
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

view("aliases", """
SELECT concat(name, ' [', CASE WHEN notes LIKE '%-localised' THEN replace(notes, '-localised', '')
              ELSE region END, ' - ', version, '] - ', side) AS alias, id AS server_id, 'g2g' AS source
FROM servers, (VALUES ('Alliance'), ('Horde')) AS f(side)
UNION ALL
SELECT concat('(', CASE WHEN region IN ('EU', 'RU') THEN 'EU' ELSE 'US' END, ') ', version, ' - ', name),
       id, 'funpay'
FROM servers WHERE region IN ('EU', 'RU', 'US') OR (region = 'OCE' AND name IN
      ('Realm 4', 'Realm 9', 'Realm 14', 'Realm 21'))
""", lambda t: registry.generate_aliases(t.servers, ("Realm 4", "Realm 9", "Realm 14", "Realm 21")))

# a registry with a gap, for what reports missing aliases: those of one source only
view("known_aliases", "SELECT alias, server_id, source FROM aliases WHERE source = 'g2g'",
     lambda t: t.aliases.filter("source = 'g2g'"))

view("server_names", """
SELECT id AS sv_id, name AS sv_name, region AS sv_region, version AS sv_version, realm_type AS sv_type,
       notes AS sv_notes FROM servers
""")

view("raw_offers", """
SELECT concat(CASE l_returnflag WHEN 'A' THEN 'fp_' WHEN 'N' THEN 'g2g_' ELSE 'pa_' END,
              l_orderkey, '-', l_linenumber) AS id,
       CASE l_returnflag WHEN 'A' THEN 'funpay' WHEN 'N' THEN 'g2g' ELSE 'playerauctions' END AS source,
       CAST(l_suppkey AS INT) AS server_id,
       CASE l_linestatus WHEN 'O' THEN 'Horde' ELSE 'Alliance' END AS faction,
       floor(l_extendedprice) * CASE l_linenumber % 3 WHEN 1 THEN l_quantity ELSE 1 END
         / CASE l_linenumber % 3 WHEN 2 THEN 100 ELSE 100000 END AS raw_price,
       CASE l_linenumber % 3 WHEN 0 THEN 'per_unit' WHEN 1 THEN 'per_lot' ELSE 'per_1k' END AS raw_price_unit,
       CAST(l_quantity AS INT) AS lot_size, CAST(l_quantity AS BIGINT) AS amount_gold,
       concat('Seller ', l_partkey) AS seller, CAST(0 AS DOUBLE) AS given_price,
       l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS part_no,
       l_discount AS discount, l_tax AS tax,
       CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' MINUTE * (l_orderkey % 1440) AS fetched_at
FROM lineitem
""")

_PRICE = """round(CASE raw_price_unit WHEN 'per_lot' THEN raw_price / greatest(lot_size, 1) * 1000.0
             WHEN 'per_1k' THEN raw_price ELSE raw_price * 1000.0 END, 6)"""
_OFFER_COLUMNS = ("id", "source", "server_id", "faction", "raw_price", "raw_price_unit", "lot_size",
                  "price_per_1k", "amount_gold", "seller", "order_no", "line_no", "part_no", "fetched_at")

view("offers", f"""
SELECT id, source, server_id, faction, raw_price, raw_price_unit, lot_size, {_PRICE} AS price_per_1k,
       amount_gold, seller, order_no, line_no, part_no, fetched_at
FROM raw_offers
""", lambda t: prices.with_prices(t.raw_offers.withColumnRenamed("given_price", "price_per_1k"))
    .select(*_OFFER_COLUMNS))

# offers with their group label and realm
view("labelled", """
SELECT id, source, server_id, faction, price_per_1k, amount_gold, seller, fetched_at,
       concat('(', sv_region, ') ', sv_version, CASE WHEN sv_type = 'Hardcore' THEN ' · Hardcore' ELSE '' END)
         AS display_server, sv_name AS server_name, sv_region AS region, sv_version AS version
FROM offers JOIN server_names ON server_id = sv_id
""")

# one offer per id: the cheapest, larger amount first
view("unique_offers", """
SELECT id, source, server_id, faction, price_per_1k, amount_gold, seller, fetched_at FROM (
  SELECT id, source, server_id, faction, price_per_1k, amount_gold, seller, fetched_at,
         row_number() OVER (PARTITION BY source, id ORDER BY price_per_1k, amount_gold DESC, id,
                            faction, fetched_at, seller, server_id) AS rn
  FROM offers) WHERE rn = 1
""")

# titles in eight shapes
view("titles", """
SELECT order_no, line_no, source, faction, server_id, sv_version AS version,
       CASE WHEN sv_version IN ('MoP Classic', 'Retail') THEN sv_version ELSE 'Classic Era' END AS game_version,
       sv_name AS realm, sv_region AS region,
       CASE (order_no + line_no) % 8
         WHEN 0 THEN concat(sv_name, ' [', sv_region, ' - ', sv_version, '] - ', faction)
         WHEN 1 THEN concat(sv_name, ' [', sv_region, '] - ', faction)
         WHEN 2 THEN concat('  ', sv_name, ' - ', faction)
         WHEN 3 THEN concat(sv_name, '[', lower(sv_region), ' -  seasonal ]')
         WHEN 4 THEN concat('(', lower(sv_region), ') ', sv_version, ' - ', replace(sv_name, chr(39), '’'))
         WHEN 5 THEN concat('(', sv_region, ') ', sv_version, ' - ', sv_name, ' - ', faction)
         WHEN 6 THEN concat(sv_name, '  NA  classic era - ', upper(faction), ' ')
         ELSE concat('Реалм (', sv_name, ') - ', lower(faction)) END AS title
FROM raw_offers JOIN server_names ON server_id = sv_id
""")

# raw listings with the defects that quarantine rules look for, by order number
view("listings", """
SELECT id, source,
       CASE source WHEN 'g2g' THEN CASE WHEN sv_name = '' THEN id ELSE lower(sv_name) END
         WHEN 'playerauctions' THEN id ELSE lower(label) END AS server,
       CASE source WHEN 'funpay' THEN label ELSE '' END AS display_server,
       CASE source WHEN 'funpay' THEN '' ELSE sv_name END AS server_name,
       CAST(NULL AS INT) AS server_id, 'Normal' AS realm_type,
       CASE source
         WHEN 'g2g' THEN CASE WHEN k = 0 THEN ''
                              WHEN k = 8 THEN concat(sv_name, ' [', code, '] - ', faction)
                              ELSE concat(sv_name, ' [', code, ' - ', sv_version, '] - ', faction) END
         WHEN 'playerauctions' THEN concat('(', sv_region, ') ', sv_version, ' - ', sv_name, ' - ', faction)
         ELSE '' END AS raw_title,
       CASE WHEN sv_version IN ('MoP Classic', 'Retail') THEN sv_version ELSE 'Classic Era' END AS game_version,
       CASE k WHEN 1 THEN 'Neutral' WHEN 2 THEN ' ' ELSE faction END AS faction,
       CASE WHEN k IN (3, 4) THEN CAST(0 AS DOUBLE) ELSE raw_price END AS raw_price, raw_price_unit, lot_size,
       CAST(CASE WHEN k = 4 THEN 3.5 ELSE 0 END AS DOUBLE) AS price_per_1k,
       amount_gold, seller, fetched_at, arrival
FROM (
  SELECT id, source, faction, raw_price, raw_price_unit, lot_size, amount_gold, seller, fetched_at,
         sv_region, sv_version, k,
         CASE WHEN k = 5 THEN 'Nowhere' WHEN k = 6 THEN replace(name, chr(39), '’') ELSE name END AS sv_name,
         CASE WHEN k = 7 AND sv_region = 'US' THEN 'NA' WHEN sv_notes <> '' AND source = 'g2g' THEN 'DE'
              ELSE sv_region END AS code,
         CASE WHEN k = 0 THEN '' WHEN k = 9 THEN name
              ELSE concat('(', CASE sv_region WHEN 'RU' THEN 'EU' WHEN 'OCE' THEN 'US' ELSE sv_region END, ') ',
                   sv_version, ' - ', CASE WHEN k = 5 THEN 'Nowhere'
                                           WHEN k = 6 THEN replace(name, chr(39), '’') ELSE name END) END AS label,
         concat(lpad(CAST(order_no AS STRING), 12, '0'), line_no, '/', lpad(CAST(part_no AS STRING), 10, '0'),
                '/', server_id, '/', raw_price, '/', discount, '/', tax) AS arrival
  FROM (SELECT id, source, faction, raw_price, raw_price_unit, lot_size, amount_gold, seller, fetched_at,
               order_no, line_no, part_no, discount, tax, server_id, order_no % 97 AS k
        FROM raw_offers) JOIN
       (SELECT sv_id, sv_name AS name, sv_region, sv_version, sv_notes FROM server_names) ON server_id = sv_id)
""")

view("raw_ticks", """
SELECT event_id, CAST(user_id % 3 AS INT) AS server_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'Horde' ELSE 'Alliance' END AS faction,
       date_trunc('minute', CAST(ts AS TIMESTAMP)) AS recorded_at, value AS index_price,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(value * 0.9, 4) END AS best_ask,
       CAST(user_id % 7 + 1 AS INT) AS sample_size
FROM events
""")

# one tick per key: the first event wins
view("ticks", """
SELECT server_id, faction, recorded_at, index_price, best_ask, sample_size FROM (
  SELECT server_id, faction, recorded_at, index_price, best_ask, sample_size,
         row_number() OVER (PARTITION BY server_id, faction, recorded_at ORDER BY event_id) AS rn
  FROM raw_ticks) WHERE rn = 1
""")

view("group_index", """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE user_id % 4 WHEN 0 THEN '(EU) Anniversary' WHEN 1 THEN '(US) Retail'
         WHEN 2 THEN '(RU) Classic Era' ELSE '(EU) Season of Discovery · Hardcore' END AS server,
       CASE event_id % 3 WHEN 0 THEN 'All' WHEN 1 THEN 'Alliance' ELSE 'Horde' END AS faction,
       value AS index_price, round(value * 1.01, 4) AS vwap,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(value * 0.9, 4) END AS best_ask,
       CAST(user_id % 5 + 1 AS INT) AS offer_count,
       CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'g2g' WHEN 'click' THEN 'funpay,g2g'
         WHEN 'purchase' THEN 'playerauctions,funpay' ELSE 'funpay' END AS source_text
FROM events
""")

# one rate per currency and day, on days with orders of the priority that stands for the currency
view("rates", """
SELECT code, valid_from, round(avg(o_totalprice) / 200000, 3) AS rate FROM (
  SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EUR' WHEN '2' THEN 'GBP' WHEN '3' THEN 'UAH'
           WHEN '4' THEN 'PLN' ELSE 'RUB' END AS code,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE * 600 AS valid_from, o_totalprice
  FROM orders) GROUP BY code, valid_from
""")


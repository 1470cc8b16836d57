"""Column types of the stored tables. Everything is read with these, nothing is inferred."""

import re

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), "decimal(18,8)": T.DecimalType(18, 8), "decimal(12,6)": T.DecimalType(12, 6), "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema from 'name type' pairs, pairs separated by a comma and white space."""
    pairs = [part.split(None, 1) for part in re.split(r",\s+", columns.strip())]
    return T.StructType([T.StructField(name, _TYPES[kind.strip()]) for name, kind in pairs])


OFFERS = _schema("""
    id string, source string, server string, display_server string, server_name string,
    server_id int, realm_type string, raw_title string, game_version string, faction string,
    raw_price double, raw_price_unit string, lot_size int, price_per_1k double, amount_gold bigint,
    seller string, is_suspicious boolean, offer_url string, updated_at timestamp,
    fetched_at timestamp""")

SERVERS = _schema("""
    id int, game string, name string, region string, version string, realm_type string,
    is_active boolean""")

ALIASES = _schema("alias string, server_id int, source string")

RAW_PRICES = _schema("""
    source string, offer_id string, server_id int, faction string, raw_price decimal(18,8),
    raw_price_unit string, lot_size int, currency string, seller string, offer_url string,
    fetched_at timestamp, date date""")

GROUP_INDEX = _schema("""
    ts timestamp, server string, faction string, index_price decimal(12,6), vwap decimal(12,6),
    best_ask decimal(12,6), price_min decimal(12,6), price_max decimal(12,6), offer_count int,
    total_volume bigint, sources array<string>, source_count int, date date""")

TICKS = _schema("""
    server_id int, faction string, recorded_at timestamp, index_price double, best_ask double,
    sample_size int, date date""")

CURRENT_OFFERS = _schema("""
    source string, id string, server_id int, faction string, price_per_1k double, fetched_at timestamp,
    bucket int""")

MARKET = _schema("""
    source string, id string, server_id int, faction string, price_per_1k double, fetched_at timestamp,
    cycle bigint""")

CURRENT_INDEX = _schema("""
    server_id int, faction string, computed_at timestamp, index_price double, best_ask double,
    sample_size bigint, min_price double, max_price double, bucket int""")

from pyspark.sql import functions as F

from tidemark.functions import prices, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def many(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_price_units(spark):
    price = lambda raw, unit, lot: one(spark, prices.price_per_1k(F.lit(raw), F.lit(unit), F.lit(lot)))
    assert price(3.0, "per_lot", 1000) == 3.0
    assert price(0.003, "per_unit", 1) == 3.0
    assert price(3.25, "per_1k", 1) == 3.25
    assert price(3.0, "per_lot", 0) == 3000.0


def test_numbers(spark):
    given = ["1,234.56", "1.234,56", "0,5", "1.2.3", "1,2,3", "$ 7", "", None, "abc", "1.2,3.4"]
    assert many(spark, given, text.parse_number) == [
        1234.56, 1234.56, 0.5, 12.3, 12.3, 7.0, None, None, None, None]
    assert many(spark, ["1 000", "", None, "0", "x9"], text.parse_amount) == [1000, 1, 1, 1, 9]


def test_bracket_titles(spark):
    given = ["Flamelash [EU - Classic] - Alliance", "Firemaw [EU] - Alliance", "Firemaw - alliance", "",
             "Penance [eu-Seasonal]", None]
    got = [tuple(r) for r in many(spark, given, text.bracket_title)]
    assert got == [("Flamelash", "EU", "Classic", "Alliance"), ("Firemaw", "EU", "Classic", "Alliance"),
                   ("Firemaw", "", "", "Alliance"), ("", "", "", "Horde"), ("Penance", "EU", "Seasonal", "Horde"),
                   ("", "", "", "Horde")]


def test_labels(spark):
    got = many(spark, ["(EU) Anniversary - Spineshatter", "(us) sod", "Spineshatter", "", None],
               lambda c: text.listing_label(c, F.lit("old")))
    assert [tuple(r) for r in got] == [("(EU) Anniversary", "Spineshatter"), ("(US) Season of Discovery", "sod"),
                                       ("", "old"), ("", "old"), ("", "old")]
    assert many(spark, ["(EU) Retail - A - Horde", "x"], lambda c: text.title_label(c, F.lit("d"))) == [
        "(EU) Retail", "d"]
    assert many(spark, ["(EU) Anniversary · Hardcore", "(EU) Classic Era", "(EU) MoP Classic", "other"],
                text.version_rank) == [100, 40, 0, 99]
    assert many(spark, ["Arcanite Reaper- Horde", "Lei-Shen - Alliance", "Solo"], text.realm_faction)[0][:] == (
        "Arcanite Reaper", "Horde")


def test_slug(spark):
    got = [tuple(r) for r in many(spark, ["(EU) #Anniversary - Spine-shatter", " ", None, "Firemaw"], text.server_slug)]
    assert got == [("spine-shatter", "Spine-shatter (EU)"), ("unknown", "unknown"), ("unknown", "unknown"),
                   ("firemaw", "Firemaw")]


def test_adaptive_floor(spark):
    ts = F.lit("2024-01-01 10:58:31").cast("timestamp")
    assert one(spark, times.utc_text(times.floor_minutes(ts, 25))) == "2024-01-01T10:50:00Z"
    assert one(spark, times.utc_text(times.floor_minutes(ts, 86))) == "2024-01-01T10:00:00Z"
    assert times.bucket_minutes(720, 500) == 86 and times.bucket_minutes(1, 500) == 5


def test_spread_of_zero_prices(spark):
    assert one(spark, prices.spread_percent(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, prices.spread_percent(F.lit(3.0), F.lit(4.0))) == 25.0


def test_safe_url(spark):
    assert many(spark, ["https://a.b/c", "javascript:x()", "", None, "http://a b"], prices.safe_url)[:4] == [
        "https://a.b/c", None, None, None]

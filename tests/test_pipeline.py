import datetime as dt


from tidemark import schemas
from tidemark.operators import indexes, quality
from tidemark.session import new_path
from tidemark.sources import tables

NOW = dt.datetime(2024, 1, 1, 12)


def servers(spark):
    rows = [(1, "g", "Firemaw", "EU", "Anniversary", "Normal", True), (2, "g", "Firemaw", "EU", "MoP Classic", "Normal", True),
            (3, "g", "Stitches", "US", "Anniversary", "Hardcore", True), (4, "g", "Old", "EU", "Anniversary", "Normal", False)]
    return spark.createDataFrame(rows, schemas.SERVERS)


def aliases(spark):
    rows = [("Firemaw [EU - Anniversary] - Horde", 1, "g2g"), ("(EU) Anniversary - Firemaw", 1, "funpay"),
            ("Twin [EU - Classic] - Horde", 1, "g2g"), ("TWIN [EU - Classic] - Horde", 2, "g2g"),
            ("Old [EU - Anniversary] - Horde", 4, "g2g"), ("Galakras [US] - Horde", 1, "g2g")]
    return spark.createDataFrame(rows, schemas.ALIASES)


def offer(id_, source="g2g", title="", label="", name="x", faction="Horde", raw=0.003, version="Classic Era"):
    return (id_, source, name.lower(), label, name, None, "Normal", title, version, faction, raw, "per_unit", 1, 0.0,
            100, "s", False, None, NOW, NOW, int(id_))


def listings(spark, *rows):
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.OFFERS.fields) + ", arrival int"
    return tables.normal_offers(spark.createDataFrame(list(rows), ddl))


def test_each_row_gets_its_first_reason(spark):
    rows = listings(
        spark, offer("1", title="Firemaw [EU - Anniversary] - Horde", faction=" "),
        offer("2", title="nothing"), offer("3", title="Twin [EU - Classic] - Horde"),
        offer("4", title="Old [EU - Anniversary] - Horde"), offer("5", faction="Neutral", raw=0.0),
        offer("6", source="funpay", label="bare", name=""), offer("7", raw=0.0),
        offer("8", source="funpay", label="(EU) Anniversary - Firemaw", name=""),
        offer("9", title="Firemaw [EU - Anniversary] - Horde", version="MoP Classic"),
        offer("10", source="playerauctions", title="(US) Anniversary - Stitches - Horde", name="Stitches"))
    out = quality.normalize(rows, aliases(spark), servers(spark))
    reasons = {r["raw_id"]: r["reason"] for r in out.rejected.collect()}
    assert reasons == {"2": "unresolved_server", "3": "alias_conflict", "4": "deprecated_version",
                       "5": "unknown_faction:'Neutral'", "6": "empty_server_title", "7": "zero_price"}
    clean = {r["id"]: r for r in out.clean.collect()}
    assert {k: r["server_id"] for k, r in clean.items()} == {"1": 1, "8": 1, "9": 2, "10": 3}
    assert clean["1"]["faction"] == "Horde" and clean["10"]["display_server"] == "(US) Anniversary · Hardcore"


def test_duplicates_keep_the_first_arrival(spark):
    a = offer("1", title="Firemaw [EU - Anniversary] - Horde", raw=0.005)
    b = a[:10] + (0.004,) + a[11:20] + (0,)
    out = quality.normalize(listings(spark, a, b), aliases(spark), servers(spark)).clean.collect()
    assert [r["raw_price"] for r in out] == [0.004]


def test_degraded_rows_pass_with_a_rebuilt_label(spark):
    rows = listings(spark, offer("1", title="Spineshatter [NA - Seasonal] - Horde"), offer("2", title="odd"))
    out = quality.normalize(rows, aliases(spark), servers(spark), registry_available=False)
    assert [(r["id"], r["display_server"], r["server_id"]) for r in out.clean.collect()] == [
        ("1", "(US) Season of Discovery", None)]
    assert [r["reason"] for r in out.rejected.collect()] == ["unresolved_server"]


def index_input(spark, rows):
    return spark.createDataFrame(rows, "id string, server_id int, source string, faction string, "
                                       "price_per_1k double, amount_gold bigint, display_server string")


def test_group_index_needs_two_pairs(spark):
    rows = [("1", 1, "g2g", "Horde", 1.5, 10, "A"), ("2", 1, "funpay", "Horde", 2.0, 20, "A"),
            ("3", 1, "g2g", "Horde", 9.0, 30, "A"), ("4", 1, "g2g", "Horde", 5.0, 1, "B"), ("5", 1, "g2g", "Horde", 6.0, 1, "B")]
    got = {(r["display_server"], r["faction"]): r for r in indexes.group_index(index_input(spark, rows)).collect()}
    assert set(got) == {("A", "Horde"), ("A", "All")}
    assert got["A", "All"]["index_price"] == 1.75 and got["A", "All"]["total_volume"] == 30


def test_server_index_drops_dear_sources(spark):
    rows = [("1", 1, "g2g", "Horde", 2.0, 1, ""), ("2", 1, "g2g", "Alliance", 4.0, 1, ""),
            ("3", 1, "funpay", "Horde", 1.0, 1, ""), ("4", 1, "funpay", "Alliance", 20.0, 1, "")]
    got = {r["faction"]: r for r in indexes.server_index(index_input(spark, rows)).collect()}
    # the mean of the second source is above twice the first, its cheap offer goes with it
    assert got["All"]["index_price"] == 0.003 and got["All"]["min_price"] == 0.002
    assert got["Horde"]["sample_size"] == 2


def test_profiles_use_the_floor_position(spark):
    rows = [(str(i), 1, "g2g", "Horde", float(i), 1, "") for i in (4, 1, 3, 2)] + [("9", 2, "g2g", "Horde", 1.0, 1, "")]
    got = [r for r in indexes.price_profiles(index_input(spark, rows)).collect() if r["faction"] == "Horde"]
    assert [(r["server_id"], r["p25"], r["median"], r["p75"]) for r in got] == [(1, 2.0, 3.0, 4.0)]


def test_upsert_and_insert_can_run_again(spark):
    path = new_path(spark, "ticks")
    at = dt.datetime(2024, 1, 1, 10)
    df = lambda p: spark.createDataFrame([(1, "Horde", at, p, None, 1)],
                                         "server_id int, faction string, recorded_at timestamp, index_price double, "
                                         "best_ask double, sample_size int")
    stored = lambda: [r["index_price"] for r in tables.read(spark, path, schemas.TICKS).collect()]
    for _ in range(2):
        tables.insert_ticks(df(1.0), path)
    tables.insert_ticks(df(2.0), path)
    assert stored() == [1.0]
    for _ in range(2):
        tables.upsert_ticks(df(3.0), path)
    assert stored() == [3.0]
    assert tables.apply_retention(spark, path, schemas.TICKS, "recorded_at", "2024-01-01 11:00:00") == 1
    assert stored() == []


def test_empty_input(spark):
    empty = index_input(spark, [])
    assert indexes.server_index(empty).count() == 0
    assert indexes.group_index(empty).count() == 0
    assert indexes.price_profiles(empty).count() == 0
    assert indexes.market_stats(empty).first()["g2g_count"] == 0

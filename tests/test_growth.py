"""Steps whose shuffles and memory must not carry more than the result needs."""

from pyspark.sql import functions as F
from test_pipeline import aliases, listings, offer, servers

from tidemark.operators import quality, resolve
from tidemark.operators.scale import once
from tidemark.plans import q_extract
from tidemark.plans.catalog import Tables
from tidemark.session import new_path
from tidemark.sources import extract
from tidemark.streaming import jobs

TITLE = "Firemaw [EU - Anniversary] - Horde"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_rows_carry_only_what_is_asked_for(spark):
    rows = listings(spark, offer("1", title=TITLE), offer("1", title=TITLE, raw=0.5), offer("2", title="nothing"))
    out = quality.normalize(rows, aliases(spark), servers(spark))
    narrow = out.clean_of("id", "server_id", "arrival")
    assert [tuple(r) for r in narrow.collect()] == [("1", 1, 1)]
    assert not [line for line in plan(narrow).splitlines() if "Window" in line and "seller" in line]


def test_title_keys_tell_texts_with_shifted_edges_apart(spark):
    rows = [("g2g", "a", "bc", "", "Horde", ""), ("g2g", "ab", "c", "", "Horde", ""), ("g2g", "ab", "c", "", "Horde", "")]
    keys = spark.createDataFrame(rows, quality.TITLE).select(quality.title_key().alias("k")).collect()
    assert len({bytes(r["k"]) for r in keys}) == 2 and {len(r["k"]) for r in keys} == {16}


def test_rows_are_accounted_for_in_one_pass(spark):
    rows = listings(spark, offer("1", title=TITLE), offer("1", title=TITLE, raw=0.5), offer("2", title="nothing"),
                    offer("3", title=TITLE), offer("3", raw=0.0))
    out = quality.normalize(rows, aliases(spark), servers(spark))
    assert out.accounting.first().asDict() == {"input": 5, "rejected": 2, "clean": 2, "duplicates": 1}
    assert plan(out.accounting).count("FileScan") == 1
    nothing = quality.Normalized(out.tagged.filter("id = 'x'")).accounting.first()
    assert tuple(nothing) == (0, 0, 0, 0)


def test_normalizer_stores_listings_columns(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = listings(spark, offer("1", title=TITLE), offer("2", title="nothing"))
    rows.write.parquet(source)
    clean, rejected, cp = (new_path(spark, n) for n in ("clean", "rejected", "cp"))
    stream = spark.readStream.schema(rows.schema).parquet(source)
    jobs.start_normalizer(stream, aliases(spark), servers(spark), clean, rejected, cp).awaitTermination()
    stored = spark.read.parquet(clean)
    assert stored.columns == [*rows.columns, "batch"]
    assert [(r["id"], r["server_id"]) for r in stored.collect()] == [("1", 1)]
    assert spark.read.parquet(rejected).count() == 1


def test_filters_do_not_compute_a_column_again(spark):
    rows = spark.createDataFrame([("a1",), ("b",)], "text string")
    out = once(rows, digits=F.regexp_replace("text", "[a-z]", "")).filter("digits <> '' AND length(digits) < 9")
    assert [tuple(r) for r in out.collect()] == [("a1", "1")]
    assert plan(out).count("regexp_replace(") == 1


def test_pages_are_built_behind_the_shuffle(spark):
    pages = q_extract.listing_pages(Tables(spark, "/root/testdata/sf0.001"))
    below = plan(pages).split("Exchange ")
    assert len(below) == 2 and "l_orderkey" in below[1].splitlines()[0] and "tc-item" not in below[1]


def test_an_absent_class_has_no_text(spark):
    rows = spark.createDataFrame([('<p class="x TC-Price">7</p>',), ("<p>tc-price</p>",), (None,)], "html string")
    assert [r[0] for r in rows.select(extract.element_text(F.col("html"), "tc-price")).collect()] == ["7", "", ""]


def test_alias_coverage_counts_the_rows_of_a_title(spark):
    titles = spark.createDataFrame([("g2g", "New [EU - Classic] - Horde", "", "New", "Horde", 5),
                                    ("g2g", "NEW [EU - Classic] - Horde", "", "New", "Horde", 2)],
                                   "source string, raw_title string, display_server string, server_name string, faction string, n int")
    out = resolve.alias_coverage(titles, aliases(spark), F.col("n")).collect()
    assert [(r["alias_key"], r["offers"]) for r in out] == [("new [eu - classic] - horde", 7)]

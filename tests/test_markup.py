"""Items read from bytes are those that patterns on columns find, without these patterns."""

from pyspark.sql import functions as F

from tidemark.plans import q_extract
from tidemark.plans.catalog import Tables
from tidemark.sources import extract, markup

GOOD = ('<a href="/o?id=1-2" class="tc-item lazy" data-online="1" data-user="Sam"><div class="tc-server">Realm &amp; Co '
        '</div><div class=\'x TC-Side\'>Horde</div><div class="tc-price"><b>1,5</b> <i class="unit">€</i></DIV ></a>')
PAGES = [
    "", None, "no items, tc-item", GOOD, GOOD + "\n" + GOOD.replace('="1"', '="0"'),
    # names that stand elsewhere first, quotes that a '>' lies in, a tag in a tag, a class cut off by the next item
    GOOD.replace("Realm", "tc-price 'TC-PRICE' Realm"), GOOD.replace("x TC-Side", "a>b tc-price tc-side"),
    GOOD.replace("<div class=\"tc-server\"", "<p <div title='>' class = \"tc-server\""), "<b " + GOOD, GOOD[:40] + GOOD,
    # no end tag, an end tag of another name first, blanks and line ends that '$' stands ahead of
    GOOD.replace("</div>", "").replace("</DIV >", ""), GOOD.replace("Co ", "</divs> </span>Co"),
    GOOD.replace("Co ", " Co \u2028"), GOOD.replace("Co ", "Co \x85 \x0b"), GOOD.replace("Co ", "Co\n\u2029\n"),
    # a tag name that goes on outside ASCII, one that ends there
    GOOD.replace("<div class=\"tc-s", "<divé class=\"tc-s"), GOOD.replace("<div class=\"tc-s", "<div\u00a0class=\"tc-s"),
    # the seller's other places
    GOOD.replace("</a>", "<u class='tc-seller'>Ann</u><u class='media-user-name'> - </u></a>"),
    GOOD.replace("href=", "data-seller='&lt;Bo&gt;' data-username=N/A rel="), GOOD.replace("<a ", "<a\ndata-online = 'TRUE' "),
]


def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")


def test_items_are_those_that_patterns_find(spark):
    item = F.col("item")
    rows = pages(spark).select("page_id", F.posexplode(extract.segments(F.col("html"), "tc-item")).alias("n", "item"))
    wanted = rows.select("page_id", "n", item, *[extract.attribute(item, a).alias(f) for f, a in markup.ATTRIBUTES.items()],
                         *[extract.element_text(item, c).alias(f) for f, c in markup.ELEMENTS.items()]).collect()
    found = {(r["page_id"], r["n"]): r["i"] for r in pages(spark).select(
        "page_id", F.posexplode(markup.page_items(F.col("html").cast("binary"))).alias("n", "i")).collect()}
    assert len(found) == len(wanted) > len(PAGES) - 3
    for row in wanted:
        have = {f: v.decode() for f, v in found[row["page_id"], row["n"]].asDict().items() if v is not None}
        online = row["online"].lower() in ("1", "true", "yes")
        assert set(have) >= ({*markup.ELEMENTS, "online", "href"} if online else {"online"})
        assert {f: row[f] for f in have if f != "markup"} == {f: v for f, v in have.items() if f != "markup"}
        assert have.get("markup", row["item"]) == row["item"] and ("markup" in have) == (online and "id=1" not in row["href"])
        if online and have["user"] in ("", "-"):
            assert {*markup.ATTRIBUTES} <= set(have)


def test_items_are_found_without_a_pattern_a_field(spark):
    listed = pages(spark).withColumn("game_version", F.lit("Classic Era"))
    plan = extract.listing_items(listed, "https://x")._jdf.queryExecution().executedPlan().toString()
    assert "tc-price" not in plan and "tc-item" not in plan


def test_pages_are_spread_by_number_not_by_size(spark):
    plan = q_extract.listing_pages(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan

"""Normalising listings: validation, resolution, quarantine and deduplication in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, text
from tidemark.functions.prices import with_prices
from tidemark.operators.ranking import dedup
from tidemark.operators.resolve import enriched, resolved
from tidemark.operators.scale import lookup, maybe, repeated
from tidemark.session import materialize


def relabelled(listings: DataFrame) -> DataFrame:
    """Per source, bring the listing's label into the '(REG) Version' form."""
    src = F.col("source")
    listing = text.listing_label(F.col("display_server"), F.col("server_name"))
    return listings.withColumn("_l", F.when(src == "funpay", listing)).withColumns({
        "display_server": F.when(src == "funpay", F.col("_l.label"))
        .when(src == "playerauctions", text.title_label(F.col("raw_title"), F.col("display_server")))
        .otherwise(text.group_label(F.col("display_server"), F.col("server_name"))),
        "server_name": F.when(src == "funpay", F.col("_l.server")).otherwise(F.col("server_name")),
    }).drop("_l")


def title_reason() -> Column:
    """Reject reason of a row's faction and title."""
    faction = F.lower(text.strip(F.col("faction")))
    return (F.when(~faction.isin("", "horde", "alliance"),
                   F.concat(F.lit("unknown_faction:'"), F.col("faction"), F.lit("'")))
            .when((text.strip(F.col("server_name")) == "") & (text.strip(F.col("display_server")) == ""),
                  F.lit("empty_server_title")))


def with_default_faction(listings: DataFrame) -> DataFrame:
    return listings.withColumn("faction", F.when(
        text.strip(F.col("faction")) == "", fixed.DEFAULT_FACTION).otherwise(F.col("faction")))


SLICES = 2  # every slice reads all listings again, so more would save disk and cost time
SLICE_ROWS = 1_000_000


@dataclass
class Normalized:
    """``repeated`` is a bitmap of the (source, id) of listings that come more than once, see ``sliced``."""
    tagged: DataFrame
    repeated: DataFrame | None = None

    @property
    def clean(self) -> DataFrame:
        """Accepted rows, one per (source, id), the first in arrival order."""
        return self.clean_of(*self.tagged.columns)

    def clean_of(self, *columns: str) -> DataFrame:
        """The accepted rows with these columns only.

        The order among equal arrivals takes in every column, so all of them go through the shuffle;
        callers name the ones that they need.
        """
        needed = dict.fromkeys(("source", "id", "arrival", *columns))
        accepted = self.tagged.filter("reason IS NULL").select(*needed)
        if self.repeated is None:
            return dedup(accepted, F.col("arrival")).select(*columns)
        if self.repeated.isEmpty():
            return accepted.select(*columns)
        accepted = maybe(accepted, self.repeated, "source", "id")
        several = accepted.filter("_may").drop("_may")
        return accepted.filter("NOT _may").select(*columns).unionByName(
            dedup(several, F.col("arrival")).select(*columns))

    def sliced(self, listings: DataFrame) -> list[Normalized]:
        """The same rows in slices by id, for sinks that take one after the other; few rows are one slice.

        ``listings`` are those that were normalized. Rows of ids that they have once are not shuffled for deduplication.
        """
        bits, rows = repeated(listings.withColumn("source", text.or_blank(F.col("source"))), "source", "id")
        slices = min(SLICES, max(1, -(-rows // SLICE_ROWS)))
        own = F.pmod(F.xxhash64("id"), F.lit(slices))
        return [Normalized(self.tagged if slices == 1 else self.tagged.filter(own == i), bits) for i in range(slices)]

    @property
    def accounting(self) -> DataFrame:
        """One row: all rows, rejects, clean rows and duplicates, counted in one pass per (source, id)."""
        per_id = self.tagged.groupBy("source", "id").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNull()).alias("accepted"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return per_id.agg(
            total("rows").alias("input"), total(F.col("rows") - F.col("accepted")).alias("rejected"),
            F.count_if(F.col("accepted") > 0).alias("clean"),
            total(F.greatest(F.col("accepted") - 1, F.lit(0))).alias("duplicates"))

    @property
    def rejected(self) -> DataFrame:
        return self.tagged.filter("reason IS NOT NULL").select(
            F.col("id").alias("raw_id"), "source", "reason",
            F.coalesce(text.blank_to_null(F.col("raw_title")), F.col("given_label")).alias("raw_title"),
            F.col("price_per_1k").alias("price"), "details", F.col("fetched_at").alias("ts"))

    @property
    def region_overrides(self) -> DataFrame:
        """Rows whose own region differs from the registry's; not rejects."""
        return (self.tagged
                .filter("server_id IS NOT NULL AND source_region <> '' "
                        "AND source_region <> canonical_region")
                .select("id", "source", "source_region", "canonical_region", "server_name"))


TITLE = ["source", "display_server", "server_name", "raw_title", "faction", "game_version"]


def title_key() -> Column:
    """128 bits of the SHA-256 of a title's columns, each with its length ahead of it; rows carry it to
    the join in place of six texts."""
    parts = [part for c in TITLE for part in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def with_plain_titles(listings: DataFrame) -> DataFrame:
    """Title columns without nulls, and without labels that the title replaces anyway: those are often unique per row."""
    rows = listings.withColumns({c: text.or_blank(F.col(c)) for c in TITLE})
    replaced = (F.col("source") == "playerauctions") & text.strip(F.col("raw_title")).rlike(fixed.REGION_LABEL)
    return rows.withColumn("display_server", F.when(replaced, "").otherwise(F.col("display_server")))


def resolved_titles(listings: DataFrame, aliases: DataFrame, servers: DataFrame,
                    registry_available: bool = True) -> DataFrame:
    """One row per different title of the listings, parsed and resolved.

    Titles repeat millions of times, so text is parsed once per title and not once per row.
    ``title_key`` stands for the columns of ``TITLE`` as given; ``own_reason`` is the title's reject reason.
    """
    titles = listings.select(*TITLE).distinct().withColumn("title_key", title_key())
    rows = relabelled(titles).withColumn("given_label", F.col("display_server"))
    rows = with_default_faction(rows.withColumn("own_reason", title_reason()))
    if not registry_available:
        return _degraded(rows)
    rows = rows.withColumn("server_id", F.lit(None).cast("int")).withColumn("passes", F.lit(False))
    return enriched(resolved(rows, aliases, servers), servers)


def normalize(listings: DataFrame, aliases: DataFrame, servers: DataFrame,
              registry_available: bool = True) -> Normalized:
    """Tag every listing with its first reject reason (null = accepted) and registry fields.

    Without a registry nothing can be resolved; rows then pass with a label rebuilt from
    their title and are rejected only where that fails.
    """
    rows = with_prices(with_plain_titles(listings))
    titles = materialize(resolved_titles(rows, aliases, servers, registry_available), "titles")
    keyed = rows.withColumn("title_key", title_key()).drop(*TITLE, "server_id", "realm_type")
    joined = (lookup(keyed, titles, "title_key")
              .withColumn("server", F.coalesce("slug", "server")).drop("slug", "title_key"))
    bad_title, bad_price = F.col("own_reason"), F.coalesce(F.col("price_per_1k"), F.lit(0.0)) <= 0
    where = F.concat(F.lit("server_name="), "server_name", F.lit(" display_server="), "display_server")
    reason = (F.when(bad_title.isNotNull(), bad_title).when(bad_price, "zero_price")
              .when(F.col("server_id").isNull() & F.col("alias_conflict"), "alias_conflict")
              .when(F.col("server_id").isNull() & ~F.col("passes"), "unresolved_server")
              .when(~F.coalesce("server_active", F.lit(True)), "deprecated_version"))
    details = (F.when(F.col("reason") == "unresolved_server", where)
               .when(F.col("reason") == "deprecated_version",
                     F.concat(F.lit("server="), F.col("server_name"), F.lit(" version="),
                              F.col("registry_version"))).otherwise(""))
    return Normalized(joined.withColumn("reason", reason).withColumn("details", details)
                      .drop("own_reason", "passes"))


def _degraded(rows: DataFrame) -> DataFrame:
    bracketed = F.col("source") == "g2g"
    rows = rows.withColumn("_r", F.when(bracketed, text.rebuilt_label(F.col("raw_title"))))
    rows = rows.withColumns({
        "passes": F.when(bracketed, F.col("_r").isNotNull())
        .otherwise(text.strip(F.col("display_server")) != ""),
        "display_server": F.coalesce("_r.label", "display_server"),
        "slug": F.lower("_r.label"),
        "server_name": F.coalesce(text.blank_to_null(F.col("_r.server")), F.col("server_name"))}).drop("_r")
    nothing = F.lit(None)
    return rows.withColumns({
        "alias_text": nothing.cast("string"), "alias_conflict": F.lit(False),
        "server_id": nothing.cast("int"), "server_active": F.lit(True),
        "registry_version": nothing.cast("string"), "realm_type": F.lit("Normal"),
        "source_region": F.lit(""), "canonical_region": nothing.cast("string")})


def unresolved_titles(tagged: DataFrame) -> DataFrame:
    """Unresolved titles: source and time of the first sighting, count."""
    return (tagged.filter("reason = 'unresolved_server' AND alias_text IS NOT NULL")
            .groupBy(F.col("alias_text").alias("raw_title"))
            .agg(F.min(F.struct("fetched_at", "source")).alias("_first"),
                 F.count(F.lit(1)).alias("count"))
            .select("raw_title", F.col("_first.source").alias("source"),
                    F.col("_first.fetched_at").alias("first_seen"), "count"))


def quarantine_summary(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rows"))


def quarantine_tail(rejected: DataFrame, n: int = fixed.QUARANTINE_TAIL) -> DataFrame:
    """The newest ``n`` rejects, newest first."""
    return rejected.orderBy(F.col("ts").desc(), "raw_id", "source", "reason", "price",
                            "raw_title").limit(n)

"""Lab directory records to firm rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import as_col, blank_to_null, has, normalize_name, site_domain, slug_of
from plinth.operators.ranking import keep_first
from plinth.operators.resolve import not_known

LAB = (
    "name string, country_code string, city string, county string, blurb string, kind_name string, "
    "activity_status string, capabilities array<string>, links array<struct<url:string>>"
)

# Capability codes with their own label, and social sites.
CAPABILITIES = {
    "three_d_printing": "3D Printing", "cnc_milling": "CNC Milling", "circuit_production": "Circuit Production",
    "laser": "Laser Cutting", "precision_milling": "Precision Milling", "vinyl_cutting": "Vinyl Cutting",
}
SOCIAL_SITES = [
    "instagram.com", "twitter.com", "x.com", "facebook.com", "youtube.com", "linkedin.com", "tiktok.com",
]


def website_from_links(links: Column | str, legacy: bool = False) -> Column:
    """First link that is not a social site, judged by host; the legacy rule looks for the site anywhere in the text."""
    def social(url: Column) -> Column:
        if legacy:
            return F.lower(url).rlike("|".join(s.replace(".", "\\.") for s in SOCIAL_SITES))
        return F.lower(site_domain(url)).rlike("(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in SOCIAL_SITES) + ")$")

    urls = F.transform(as_col(links), lambda link: link["url"])
    return F.get(F.filter(urls, lambda u: (F.length(u) > 0) & ~social(u)), F.lit(0))


def _title(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def lab_description() -> Column:
    """Kind, blurb and capabilities, joined by full stops."""
    blurb = F.trim("blurb")
    label = F.create_map(*[F.lit(x) for item in CAPABILITIES.items() for x in item])
    labels = F.transform("capabilities", lambda c: F.coalesce(F.try_element_at(label, c), _title(c)))
    listed = F.when(F.size("capabilities") > 0, F.concat(F.lit("Capabilities: "), F.array_join(labels, ", ")))
    kind = _title(F.coalesce("kind_name", F.lit("fab_lab")))
    return F.concat_ws(". ", kind, blank_to_null(blurb), listed)


def ingest_labs(labs: DataFrame, firms: DataFrame, aliases: DataFrame, include_inactive: bool = False,
    order: list[Column] | None = None) -> DataFrame:
    """Firm rows for labs that name a place and are not known yet; of equal names the first by `order`, ascending, stays.

    Without an order, the least by all columns counts as first.
    """
    named = labs.withColumn("display_name", F.trim("name")).withColumn(
        "country", F.upper(F.trim("country_code"))).where(has("display_name") & has("country"))
    if not include_inactive:
        named = named.where(F.col("activity_status") == "active")
    rows = named.select(
        *[c.alias(f"_order{i}") for i, c in enumerate(order or [])],
        "display_name", normalize_name("display_name").alias("canonical_name"), F.lit("technology").alias("sector"),
        "country", blank_to_null(F.trim(F.coalesce(blank_to_null("city"), F.col("county")))).alias("city"),
        website_from_links("links").alias("website"), lab_description().alias("short_description"),
    ).withColumn("slug", slug_of("canonical_name"))
    fresh = not_known(rows, firms, aliases, "firm")
    kept = [c for c in fresh.columns if not c.startswith("_order")]
    first = [F.asc_nulls_last(f"_order{i}") for i in range(len(order or []))] + [F.asc_nulls_last(c) for c in kept if c != "canonical_name"]
    return keep_first(fresh, ["canonical_name"], first).select(*kept)

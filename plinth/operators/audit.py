"""Data audit: uniform issue rows, one scan per table, over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.similarity import similarity
from plinth.functions.text import has, normalize_name
from plinth.operators import counts, filters
from plinth.operators.ranking import top_n, with_next
from plinth.session import write_once

SEVERITIES = ["critical", "high", "medium", "low"]
COLUMNS = ["severity", "category", "entity_type", "entity_id", "name", "detail"]


def _issue(when: Column, severity: str, category: str, detail: Column) -> Column:
    return F.when(when, F.struct(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.alias("detail")))


def _rows(df: DataFrame, entity_type: Column, entity: Column, name: Column, issues: list[Column]) -> DataFrame:
    """All checks of a table in one projection; only raised issues become rows."""
    raised = df.select(
        entity_type.alias("entity_type"), entity.cast("string").alias("entity_id"), name.alias("name"),
        F.explode(F.array_compact(F.array(*issues))).alias("issue"))
    return raised.select("issue.severity", "issue.category", "entity_type", "entity_id", "name", "issue.detail")


def _quoted(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix + "'"), value, F.lit("'"))


def _mismatch(expected: Column) -> tuple[Column, Column]:
    detail = F.concat(F.lit("canonical='"), F.col("canonical_name"), F.lit("' vs expected='"), expected, F.lit("'"))
    return ~F.col("canonical_name").eqNullSafe(expected), detail


def _firm_checks() -> list[tuple[Column, str, str, Column]]:
    """Condition, severity, category and detail of each check of one firm, by the bit it sets."""
    name, expected = F.col("display_name"), F.col("expected")
    detail = F.concat(F.lit("canonical='"), F.col("canonical_name"), F.lit("' vs expected='"), expected, F.lit("'"))
    return [
        (filters.junk_name(name), "critical", "junk_name", _quoted("Name too short or garbage: ", name)),
        (filters.irrelevant_firm(name, filters.AUDIT_IRRELEVANT_WORDS), "high", "irrelevant_entity", _quoted("Likely irrelevant: ", name)),
        (filters.bad_slug("slug"), "medium", "bad_slug", _quoted("Bad slug: ", "slug")),
        (filters.thin_firm(), "low", "thin_record", F.lit("Fewer than 2 metadata fields filled")),
        (~has("sector"), "high", "missing_field", F.lit("Missing sector")),
        (~F.col("canonical_name").eqNullSafe(expected), "medium", "canonical_mismatch", detail),
    ]


def firm_flags(firms: DataFrame) -> DataFrame:
    """The columns that audits of firms read, and `flags`: a bit for each check of `_firm_checks` that fails.

    One scan evaluates every check once; written, it is all that the other checks need of the firms.
    """
    judged = firms.withColumn("expected", normalize_name("display_name"))
    bits = [F.when(failing, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (failing, *_) in enumerate(_firm_checks())]
    return judged.select(
        "id", "slug", "display_name", "canonical_name", "merged_into", "publish_status", "expected",
        reduce(lambda x, y: x.bitwiseOR(y), bits).alias("flags"))


def _set(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(1 << bit)) != 0


def firm_issues(flagged: DataFrame) -> DataFrame:
    """The issues of firms by their flags."""
    live = flagged.where(F.col("merged_into").isNull() & (F.col("flags") != 0))
    return _rows(live, F.lit("firm"), F.col("id"), F.col("display_name"), [
        _issue(_set(bit), severity, category, detail) for bit, (_, severity, category, detail) in enumerate(_firm_checks())])


def firm_totals(flagged: DataFrame) -> DataFrame:
    """Per check of one firm: severity, category and how many live firms fail it, by one aggregate over the flags."""
    by_flags = flagged.where(F.col("merged_into").isNull()).groupBy("flags").agg(F.count("*").alias("n"))
    cells = [
        F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.when(_set(bit), F.col("n")).otherwise(0).alias("n"))
        for bit, (_, severity, category, _) in enumerate(_firm_checks())
    ]
    spread = by_flags.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return spread.groupBy("severity", "category").agg(F.sum("n").cast("long").alias("count"))


def person_issues(people: DataFrame) -> DataFrame:
    name, expected = F.col("display_name"), F.col("_expected")
    wrong, detail = _mismatch(expected)
    checked = people.withColumn("_expected", normalize_name("display_name"))
    return _rows(checked, F.lit("person"), F.col("id"), name, [
        _issue(filters.junk_name(name), "critical", "junk_name", _quoted("Name too short or garbage: ", name)),
        _issue(filters.bad_slug("slug"), "medium", "bad_slug", _quoted("Bad slug: ", "slug")),
        _issue(filters.thin_person(), "low", "thin_record", F.lit("Fewer than 2 metadata fields filled")),
        _issue(~F.trim(name).contains(" "), "medium", "suspicious_name",
               F.lit("Single-word name — may be incomplete")),
        _issue(wrong, "medium", "canonical_mismatch", detail),
    ])


def alias_issues(aliases: DataFrame) -> DataFrame:
    length = F.length("alias_normalized")
    return _rows(aliases, F.col("entity_type"), F.col("entity_id"), F.col("alias"), [
        _issue(length < 2, "medium", "junk_alias", _quoted("Alias too short: ", "alias_normalized")),
        _issue(length == 1, "high", "junk_alias", _quoted("Single-char alias: ", "alias_normalized")),
    ])


def duplicate_issues(firms: DataFrame) -> DataFrame:
    """One issue per shared canonical name. The members are rows of `counts.duplicate_members`."""
    groups = counts.exact_duplicates(firms)
    detail = F.concat(F.lit("Exact canonical_name duplicate: "), F.col("members").cast("string"), F.lit(" firms"))
    return _rows(groups, F.lit("firm"), F.col("first_id"), F.col("canonical_name"), [
        _issue(F.lit(True), "critical", "exact_duplicate", detail)])


def queue_issues(enrichment_queue: DataFrame, review_queue: DataFrame, backlog: int = 100) -> DataFrame:
    stuck = enrichment_queue.where(F.col("status").isin("failed", "processing")).groupBy("status").agg(
        F.count("*").alias("n"))
    detail = F.concat(F.lit("Enrichment queue: "), F.col("n").cast("string"), F.lit(" items in '"), "status", F.lit("' state"))
    none = F.lit("")
    stuck_rows = _rows(stuck, F.lit("system"), none, none, [_issue(F.col("n") > 0, "medium", "enrichment_stuck", detail)])
    pending = review_queue.agg(F.count_if(F.col("status") == "pending").alias("n"))
    detail = F.concat(F.lit("Review queue: "), F.col("n").cast("string"), F.lit(" pending items need operator attention"))
    return stuck_rows.unionByName(
        _rows(pending, F.lit("system"), none, none, [_issue(F.col("n") > backlog, "high", "review_backlog", detail)]))


def source_issues(sources: DataFrame, cursors: DataFrame) -> DataFrame:
    none = F.lit("")
    missing = sources.agg(F.count_if(F.col("url").isNull()).alias("n"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" sources without URLs"))
    no_url = _rows(missing, F.lit("source"), none, none, [_issue(F.col("n") > 0, "medium", "missing_field", detail)])
    broken = F.concat(F.lit("Feed '"), "source_name", F.lit("' in error state"))
    return no_url.unionByName(_rows(cursors, F.lit("source"), none, F.col("source_name"), [
        _issue(F.col("status") == "error", "medium", "broken_feed", broken)]))


def unlinked_firms(firms: DataFrame, links: DataFrame) -> DataFrame:
    """Active firms without any source link."""
    linked = links.where(F.col("entity_type") == "firm").select(F.col("entity_id").alias("id"))
    return filters.active(firms, "firm").join(linked, "id", "left_anti")


def unlinked_issues(firms: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.where(F.col("entity_type") == "firm").select(
        F.col("entity_id").alias("id")).distinct().withColumn("_linked", F.lit(True))
    shown = filters.active(firms, "firm").join(linked, "id", "left")
    totals = shown.agg(F.count_if(F.col("_linked").isNull()).alias("n"), F.count("*").alias("total"))
    detail = F.concat(
        F.col("n").cast("string"), F.lit(" published firms have no entity_sources links (of "),
        F.col("total").cast("string"), F.lit(")"))
    none = F.lit("")
    return _rows(totals, F.lit("firm"), none, none, [_issue(F.col("n") > 0, "low", "no_source_links", detail)])


def dangling_merges(firms: DataFrame) -> DataFrame:
    """Firms merged into an id that does not exist."""
    merged = firms.where(F.col("merged_into").isNotNull()).select("id", "display_name", "merged_into")
    return merged.join(firms.select(F.col("id").alias("merged_into")), "merged_into", "left_anti").select(
        "id", "display_name", "merged_into")


def dangling_issues(firms: DataFrame) -> DataFrame:
    detail = F.concat(F.lit("merged_into="), F.col("merged_into").cast("string"), F.lit(" but target does not exist"))
    return _rows(dangling_merges(firms), F.lit("firm"), F.col("id"), F.col("display_name"), [
        _issue(F.lit(True), "critical", "dangling_merge", detail)])


def adjacent_duplicates(firms: DataFrame, threshold: float = 0.95, ratio=similarity) -> DataFrame:
    """Active firms whose canonical name is nearly the next one in name order."""
    shown = filters.active(firms, "firm").select("id", "canonical_name", "display_name")
    paired = with_next(shown, [F.asc("canonical_name"), F.asc("id")], ["id", "canonical_name", "display_name"])
    scored = paired.where(
        F.col("next_id").isNotNull() & (F.col("canonical_name") != F.col("next_canonical_name"))
    ).withColumn("ratio", ratio("canonical_name", "next_canonical_name"))
    return scored.where(F.col("ratio") > threshold).select("id", "display_name", "next_id", "next_display_name", "ratio")


def fuzzy_issues(firms: DataFrame, threshold: float = 0.95, ratio=similarity) -> DataFrame:
    detail = F.concat(
        F.lit("Very similar to '"), "next_display_name", F.lit("' (ratio="), F.format_string("%.3f", "ratio"), F.lit(")"))
    return _rows(adjacent_duplicates(firms, threshold, ratio), F.lit("firm"), F.col("id"), F.col("display_name"), [
        _issue(F.lit(True), "high", "fuzzy_duplicate", detail)])


def audit_issues(tables: dict[str, DataFrame], fuzzy_threshold: float = 0.95) -> DataFrame:
    """Every check as one stream of issue rows. The firms are scanned once, for their flags."""
    firms = write_once(firm_flags(tables["firms"]))
    parts = [
        firm_issues(firms), person_issues(tables["people"]), alias_issues(tables["entity_aliases"]),
        duplicate_issues(firms), queue_issues(tables["enrichment_queue"], tables["review_queue"]),
        source_issues(tables["sources"], tables["ingest_cursors"]),
        unlinked_issues(firms, tables["entity_sources"]), dangling_issues(firms), fuzzy_issues(firms, fuzzy_threshold),
    ]
    return reduce(DataFrame.unionByName, parts)


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return counts.zero_filled(issues, "severity", SEVERITIES)


def issues_by_category(issues: DataFrame) -> DataFrame:
    return counts.count_by(issues, "category")


def examples_per_severity(issues: DataFrame, n: int = 10) -> DataFrame:
    severe = issues.where(F.col("severity").isin("critical", "high", "medium"))
    order = [F.asc("category"), F.asc("entity_type"), F.asc("entity_id"), F.asc("name"), F.asc("detail")]
    return top_n(severe, ["severity"], order, n, rank="place")


def thin_ratio(df: DataFrame, thin: Column, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Share of thin rows and their number; with `fraction` a sample is checked and scaled up."""
    checked = df.sample(fraction=fraction, seed=seed) if fraction else df
    out = checked.agg(F.count_if(thin).alias("thin"), F.count("*").alias("checked"))
    total = df.agg(F.count("*").alias("total")).scalar()
    share = F.try_divide(F.col("thin").cast("double"), F.col("checked"))
    return out.withColumn("total", total).withColumn("share", F.round(share, 6)).withColumn(
        "estimated", F.floor(share * F.col("total")).cast("long"))

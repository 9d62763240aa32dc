"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found in each whole text by patterns. Their values, as hashes, are counted over
the corpus by distinct repositories and owners. A value that many owners hold is a widely copied
example; one that few hold and that looks random is taken as live. Base kinds are always reported;
long mixed strings without a keyword (`token`) are reported only where their ownership says live.

Positions count code points, the end exclusive. A text is split at its matches once per kind, and
lengths of the stretches give the positions.

Defined cases: NULL and empty texts have no spans; a NULL owner or repository counts as one;
repeated rows count once per owner; an empty table gives no rows; other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import row_key, written

# Patterns by kind, in listed order. Group 2 of `assign` is the value.
KINDS: dict[str, str] = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "token": "[A-Za-z0-9_-]{20,}",
}
BASE = ["assign", "access", "hex"]
LEAST_VALUE = 8
#: Owners from which on a value is a widely copied example.
EXAMPLE_OWNERS = 3
REPLACEMENT = "[SECRET]"


def _hits(text: Column, kind: str) -> Column:
    """Per match: what lies between it and the match before, its length, and its value."""
    pattern = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else matches
    gaps = F.split(text, pattern, -1)
    cells = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"), values.alias("v")),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["g"]).alias("gap"),
            F.length(x["m"]).alias("size"),
            F.length(x["v"]).alias("value_size"),
            F.sha2(x["v"].cast("binary"), 256).alias("value"),
            _random(x["v"]).alias("random"),
        ),
    )
    return F.when(text.rlike(pattern), cells)


def _random(value: Column) -> Column:
    """Whether a value looks like a credential: LEAST_VALUE characters or more, digits and letters."""
    return (F.length(value) >= LEAST_VALUE) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def candidates(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its hits of all kinds and without its text, written once."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hits = {kind: _hits(whole, kind) for kind in KINDS}
    # Strings of one class are words or numbers, not tokens; gaps need all matches, so they stay in as failing.
    arrays = [F.coalesce(h, F.array().cast("array<struct<kind:string,gap:int,size:int,value_size:int,value:string,random:boolean>>")) for h in hits.values()]
    table = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), owner.alias("owner"), repository.alias("repository"), *(a.alias(k) for a, k in zip(arrays, KINDS)))
    return written(table.withColumn("row", F.monotonically_increasing_id()))


def spans(found: DataFrame) -> DataFrame:
    """One row per valid span: row, key, owner, repository, kind, rank, start, end, value_start, value, random."""
    parts = []
    for rank, kind in enumerate(KINDS):
        # Kinds are split one by one: their matches may overlap.
        rows = found.where(F.size(kind) > 0).select("row", "key", "owner", "repository", F.posexplode(kind).alias("at", "hit"))
        parts.append(rows.select("row", "key", "owner", "repository", "at", "hit.*").withColumn("rank", F.lit(rank)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("value_start", F.col("end") - F.col("value_size"))
    valid = F.when(F.col("kind") == "assign", F.col("value_size") >= LEAST_VALUE).when(F.col("kind") == "token", F.col("random")).otherwise(F.lit(True))
    return placed.where(valid).select("row", "key", "owner", "repository", "kind", "rank", "start", "end", "value_start", "value", "random")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: rows, distinct repositories and distinct owners that hold it.

    Three groupings, each summed before it is shuffled, so a value in a third of all rows is one
    row per task, owner and repository.
    """
    by_repository = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_rows"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def classify(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Spans with `class`: example, live or weak; a `token` that is not live or lies over a base span goes."""
    known = ownership(found)
    label = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("random"), "live").otherwise("weak")
    judged = found.join(known, "value").withColumn("class", label)
    base = F.col("rank") < len(BASE)
    order = Window.partitionBy("row").orderBy("start", "rank")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    alone = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return judged.withColumn("_alone", alone).where(base | (F.col("_alone") & (F.col("class") == "live"))).drop("_alone")


def _listed(items: Column) -> Column:
    ordered = F.array_sort(F.filter(items, lambda s: s.isNotNull()))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per document: counts of base spans, their digest, all spans, and how many are live or examples."""
    table = candidates(docs, owner, repository, doc_id, text)
    cell = F.struct("start", "rank", "kind", "end")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    per_row = classify(spans(table), example_owners).groupBy("row").agg(
        *(count(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.collect_list(F.when(F.col("rank") < len(BASE), cell)).alias("base"),
        F.collect_list(cell).alias("all"),
        count(F.col("class") == "live").alias("n_live"),
        count(F.col("class") == "example").alias("n_example"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    listed = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    return table.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *(zero(f"n_{k}") for k in BASE),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("all").alias("spans"), zero("n_live"), zero("n_example"),
    )


def redact(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """`docs` with the values of live spans replaced. Texts without a candidate are never shuffled."""
    live = classify(spans(candidates(docs, owner, repository, doc_id, text)), example_owners).where(F.col("class") == "live")
    cuts = live.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct(F.col("value_start").alias("start"), "end"))).alias("_cuts"))
    # Rows equal in id and text have equal cuts. Rows travel whole in one column, so no name can clash.
    cuts = cuts.groupBy(F.col("key").alias("_cut_key")).agg(F.first("_cuts").alias("_cuts"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), row_key(doc_id, text).alias("_key"))
    likely = F.coalesce(F.col("_text"), F.lit("")).rlike("|".join(KINDS.values()))
    hit = whole.where(likely).join(cuts, F.col("_key") == F.col("_cut_key"), "left")
    body = F.col("_text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(state: Column, span: Column) -> Column:
        # A cut that starts inside the one before only moves its end.
        fresh = F.concat(state["out"], F.substring(body, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")), F.lit(REPLACEMENT))
        return F.struct(F.when(span["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    done = F.aggregate("_cuts", start, cut, lambda s: F.concat(s["out"], F.substring(body, (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    cleaned = hit.select("_row", F.coalesce(done, body).alias("_text"))
    both = whole.where(~likely).select("_row", "_text").unionByName(cleaned)
    return both.select(*(F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns))

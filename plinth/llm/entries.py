"""Registered queries of the operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import alignment, embeddings, filter_audit, licences, minhash, mixing, pieces, quality_classifier, quality_rules, repeats, secrets, token_counts, warc
from plinth.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


@register("op4_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def _known_values() -> str:
    return ", ".join(f"('{text}', '{licences._symbol(name)}', '{name}')" for name, text in licences.SENTENCES.items())


def _rule_values() -> str:
    first = {licences._rule(s): name for name, s in reversed(licences.RULES)}
    return ", ".join(f"('{k}', '{v}')" for k, v in first.items())


SENTENCE_SQL = f"""
with known(sentence, symbol, name) as (values {_known_values()}),
rules(sequence, licence) as (values {_rule_values()}),
sentences as (
  select doc_id, unnest(string_split_regex(coalesce(text, ''), '{licences.SENTENCE_END}')) as s,
    generate_subscripts(string_split_regex(coalesce(text, ''), '{licences.SENTENCE_END}'), 1) as i
  from documents
),
named as (
  select doc_id, i, symbol, name from sentences
  join known on known.sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))
),
found as (
  select doc_id, count(*) as n, string_agg(symbol, '' order by i) as seq, string_agg(name, ',' order by i) as names
  from named group by doc_id
),
hits as (
  select doc_id, unnest(regexp_extract_all(seq, '{licences.rule_pattern()}')) as m,
    generate_subscripts(regexp_extract_all(seq, '{licences.rule_pattern()}'), 1) as i
  from found
),
matched as (
  select doc_id, string_agg(licence, ',' order by i) as matches, list_sort(list(distinct licence)) as licences
  from hits join rules on rules.sequence = hits.m group by doc_id
)
select d.doc_id, coalesce(f.n, 0)::bigint as n_sentences, coalesce(f.names, '') as sentences,
  coalesce(m.matches, '') as matches, coalesce(array_to_string(m.licences, ','), '') as licences
from documents d left join found f using (doc_id) left join matched m using (doc_id)
"""


@register("op5_licences", SENTENCE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORD = r"[^\x20\x09-\x0D]+"


def measures_sql(source: str) -> str:
    """CTEs that end in `judged`: every row of `source` with measurements and fail_bits."""
    rules = " | ".join(f"case when {rule.replace('/', '//')} then {1 << bit} else 0 end" for bit, rule in quality_rules.RULES.values())
    return f"""
words as (
  select *, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as lines
  from {source}
),
windows as (
  select doc_id, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k+7], ' '))) as win
  from words where len(w) >= 9
),
repeated as (
  select doc_id, count(distinct p)::bigint as n_repeat_words from (
    select doc_id, unnest(range(i, i + 8)) as p
    from (select *, count(*) over (partition by doc_id, win) as c from windows) where c > 1
  ) group by doc_id
),
measured as (
  select words.* exclude (w, lines), len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::bigint as n_upper
  from words left join repeated using (doc_id)
),
judged as (select *, ({rules})::bigint as fail_bits from measured)
"""


@register("op9_quality_rules", f"""
with {measures_sql('documents')}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality_rules.mask(quality_rules.POLICIES['base'])} != 0 as base_failed,
  fail_bits & {quality_rules.mask(quality_rules.POLICIES['v1'])} = 0 as kept, n_lines, n_upper, fail_bits
from judged
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.ledger(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"),
        "n_lines", "n_upper", "fail_bits",
    )


def hits_sql(source: str) -> str:
    """CTEs that end in `judged`: the spans of every row of `source`, by doc_id, with their class."""
    parts = []
    for rank, (kind, pattern) in enumerate(secrets.KINDS.items()):
        text = pattern.replace("'", "''")
        value = f"regexp_extract_all(t, '{text}', 2)" if kind == "assign" else f"regexp_extract_all(t, '{text}')"
        parts.append(f"""
  select doc_id, source, lang, '{kind}' as kind, {rank} as rank, unnest(range(1, len(m) + 1)) as pos, unnest(m) as m, unnest(v) as v, unnest(g[1:len(m)]) as g
  from (select doc_id, source, lang, regexp_extract_all(t, '{text}') as m, {value} as v, string_split_regex(t, '{text}') as g
        from (select doc_id, source, lang, coalesce(text, '') as t from {source}) where regexp_matches(t, '{text}'))""")
    base = len(secrets.BASE)
    return f"""
hits as ({" union all ".join(parts)}),
placed as (
  select *, (sum(length(g) + length(m)) over (partition by doc_id, rank order by pos))::bigint as "end",
    length(v) >= {secrets.LEAST_VALUE} and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') as random
  from hits
),
found as (
  select *, "end" - length(m) as start from placed
  where case kind when 'assign' then length(v) >= {secrets.LEAST_VALUE} when 'token' then random else true end
),
owned as (select v, count(distinct coalesce(source, chr(1))) as owners from found group by v),
classed as (
  select found.*, case when owners >= {secrets.EXAMPLE_OWNERS} then 'example' when random then 'live' else 'weak' end as class,
    max(case when rank < {base} then "end" end) over (partition by doc_id order by start, rank rows between unbounded preceding and 1 preceding) as before,
    min(case when rank < {base} then start end) over (partition by doc_id order by start, rank rows between 1 following and unbounded following) as after
  from found join owned using (v)
),
judged as (
  select * from classed where rank < {base} or (class = 'live' and coalesce(before, -1) <= start and coalesce(after, "end") >= "end")
)"""


@register("op3_secrets", f"""
with {hits_sql('documents')},
listed as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (rank < {len(secrets.BASE)}) as base,
    string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) as spans,
    count(*) filter (class = 'live') as n_live, count(*) filter (class = 'example') as n_example
  from judged group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from documents d left join listed using (doc_id)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def mix_sql(source: str) -> str:
    """CTEs that end in `mixed`: every row of `source` with size, source_size, target and copies."""
    cap = mixing.MAX_EPOCHS
    return f"""
sized as (
  select *, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
    substr(md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 16) as hash
  from {source}
),
totals as (
  select source, sum(size)::hugeint as source_size, ((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)})::integer as k
  from sized group by source
),
weighed as (select *, ({mixing.WEIGHTS})[k + 1]::hugeint as weight from totals),
walked as (
  select *, coalesce(sum({cap} * source_size) over w, 0)::hugeint as caps, coalesce(sum(weight) over w, 0)::hugeint as weights_before,
    sum(source_size) over ()::hugeint as total, sum(weight) over ()::hugeint as weights
  from weighed window w as (order by {cap} * source_size::double / weight, source rows between unbounded preceding and 1 preceding)
),
clamped as (select *, {cap} * source_size * (weights - weights_before) < weight * (total - caps) as full_up from walked),
filled as (
  select source, source_size, case when full_up then source_size::double * {cap}
    else weight::double * (total - coalesce(sum(case when full_up then {cap} * source_size end) over (), 0))::double / (weights - coalesce(sum(case when full_up then weight end) over (), 0))::double end as target
  from clamped
),
targets as (
  select *, case when source_size > 0 then least(floor(target / source_size::double), {cap})::bigint else 0 end as whole from filled
),
wanted as (select *, target - (whole * source_size)::double as need from targets),
runs as (
  select source, hash, sum(n) over (partition by source order by hash) as upto from (select source, hash, sum(size) as n from sized group by source, hash)
),
ended as (
  select w.source, coalesce(arg_min(r.upto, struct_pack(a := abs(r.upto::double - need), b := r.upto)), 0) as upto, any_value(need) as need
  from wanted w left join runs r on r.source is not distinct from w.source group by w.source
),
stops as (select source, case when abs(upto::double - need) < need then upto else 0 end as stop from ended),
mixed as (
  select s.*, w.source_size::bigint as source_size, w.target, w.whole + (r.upto <= p.stop)::bigint as copies
  from sized s join wanted w on w.source is not distinct from s.source
  join stops p on p.source is not distinct from s.source
  join runs r on r.source is not distinct from s.source and r.hash = s.hash
)"""


@register("op8_mixing", f"with {mix_sql('documents')} select doc_id, size, source_size, target, (size * copies)::bigint as taken from mixed")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocation(table(spark, sf_dir, "documents"))


@register("op7_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_rows", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


@register("op1_embeddings")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op10_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


@register("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL))


#: Every document is led through every order, step by step; documents that fail alike are counted first.
AUDIT_SQL = f"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents
),
firsts as (select t, min(doc_id) as least from docs group by t),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
judged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when docs.doc_id > least then 'E' else '' end as fails
  from docs join firsts using (t) left join marks on marks.doc_id = docs.doc_id
),
counted as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from judged group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a join letters b on b.x <> a.x join letters c on c.x not in (a.x, b.x)
  join letters d on d.x not in (a.x, b.x, c.x) join letters e on e.x not in (a.x, b.x, c.x, d.x)
),
steps as (select filter_order, unnest(range(1, 6))::integer as step from orders),
led as (
  select part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) as x, fails,
    length(translate(substr(filter_order, 1, step - 1), fails, '')) = step - 1 as there,
    contains(fails, substr(filter_order, step, 1)) as failing
  from counted, steps
),
summed as (
  select part, filter_order, step, x, coalesce(sum(n) filter (there and not failing), 0)::bigint as kept,
    coalesce(sum(n) filter (there and failing), 0)::bigint as removed, coalesce(sum(n) filter (failing and not there), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = x), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (there and failing), 0)::bigint as good_lost, coalesce(sum(toxic) filter (there and failing), 0)::bigint as toxic_lost
  from led group by part, filter_order, step, x
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley
from summed
"""


@register("op13_filter_audit", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_audit.five_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(judged, filter_audit.LETTERS, losses=("good", "toxic"))


#: Five hexadecimal digits are four digits of base 32.
WARC_SQL = """
with bodies as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
most as (select body, max(page_id) as most from bodies group by body)
select page_id, octet_length(encode(body))::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::integer, 5))::bigint >> s) & 31) + 1)::integer, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id is not distinct from most then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from most then null else most end as refers_to
from bodies join most using (body)
"""


@register("op12_warc", WARC_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))

"""Directory tables derived from the driver's Parquet tables.

Each view is one SELECT that Spark SQL and DuckDB both run, so a query here and its oracle
start from the same rows. The views grow with the tables; nothing is sampled. `v_entity_sources` leaves out
firms of one segment with a high balance, so that some published firms have no source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import roomy_shuffles

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


#: Tables with texts that are dear to work on, and the usual bound of a Parquet row group.
TEXT_TABLES = ["documents", "pages"]
ROW_GROUP_BYTES = 128 << 20

VIEWS: dict[str, str] = {
    "v_firms": """
        select c_custkey as id,
               'firm-' || cast(c_custkey as string) || case when c_custkey % 37 = 5 then '--X' else '' end as slug,
               case when c_custkey % 97 = 3 then cast(c_custkey as string)
                    when c_custkey % 101 = 4 then 'Hospital of ' || n_name
                    else substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || ' Works '
                         || cast(c_custkey as string) end as display_name,
               case when c_custkey % 97 = 3 then cast(c_custkey as string)
                    when c_custkey % 101 = 4 then 'hospital of ' || lower(n_name)
                    when c_custkey % 41 = 6 then 'old ' || lower(c_mktsegment) || ' works ' || cast(c_custkey as string)
                    else lower(c_mktsegment) || ' works ' || cast(c_custkey as string) end as canonical_name,
               case c_mktsegment when 'AUTOMOBILE' then 'architecture' when 'BUILDING' then 'architecture'
                    when 'FURNITURE' then 'design' when 'MACHINERY' then 'technology'
                    else 'multidisciplinary' end as sector,
               case n_nationkey when 0 then 'Germany' when 1 then ' usa ' when 2 then 'UK' when 3 then 'JP'
                    when 4 then 'the Netherlands' when 5 then cast(null as string) when 6 then ''
                    else n_name end as country,
               case n_nationkey when 0 then 'DE' when 3 then 'JP' end as country_code,
               case when c_custkey % 4 = 0 then cast(null as string) else 'City ' || cast(n_nationkey as string) end as city,
               case when c_custkey % 3 = 0 then cast(null as string)
                    else 'https://www.works' || cast(c_custkey as string) || '.example.com/home' end as website,
               case when c_acctbal > 5000 then cast(1950 + c_custkey % 70 as int) end as founded_year,
               case when c_acctbal > 3000 then '11-50' end as size_range,
               case when c_custkey % 5 = 0 then cast(null as string) when c_custkey % 5 = 1 then 'Short note'
                    else 'A practice of the ' || lower(c_mktsegment) || ' trade working across '
                         || n_name || ' since it was founded' end as short_description,
               case when c_custkey % 50 = 7 then case when c_custkey % 200 = 57 then -c_custkey else c_custkey - 1 end end
                    as merged_into,
               case when c_acctbal < 0 then 'hidden' when c_acctbal < 2000 then 'draft' else 'published' end
                    as publish_status,
               cast(greatest(0, floor(c_acctbal / 100)) as int) as quality_score,
               case when c_custkey % 7 = 0 then 'Q' || cast(c_custkey as string) end as wikidata_id,
               case when c_custkey % 6 = 0 then cast(c_custkey * 37 % 180 - 90 as double) end as latitude,
               case when c_custkey % 6 = 0 then cast(c_custkey * 53 % 360 - 180 as double) end as longitude,
               case when c_custkey % 8 = 0 then 'https://img.example.com/' || cast(c_custkey as string) || '.jpg' end
                    as image_url,
               c_custkey * 7919 % 100003 as created_at
        from customer join nation on c_nationkey = n_nationkey""",
    "v_people": """
        select p_partkey as id, replace(p_name, ' ', '-') || '-' || cast(p_partkey as string) as slug,
               case when p_partkey % 31 = 2 then split_part(p_name, ' ', 2)
                    else upper(substr(p_name, 1, 1)) || substr(p_name, 2) end as display_name,
               p_name as canonical_name,
               case when p_size < 15 then 'Researcher' when p_size < 25 then 'Architect'
                    when p_size < 35 then 'Design Lead / R&D' when p_size < 49 then p_type end as role,
               case when p_partkey % 6 = 0 then 'Principal' end as title,
               case p_type when 'ECONOMY' then 'architecture' when 'STANDARD' then 'architecture'
                    when 'PROMO' then 'design' when 'SMALL' then 'technology' when 'MEDIUM' then 'technology'
                    else 'multidisciplinary' end as sector,
               case when p_partkey % 4 = 0 then cast(null as bigint) else p_partkey * 31 % (select count(*) from customer) + 1 end as current_firm_id,
               case when p_partkey % 3 = 0 then cast(null as string) else 'DE' end as nationality,
               case when p_partkey % 5 < 2 then cast(null as string) when p_partkey % 5 = 2 then 'Brief'
                    else p_name || ' is known for ' || lower(p_type) || ' work, and studied ' || lower(p_brand)
                         || ' methods before the award' end as bio,
               case when p_size < 10 then 'draft' else 'published' end as publish_status,
               cast(floor(p_retailprice / 20) as int) as quality_score,
               case when p_partkey % 9 = 0 then 'Q' || cast(p_partkey as string) end as wikidata_id,
               case when p_partkey % 10 = 4 then 'https://img.example.com/p/' || cast(p_partkey as string) end as image_url,
               p_partkey * 7919 % 100003 as created_at
        from part""",
    "v_aliases": """
        select c_custkey as entity_id, 'firm' as entity_type, 'W' || cast(c_custkey as string) as alias,
               'w' || cast(c_custkey as string) as alias_normalized
        from customer
        union all
        select min(p_partkey) as entity_id, 'person' as entity_type,
               upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) as alias,
               substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) as alias_normalized
        from part
        group by upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)),
                 substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)
        union all
        select s_suppkey as entity_id, 'firm' as entity_type, cast(s_suppkey % 10 as string) as alias,
               case when s_suppkey % 10 = 3 then '' else cast(s_suppkey % 10 as string) end as alias_normalized
        from supplier""",
    "v_firm_people": """
        select o_custkey as firm_id, l_partkey as person_id,
               min(case l_returnflag when 'A' then 'Founder' when 'R' then 'Partner' else 'Employee' end) as role,
               max(l_linestatus) = 'O' as is_current, cast(min(year(l_shipdate)) as int) as start_year
        from orders join lineitem on o_orderkey = l_orderkey
        group by o_custkey, l_partkey""",
    "v_sources": """
        select doc_id as id, text as title,
               case source when 'src1' then 'ArchDaily' when 'src2' then 'Dezeen' else source end as source_name,
               case when doc_id % 23 = 0 then cast(null as string)
                    else 'https://' || source || '.example.com/' || cast(doc_id as string) end as url,
               case when doc_id % 11 = 0 then cast(null as bigint) else n_chars end as published_at,
               case lang when 'en' then 'architecture' when 'de' then 'design' when 'fr' then 'technology'
                    else 'multidisciplinary' end as sector
        from documents""",
    "v_entity_sources": """
        select o_custkey as entity_id, 'firm' as entity_type,
               o_orderkey % (select count(*) + 100 from documents) as source_id,
               min(o_orderpriority) as mention_type, max(o_orderdate) as created_at
        from orders join customer on c_custkey = o_custkey
        where not (c_mktsegment = 'FURNITURE' and c_acctbal > 7000) group by 1, 2, 3
        union all
        select l_partkey as entity_id, 'person' as entity_type,
               l_orderkey % (select count(*) + 100 from documents) as source_id,
               min(l_returnflag) as mention_type, max(l_shipdate) as created_at
        from lineitem group by 1, 2, 3""",
    "v_tags": """
        select s_suppkey as id, 'Tag ' || s_name as name, substr(md5(s_name), 1, 9) || '-kind' as slug,
               case when s_nationkey % 5 = 0 then cast(null as string) when s_nationkey % 5 = 1 then ''
                    else 'cat' || cast(s_nationkey % 5 as string) end as category
        from supplier
        union all
        select 1000000000 + n_nationkey, 'Unused ' || n_name, 'unused-' || lower(n_name), 'cat9' from nation""",
    "v_entity_tags": """
        select distinct l_partkey as entity_id, 'person' as entity_type, l_suppkey as tag_id
        from lineitem
        union all
        select distinct o_custkey as entity_id, 'firm' as entity_type, l_suppkey as tag_id
        from lineitem join orders on l_orderkey = o_orderkey""",
    "v_awards": """
        select o_orderkey as id, 'award-' || cast(o_orderkey as string) as slug,
               'Award ' || o_orderpriority as award_name,
               case when o_orderkey % 13 = 0 then cast(null as string) else o_orderpriority end as organization,
               case when o_orderkey % 17 = 0 then cast(null as string) else 'Works' end as category,
               case when o_orderkey % 19 = 0 then cast(null as int) else cast(year(o_orderdate) as int) end as year,
               o_orderstatus as prestige
        from orders""",
    "v_recipients": """
        select l_orderkey as award_id,
               case when l_orderkey % 3 = 0 then cast(null as bigint) else o_custkey end as firm_id,
               case when l_orderkey % 3 = 1 then cast(null as bigint) else l_partkey end as person_id,
               case when l_linenumber = 1 then 'Project ' || cast(l_suppkey as string) end as project_name,
               cast(year(o_orderdate) as int) as year
        from lineitem join orders on l_orderkey = o_orderkey""",
    "v_queue": """
        select event_id as id, user_id as entity_id, case when event_id % 2 = 0 then 'firm' else 'person' end as entity_type,
               case event_type when 'click' then 'processing' when 'purchase' then 'done' when 'error' then 'failed'
                    else 'pending' end as status,
               ts as created_at, cast(event_id % 3 as int) as attempts
        from events""",
    "v_review": """
        select event_id as id, event_type || ' ' || cast(user_id as string) as candidate_name,
               case when event_id % 2 = 0 then 'firm' else 'person' end as entity_type,
               case when event_id % 10 = 9 then cast(null as bigint) else user_id end as suggested_entity_id,
               case when event_id % 29 = 0 then cast(null as double) when event_id % 31 = 0 then 0.0
                    else least(value / 200.0, 1.0) end as confidence,
               'trigram' as match_type,
               case event_type when 'click' then 'accepted' when 'purchase' then 'rejected' else 'pending' end as status
        from events""",
    "v_cursors": """
        select source || '_' || lang as source_name, cast(max(doc_id) as string) as last_cursor,
               case when max(doc_id) % 4 = 0 then cast(null as bigint) else max(n_chars) end as last_run_at,
               count(*) as entity_count,
               case max(doc_id) % 3 when 0 then 'ok' when 1 then 'partial' else 'error' end as status
        from documents group by source, lang""",
    "v_runs": """
        select event_type || '_' || cast(user_id % 11 as string) as name, cast(date_trunc('day', ts) as date) as run_day,
               count(*) as entity_count, round(sum(value), 2) as duration_s,
               max(case when value > 300 then 'timeout' end) as error
        from events group by 1, 2""",
}

_REFERENCES = re.compile(r"\bv_[a-z_]+\b")


def needed_views(sql: str) -> list[str]:
    """The stand-in views a statement uses, directly or through other views, in definition order."""
    wanted: set[str] = set()
    pending = {name for name in _REFERENCES.findall(sql) if name in VIEWS}
    while pending:
        name = pending.pop()
        wanted.add(name)
        pending |= {n for n in _REFERENCES.findall(VIEWS[name]) if n in VIEWS} - wanted
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str) -> str:
    """Prefix the statement with the views it uses as common table expressions."""
    body = sql.strip()
    parts = [f"{name} as ({VIEWS[name]})" for name in needed_views(body)]
    if not parts:
        return body
    if found := re.match(r"(?i)with\s+(recursive\s)?", body):
        return found[0] + ",\n".join(parts) + ",\n" + body[found.end() :]
    return "with " + ",\n".join(parts) + "\n" + body


class StandIns:
    """Lazy access: `s.base('orders')` is a Parquet table, `s.firms` the view `v_firms`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._small: dict[str, bool] = {}
        self._counted: set[str] = set()
        self._bytes = 0

    def _count(self, tables: list[str]) -> None:
        """Adds the files of tables not met before to the size of the input, by which shuffles are dealt."""
        if new := [t for t in tables if t not in self._counted]:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
                [f"{self.sf_dir}/{t}.parquet" for t in new])
            self._bytes += files.agg(F.sum("length")).first()[0] or 0
            self._counted.update(new)
            roomy_shuffles(self.spark, self._bytes)

    def base(self, table: str) -> DataFrame:
        """A Parquet table; a text table that is one small file is dealt out, see `_is_one_row_group`."""
        self._count([table])
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        if table in TEXT_TABLES and self._is_one_row_group(f"{self.sf_dir}/{table}.parquet"):
            return df.repartition(self.spark.sparkContext.defaultParallelism)
        return df

    def _is_one_row_group(self, path: str) -> bool:
        """Whether a table is one file no longer than a row group: Spark would read it in one task, and work on
        its texts would stay there. Dealing it out shuffles no more than that one group; the rows are the same.
        """
        if path not in self._small:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            sizes = [r["length"] for r in files.select("length").where("length > 0").limit(2).collect()]
            self._small[path] = len(sizes) == 1 and sizes[0] <= ROW_GROUP_BYTES
        return self._small[path]

    def sql(self, statement: str) -> DataFrame:
        """Run SQL over the base tables and stand-in views, without leaving temp views behind."""
        text = with_views(statement)
        used = [t for t in BASE_TABLES if re.search(rf"\b(from|join)\s+{t}\b", text)]
        self._count(used)
        for table in used:
            text = re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", text)
        return self.spark.sql(text, **{t: self.base(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"select * from {view}")

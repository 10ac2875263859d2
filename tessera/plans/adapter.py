"""Model tables projected from the driver's tables by SQL that both engines run unchanged.

A test harness: operators take model-shaped DataFrames and know nothing of it. ``{x}`` stands for a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {
    "symbols": """
select p_partkey as id, concat('c:@F@', p_brand, case when p_partkey % 6 = 0 then '@ST>1#T@F@' else '#' end, cast(p_size as string)) as usr,
       case p_partkey % 5 when 0 then 6 when 1 then 7 when 2 then 20 when 3 then 30 else 3 end as kind,
       case when p_partkey % 211 = 0 then 'main' else p_name end as name, concat(p_brand, '::', case when p_partkey % 211 = 0 then 'main' else p_name end) as qualified_name,
       cast(p_size % 5 as int) as linkage, cast(p_partkey % 4 as int) as visibility,
       p_partkey % 37 = 0 as exported, concat(p_brand, '#', cast(p_size as string), '#', cast(p_partkey % 2 as string)) as logical_id,
       case when p_partkey >= 10 then cast(floor(p_partkey / 10) as bigint) end as semantic_parent, cast(p_size as bigint) as type_id,
       cast(p_partkey % 32 as int) as function_flags, cast(p_partkey % 3 as int) as template_flags,
       case p_size % 5 when 0 then 'MACHINERY' when 1 then 'BUILDING' when 2 then 'AUTOMOBILE' when 3 then 'HOUSEHOLD' else 'FURNITURE' end as configuration_id
from {part}""",
    "translation_units": """
select c_custkey as id, cast(c_nationkey as bigint) as source_file, c_mktsegment as configuration_id, concat('h', cast(c_custkey % 3 as string)) as source_hash,
       concat('f', cast(c_custkey % 2 as string)) as compilation_fingerprint
from {customer}""",
    "revisions": """
select o_orderkey as id, o_custkey as tu_id, o_orderdate as seen_at,
       case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as quality, cast(o_orderkey % 3 as int) + 13 as extractor_version,
       concat('h', cast((o_custkey + case when o_orderkey % 4 = 0 then 1 else 0 end) % 3 as string)) as source_hash,
       concat('f', cast((o_custkey + case when o_orderkey % 5 = 0 then 1 else 0 end) % 2 as string)) as compilation_fingerprint
from {orders}""",
    "edges": """
select l_orderkey * 10 + l_linenumber as id,
       case when l_returnflag = 'R' then 8 when l_linenumber % 4 = 0 then 21 when l_linenumber % 4 = 1 then 22 when l_linenumber % 4 = 2 then 12 else 7 end as kind,
       (l_suppkey % 20) * 97 as source_id,
       case when l_returnflag = 'R' and l_linenumber % 5 = 0 and l_linenumber % 3 = 0 then null
            when l_returnflag = 'R' and l_linestatus <> 'O' and l_linenumber % 4 <> 1 then null
            when l_returnflag = 'R' then l_partkey - l_partkey % 3
            when l_linenumber % 4 = 1 then (l_suppkey % 20) * 97 else l_partkey end as target_symbol,
       case when l_linenumber % 6 = 0 then cast(l_linenumber as bigint) end as target_type, case when l_linenumber % 4 = 0 then p_type else '' end as unresolved_target,
       concat('c:@F@', p_brand, '#', cast(p_size as string)) as observed_target_usr, p_name as observed_target_spelling,
       l_orderkey as revision_id, cast(l_suppkey % 7 as bigint) as file_version_id, cast(l_orderkey % 3 as bigint) as bo,
       cast(l_orderkey % 3 as bigint) + 10 as eo,
       case when l_returnflag = 'R' and l_linestatus <> 'O' and l_linenumber % 4 <> 1 then 3 when l_linenumber % 5 = 0 then 3 else 0 end as resolution,
       cast(l_partkey % 3 as int) + 1 as dispatch, 0 as origin, case when l_linenumber % 5 = 0 then 1 when l_partkey % 9 = 4 then 4 else 0 end as target_domain,
       case when l_linenumber % 5 = 0 then 7 else 0 end as resolution_failure, 1 as access, l_linenumber = 7 as is_virtual, false as is_dependent
from {lineitem} join {part} on p_partkey = l_partkey
union all
select 1000000000000 + p_partkey, 13, p_partkey, cast(floor(p_partkey / 3) as bigint), null, '', null, null, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, false, false
from {part} where p_partkey % 2 = 0 and p_partkey >= 3
union all
select 2000000000000 + p_partkey, 11, p_partkey, cast(floor(p_partkey / 2) as bigint), null, '', null, null, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, false, false
from {part} where p_partkey % 7 = 0""",
    "occurrences": """
select l_orderkey * 10 + l_linenumber as id, l_partkey as symbol_id, l_orderkey as revision_id,
       case when l_linenumber % 3 = 0 and l_partkey % 4 <> 1 then 1 when l_linenumber % 3 <> 2 then 0 else 3 end as role, l_linenumber % 3 = 2 as implicit,
       case when l_tax < 0.06 then cast(l_linenumber as bigint) end as type_id, cast(l_suppkey % 32 as int) as function_flags, l_linestatus = 'F' and l_linenumber = 1 as exported,
       cast(l_suppkey % 7 as bigint) as file_version_id, l_linenumber as begin_line, cast(l_linenumber as bigint) * 10 as begin_offset
from {lineitem}""",
    "types": """
select cast(p_partkey as bigint) as id, cast(p_partkey % 14 as int) as kind, p_type as canonical_spelling from {part}""",
    "type_children": """
select p_partkey as type_id, 0 as position, (p_partkey * 7 + 3) % 500 as child_id from {part} where p_partkey % 3 <> 0
union all select p_partkey, 1, cast(floor(p_partkey / 2) as bigint) from {part} where p_partkey % 3 <> 0""",
    "files": """
select doc_id as id, concat(source, '/', lang, '/', cast(doc_id as string)) as path, lang <> 'en' as external from {documents}""",
    "file_versions": """
select doc_id as id, doc_id as file_id, {sha}(text{bits}) as content_hash, cast(octet_length(encode(text{utf8})) as bigint) as size from {documents}""",
    "includes": """
select p_partkey as includer, (p_partkey * 7 + 3) % 500 as included from {part} union all select p_partkey, cast(floor(p_partkey / 2) as bigint) from {part}""",
    "diagnostics": """
select event_id as id, cast(user_id % 4 as int) as severity, event_type as option_name, concat('m', cast(user_id % 5 as string)) as message from {events}""",
    "build_targets": """
select cast(n_nationkey as bigint) as id, n_name as name, case when n_nationkey % 5 = 0 then 1 when n_nationkey % 7 = 0 then 5 else 2 end as kind, n_nationkey % 6 <> 5 as topology_authoritative from {nation}""",
    "target_dependencies": """
select cast(n_nationkey as bigint) as consumer_id, cast((n_nationkey + 1) % 25 as bigint) as dependency_id from {nation} where n_nationkey % 5 <> 4""",
    "target_memberships": """
select cast(c_nationkey as bigint) as target_id, c_custkey as tu_id from {customer} where c_custkey % 9 <> 0""",
    "entry_roots": """
select p_partkey as id, p_partkey as symbol_id, cast(p_partkey % 4 as int) as kind, concat('r', cast(p_partkey % 3 as string)) as reason, p_brand as configuration_id
from {part} where p_partkey % 41 = 0""",
    "summaries": """
select l_orderkey * 10 + l_linenumber as call_observation, l_orderkey % 2 = 0 as complete, l_suppkey % 3 = 0 as storage_escapes, {arr}(2000000000000 + l_partkey) as modeled_addresses from {lineitem} where l_returnflag = 'R' and l_linenumber % 3 = 2""",
}


def names_in(sql: str, known) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in known]


class Model:
    """Model tables of one directory, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def base(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            sql = VIEWS[name].replace("{sha}", "sha2").replace("{bits}", ", 256").replace("{utf8}", ", 'UTF-8'").replace("{arr}", "array")
            self._made[name] = self._spark.sql(sql, **{t: self.base(t) for t in names_in(sql, BASE)})
        return self._made[name]


def duck(sql: str) -> str:
    """sql over model tables (``{symbols}``), with those it names in front of it as common tables for DuckDB."""
    used = names_in(sql, VIEWS)
    views = []
    for n in used:
        v = VIEWS[n].replace("{sha}", "sha256").replace("{bits}", "").replace("{utf8}", "").replace("{arr}", "list_value")
        for b in names_in(v, BASE):
            v = v.replace("{%s}" % b, b)
        views.append(f"m_{n} as ({v})")
        sql = sql.replace("{%s}" % n, f"m_{n}")
    for b in names_in(sql, BASE):
        sql = sql.replace("{%s}" % b, b)
    sql = sql.strip()
    if not views:
        return sql
    if sql.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(views) + ", " + sql[len("with recursive") :]
    if sql.lower().startswith("with "):
        return "with " + ", ".join(views) + ", " + sql[5:]
    return "with " + ", ".join(views) + " " + sql

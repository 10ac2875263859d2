"""Registered queries of the engine's own operators, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import analysis, audit, canon, canonicalise, export, fixpoint, incremental, resolve, validate
from .adapter import Model, duck

Q: dict[str, tuple[Callable[[Model], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


EDGE = ", ".join(export.EDGE_KEY)


@query("snk04_semantic_edges", f"""
select {EDGE}, count(*) as evidence_count, min(e.id) as representative,
       coalesce(string_agg(distinct u.configuration_id, ',' order by u.configuration_id), '') as configurations
from {{edges}} e left join {{revisions}} r on r.id = e.revision_id left join {{translation_units}} u on u.id = r.tu_id group by {EDGE.replace('id,', 'id,')}""")
def _(m):
    return export.semantic_edges(m.edges, m.revisions, m.translation_units)


@query("snk03_observations", f"""
select {EDGE}, cast(1 as bigint) as evidence_count, e.id as representative, coalesce(u.configuration_id, '') as configurations
from {{edges}} e left join {{revisions}} r on r.id = e.revision_id left join {{translation_units}} u on u.id = r.tu_id""")
def _(m):
    return export.observations(m.edges, m.revisions, m.translation_units)


@query("snk05_edge_records", f"""
with g as (
  select e.kind, e.source_id, e.target_symbol, e.target_type, e.unresolved_target, e.observed_target_usr, e.observed_target_spelling, e.resolution, e.dispatch, e.origin, e.target_domain, e.resolution_failure, e.access, e.is_virtual, e.is_dependent, count(*) as n,
    coalesce(string_agg(distinct u.configuration_id, ',' order by u.configuration_id), '') as configurations
  from {{edges}} e left join {{revisions}} r on r.id = e.revision_id left join {{translation_units}} u on u.id = r.tu_id
  group by e.kind, e.source_id, e.target_symbol, e.target_type, e.unresolved_target, e.observed_target_usr, e.observed_target_spelling, e.resolution, e.dispatch, e.origin, e.target_domain, e.resolution_failure, e.access, e.is_virtual, e.is_dependent)
select concat('relationship|', {S.enum_sql('g.kind', 'relationship')}, '|', coalesce(s.qualified_name, ''), '|',
  case when g.target_symbol is not null then coalesce(t.qualified_name, '') else coalesce(ty.canonical_spelling, g.unresolved_target, '') end, '|',
  {S.enum_sql('g.resolution', 'resolution')}, '|', {S.enum_sql('g.dispatch', 'dispatch')}, '|', {S.enum_sql('g.origin', 'origin')}, '|domain:', {S.enum_sql('g.target_domain', 'domain')},
  '|failure:', {S.enum_sql('g.resolution_failure', 'failure')}, '|observed-usr:', coalesce(g.observed_target_usr, ''), '|observed-spelling:', coalesce(g.observed_target_spelling, ''),
  '|evidence:', cast(g.n as string), '|configurations:', g.configurations) as line
from g left join {{symbols}} s on s.id = g.source_id left join {{symbols}} t on t.id = g.target_symbol left join {{types}} ty on ty.id = g.target_type""")
def _(m):
    return export.edge_record(export.target_name(m.symbols, m.types, export.semantic_edges(m.edges, m.revisions, m.translation_units)))


@query("snk05_symbol_records", f"""
select concat('symbol|', {S.enum_sql('kind', 'symbol')}, '|', qualified_name, '|', cast(id as string), '|logical:', coalesce(logical_id, ''), '|exported:', case when exported then '1' else '0' end) as line from {{symbols}}""")
def _(m):
    return export.symbol_record(m.symbols)


@query("snk07_normalised_snapshot")
def _(m):
    return export.normalised_snapshot(m)


@query("snk03_export_records")
def _(m):
    return export.export_records(m)


@query("cli06_query_calls", f"select id, source_id, target_symbol, {S.enum_sql('dispatch', 'dispatch')} as dispatch_name from {{edges}} where kind = 8")
def _(m):
    return export.query(m.edges, "Calls").select("id", "source_id", "target_symbol", S.enum_name(F.col("dispatch"), "dispatch").alias("dispatch_name"))


TABLES = ("symbols", "edges", "occurrences", "revisions", "types", "files", "file_versions", "includes", "diagnostics", "build_targets", "target_dependencies", "target_memberships", "entry_roots", "summaries")


@query("cli03_inspect", " union all ".join(f"select '{t}' as what, count(*) as n from {{{t}}}" for t in TABLES))
def _(m):
    return export.inspect(m, TABLES)


@query("cli07_diagnostics", "select severity, option_name, message, count(*) as n from {diagnostics} group by severity, option_name, message")
def _(m):
    return export.diagnostics(m.diagnostics)


@query("fn07_enum_names", f"select id, {S.enum_sql('kind', 'symbol')} as kind_name, {S.enum_sql('linkage', 'linkage')} as linkage_name, {S.enum_sql('visibility', 'visibility')} as visibility_name from {{symbols}}")
def _(m):
    return m.symbols.select("id", *[S.enum_name(F.col(c), d).alias(f"{c}_name") for c, d in (("kind", "symbol"), ("linkage", "linkage"), ("visibility", "visibility"))])


@query("fn08_flags", "select id, (function_flags & 1) = 1 as f0, (function_flags & 16) = 16 as f4, reverse(lpad(bin(function_flags), 5, '0')) as state from {symbols}")
def _(m):
    return m.symbols.select("id", X.flag(F.col("function_flags"), 0).alias("f0"), X.flag(F.col("function_flags"), 4).alias("f4"), X.state_string(F.col("function_flags"), 5).alias("state"))


@query("fn02_path_within", "select id, path = 'src0/en' or starts_with(path, 'src0/en/') as inside from {files}")
def _(m):
    return m.files.select("id", X.path_is_within(F.col("path"), F.lit("src0/en")).alias("inside"))


@query("fn03_append_key", "select id, concat(cast(octet_length(encode(path)) as string), ':', path, ';') as k from {files}")
def _(m):
    return m.files.select("id", X.append_key(F.col("path")).alias("k"))


@query("fn10_unsigned_literal", """
select p_partkey as id, form, p_partkey as v from {part}, (values ('hexadecimal'), ('decimal'), ('octal')) f(form)""")
def _(m):
    """Each number written in three ways, read back."""
    n = F.col("p_partkey")
    forms = {"hexadecimal": F.concat(F.lit("0x"), F.hex(n), F.lit("u")), "decimal": F.concat(n.cast("string"), F.lit("UL")), "octal": F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8))}
    rows = m.base("part").select(n.alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("form"), t.alias("text")) for k, t in forms.items()])).alias("f"))
    return rows.select("id", "f.form", X.unsigned_literal(F.col("f.text")).cast("bigint").alias("v"))


@query("fn11_source_slice", """
select doc_id, 'all' as part, text as piece from {documents} union all select doc_id, 'head', left(text, length(text) // 2) from {documents}
union all select doc_id, 'tail', substr(text, length(text) // 2 + 1) from {documents}""")
def _(m):
    text, zero = F.col("text"), F.lit(0)
    cut, end = F.octet_length(F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))), F.octet_length(text)
    part = lambda name, a, b: F.struct(F.lit(name).alias("part"), X.source_slice(text, a, b).alias("piece"))
    return m.base("documents").select("doc_id", F.inline(F.array(part("all", zero, end), part("head", zero, cut), part("tail", cut, end))))


@query("fn18_usr_suffix", "select id, case when contains(usr, '@F@') then concat('@F@', list_last(string_split(usr, '@F@'))) else '' end as suffix from {symbols}")
def _(m):
    return m.symbols.select("id", X.usr_suffix(F.col("usr")).alias("suffix"))


@query("fn01_normal_paths", "select doc_id as id, concat('/', source, '/', lang, '/', cast(doc_id as string)) as path from {documents}")
def _(m):
    id, odd = F.col("doc_id").cast("string"), [F.lit("/"), F.col("source"), F.lit("/./x/../"), F.col("lang"), F.lit("//")]
    return m.base("documents").select(F.col("doc_id").alias("id"), X.normalize_path(F.concat(*odd, id), F.lit("/elsewhere")).alias("path"))


@query("can04_files", """
select sha256(concat('file|w|', path)) as file_id, path, external, sha256(concat('file-version|', sha256(concat('file|w|', path)), '|', case when external then concat('missing:', sha256(path)) else content_hash end)) as id,
  case when external then 0 else size end as size from {files} join {file_versions} v on v.file_id = files.id""".replace("files.id", "m_files.id"))
def _(m):
    """Files that are external don't exist; those inside do."""
    rows = m.files.select("path", F.lit("").alias("source_path"), F.when(~F.col("external"), F.array("path")).alias("project_roots"))
    hashes = m.files.where("not external").join(m.file_versions.select(F.col("file_id").alias("id"), "content_hash", "size"), "id").select("path", "content_hash", "size")
    files, versions = canonicalise.files(rows, hashes, "w")
    return files.select(F.col("id").alias("file_id"), "path", "external").join(versions.select("file_id", "id", "size"), "file_id")


@query("can07_representatives", """
select concat('k', cast(l_suppkey as string)) as local_identity, cast(l_orderkey as string) as tu, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) as usr, count(distinct l_returnflag) > 1 as contradicted from {lineitem} group by l_suppkey, l_orderkey""")
def _(m):
    of = lambda c: F.col(c).cast("string")
    facts = m.base("lineitem").select(of("l_orderkey").alias("tu"), F.concat(F.lit("k"), of("l_suppkey")).alias("local_identity"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("seq"), F.col("l_returnflag").alias("usr"), F.lit(6).alias("kind"), F.lit("p").alias("semantic_parent"))
    first, _ = canonicalise.representatives(facts)
    several = facts.groupBy("tu", "local_identity").agg((F.count_distinct("usr") > 1).alias("contradicted"))
    return first.select("tu", "local_identity", "usr").join(several, ["tu", "local_identity"])


@query("can08_symbol_ids", """
with recursive f as (select p_partkey % 15 as t, cast(floor(p_partkey / 15) as bigint) as j, concat('c:@F@', p_brand, '#', cast(p_size as string)) as usr, sha256(cast(p_partkey % 5 as string)) as c from {part}),
r as (select t, j, usr, c, sha256(concat('usr|', usr, '|configuration|', c, '|parent|global')) as id from f where j = 0
  union all select f.t, f.j, f.usr, f.c, sha256(concat('usr|', f.usr, '|configuration|', f.c, '|parent|', r.id)) from f join r on r.t = f.t and r.j = cast(floor(f.j / 4) as bigint) and f.j > 0)
select cast(t as string) as tu, concat('k', cast(j as string)) as local_identity, id from r""")
def _(m):
    """Fifteen units in five configurations, symbols in trees of four children a node."""
    n, j = F.col("p_partkey"), F.floor(F.col("p_partkey") / 15)
    name = lambda k: F.concat(F.lit("k"), k.cast("string"))
    reps = m.base("part").select(
        (n % 15).cast("string").alias("tu"), name(j).alias("local_identity"), F.when(j > 0, name(F.floor(j / 4))).alias("semantic_parent"), F.concat(F.lit("c:@F@"), "p_brand", F.lit("#"), F.col("p_size").cast("string")).alias("usr"),
        F.sha2((n % 5).cast("string"), 256).alias("configuration_id"), (n % 15).cast("string").alias("place"), F.lit(4).alias("linkage"), F.lit(False).alias("is_anonymous"), F.lit(7).alias("kind"), F.lit("f").alias("name"),
        F.lit("f").alias("qualified_name"), F.lit("").alias("signature"), F.lit("").alias("source_file"),
    )
    none = m._spark.createDataFrame([], "configuration_id string, usr string, id string, place string")
    return canonicalise.symbol_ids(reps, none, "w").select("tu", "local_identity", "id")


@query("can12_parent_edges", """
select sha256(concat('semantic-parent|', cast(o.revision_id as string), '|', cast(o.symbol_id as string), '|', cast(s.semantic_parent as string), '|', cast(o.file_version_id as string), '|', cast(o.begin_offset as string))) as id,
  any_value(o.symbol_id) as source_id, any_value(s.semantic_parent) as target_symbol from {occurrences} o join {symbols} s on s.id = o.symbol_id where s.semantic_parent is not null group by 1""")
def _(m):
    seen = m.occurrences.withColumnRenamed("id", "seq").join(m.symbols.select(F.col("id").alias("symbol_id"), F.col("semantic_parent").alias("parent_id")), "symbol_id")
    for c in canonicalise.RANGE:
        seen = seen if c in seen.columns else seen.withColumn(c, F.lit(0))
    return canonicalise.parent_edges(seen).select("id", "source_id", "target_symbol")


@query("can15_diagnostics", """
select sha256(concat('diagnostic|', cast(user_id as string), '|', cast(user_id % 4 as string), '|', event_type, '|', cast(event_id % 10 as string))) as id, arg_max(event_id, event_id) as begin_line from {events} group by 1""")
def _(m):
    rows = m.base("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("revision_id"), (F.col("user_id") % 4).alias("severity"), F.col("event_type").alias("message"), F.lit("").alias("option_name"), F.lit(0).alias("file_version_id"), (F.col("event_id") % 10).alias("begin_offset"), F.col("event_id").alias("begin_line"))
    for c in canonicalise.RANGE:
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(0))
    return canonicalise.diagnostics(rows).select("id", "begin_line")


@query("ident_revision_ids", "select id, sha256(concat('tu-revision|', cast(tu_id as string), '|', cast(quality as string), '|', cast(extractor_version as string))) as revision_key from {revisions}")
def _(m):
    return m.revisions.select("id", X.digest("tu-revision", F.col("tu_id"), F.col("quality"), F.col("extractor_version")).alias("revision_key"))


@query("can02_detach", """
with a as (select arg_max(id, (seen_at, id)) as rid, arg_max(quality, (seen_at, id)) as q from {revisions} group by tu_id), gone as (select rid from a where q <> 0)
select 'edges' as what, count(*) as n from {edges} where revision_id not in (select rid from gone)
union all select 'occurrences', count(*) from {occurrences} where revision_id not in (select rid from gone)""")
def _(m):
    """Both observation tables without the units whose active revision isn't complete."""
    active = canon.active_revisions(m.revisions).select(F.col("revision_id").alias("id"))
    tus = m.revisions.where("quality <> 0").join(active, "id", "left_semi").select("tu_id")
    left = lambda what, t: canon.detach(t, m.revisions, tus).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return left("edges", m.edges).union(left("occurrences", m.occurrences))


@query("can05_active_revisions", "select tu_id, arg_max(id, (seen_at, id)) as revision_id from {revisions} group by tu_id")
def _(m):
    return canon.active_revisions(m.revisions)


@query("can06_ordered_children", "select type_id, string_agg(cast(child_id as string), ',' order by position, child_id) as children from {type_children} group by type_id")
def _(m):
    return canon.ordered_children(m.type_children)


@query("can03_collisions", "select l_partkey as id from (select l_partkey, count(distinct l_suppkey) as k from {lineitem} group by l_partkey) where k > 1")
def _(m):
    return canon.collisions(m.base("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("k")), "k")


@query("can08_parent_paths", """
with recursive p as (
  select s.id, 0 as depth, cast(s.id as string) as path from {symbols} s where s.semantic_parent is null or s.semantic_parent not in (select id from {symbols})
  union all select s.id, p.depth + 1, concat(p.path, '/', cast(s.id as string)) from {symbols} s join p on s.semantic_parent = p.id)
select id, depth, path from p""")
def _(m):
    roots = m.symbols.where("semantic_parent is null").select("id", F.lit(-1).cast("bigint").alias("semantic_parent"))
    return canon.parent_paths(m.symbols.where("semantic_parent is not null").select("id", "semantic_parent").union(roots))


@query("can09_logical_groups", "select logical_id, count(*) as variants, min(id) as low from {symbols} where usr <> '' group by logical_id")
def _(m):
    return canon.logical_groups(m.symbols)


@query("can10_unique_usr", "select configuration_id, usr, min(id) as id from {symbols} group by configuration_id, usr having count(distinct id) = 1")
def _(m):
    return canon.unique_usr(m.symbols)


@query("can11_merge_occurrences", "select symbol_id, role, bit_or(function_flags) as function_flags, bool_or(exported) as exported, bool_and(implicit) as implicit, count(*) as n from {occurrences} group by symbol_id, role")
def _(m):
    return canon.merge_occurrences(m.occurrences, "symbol_id", "role")


@query("can13_resolve_targets", """
with u as (select configuration_id as c, usr, min(id) as by_usr from {symbols} where usr <> '' group by 1, 2 having count(distinct id) = 1),
e as (select e.*, coalesce(e.target_symbol, u.by_usr) as t from {edges} e left join {revisions} r on r.id = e.revision_id left join {translation_units} x on x.id = r.tu_id
  left join u on u.usr = e.observed_target_usr and u.c = x.configuration_id where e.source_id in (select id from {symbols}))
select id, t as target_symbol, case when resolution = 0 and t is null and target_type is null then 3 else resolution end as resolution,
  case when t is not null or target_type is not null or resolution_failure <> 0 then resolution_failure when target_domain = 0 then 1 when target_domain = 1 then 7 when target_domain = 2 then 5 when target_domain = 3 then 6 else 8 end as resolution_failure from e""")
def _(m):
    return canon.resolve_targets(export.configured(m.edges, m.revisions, m.translation_units), m.symbols).select("id", "target_symbol", "resolution", "resolution_failure")


@query("can14_macro_bindings", """
with d as (select l_orderkey as r, l_shipmode as name, max(l_linenumber) as seq from (select l_orderkey, l_linestatus as l_shipmode, l_linenumber from {lineitem} where l_returnflag = 'N') group by 1, 2)
select l.l_orderkey as revision_id, l.l_linestatus as name, cast(l.l_linenumber as bigint) as id, cast(d.seq as bigint) as definition_id
from {lineitem} l left join d on d.r = l.l_orderkey and d.name = l.l_linestatus where l.l_returnflag <> 'N'""")
def _(m):
    rows = m.base("lineitem").select(F.col("l_orderkey").alias("revision_id"), F.col("l_linestatus").alias("name"), F.col("l_linenumber").cast("bigint").alias("id"), "l_linenumber", "l_returnflag")
    return canon.macro_bindings(rows.where("l_returnflag <> 'N'").select("revision_id", "name", "id"), rows.where("l_returnflag = 'N'").select("revision_id", "name", "id", F.col("l_linenumber").alias("seq")))


@query("can16_properties", """
select symbol_id, bit_or(function_flags) as function_flags, bool_or(exported) as exported,
  arg_min(type_id, (-(case when role = 1 then 3 when not implicit then 2 else 1 end), id)) filter (where type_id is not null) as type_id
from {occurrences} group by symbol_id""")
def _(m):
    return canon.properties(m.occurrences)


@query("can17_completeness", """
with a as (select tu_id, arg_max(quality, (seen_at, id)) as q from {revisions} group by tu_id)
select count(*) as total, count(*) filter (where q = 0) as complete, count(*) filter (where q = 1) as warning, count(*) filter (where q = 2) as partial, count(*) filter (where q = 3) as failed from a""")
def _(m):
    return canon.completeness(m.revisions)


@query("can18_live_types", """
with recursive r as (select id from (select type_id as id from {symbols} union select type_id from {occurrences}) where id is not null union select c.child_id from r join {type_children} c on c.type_id = r.id)
select id, kind, canonical_spelling from {types} where id in (select id from r)""")
def _(m):
    used = m.symbols.select(F.col("type_id").alias("id")).union(m.occurrences.select("type_id"))
    return canon.live_types(m.types, m.type_children, used)


@query("can18_live_symbols", """
with a as (select arg_max(id, (seen_at, id)) as rid from {revisions} group by tu_id)
select id, usr from {symbols} where id in (select symbol_id from {occurrences} where revision_id in (select rid from a))""")
def _(m):
    return canon.live_symbols(m.symbols, m.occurrences, canon.active_revisions(m.revisions)).select("id", "usr")


CLOSURE = """with recursive o as (select target_symbol as src, source_id as dst from {edges} where kind = 13),
c as (select src, dst from o where src in (select target_symbol from {edges} where kind = 8 and dispatch = 2 and resolution = 0) union select c.src, o.dst from c join o on o.src = c.dst) """


@query("res01_virtual_dispatch", CLOSURE + """
select distinct e.id as call_id, e.source_id, c.dst as target_symbol, e.revision_id, 1 as resolution, 2 as dispatch, 3 as origin, true as is_virtual
from {edges} e join c on c.src = e.target_symbol and c.src <> c.dst where e.kind = 8 and e.dispatch = 2 and e.resolution = 0""")
def _(m):
    return resolve.virtual_dispatch(m.edges)


@query("res02_cross_configuration", """
select e.id as call_id, e.source_id, s.id as target_symbol, e.revision_id, 1 as resolution, 4 as origin, 3 as resolution_failure
from {edges} e join {symbols} s on s.usr = e.observed_target_usr and s.usr <> ''
where e.kind = 8 and e.resolution = 3 and e.target_domain = 0 and s.id in (select symbol_id from {occurrences} where role = 1)""")
def _(m):
    return resolve.cross_configuration(m.edges, m.symbols, m.occurrences)


FLOW = """with recursive f as (select e.revision_id, e.source_id, e.target_symbol, s.kind as tk from {edges} e join {symbols} s on s.id = e.target_symbol where e.kind = 21 and e.origin = 0),
v as (select revision_id, source_id as storage, target_symbol as value from f where tk <> 30 union select f.revision_id, f.source_id, v.value from v join f on f.tk = 30 and f.revision_id = v.revision_id and f.target_symbol = v.storage) """


@query("res03_flow_values", FLOW + "select revision_id, storage, value from v")
def _(m):
    return resolve.flow_values(m.edges, m.symbols)


@query("res04_indirect_calls", FLOW + """, i as (select source_id, revision_id, file_version_id, bo, eo, arg_min(target_symbol, id) as storage from {edges} where kind = 22 and origin = 0 and target_symbol is not null group by all)
select distinct c.id as call_id, c.source_id, v.value as target_symbol, c.revision_id, 1 as resolution, 3 as dispatch, 3 as origin, 0 as target_domain, 0 as resolution_failure
from {edges} c join i on i.source_id = c.source_id and i.revision_id = c.revision_id and i.file_version_id = c.file_version_id and i.bo = c.bo and i.eo = c.eo
join v on v.revision_id = c.revision_id and v.storage = i.storage where c.kind = 8 and c.resolution = 3 and c.dispatch = 3 and c.origin = 0""")
def _(m):
    return resolve.indirect_calls(m.edges, m.symbols)


SETS = """with s as (select source_id, revision_id, file_version_id, bo, eo, count(distinct target_symbol) as n, array_to_string(list_sort(list(distinct target_symbol)), ',') as t
from {edges} where kind = 8 and target_symbol is not null group by all),
d as (select distinct call_observation as id from {summaries} where complete and not storage_escapes),
x as (select e.id as observation, case when (e.dispatch = 1 and e.resolution = 0 and e.target_symbol is not null) or d.id is not null then 0
  when e.dispatch = 1 and e.target_domain = 1 and s.n is null then 2 else 1 end as completeness, coalesce(s.n, 0) as n_targets, coalesce(s.t, '') as targets
from {edges} e left join s using (source_id, revision_id, file_version_id, bo, eo) left join d on d.id = e.id where e.kind = 8 and e.origin = 0) """


@query("res06_call_target_sets", SETS + "select observation, completeness, n_targets, targets from x")
def _(m):
    return resolve.call_target_sets(m.edges, m.summaries)


@query("cli03_call_set_histogram", SETS + "select completeness, count(*) as n from x group by completeness")
def _(m):
    return resolve.call_target_sets(m.edges, m.summaries).groupBy("completeness").agg(F.count("*").alias("n"))


@query("inc06_changed_files", """
with recursive n as (select id from {files} where external), r as (select id from n union select i.includer from r join {includes} i on i.included = r.id) select id from r""")
def _(m):
    """External files are gone."""
    now = m.file_versions.join(m.files.select(F.col("id").alias("file_id"), "external", "path"), "file_id")
    now = now.select("file_id", F.when(F.col("external"), F.concat(F.lit("missing:"), F.sha2("path", 256))).otherwise(F.col("content_hash")).alias("content_hash"))
    return incremental.changed_files(m.file_versions, now, m.includes)


PLAN = """with a as (select tu_id, arg_max(extractor_version, (seen_at, id)) as v, arg_max(source_hash, (seen_at, id)) as h, arg_max(compilation_fingerprint, (seen_at, id)) as f from {revisions} group by tu_id),
p as (select u.id as tu_id, case when a.tu_id is null then 'new' when u.source_file in (select id from {files} where external) then 'invalidated' when a.h <> u.source_hash then 'source' when a.f <> u.compilation_fingerprint then 'fingerprint' when a.v <> 15 then 'extractor' else 'unchanged' end as reason
from {translation_units} u left join a on a.tu_id = u.id) """


@query("inc08_plan", PLAN + "select tu_id, case when reason = 'unchanged' then 'reuse' else 'extract' end as action, reason from p")
def _(m):
    return incremental.plan(m.translation_units, m.revisions, m.files.where("external").select("id"), 15)


@query("inc05_removed_units", "select distinct tu_id from {revisions} where tu_id not in (select id from {translation_units} where configuration_id <> 'MACHINERY')")
def _(m):
    return incremental.removed_units(m.revisions, m.translation_units.where("configuration_id <> 'MACHINERY'"))


@query("inc02_conflicting_commands", "select l_orderkey as source, l_linestatus as configuration from {lineitem} group by 1, 2 having count(distinct l_returnflag) > 1")
def _(m):
    return incremental.conflicting_commands(m.base("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linestatus").alias("configuration"), F.col("l_returnflag").alias("arguments")))


@query("inc11_entry_roots", """
with w as (select distinct o.symbol_id, u.configuration_id from {occurrences} o join {revisions} r on r.id = o.revision_id join {translation_units} u on u.id = r.tu_id),
modeled as (select unnest(modeled_addresses) as id from {summaries} where complete and not storage_escapes),
k as (select id as symbol_id, 0 as kind, '%s' as reason from {symbols} where kind = 6 and name = 'main' union all select id, 1, '%s' from {symbols} where exported
  union all select id, 2, '%s' from {symbols} where qualified_name = 'Brand#1::small ring' union all select distinct target_symbol, 3, '%s' from {edges} where kind = 11 and id not in (select id from modeled))
select sha256(concat('entry-root|', cast(symbol_id as string), '|', cast(kind as string), '|', reason, '|', configuration_id)) as id, symbol_id, kind, reason, configuration_id from k join w using (symbol_id)""" % incremental.REASONS)
def _(m):
    return incremental.entry_roots(m.symbols, m.occurrences, m.revisions, m.translation_units, m.edges, m.summaries, ("Brand#1::small ring",))


@query("inc13_orphan_configurations", "select distinct p_brand as id from {part} where p_brand not in (select configuration_id from {translation_units})")
def _(m):
    return incremental.orphan_configurations(m.translation_units, m.base("part").select(F.col("p_brand").alias("id")).distinct())


GRAPH = """with recursive s as (select * from {symbols}), lone as (select logical_id, min(id) as h from s group by logical_id),
mem as (select concat(qualified_name, '|', regexp_extract(usr, '.*(@F@.*)$', 1)) as f, id, contains(usr, '@ST>') or contains(usr, '@SP>') as t from s where contains(usr, '@F@')),
fam as (select f, min(id) as h from mem group by f having bool_or(t)),
g as (select source_id as a, target_symbol as b from {edges} where kind in (0, 8, 9, 10, 18, 19) and target_symbol is not null
  union all select h, s.id from s join lone using (logical_id) union all select s.id, h from s join lone using (logical_id)
  union all select h, mem.id from mem join fam using (f) union all select mem.id, h from mem join fam using (f)
  union all select x.id, y.id from s x join s y on x.qualified_name = y.qualified_name where x.kind = 6 and contains(x.usr, '@F@') and y.kind = 20 and y.template_flags & 1 = 1 and y.usr <> ''),
ge as (select distinct a, b from g where a <> b),
st as (select symbol_id as id from {entry_roots} union select id from s where kind in CALLABLE and linkage in (3, 4) and visibility <> 1 and id in (select symbol_id from {occurrences} where role = 1)),
r as (select id from st union select ge.b from r join ge on ge.a = r.id) """.replace("CALLABLE", str(S.CALLABLE))


def _seen(m):
    return analysis.reachable_symbols(m.edges, m.symbols, analysis.roots(m.symbols, m.occurrences, m.entry_roots))


@query("ana06_roots", "select symbol_id as id from {entry_roots} union select id from {symbols} where kind in (6, 7, 8, 9, 10, 11, 20, 29) and linkage in (3, 4) and visibility <> 1 and id in (select symbol_id from {occurrences} where role = 1)")
def _(m):
    return analysis.roots(m.symbols, m.occurrences, m.entry_roots)


@query("ana07_reachable", GRAPH + "select id from r")
def _(m):
    return _seen(m)


@query("ana08_open_targets", """
with recursive r as (select id from {build_targets} where kind in (1, 5) union select d.dependency_id from r join {target_dependencies} d on d.consumer_id = r.id)
select id from {build_targets} where not topology_authoritative or id not in (select id from r)""")
def _(m):
    return analysis.open_targets(m.build_targets, m.target_dependencies)


@query("ana09_target_root_issues", """
with own as (select distinct t.target_id, e.symbol_id, e.kind from {entry_roots} e join {occurrences} o on o.symbol_id = e.symbol_id and o.role = 1 join {revisions} r on r.id = o.revision_id join {target_memberships} t on t.tu_id = r.tu_id)
select 'target.multiple-process-entries' as code, target_id as id from own where kind = 0 group by target_id having count(distinct symbol_id) > 1
union all select 'roots.target-missing', id from {build_targets} where kind in (1, 5) and id not in (select target_id from own)""")
def _(m):
    return analysis.target_root_issues(m.build_targets, m.target_memberships, m.revisions, m.occurrences, m.entry_roots)


@query("ana10_stranded_bindings", """
with d as (select distinct symbol_id as id from {occurrences} where role = 1), g as (select * from {symbols} where id in (select id from d))
select e.id as edge_id, s.id as target_symbol from {edges} e join {symbols} s on s.id = e.target_symbol
where e.kind = 8 and e.resolution <> 3 and s.id not in (select id from d) and s.logical_id not in (select logical_id from g) and s.usr in (select usr from g where usr <> '')""")
def _(m):
    return analysis.stranded_bindings(m.edges, m.symbols, m.occurrences)


UNRESOLVED = """, dn as (select call_observation as id from {summaries} where complete and not storage_escapes),
ur as (select * from {edges} where kind = 8 and resolution = 3 and source_id in (select id from r) and id not in (select id from dn)),
un as (select case when target_domain = 0 then 'calls.project-unresolved' when target_domain = 3 or dispatch = 3 then 'calls.indirect-unresolved' else 'calls.unclassified-unresolved' end as class, count(*) as n
  from ur where target_domain in (0, 3, 4) or dispatch = 3 group by 1)"""


@query("ana11_unresolved_reachable", GRAPH + UNRESOLVED + " select class, n from un")
def _(m):
    return analysis.unresolved_reachable(m.edges, _seen(m), m.summaries)


DEAD = """, de as (select symbol_id as id from {occurrences} where role = 1 and not implicit),
dd as (select logical_id, min(id) as representative, arg_min(linkage, id) as linkage, arg_min(visibility, id) as visibility from s where kind in CALLABLE and not exported and id in (select id from de) group by logical_id),
dg as (select logical_id, count(*) as variants, count(*) filter (where id in (select id from r)) as hits from s group by logical_id),
dc as (select concat('logical:', logical_id) as group_key, representative, variants, linkage, visibility from dd join dg using (logical_id) where hits = 0)""".replace("CALLABLE", str(S.CALLABLE))


@query("ana12_dead_code", GRAPH + DEAD + " select * from dc")
def _(m):
    return analysis.dead_code(m.symbols, m.occurrences, _seen(m))


READINESS = UNRESOLVED + """, av as (select arg_max(quality, (seen_at, id)) as q from {revisions} group by tu_id),
ot as (select id from {build_targets} where kind in (1, 5) union select d.dependency_id from ot join {target_dependencies} d on d.consumer_id = ot.id),
ow as (select distinct t.target_id, e.symbol_id, e.kind from {entry_roots} e join {occurrences} o on o.symbol_id = e.symbol_id and o.role = 1 join {revisions} v on v.id = o.revision_id join {target_memberships} t on t.tu_id = v.tu_id),
bd as (select distinct symbol_id as id from {occurrences} where role = 1), bg as (select * from s where id in (select id from bd)),
rd as (select 1 as seq, 'coverage.incomplete' as code, count(*) - count(*) filter (where q = 0) as n from av having count(*) = 0 or count(*) > count(*) filter (where q = 0)
  union all select 2, 'target.topology-unproven', count(*) from {build_targets} where not topology_authoritative or id not in (select id from ot) having count(*) > 0
  union all select 3, 'roots.missing', 0 from {entry_roots} having count(*) = 0
  union all select 4, 'target.multiple-process-entries', count(*) from (select target_id from ow where kind = 0 group by target_id having count(distinct symbol_id) > 1) having count(*) > 0
  union all select 5, 'roots.target-missing', count(*) from {build_targets} where kind in (1, 5) and id not in (select target_id from ow) having count(*) > 0
  union all select 6, 'binding.declaration-only-target', count(*) from {edges} e join s on s.id = e.target_symbol where e.kind = 8 and e.resolution <> 3 and s.id not in (select id from bd)
    and s.logical_id not in (select logical_id from bg) and s.usr in (select usr from bg where usr <> '') having count(*) > 0
  union all select case when class like '%project%' then 7 when class like '%indirect%' then 8 else 9 end, class, n from un)"""


@query("ana09_readiness", GRAPH + READINESS + " select seq, code, n from rd")
def _(m):
    return analysis.readiness(m)


@query("ana13_confident_dead_code", GRAPH + READINESS + DEAD + f"""
select dc.*, case when (select count(*) from rd) = 0 and (linkage in (1, 2) or visibility = 1) then 'High' when (select count(*) from rd where code in {tuple(sorted(analysis.BASICS))}) = 0 then 'Medium' else 'Low' end as confidence,
  coalesce('{analysis.GATED}' || (select string_agg(code, ', ' order by seq, code) from rd), '{analysis.READY}') as reason from dc""")
def _(m):
    return analysis.confident_dead_code(m)


@query("ana14_candidates")
def _(m):
    return analysis.export_candidates(m)


@query("val_references", " union all ".join(
    f"select '{code}' as code, cast(t.{c} as string) as id from {{{t}}} t where t.{c} is not null and not exists (select 1 from {{{o}}} o where o.{k} = t.{c})" for code, t, c, o, k in validate.REFERENCES
))
def _(m):
    return validate.references(m)


@query("val_semantics", """
select 'resolution.exact-without-target' as code, cast(id as string) as id from {edges} where resolution = 0 and target_symbol is null and target_type is null
union all select 'resolution.unclassified', cast(id as string) from {edges} where resolution = 3 and resolution_failure = 0
union all select 'hierarchy.base-kind', cast(e.id as string) from {edges} e join {symbols} s on s.id = e.target_symbol where e.kind = 12 and s.kind not in (3, 4, 5, 19, 17, 18, 22, 23, 25)
union all select 'hierarchy.override-source', cast(e.id as string) from {edges} e join {symbols} s on s.id = e.source_id where e.kind = 13 and s.kind not in (7, 8, 9, 10, 11)
union all select 'hierarchy.override-target', cast(e.id as string) from {edges} e join {symbols} s on s.id = e.target_symbol where e.kind = 13 and s.kind not in (7, 8, 9, 10, 11)""")
def _(m):
    return validate.semantics(m.edges, m.symbols)


@query("val_lifetime", """
with a as (select arg_max(id, (seen_at, id)) as rid from {revisions} group by tu_id)
select 'lifetime.stale-revision' as code, cast(id as string) as id from {revisions} where id not in (select rid from a)
union all select 'lifetime.orphan-symbol', cast(id as string) from {symbols} where id not in (select symbol_id from {occurrences})
union all select 'revision.missing-active', cast(id as string) from {translation_units} where id not in (select tu_id from {revisions})
union all select 'revision.cardinality', cast(tu_id as string) from {revisions} group by tu_id having count(*) > 1""")
def _(m):
    return validate.lifetime(m)


@query("val_property_drift", """
with p as (select symbol_id, bit_or(function_flags) as f, bool_or(exported) as e from {occurrences} group by symbol_id)
select 'lifetime.symbol-properties' as code, cast(id as string) as id from {symbols} join p on p.symbol_id = id where function_flags <> f or exported <> e""")
def _(m):
    return validate.property_drift(m.symbols, m.occurrences)


@query("val_digest", "select 'identity.type-digest' as code, content_hash as id from {file_versions} where content_hash <> sha256(cast(size as string))")
def _(m):
    return validate.wrong_digest(m.file_versions, F.sha2(F.col("size").cast("string"), 256), "identity.type-digest", "content_hash")


@query("val_parent_cycles", """
with recursive e as (select distinct p_partkey as id, (p_partkey * 7 + 3) % 500 as parent from {part}),
ok as (select id from e where parent not in (select id from e) union select e.id from e join ok on e.parent = ok.id)
select id from e where id not in (select id from ok)""")
def _(m):
    return fixpoint.cyclic(m.base("part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7 + 3) % 500).alias("parent")))


@query("ver01_normalised_symbols", """
with o as (select symbol_id, count(*) filter (where role = 0) as d, count(*) filter (where role = 1) as f from {occurrences} group by symbol_id)
select kind, qualified_name, linkage, coalesce(d, 0) as declarations, coalesce(f, 0) as definitions from {symbols} left join o on symbol_id = id""")
def _(m):
    return audit.normalised_symbols(m.symbols, m.occurrences)


@query("ver05_semantic_diff", """
with v as (select arg_max(id, (seen_at, id)) as rid from {revisions} group by tu_id),
x as (select kind, source_id, target_symbol, resolution, dispatch, case when revision_id in (select rid from v) then 1 when revision_id in (select id from {revisions}) then -1 else 0 end as d from {edges}),
y as (select kind, source_id, target_symbol, resolution, dispatch, sum(d) as d from x group by all)
select kind, source_id, target_symbol, resolution, dispatch, case when d > 0 then '+' else '-' end as side, cast(abs(d) as bigint) as times from y where d <> 0""")
def _(m):
    """Edges of superseded revisions against those of the active ones; what no revision holds is in both."""
    row = ["kind", "source_id", "target_symbol", "resolution", "dispatch"]
    active = canon.active_revisions(m.revisions).select("revision_id")
    old = m.revisions.select(F.col("id").alias("revision_id")).join(active, "revision_id", "left_anti")
    return audit.semantic_diff(m.edges.join(active, "revision_id", "left_anti").select(*row), m.edges.join(old, "revision_id", "left_anti").select(*row))


@query("ver04_unmet_expectations", """
with w as (select kind, cast(40 as bigint) as c from {symbols} group by kind) select w.kind, w.c as "count", count(*) as found from w join {symbols} s using (kind) group by 1, 2 having count(*) <> w.c""")
def _(m):
    wanted = m.symbols.select("kind").distinct().withColumn("count", F.lit(40).cast("bigint"))
    return audit.unmet(wanted, m.symbols, ["kind"])


@query("ver07_positions", """
with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k, unnest(string_split(text, chr(10))) as s from {documents} where text is not null)
select doc_id as file_id, cast(sum(strlen(s) + 1) over (partition by doc_id order by k) - 1 as bigint) as "offset", k as line, cast(strlen(s) + 1 as bigint) as column_no from l
union all select doc_id, 0, null, null from {documents} where text is null""")
def _(m):
    docs = m.base("documents").select(F.col("doc_id").alias("file_id"), "text")
    return audit.positions(docs, audit.line_ends(docs))


@query("ver07_sql_audit", "select source_id, count(distinct target_symbol) as n from {edges} where kind = 8 and is_virtual = false group by source_id having count(distinct target_symbol) > 3")
def _(m):
    return audit.sql_check(m._spark, {"m_edges": m.edges}, "select source_id, count(distinct target_symbol) as n from m_edges where kind = 8 and is_virtual = false group by source_id having count(distinct target_symbol) > 3")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, sf_dir: f(Model(spark, sf_dir)))(f) for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duck(sql) for name, (_, sql) in Q.items() if sql}

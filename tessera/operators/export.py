"""Observation and semantic edge views, record and JSON-lines formats, inspection and queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import record_escape
from . import canon

EDGE_KEY = [
    "kind", "source_id", "target_symbol", "target_type", "unresolved_target", "observed_target_usr", "observed_target_spelling", "resolution", "dispatch", "origin",
    "target_domain", "resolution_failure", "access", "is_virtual", "is_dependent",
]


def configured(edges: DataFrame, revisions: DataFrame, units: DataFrame) -> DataFrame:
    """edges with configuration_id of the unit they were observed in (null if unknown)."""
    at = revisions.select(F.col("id").alias("revision_id"), "tu_id").join(units.select(F.col("id").alias("tu_id"), "configuration_id"), "tu_id").select("revision_id", "configuration_id")
    return edges.join(at, "revision_id", "left")


def semantic_edges(edges: DataFrame, revisions: DataFrame, units: DataFrame) -> DataFrame:
    """One row per distinct edge: its key, evidence_count, smallest observation id and configurations in ascending order."""
    sets = F.array_join(F.array_sort(F.collect_set(F.when(F.col("configuration_id") != "", F.col("configuration_id")))), ",")
    return configured(edges, revisions, units).groupBy(*EDGE_KEY).agg(F.count("*").alias("evidence_count"), F.min("id").alias("representative"), sets.alias("configurations"))


def target_name(symbols: DataFrame, types: DataFrame, edges: DataFrame, unresolved: str = "unresolved_target") -> DataFrame:
    """edges with source_name and target_name: qualified name of the symbol, else the type's spelling, else the text as written."""
    names = symbols.select(F.col("id").alias("_s"), F.col("qualified_name").alias("_n"))
    src = names.select(F.col("_s").alias("source_id"), F.col("_n").alias("source_name"))
    dst = names.select(F.col("_s").alias("target_symbol"), F.col("_n").alias("_symbol"))
    typ = types.select(F.col("id").alias("target_type"), F.col("canonical_spelling").alias("_type"))
    out = edges.join(src, "source_id", "left").join(dst, "target_symbol", "left").join(typ, "target_type", "left")
    name = F.when(F.col("target_symbol").isNotNull(), F.coalesce("_symbol", F.lit(""))).otherwise(F.coalesce("_type", F.col(unresolved), F.lit("")))
    return out.withColumns({"source_name": F.coalesce("source_name", F.lit("")), "target_name": name}).drop("_symbol", "_type")


def edge_record(named: DataFrame) -> DataFrame:
    """(line): record text of named edges with evidence_count and configurations."""
    t = lambda c: record_escape(F.coalesce(F.col(c), F.lit("")))
    e = lambda c, d: S.enum_name(F.col(c), d)
    parts = [
        F.lit("relationship|"), e("kind", "relationship"), F.lit("|"), t("source_name"), F.lit("|"), t("target_name"), F.lit("|"), e("resolution", "resolution"),
        F.lit("|"), e("dispatch", "dispatch"), F.lit("|"), e("origin", "origin"), F.lit("|domain:"), e("target_domain", "domain"), F.lit("|failure:"),
        e("resolution_failure", "failure"), F.lit("|observed-usr:"), t("observed_target_usr"), F.lit("|observed-spelling:"), t("observed_target_spelling"),
        F.lit("|evidence:"), F.col("evidence_count").cast("string"), F.lit("|configurations:"), F.coalesce("configurations", F.lit("")),
    ]
    return named.select(F.concat(*parts).alias("line"))


def symbol_record(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.concat(
        F.lit("symbol|"), S.enum_name(F.col("kind"), "symbol"), F.lit("|"), record_escape(F.col("qualified_name")), F.lit("|"), F.col("id").cast("string"),
        F.lit("|logical:"), F.coalesce("logical_id", F.lit("")), F.lit("|exported:"), F.col("exported").cast("int").cast("string"),
    ).alias("line"))


def symbol_json(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.to_json(F.struct(
        F.lit("symbol").alias("record"), F.col("id").cast("string").alias("id"), F.coalesce("logical_id", F.lit("")).alias("logical_symbol_id"),
        S.enum_name(F.col("kind"), "symbol").alias("kind"), F.col("qualified_name").alias("name"), "exported",
    )).alias("line"))


def observations(edges: DataFrame, revisions: DataFrame, units: DataFrame) -> DataFrame:
    """Every edge as its own evidence, in the columns of semantic_edges."""
    return configured(edges, revisions, units).select(*EDGE_KEY, F.lit(1).cast("bigint").alias("evidence_count"), F.col("id").alias("representative"), F.coalesce("configuration_id", F.lit("")).alias("configurations"))


def query(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of one kind; the filter reaches the scan."""
    return edges.where(F.col("kind") == S.ENUMS["relationship"].index(kind))


def query_lines(lines: DataFrame, kind: str, jsonl: bool = False) -> DataFrame:
    """The textual filter over exported lines: in JSON lines a symbol of that kind matches too."""
    return lines.where(F.col("line").contains(f'"kind":"{kind}"') if jsonl else F.col("line").contains(f"relationship|{kind}|"))


def inspect(model, tables: tuple[str, ...]) -> DataFrame:
    """(what, n) rows of each table."""
    return reduce(DataFrame.union, [getattr(model, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n") for t in tables])


def diagnostics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity", "option_name", "message").agg(F.count("*").alias("n"))


def _field(df: DataFrame, c: str):
    """A column as text: '' for null or a column the table doesn't have, booleans as 1 and 0."""
    if c not in df.columns:
        return F.lit("")
    x = F.col(c)
    return F.coalesce((x.cast("int") if dict(df.dtypes)[c] == "boolean" else x).cast("string"), F.lit(""))


RANGE = "{file_version_id}|{begin_line}:{begin_column}:{bo}-{end_line}:{end_column}:{eo}"
STATE = "{function_flags}|{variable_flags}|{template_flags}|{exported}"

#: Record types of the normalised snapshot in order: tag, table, the column they are ordered by, format.
SNAPSHOT = [
    ("workspace", "workspaces", "id", "{id}|{path}"),
    ("config", "configurations", "id", "{id}|{canonical_key}|{fingerprint}"),
    ("file", "files", "id", "{id}|{workspace_id}|{path}|{external}"),
    ("file-version", "file_versions", "id", "{id}|{file_id}|{content_hash}|{size}"),
    ("tu", "translation_units", "id", "{id}|{source_file}|{configuration_id}"),
    ("revision", "revisions", "id", "{id}|{tu_id}|{source_hash}|{compilation_fingerprint}|{extractor_version}|{quality}"),
    ("type", "types", "id", "{id}|{canonical_key}|{kind}|{is_const}{is_volatile}{is_restrict}|{spelling}|{canonical_spelling}|{named_symbol}|{array_extent}|{variadic}|{dependent}{children}{arguments}"),
    ("logical-symbol", "logical_symbols", "id", "{id}|{canonical_key}|{usr}|{linkage}{variants}"),
    ("symbol", "symbols", "id", "{id}|{canonical_key}|{usr}|{logical_id}|{kind}|{name}|{qualified_name}|{linkage}|{visibility}|{semantic_parent}|{type_id}|" + STATE),
    ("occurrence", "occurrences", "id", "{id}|{symbol_id}|{revision_id}|" + RANGE + "|{role}|{implicit}|{type_id}|" + STATE),
    ("relationship", "edges", "id", "{id}|{kind}|{source_id}|{target_symbol}|{target_type}|{unresolved_target}|{observed_target_usr}|{observed_target_spelling}|{revision_id}|" + RANGE
     + "|{resolution}|{dispatch}|{origin}|{target_domain}|{resolution_failure}|{access}|{is_virtual}|{is_dependent}"),
    ("macro-definition", "macro_definitions", "id", "{id}|{name}|{replacement}|{revision_id}|" + RANGE),
    ("macro-expansion", "macro_expansions", "id", "{id}|{name}|{definition_id}|{revision_id}|" + RANGE),
    ("include", "includes", "id", "{id}|{revision_id}|{includer}|{included}|{path}:{line}:{column}:{offset}|{kind}|{resolved}"),
    ("diagnostic", "diagnostics", "id", "{id}|{revision_id}|{severity}|{message}|{option_name}|" + RANGE),
    ("build-target", "build_targets", "id", "{id}|{name}|{kind}|{source}|{topology_authoritative}"),
    ("target-membership", "target_memberships", "id", "{id}|{target_id}|{tu_id}"),
    ("target-dependency", "target_dependencies", "id", "{id}|{consumer_id}|{dependency_id}"),
    ("entry-root", "entry_roots", "id", "{id}|{symbol_id}|{kind}|{reason}|{configuration_id}"),
    ("indirect-summary", "summaries", "id", "{id}|{call_observation}|{revision_id}|{configuration_id}|{analyzer_version}|{storage_provider}|{index_provider}|{domain_kind}|{domain_minimum}|{domain_maximum}"
     "|{known_zero_mask}|{storage_escapes}|{complete}|{reason}{values}{stored}{selected}{addresses}"),
    ("active", "active", "tu_id", "{tu_id}|{revision_id}"),
    ("completeness", "completeness", "total", "{total}|{complete}|{warning}|{partial}|{failed}"),
]


def _snapshot_table(model, name: str) -> DataFrame | None:
    """A table of the model, with lists as text; those that follow from others are made; None if the model has none of that name."""
    tagged = lambda tag, ids: F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit(f"|{tag}:"), x.cast("string"))))
    if name == "active":
        return canon.active_revisions(model.revisions)
    if name == "completeness":
        return canon.completeness(model.revisions)
    out = getattr(model, name, None)
    if name == "configurations" and out is None:
        return model.translation_units.select(F.col("configuration_id").alias("id")).where("id is not null").distinct()
    if name == "logical_symbols" and out is None:
        named = model.symbols.where("logical_id is not null and usr is not null and usr <> ''")
        return named.groupBy(F.col("logical_id").alias("id")).agg(
            F.min_by("usr", "id").alias("usr"), F.min_by("linkage", "id").alias("linkage"), tagged("variant", F.array_sort(F.collect_set(F.col("id").cast("string")))).alias("variants")
        )
    if name == "types":
        rows = F.array_sort(F.collect_list(F.struct("position", "child_id")))
        lists = model.type_children.groupBy(F.col("type_id").alias("_t")).agg(tagged("child", F.transform(rows, lambda r: r["child_id"])).alias("children"))
        out = out.join(lists, F.col("id") == F.col("_t"), "left")
    return out


def normalised_snapshot(model) -> DataFrame:
    """(line): every row of every table of a model as a record, by record type and then by id as text.

    Columns that a table lacks come out empty, so that fields keep their places.
    """
    parts = []
    for k, (tag, table, key, shape) in enumerate(SNAPSHOT):
        rows = _snapshot_table(model, table)
        if rows is not None:
            pieces = [_field(rows, x[1:-1]) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", shape) if x]
            parts.append(rows.select(F.lit(k).alias("k"), _field(rows, key).alias("id"), F.concat(F.lit(tag + "|"), *pieces).alias("line")))
    return reduce(DataFrame.union, parts).orderBy("k", "id", "line").select("line")


def ownership_records(model) -> DataFrame:
    """(line): build targets, their dependencies, entry roots and summaries of indirect calls."""
    r = lambda df, c: record_escape(_field(df, c))
    t, d, e, s = model.build_targets, model.target_dependencies, model.entry_roots, model.summaries
    e = e.join(model.symbols.select(F.col("id").alias("_s"), F.col("qualified_name").alias("symbol_name")), F.col("symbol_id") == F.col("_s"), "left")
    line = lambda df, *x: df.select(F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x]).alias("line"))
    count = lambda c: F.size(c).cast("string") if c in s.columns else F.lit("0")
    return reduce(DataFrame.union, [
        line(t, "build-target|", r(t, "name"), "|", S.enum_name(F.col("kind"), "target_kind"), "|", r(t, "source"), "|", _field(t, "id"), "|authoritative:", _field(t, "topology_authoritative")),
        line(d, "target-dependency|", _field(d, "consumer_id"), "|", _field(d, "dependency_id")),
        line(e, "entry-root|", S.enum_name(F.col("kind"), "root_kind"), "|", r(e, "symbol_name"), "|", r(e, "reason"), "|configuration:", _field(e, "configuration_id")),
        line(s, "indirect-call-summary|", _field(s, "id"), "|call:", _field(s, "call_observation"), "|version:", _field(s, "analyzer_version"), "|domain:", _field(s, "domain_minimum"), "..", _field(s, "domain_maximum"),
             "|stored:", count("stored_targets"), "|selectable:", count("selectable_targets"), "|escapes:", _field(s, "storage_escapes"), "|complete:", _field(s, "complete"), "|", r(s, "reason")),
    ])


def export_records(model, view: str = "observations") -> DataFrame:
    """(line): the whole export of a view: symbols, edges with their configurations, ownership."""
    edges = {"observations": observations, "semantic": semantic_edges}[view](model.edges, model.revisions, model.translation_units)
    return symbol_record(model.symbols).union(edge_record(target_name(model.symbols, model.types, edges))).union(ownership_records(model))

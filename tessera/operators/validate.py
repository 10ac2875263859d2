"""Integrity rules as DataFrames of (code, id); the validator is their union."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from . import canon, fixpoint, incremental

#: code, table, column, referred table, referred column
REFERENCES = [
    ("reference.tu-file", "translation_units", "source_file", "files", "id"),
    ("reference.revision-tu", "revisions", "tu_id", "translation_units", "id"),
    ("reference.file-version", "file_versions", "file_id", "files", "id"),
    ("reference.occurrence-symbol", "occurrences", "symbol_id", "symbols", "id"),
    ("reference.occurrence-revision", "occurrences", "revision_id", "revisions", "id"),
    ("reference.occurrence-type", "occurrences", "type_id", "types", "id"),
    ("reference.edge-source", "edges", "source_id", "symbols", "id"),
    ("reference.edge-target", "edges", "target_symbol", "symbols", "id"),
    ("reference.edge-type", "edges", "target_type", "types", "id"),
    ("reference.edge-revision", "edges", "revision_id", "revisions", "id"),
    ("reference.edge-file", "edges", "file_version_id", "file_versions", "id"),
    ("reference.symbol-parent", "symbols", "semantic_parent", "symbols", "id"),
    ("reference.symbol-type", "symbols", "type_id", "types", "id"),
    ("reference.type-child", "type_children", "child_id", "types", "id"),
    ("reference.include-source", "includes", "includer", "files", "id"),
    ("reference.include-target", "includes", "included", "files", "id"),
    ("reference.target-membership-target", "target_memberships", "target_id", "build_targets", "id"),
    ("reference.target-membership-tu", "target_memberships", "tu_id", "translation_units", "id"),
    ("reference.target-dependency", "target_dependencies", "dependency_id", "build_targets", "id"),
    ("reference.entry-root-symbol", "entry_roots", "symbol_id", "symbols", "id"),
    ("reference.indirect-call", "summaries", "call_observation", "edges", "id"),
]

#: The same of tables and columns that a model may lack; a list column refers by each of its elements.
MORE_REFERENCES = [
    ("reference.tu-config", "translation_units", "configuration_id", "configurations", "id"),
    ("reference.occurrence-file", "occurrences", "file_version_id", "file_versions", "id"),
    ("reference.symbol-logical", "symbols", "logical_id", "logical_symbols", "id"),
    ("reference.logical-variant", "logical_symbols", "variants", "symbols", "id"),
    ("reference.include-revision", "includes", "revision_id", "revisions", "id"),
    ("reference.diagnostic-revision", "diagnostics", "revision_id", "revisions", "id"),
    ("reference.diagnostic-file", "diagnostics", "file_version_id", "file_versions", "id"),
    ("reference.macro-revision", "macro_definitions", "revision_id", "revisions", "id"),
    ("reference.macro-file", "macro_definitions", "file_version_id", "file_versions", "id"),
    ("reference.expansion-revision", "macro_expansions", "revision_id", "revisions", "id"),
    ("reference.expansion-file", "macro_expansions", "file_version_id", "file_versions", "id"),
    ("reference.expansion-definition", "macro_expansions", "definition_id", "macro_definitions", "id"),
    ("reference.target-dependency", "target_dependencies", "consumer_id", "build_targets", "id"),
    ("reference.entry-root-configuration", "entry_roots", "configuration_id", "configurations", "id"),
    ("reference.indirect-revision", "summaries", "revision_id", "revisions", "id"),
    ("reference.indirect-revision", "summaries", "configuration_id", "configurations", "id"),
    ("reference.indirect-provider", "summaries", "storage_provider", "symbols", "id"),
    ("reference.indirect-provider", "summaries", "index_provider", "symbols", "id"),
    ("reference.indirect-stored-target", "summaries", "stored_targets", "symbols", "id"),
    ("reference.indirect-address", "summaries", "modeled_addresses", "edges", "id"),
]


def dangling(table: DataFrame, column: str, other: DataFrame, key: str, code: str) -> DataFrame:
    """Rows whose reference isn't null and finds nothing."""
    keys = other.select(F.col(key).alias("_key")).distinct()
    return table.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti").select(F.lit(code).alias("code"), F.col(column).cast("string").alias("id"))


def references(model) -> DataFrame:
    return reduce(DataFrame.union, [dangling(getattr(model, t), c, getattr(model, o), k, code) for code, t, c, o, k in REFERENCES])


def _has(model, table: str, *columns: str) -> bool:
    found = getattr(model, table, None)
    return found is not None and set(columns) <= set(found.columns)


def more_references(model) -> DataFrame | None:
    """MORE_REFERENCES as far as the model has their tables and columns; None if it has none of them."""
    found = []
    for code, t, c, o, k in MORE_REFERENCES:
        if _has(model, t, c) and _has(model, o, k):
            rows = getattr(model, t)
            if dict(rows.dtypes)[c].startswith("array"):
                rows = rows.select(F.explode(c).alias(c))
            found.append(dangling(rows, c, getattr(model, o), k, code))
    return reduce(DataFrame.union, found) if found else None


def consistency(model) -> DataFrame:
    """Stored facts that others contradict: semantic-parent edges, summaries, and what is stored of logical symbols,
    configurations, active revisions and completeness."""
    issue = lambda df, code, c: df.select(F.lit(code).alias("code"), F.col(c).cast("string").alias("id"))
    parents = model.symbols.select(F.col("id").alias("source_id"), "semantic_parent") if _has(model, "symbols", "semantic_parent") else None
    bad = "semantic_parent is null or semantic_parent <> target_symbol"
    found = []
    if parents is not None:
        found.append(issue(model.edges.where("kind = 2 and target_symbol is not null").join(parents, "source_id", "left").where(bad), "hierarchy.semantic-parent-edge", "id"))
    if not _has(model, "summaries", "complete", "storage_escapes"):
        model = SimpleNamespace(**{**{k: getattr(model, k, None) for k in ("edges", "symbols", "logical_symbols", "configurations", "translation_units", "active", "revisions", "completeness")}, "summaries": model.edges.select(F.lit("").alias("call_observation"), F.lit(False).alias("complete"), F.lit(False).alias("storage_escapes")).limit(0)})
    unsound = F.col("storage_escapes")
    if _has(model, "summaries", "selectable_targets"):
        unsound = unsound | (F.coalesce(F.size("selectable_targets"), F.lit(0)) <= 0)
    found.append(issue(model.summaries.where(F.col("complete") & unsound), "analysis.indirect-unsound-complete", "call_observation"))
    if _has(model, "summaries", "stored_targets", "selectable_targets"):
        over = model.summaries.select(F.explode(F.array_except("selectable_targets", F.coalesce("stored_targets", F.slice("selectable_targets", 1, 0)))).alias("t"))
        found.append(issue(over, "reference.indirect-selectable-target", "t"))
    if _has(model, "logical_symbols", "variants"):
        variants = model.logical_symbols.select(F.col("id").alias("l"), F.explode("variants").alias("id"))
        found.append(issue(variants.join(model.symbols.select("id", "logical_id"), "id").where(~F.col("l").eqNullSafe(F.col("logical_id"))), "reference.logical-membership", "id"))
    if _has(model, "configurations", "id"):
        found.append(issue(incremental.orphan_configurations(model.translation_units, model.configurations.select("id")), "lifetime.orphan-configuration", "id"))
    if _has(model, "active", "tu_id", "revision_id"):
        owner = model.revisions.select(F.col("id").alias("revision_id"), F.col("tu_id").alias("owner"))
        found.append(issue(model.active.join(owner, "revision_id", "left").where("owner is null or owner <> tu_id"), "revision.active-map", "tu_id"))
    if _has(model, "completeness"):
        cols = ["total", "complete", "warning", "partial", "failed"]
        wrong = canon.completeness(model.revisions).select(*cols).exceptAll(model.completeness.select(*cols))
        found.append(issue(wrong, "publication.completeness", "total"))
    return reduce(DataFrame.union, found)


def wrong_digest(table: DataFrame, expected, code: str, column: str = "id") -> DataFrame:
    """Rows whose id isn't the digest of their own key."""
    return table.where(F.col(column) != expected).select(F.lit(code).alias("code"), F.col(column).alias("id"))


def _of(prefix: str, *columns: str):
    """Digest of a prefix and columns with '|' between."""
    return X.digest(prefix, *[F.col(c) for c in columns])


#: code, table, what the id of a row must be
DIGESTS = [
    ("identity.configuration", "configurations", lambda: F.sha2("canonical_key", 256)),
    ("identity.tu-key", "translation_units", lambda: _of("tu", "source_file", "configuration_id")),
    ("identity.revision", "revisions", lambda: _of("tu-revision", "tu_id", "source_hash", "compilation_fingerprint", "extractor_version")),
    ("identity.file", "files", lambda: _of("file", "workspace_id", "path")),
    ("identity.file-version", "file_versions", lambda: _of("file-version", "file_id", "content_hash")),
    ("identity.symbol-digest", "symbols", lambda: F.sha2("canonical_key", 256)),
    ("identity.logical-symbol", "logical_symbols", lambda: F.sha2("canonical_key", 256)),
    ("identity.type-digest", "types", lambda: F.sha2("canonical_key", 256)),
    ("identity.build-target", "build_targets", lambda: _of("build-target", "workspace_id", "source", "name")),
    ("identity.target-membership", "target_memberships", lambda: _of("target-membership", "target_id", "tu_id")),
    ("identity.target-dependency", "target_dependencies", lambda: _of("target-dependency", "consumer_id", "dependency_id")),
    ("identity.entry-root", "entry_roots", lambda: _of("entry-root", "symbol_id", "kind", "reason", "configuration_id")),
    ("identity.indirect-summary", "summaries", lambda: _of("indirect-summary", "call_observation", "revision_id", "configuration_id", "analyzer_version")),
]
#: Columns the digests of a table are made of, so that tables which lack them are left out.
MADE_OF = {
    "configurations": ["canonical_key"], "symbols": ["canonical_key"], "logical_symbols": ["canonical_key"], "types": ["canonical_key"], "translation_units": ["source_file", "configuration_id"],
    "revisions": ["tu_id", "source_hash", "compilation_fingerprint", "extractor_version"], "files": ["workspace_id", "path"], "file_versions": ["file_id", "content_hash"], "build_targets": ["workspace_id", "source", "name"],
    "target_memberships": ["target_id", "tu_id"], "target_dependencies": ["consumer_id", "dependency_id"], "entry_roots": ["symbol_id", "kind", "reason", "configuration_id"],
    "summaries": ["call_observation", "revision_id", "configuration_id", "analyzer_version"],
}


def identities(model) -> DataFrame | None:
    """Ids that aren't the digests of what they stand for, empty keys, ids with several keys; None if the model has no table with such ids."""
    issue = lambda df, code, c="id": df.select(F.lit(code).alias("code"), F.col(c).cast("string").alias("id"))
    found = []
    for code, name, made in DIGESTS:
        if _has(model, name, "id", *MADE_OF[name]):
            found.append(wrong_digest(getattr(model, name), made(), code))
    if _has(model, "configurations", "canonical_key", "fingerprint"):
        found.append(issue(model.configurations.where(F.col("fingerprint") != F.sha2(F.concat(F.lit("compilation-fingerprint|"), "canonical_key"), 256)), "identity.configuration-fingerprint"))
    for name, what in (("symbols", "symbol"), ("types", "type")):
        if _has(model, name, "canonical_key"):
            rows = getattr(model, name)
            found.append(issue(rows.where("coalesce(canonical_key, '') = ''"), f"identity.{what}-key"))
            found.append(issue(canon.collisions(rows, "canonical_key"), f"identity.{what}-collision"))
    if _has(model, "logical_symbols", "usr"):
        found.append(issue(model.logical_symbols.where("coalesce(usr, '') = ''"), "identity.logical-symbol-usr"))
    return reduce(DataFrame.union, found) if found else None


def semantics(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exact edges without a target, unresolved ones without a reason, and inheritance or overriding between the wrong kinds."""
    s = lambda c: F.col(c).cast("string").alias("id")
    bare = edges.where("resolution = 0 and target_symbol is null and target_type is null").select(F.lit("resolution.exact-without-target").alias("code"), s("id"))
    plain = edges.where("resolution = 3 and resolution_failure = 0").select(F.lit("resolution.unclassified"), s("id"))
    kinds = symbols.select(F.col("id").alias("_id"), F.col("kind").alias("_kind"))
    base = edges.where("kind = 12 and target_symbol is not null").join(kinds, F.col("target_symbol") == F.col("_id")).where(~F.col("_kind").isin(*S.BASES)).select(F.lit("hierarchy.base-kind"), s("id"))
    over = edges.where("kind = 13 and target_symbol is not null").join(kinds, F.col("source_id") == F.col("_id")).where(~F.col("_kind").isin(*S.METHODS)).select(F.lit("hierarchy.override-source"), s("id"))
    under = edges.where("kind = 13").join(kinds, F.col("target_symbol") == F.col("_id")).where(~F.col("_kind").isin(*S.METHODS)).select(F.lit("hierarchy.override-target"), s("id"))
    return reduce(DataFrame.union, [bare, plain, base, over, under])


def lifetime(model) -> DataFrame:
    """Observations of revisions that aren't active, symbols without any, units without exactly one revision. Unused configurations are consistency()'s."""
    active = canon.active_revisions(model.revisions)
    stale = model.revisions.join(active.select(F.col("revision_id").alias("id")), "id", "left_anti").select(F.lit("lifetime.stale-revision").alias("code"), F.col("id").cast("string").alias("id"))
    orphan = model.symbols.join(model.occurrences.select(F.col("symbol_id").alias("id")), "id", "left_anti").select(F.lit("lifetime.orphan-symbol"), F.col("id").cast("string"))
    none = model.translation_units.join(model.revisions.select(F.col("tu_id").alias("id")), "id", "left_anti").select(F.lit("revision.missing-active"), F.col("id").cast("string"))
    many = model.revisions.groupBy("tu_id").count().where("count > 1").select(F.lit("revision.cardinality"), F.col("tu_id").cast("string"))
    return reduce(DataFrame.union, [stale, orphan, none, many])


def property_drift(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Symbols whose stored flags or export differ from what their occurrences add up to."""
    made = canon.properties(occurrences).select(F.col("symbol_id").alias("id"), F.col("function_flags").alias("f"), F.col("exported").alias("e"))
    return symbols.join(made, "id").where((F.col("function_flags") != F.col("f")) | (F.col("exported") != F.col("e"))).select(F.lit("lifetime.symbol-properties").alias("code"), F.col("id").cast("string").alias("id"))


def parent_cycles(symbols: DataFrame) -> DataFrame:
    found = fixpoint.cyclic(symbols.select("id", F.col("semantic_parent").alias("parent")))
    return found.select(F.lit("hierarchy.parent-cycle").alias("code"), F.col("id").cast("string").alias("id"))


def validate(model) -> DataFrame:
    """All issues (code, id) of a model."""
    parts = [references(model), semantics(model.edges, model.symbols), lifetime(model), property_drift(model.symbols, model.occurrences), parent_cycles(model.symbols), consistency(model), more_references(model), identities(model)]
    return reduce(DataFrame.union, [x for x in parts if x is not None])


def issues_of_build(model) -> DataFrame:
    """All issues of a model that build() has made: it has lists in its types, file versions that include, and its active revisions as a table."""
    own = SimpleNamespace(**vars(model))
    own.includes = model.includes.withColumnRenamed("includer", "including_version").join(model.file_versions.select(F.col("id").alias("including_version"), F.col("file_id").alias("includer")), "including_version", "left")
    own.type_children = model.types.select(F.col("id").alias("type_id"), F.explode("children").alias("child_id"))
    known = [(code, t, c, o, k) for code, t, c, o, k in REFERENCES if _has(own, t, c) and _has(own, o, k)]
    found = [dangling(getattr(own, t), c, getattr(own, o), k, code) for code, t, c, o, k in known]
    found.append(dangling(model.includes, "includer", model.file_versions, "id", "reference.include-source"))
    own.revisions = model.revisions.withColumn("seen_at", F.lit(0))
    found += [semantics(model.edges, model.symbols), lifetime(own), property_drift(model.symbols, model.occurrences), parent_cycles(model.symbols), consistency(own), more_references(own), identities(own)]
    return reduce(DataFrame.union, [x for x in found if x is not None])

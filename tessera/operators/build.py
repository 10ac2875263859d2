"""Building a model from raw facts, and keeping it current: what to extract, what to replace, what to publish."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import snapshot
from ..sources.scratch import table
from . import canon, canonicalise, incremental, resolve, validate

#: Tables of a published model, in no order.
TABLES = (
    "configurations", "files", "file_versions", "translation_units", "revisions", "types", "symbols", "logical_symbols", "occurrences", "edges", "macro_definitions", "macro_expansions",
    "includes", "diagnostics", "active", "completeness", "build_targets", "target_memberships", "target_dependencies", "entry_roots", "summaries",
)
EXTRACTOR_VERSION = 15
SUMMARY = (
    "id string, call_observation string, revision_id string, configuration_id string, analyzer_version int, storage_provider string, index_provider string, domain_kind int, domain_minimum decimal(20,0), "
    "domain_maximum decimal(20,0), known_zero_mask decimal(20,0), stored_targets array<string>, selectable_targets array<string>, modeled_addresses array<string>, storage_escapes boolean, complete boolean, reason string"
)


def current_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file_id, content_hash) of known files now; hashes (path, content_hash) are the files that exist."""
    content = F.coalesce("content_hash", F.concat(F.lit("missing:"), F.sha2("path", 256)))
    return files.select(F.col("id").alias("file_id"), "path").join(hashes.select("path", "content_hash"), "path", "left").select("file_id", content.alias("content_hash"))


def plan(model: SimpleNamespace | None, wanted: DataFrame, hashes: DataFrame, workspace: str, clean: bool = False) -> DataFrame:
    """(tu, action, reason) for wanted units (tu, source_path, configuration_key, source_hash, fingerprint, extractor_version, ...) against a model, which may be none."""
    keyed = canonicalise.units(wanted, workspace).select("tu", F.col("tu_id").alias("id"), "source_file", "source_hash", F.col("fingerprint").alias("compilation_fingerprint"))
    if model is None or clean:
        return keyed.select("tu", F.lit("extract").alias("action"), F.lit("clean" if clean else "new").alias("reason"))
    owner = model.file_versions.select(F.col("id").alias("includer"), F.col("file_id").alias("holder"))
    edges = model.includes.join(owner, "includer").select(F.col("holder").alias("includer"), "included")
    changed = table(incremental.changed_files(model.file_versions, current_hashes(model.files, hashes), edges), "changed")
    hit = model.includes.join(changed.select(F.col("id").alias("included")), "included", "left_semi").select(F.col("revision_id").alias("id"))
    hit = model.revisions.join(hit, "id", "left_semi").select(F.col("tu_id").alias("id"), F.lit(True).alias("hit")).distinct()
    old = model.revisions.select(F.col("tu_id").alias("id"), F.col("source_hash").alias("h"), F.col("compilation_fingerprint").alias("f"), F.col("extractor_version").alias("v"))
    rows = keyed.join(old, "id", "left").join(hit, "id", "left")
    reason = (
        F.when(F.col("v").isNull(), "new").when(F.col("hit"), "invalidated").when(F.col("h") != F.col("source_hash"), "source")
        .when(F.col("f") != F.col("compilation_fingerprint"), "fingerprint").when(F.col("v") != EXTRACTOR_VERSION, "extractor").otherwise("unchanged")
    )
    return rows.select("tu", F.when(reason == "unchanged", "reuse").otherwise("extract").alias("action"), reason.alias("reason"))


def _without_lost(model: SimpleNamespace, wanted: DataFrame) -> tuple[SimpleNamespace, bool]:
    """model without units that are no longer wanted (tu_id), and whether there were any."""
    lost = table(model.translation_units.select(F.col("id").alias("tu_id")).join(wanted, "tu_id", "left_anti"), "lost")
    if lost.isEmpty():
        return model, False
    out = canonicalise.detached(model, lost)
    out.translation_units = out.translation_units.join(lost.withColumnRenamed("tu_id", "id"), "id", "left_anti")
    return out, True


def _used_configurations(model: SimpleNamespace) -> None:
    used = model.translation_units.select(F.col("configuration_id").alias("id"))
    model.configurations = model.configurations.join(used, "id", "left_semi")


def load(spark, path: str) -> SimpleNamespace | None:
    """The model published at path; none if there is none."""
    try:
        return SimpleNamespace(**snapshot.load(spark, path))
    except snapshot.NoSnapshot:
        return None


def _tables(model: SimpleNamespace) -> dict[str, DataFrame]:
    return {name: getattr(model, name) for name in TABLES if getattr(model, name, None) is not None}


def build(
    spark, workspace: str, wanted: DataFrame, extract: Callable[[DataFrame], SimpleNamespace], hashes: DataFrame, output: str, *, targets: DataFrame | None = None,
    memberships: DataFrame | None = None, dependencies: DataFrame | None = None, texts: DataFrame | None = None, manual: tuple[str, ...] = (), clean: bool = False, require_complete: bool = False, window: int = 64,
) -> dict[str, int]:
    """Brings the model at output up to date and publishes it; returns how many units were extracted and reused.

    wanted are all units of the project (tu, source_path, configuration_key, source_hash, fingerprint, extractor_version, quality, project_roots); extract
    gives the facts of some of them (canonicalise.FACTS but units and hashes). Units that no longer are wanted go first. Units to extract are applied in
    windows in canonical order, and each window ends in a checkpoint beside output, from which a build that was stopped goes on: units it holds are
    up to date then. At the end calls are resolved, entry roots renewed, what nothing supports is collected, and the model is validated and published;
    ValueError leaves the published one as it was. texts (path, text) are the files that dispatch tables are read from. Targets come with ids; memberships are (target_id, tu).
    """
    half = f"{output}.checkpoint"
    model = None if clean else load(spark, half) or load(spark, output)
    space = canonicalise._sha(f"workspace|{workspace}")
    space = spark.range(1).select(space.alias("s")).first()["s"]
    wanted = table(wanted, "wanted")
    ids = table(canonicalise.units(wanted, space).select("tu", "tu_id", "place"), "wanted-ids")
    collect = False
    if model is not None:
        model, collect = _without_lost(model, ids.select("tu_id"))
    todo = table(plan(model, wanted, hashes, space, clean).where("action = 'extract'").join(ids, "tu"), "todo")
    order = [r["tu"] for r in todo.select("tu", "place").orderBy("place").toLocalIterator()] if window else []
    replaced = model is not None and not todo.join(model.revisions.select("tu_id"), "tu_id", "left_semi").isEmpty()
    for k in range(0, len(order), window):
        some = wanted.where(F.col("tu").isin(order[k : k + window]))
        facts = extract(some)
        facts.units, facts.hashes = some, hashes
        model = canonicalise.apply(facts, space, model)
        _used_configurations(model)
        snapshot.checkpoint(_tables(model), half)
        model = load(spark, half)
    if model is None:
        raise ValueError("there is nothing to build")
    for name, schema in (("summaries", SUMMARY), ("entry_roots", "id string, symbol_id string, kind int, reason string, configuration_id string")):
        if getattr(model, name, None) is None:
            setattr(model, name, spark.createDataFrame([], schema))
    model.build_targets, model.target_dependencies = targets, dependencies
    model.target_memberships = None if memberships is None else incremental.topology(memberships.join(ids, "tu").select("target_id", "tu_id"), model.translation_units)
    known = None
    if texts is not None:
        own = model.files.where("not external").select(F.col("id").alias("file_id"), "path").join(texts, "path").withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
        known = table(own.join(model.file_versions.select(F.col("id").alias("file_version_id"), "file_id", "content_hash"), ["file_id", "content_hash"]).select("file_version_id", "text"), "texts")
    flat = lambda df: df.withColumnsRenamed({"begin_offset": "bo", "end_offset": "eo"})
    edges, spots = table(flat(model.edges), "observed"), flat(model.occurrences)
    resolved = resolve.resolve_calls(edges, model.symbols, spots, known).drop("call_id").withColumnsRenamed({"bo": "begin_offset", "eo": "end_offset"})
    model.edges = table(resolved.dropDuplicates(["id"]), "edges")
    if known is not None:
        model.summaries = table(resolve.table_summaries(resolve.dispatch_tables(resolve.observed(edges), model.symbols, spots, known), model.revisions, model.translation_units), "summaries")
    model.entry_roots = table(incremental.entry_roots(model.symbols, model.occurrences, model.revisions, model.translation_units, model.edges, model.summaries, manual), "roots")
    _used_configurations(model)
    model = canon.garbage_collect(model, current_hashes(model.files, hashes)) if collect or replaced else canonicalise.recomputed(model)
    if require_complete:
        incremental.complete_gate(model.revisions.withColumn("seen_at", F.lit(0)))
    issue = validate.issues_of_build(model).first()
    if issue is not None:
        raise ValueError(f"semantic validation failed: {issue['code']}: {issue['id']}")
    snapshot.publish(_tables(model), output)
    snapshot.remove(spark, half)
    return {"extracted": len(order), "reused": ids.count() - len(order)}

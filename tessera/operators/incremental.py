"""Planning and upkeep of incremental builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import canon, fixpoint


def changed_files(versions: DataFrame, current: DataFrame, includes: DataFrame) -> DataFrame:
    """(id) of files whose current content (file_id, content_hash) no known version has, and of all that include them, directly or not."""
    new = current.join(versions.select("file_id", "content_hash"), ["file_id", "content_hash"], "left_anti").select(F.col("file_id").alias("id"))
    back = includes.select(F.col("included").alias("src"), F.col("includer").alias("dst"))
    return fixpoint.reachable(back, new).distinct()


def removed_units(revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units (tu_id) with revisions that are no longer wanted (id)."""
    return revisions.select("tu_id").distinct().join(wanted.select(F.col("id").alias("tu_id")), "tu_id", "left_anti")


def plan(units: DataFrame, revisions: DataFrame, invalid: DataFrame, extractor_version: int) -> DataFrame:
    """(tu_id, action, reason): extract units that are new, touched by invalid files (id), of another source hash or fingerprint
    than their active revision, or extracted by another version; else reuse. source_hash and compilation_fingerprint are
    compared if both tables have them."""
    keys = [c for c in ("source_hash", "compilation_fingerprint") if c in units.columns and c in revisions.columns]
    active = canon.last_wins(revisions.select(F.col("tu_id").alias("id"), "seen_at", F.col("id").alias("revision_id"), "extractor_version", *[F.col(c).alias(f"old_{c}") for c in keys]), "seen_at", "revision_id")
    hit = invalid.select(F.col("id").alias("source_file"), F.lit(True).alias("hit")).distinct()
    at = units.select(F.col("id").alias("tu_id"), "source_file", *keys).join(active.withColumnRenamed("id", "tu_id"), "tu_id", "left").join(hit, "source_file", "left")
    reason = F.when(F.col("revision_id").isNull(), "new").when(F.col("hit"), "invalidated")
    for c, name in (("source_hash", "source"), ("compilation_fingerprint", "fingerprint")):
        if c in keys:
            reason = reason.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), name)
    reason = reason.when(F.col("extractor_version") != extractor_version, "extractor").otherwise("unchanged")
    return at.select("tu_id", reason.alias("reason")).select("tu_id", F.when(F.col("reason") == "unchanged", "reuse").otherwise("extract").alias("action"), "reason")


def conflicting_commands(commands: DataFrame) -> DataFrame:
    """(source, configuration) given with different semantic arguments."""
    return commands.groupBy("source", "configuration").agg(F.count_distinct("arguments").alias("n")).where("n > 1").select("source", "configuration")


def orphan_configurations(units: DataFrame, configurations: DataFrame) -> DataFrame:
    return configurations.join(units.select(F.col("configuration_id").alias("id")), "id", "left_anti")


# fixed values: functions a process starts at; why a symbol is a root
PROCESS_ENTRIES = ("main", "wmain", "WinMain", "wWinMain")
REASONS = ("process entry point", "compiler-observed export", "configured entry root", "address taken; at least one indirect flow is unresolved or escaping")


def entry_roots(symbols: DataFrame, occurrences: DataFrame, revisions: DataFrame, units: DataFrame, edges: DataFrame, summaries: DataFrame, manual=()) -> DataFrame:
    """(id, symbol_id, kind, reason, configuration_id): process entries, exports, configured names, and symbols with an address taken that no
    complete summary models, per configuration they occur in."""
    where = (
        occurrences.select("symbol_id", "revision_id").join(revisions.select(F.col("id").alias("revision_id"), "tu_id"), "revision_id")
        .join(units.select(F.col("id").alias("tu_id"), "configuration_id"), "tu_id").select("symbol_id", "configuration_id").distinct()
    )
    modeled = summaries.where("complete and not storage_escapes").select(F.explode("modeled_addresses").alias("id")).distinct()
    taken = edges.where("kind = 11 and target_symbol is not null").select("id", "target_symbol").join(modeled, "id", "left_anti").select(F.col("target_symbol").alias("symbol_id"), F.lit(3).alias("kind"))
    of = lambda rows, kind: rows.select(F.col("id").alias("symbol_id"), F.lit(kind).alias("kind"))
    found = of(symbols.where((F.col("kind") == 6) & F.col("name").isin(*PROCESS_ENTRIES)), 0).union(of(symbols.where("exported"), 1)).union(taken)
    if manual:
        found = found.union(of(symbols.where(F.col("qualified_name").isin(*manual)), 2))
    out = found.distinct().join(where, "symbol_id").withColumn("reason", F.get(F.array(*[F.lit(x) for x in REASONS]), F.col("kind")))
    return out.select(X.digest("entry-root", F.col("symbol_id"), F.col("kind"), F.col("reason"), F.col("configuration_id")).alias("id"), "symbol_id", "kind", "reason", "configuration_id")


def extraction_view(fingerprint, roots: list[str]):
    """Fingerprint of a unit's compilation and of the project's roots: sorted, distinct, each by its length and text."""
    text = "".join(f"{len(r.encode())}:{r};" for r in sorted(set(roots)))
    return F.sha2(F.concat(F.lit("extraction-view|"), fingerprint, F.lit(text)), 256)


def merged_commands(commands: DataFrame) -> DataFrame:
    """One command for each (source, configuration), the first by database; ValueError if their arguments differ."""
    clash = conflicting_commands(commands).first()
    if clash is not None:
        raise ValueError(f"conflicting commands for {clash['source']}")
    rest = [c for c in commands.columns if c not in ("source", "configuration")]
    return commands.groupBy("source", "configuration").agg(F.min_by(F.struct(*rest), "database").alias("r")).select("source", "configuration", "r.*")


def default_target(commands: DataFrame, workspace: str, name: str = "", kind: int = 0, authoritative: bool = False, databases: int = 1) -> tuple[DataFrame, DataFrame]:
    """(targets, memberships) where no manifest says otherwise: a target for each database of commands (database, folder, tu_id), named after the workspace, its folder, or name."""
    folder = F.element_at(F.split("folder", "/"), -1)
    label = (F.lit(workspace.rstrip("/").rsplit("/", 1)[-1]) if databases == 1 else folder) if not name else (F.lit(name) if databases == 1 else F.concat(F.lit(f"{name}:"), folder))
    space = F.sha2(F.lit(f"workspace|{workspace}"), 256)
    rows = commands.withColumn("name", label).withColumn("id", X.digest("build-target", space, F.col("database"), F.col("name")))
    targets = rows.select("id", "name", F.lit(kind).alias("kind"), F.col("database").alias("source"), F.lit(authoritative).alias("topology_authoritative")).distinct()
    return targets, rows.select(F.col("id").alias("target_id"), "tu_id").distinct()


def topology(memberships: DataFrame, units: DataFrame) -> DataFrame:
    """(id, target_id, tu_id): memberships of units that the model has."""
    kept = memberships.join(units.select(F.col("id").alias("tu_id")), "tu_id", "left_semi").select("target_id", "tu_id").distinct()
    return kept.select(X.digest("target-membership", F.col("target_id"), F.col("tu_id")).alias("id"), "target_id", "tu_id")


def complete_gate(revisions: DataFrame) -> None:
    """ValueError unless there are units and all are complete."""
    r = canon.completeness(revisions).first()
    if not r["total"] or r["complete"] != r["total"]:
        raise ValueError("complete-model gate failed: " + ", ".join(f"{c}={r[c]}" for c in ("total", "complete", "warning", "partial", "failed")))

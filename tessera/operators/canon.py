"""Canonicalisation: active revisions, merged observations, properties, resolution of raw names, retraction, collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixpoint


def active_revisions(revisions: DataFrame) -> DataFrame:
    """(tu_id, revision_id): the newest revision of each unit by (seen_at, id)."""
    return revisions.groupBy("tu_id").agg(F.max_by("id", F.struct("seen_at", "id")).alias("revision_id"))


def detach(table: DataFrame, revisions: DataFrame, tus: DataFrame, column: str = "revision_id") -> DataFrame:
    """Rows of an observation table without those of the active revisions of units tus (tu_id)."""
    gone = active_revisions(revisions).join(tus, "tu_id", "left_semi").select(F.col("revision_id").alias(column))
    return table.join(gone, column, "left_anti")


def collisions(table: DataFrame, key: str) -> DataFrame:
    """Ids that stand for more than one key."""
    return table.groupBy("id").agg(F.count_distinct(key).alias("keys")).where("keys > 1").select("id")


def last_wins(table: DataFrame, *order: str) -> DataFrame:
    """One row per id: the last by order."""
    rest = [c for c in table.columns if c != "id"]
    return table.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("id", "r.*")


def logical_groups(symbols: DataFrame) -> DataFrame:
    """(logical_id, variants, low): symbols of one logical symbol; those without a USR take no part."""
    return symbols.where("usr is not null and usr <> '' and logical_id is not null").groupBy("logical_id").agg(
        F.count("*").alias("variants"), F.min("id").alias("low")
    )


def unique_usr(symbols: DataFrame) -> DataFrame:
    """(configuration_id, usr, id) where one symbol alone of a configuration has the USR; symbols without either take no part."""
    named = symbols.where("usr is not null and usr <> '' and configuration_id is not null").groupBy("configuration_id", "usr")
    return named.agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").drop("other")


def merge_occurrences(occurrences: DataFrame, *key: str) -> DataFrame:
    """Observations of one place: flags and exports are ORed, the role is the strongest, implicit only if all are."""
    return occurrences.groupBy(*key).agg(
        F.bit_or("function_flags").alias("function_flags"), F.bool_or("exported").alias("exported"), F.bool_and("implicit").alias("implicit"),
        F.count("*").alias("n"),
    )


def properties(occurrences: DataFrame, flags: tuple[str, ...] = ("function_flags",)) -> DataFrame:
    """(symbol_id, flags, exported, type_id): flags ORed over occurrences; the type of the best one
    (definition, else explicit, else implicit; of equals the smallest id) that has a type."""
    rank = F.when(F.col("role") == 1, 3).when(~F.col("implicit"), 2).otherwise(1)
    best = F.min_by(F.when(F.col("type_id").isNotNull(), F.col("type_id")), F.when(F.col("type_id").isNotNull(), F.struct((-rank).alias("p"), "id")))
    return occurrences.groupBy("symbol_id").agg(*[F.bit_or(c).alias(c) for c in flags], F.bool_or("exported").alias("exported"), best.alias("type_id"))


def completeness(revisions: DataFrame) -> DataFrame:
    """One row: total, complete, warning, partial, failed over the active revisions."""
    live = revisions.join(active_revisions(revisions).select(F.col("revision_id").alias("id")), "id", "left_semi")
    q = lambda k: F.count_if(F.col("quality") == k)
    return live.agg(F.count("*").alias("total"), q(0).alias("complete"), q(1).alias("warning"), q(2).alias("partial"), q(3).alias("failed"))


def resolve_targets(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Raw edges (with configuration_id) of known sources with a target: the local one, else the one symbol of the observed
    USR in the edge's configuration; exact edges without any become unresolved, and get a reason if they have none."""
    from .canonicalise import resolution

    only = unique_usr(symbols).select("configuration_id", F.col("usr").alias("observed_target_usr"), F.col("id").alias("by_usr"))
    known = symbols.select(F.col("id").alias("source_id"))
    target = F.coalesce("target_symbol", "by_usr")
    return (
        raw.join(known, "source_id", "left_semi").join(only, ["configuration_id", "observed_target_usr"], "left")
        .withColumns({**resolution(target, F.col("target_type")), "target_symbol": target}).drop("by_usr")
    )


def parent_paths(symbols: DataFrame) -> DataFrame:
    """(id, depth, path): ancestors first, level by level; what hangs on an absent parent starts a path of its own."""
    known = symbols.select("id", "semantic_parent")
    have = known.select(F.col("id").alias("semantic_parent"))
    level = known.join(have, "semantic_parent", "left_anti").select("id", F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"))
    from ..sources.scratch import table

    children, level = table(known, "parents"), table(level, "level")
    out = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("semantic_parent"), "depth", "path")
        level = table(
            children.join(up, "semantic_parent").select("id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), F.col("id").cast("string")).alias("path")), "level"
        )
        out = out.union(level)
    return out


def ordered_children(children: DataFrame) -> DataFrame:
    """(type_id, children): child ids in order of position, comma-separated."""
    rows = F.array_sort(F.collect_list(F.struct("position", "child_id")))
    return children.groupBy("type_id").agg(F.array_join(F.transform(rows, lambda r: r["child_id"].cast("string")), ",").alias("children"))


def live_types(types: DataFrame, children: DataFrame, used: DataFrame) -> DataFrame:
    """Types that used (id) reach through their children."""
    reach = fixpoint.reachable(children.select(F.col("type_id").alias("src"), F.col("child_id").alias("dst")), used)
    return types.join(reach.distinct(), "id", "left_semi")


def live_symbols(symbols: DataFrame, occurrences: DataFrame, active: DataFrame) -> DataFrame:
    """Symbols with an occurrence in an active revision."""
    seen = occurrences.join(active.select("revision_id"), "revision_id", "left_semi").select(F.col("symbol_id").alias("id"))
    return symbols.join(seen, "id", "left_semi")


def garbage_collect(model, current: DataFrame | None = None):
    """model without what no observation supports, as a namespace of its tables; the steps follow one another as they depend on each other.

    Symbols need an occurrence; logical symbols a variant; edges both ends; types a use, directly or through a type that is used;
    file versions an observation in them, or to be the current one of an included file or the one a unit's active revision was
    made from; files a version, an include or a unit; roots, memberships, dependencies and summaries all they refer to; targets a member. current (file_id,
    content_hash) is what included files hold now. Symbol properties and completeness follow from what is left.
    """
    from types import SimpleNamespace

    from . import canonicalise

    out = SimpleNamespace(**vars(model))
    ids = lambda df, c="id": df.select(F.col(c).alias("_k")).where("_k is not null")
    semi = lambda df, c, keys: df.join(keys.distinct(), df[c] == F.col("_k"), "left_semi")
    held = lambda df, c, keys: semi(df.where(F.col(c).isNotNull()), c, keys).unionByName(df.where(F.col(c).isNull()))
    out.symbols = semi(model.symbols, "id", ids(model.occurrences, "symbol_id"))
    symbols = ids(out.symbols)
    out.logical_symbols = semi(model.logical_symbols, "id", ids(out.symbols, "logical_id"))
    out.edges = held(semi(model.edges, "source_id", symbols), "target_symbol", symbols)
    used = ids(model.occurrences, "type_id").union(ids(out.symbols, "type_id")).union(ids(out.edges, "target_type"))
    children = model.types.select(F.col("id").alias("type_id"), F.explode("children").alias("child_id"))
    out.types = live_types(model.types, children, used.withColumnRenamed("_k", "id"))
    seen = [ids(t, "file_version_id") for t in (model.occurrences, out.edges, model.diagnostics, model.macro_definitions, model.macro_expansions)] + [ids(model.includes, "includer")]
    made_from = model.revisions.join(model.translation_units.select(F.col("id").alias("tu_id"), F.col("source_file").alias("file_id")), "tu_id").select("file_id", F.col("source_hash").alias("content_hash"))
    if current is not None:
        made_from = made_from.union(semi(current.select("file_id", "content_hash"), "file_id", ids(model.includes, "included")))
    seen.append(ids(model.file_versions.join(made_from.distinct(), ["file_id", "content_hash"])))
    keep = seen[0]
    for x in seen[1:]:
        keep = keep.union(x)
    out.file_versions = semi(model.file_versions, "id", keep)
    out.files = semi(model.files, "id", ids(out.file_versions, "file_id").union(ids(model.includes, "included")).union(ids(model.translation_units, "source_file")))
    edges, configurations = ids(out.edges), ids(model.configurations)
    if model.entry_roots is not None:
        out.entry_roots = held(semi(model.entry_roots, "symbol_id", symbols), "configuration_id", configurations)
    if model.summaries is not None:
        rows = model.summaries
        for c, keys in (("call_observation", edges), ("revision_id", ids(model.revisions)), ("configuration_id", configurations), ("storage_provider", symbols), ("index_provider", symbols)):
            rows = semi(rows, c, keys)
        for c, keys in (("stored_targets", symbols), ("selectable_targets", symbols), ("modeled_addresses", edges)):
            lost = rows.select(F.col("id").alias("_s"), F.explode(c).alias("_x")).join(keys.distinct(), F.col("_x") == F.col("_k"), "left_anti").select("_s")
            rows = rows.join(lost.distinct(), rows["id"] == F.col("_s"), "left_anti")
        out.summaries = rows
    if model.build_targets is not None:
        targets = ids(model.build_targets)
        out.target_memberships = semi(semi(model.target_memberships, "target_id", targets), "tu_id", ids(model.translation_units))
        out.target_dependencies = semi(semi(model.target_dependencies, "consumer_id", targets), "dependency_id", targets)
        out.build_targets = semi(model.build_targets, "id", ids(out.target_memberships, "target_id"))
    return canonicalise.recomputed(out)


def macro_bindings(expansions: DataFrame, definitions: DataFrame) -> DataFrame:
    """Expansions (revision_id, name, id) with definition_id: the last definition of the name in the revision, or null."""
    last = definitions.groupBy("revision_id", "name").agg(F.max_by("id", "seq").alias("definition_id"))
    return expansions.join(last, ["revision_id", "name"], "left")

"""Reachability over the logical program graph, readiness for unused-code findings, and the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from . import fixpoint

TRAVERSED = (S.CALLS, S.CONSTRUCTS, S.DESTROYS, S.CONTAINS, S.INSTANTIATES, S.SPECIALIZES)


def graph_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) of the kinds that carry reachability, whatever their resolution."""
    return edges.where(F.col("kind").isin(*TRAVERSED) & F.col("target_symbol").isNotNull()).select(F.col("source_id").alias("src"), F.col("target_symbol").alias("dst")).distinct()


def families(symbols: DataFrame) -> DataFrame:
    """(src, dst) that tie logical variants and member-template families through their smallest member, both ways.

    A star in place of all pairs: the nodes reached are the same and rows grow with the members, not their square.
    """
    logical = symbols.where("logical_id is not null").select(F.concat(F.lit("l:"), "logical_id").alias("f"), "id")
    suffix = F.regexp_extract("usr", ".*(@F@.*)$", 1)
    member = symbols.where(suffix != "").select(F.concat(F.lit("m:"), "qualified_name", F.lit("|"), suffix).alias("f"), "id", (F.col("usr").contains("@ST>") | F.col("usr").contains("@SP>")).alias("t"))
    member = member.join(member.groupBy("f").agg(F.bool_or("t").alias("any")).where("any"), "f", "left_semi").select("f", "id")
    both = logical.union(member)
    hub = both.groupBy("f").agg(F.min("id").alias("hub"))
    arms = both.join(hub, "f").where("id <> hub")
    return arms.select(F.col("hub").alias("src"), F.col("id").alias("dst")).union(arms.select("id", "hub")).distinct()


def template_primaries(symbols: DataFrame) -> DataFrame:
    """(src, dst) from a function with an '@F@' USR to the primary function templates of its qualified name that have a USR."""
    made = symbols.where((F.col("kind") == S.FUNCTION) & F.col("usr").contains("@F@")).select(F.col("id").alias("src"), "qualified_name")
    primary = symbols.where((F.col("kind") == S.FUNCTION_TEMPLATE) & X.flag(F.col("template_flags"), 0) & (F.col("usr") != "")).select(F.col("id").alias("dst"), "qualified_name")
    return made.join(primary, "qualified_name").select("src", "dst").distinct()


def roots(symbols: DataFrame, occurrences: DataFrame, entry_roots: DataFrame) -> DataFrame:
    """(id): entry roots, and defined callables of external linkage that aren't hidden."""
    defined = occurrences.where("role = 1").select(F.col("symbol_id").alias("id"))
    outside = symbols.where(F.col("kind").isin(*S.CALLABLE) & F.col("linkage").isin(3, 4) & (F.col("visibility") != 1)).join(defined, "id", "left_semi")
    return entry_roots.select(F.col("symbol_id").alias("id")).union(outside.select("id")).distinct()


def reachable_symbols(edges: DataFrame, symbols: DataFrame, start: DataFrame) -> DataFrame:
    graph = graph_edges(edges).union(families(symbols)).union(template_primaries(symbols))
    return fixpoint.reachable(graph, start).distinct()


def open_targets(targets: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Targets that keep the target graph from being authoritative: not so themselves, or out of reach of executables and tests. Without any target it isn't authoritative either."""
    start = targets.where(F.col("kind").isin(1, 5)).select("id")
    seen = fixpoint.reachable(dependencies.select(F.col("consumer_id").alias("src"), F.col("dependency_id").alias("dst")), start).distinct()
    return targets.where("not topology_authoritative").select("id").union(targets.join(seen, "id", "left_anti").select("id")).distinct()


def stranded_bindings(edges: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Resolved calls to a symbol without a definition in its logical group, though one of its USR is defined elsewhere."""
    defined = occurrences.where("role = 1").select(F.col("symbol_id").alias("id")).distinct()
    good = symbols.join(defined, "id", "left_semi")
    calls = edges.where((F.col("kind") == S.CALLS) & (F.col("resolution") != S.UNRESOLVED) & F.col("target_symbol").isNotNull()).select(F.col("id").alias("edge_id"), F.col("target_symbol").alias("id"))
    return (
        calls.join(symbols.select("id", "logical_id", "usr"), "id").join(defined, "id", "left_anti")
        .join(good.where("logical_id is not null").select("logical_id").distinct(), "logical_id", "left_anti")
        .join(good.where("usr <> ''").select("usr").distinct(), "usr", "left_semi").select("edge_id", F.col("id").alias("target_symbol"))
    )


def unresolved_reachable(edges: DataFrame, reachable: DataFrame, summaries: DataFrame) -> DataFrame:
    """(class, n) of reachable unresolved calls: project, indirect or unclassified, without those that summaries or bindings complete."""
    done = summaries.where("complete and not storage_escapes").select(F.col("call_observation").alias("id"))
    key = ["source_id", "observed_target_usr", "revision_id", "file_version_id", "bo"]
    bound = edges.where((F.col("kind") == S.CALLS) & (F.col("origin") == S.LOGICAL) & F.col("target_symbol").isNotNull()).select(*key).distinct()
    calls = edges.where((F.col("kind") == S.CALLS) & (F.col("resolution") == S.UNRESOLVED)).join(reachable.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(done, "id", "left_anti")
    project = calls.where(F.col("target_domain") == S.PROJECT).join(bound, key, "left_anti").select(F.lit("calls.project-unresolved").alias("class"))
    other = calls.where(F.col("target_domain") != S.PROJECT)
    indirect = (F.col("target_domain") == S.INDIRECT) | (F.col("dispatch") == S.DYNAMIC)
    named = F.when(indirect, "calls.indirect-unresolved").when(F.col("target_domain") == S.UNKNOWN_DOMAIN, "calls.unclassified-unresolved")
    return project.union(other.select(named.alias("class")).where("class is not null")).groupBy("class").agg(F.count("*").alias("n"))


def target_root_issues(targets: DataFrame, memberships: DataFrame, revisions: DataFrame, occurrences: DataFrame, entry_roots: DataFrame) -> DataFrame:
    """(code, id): targets with several process entries, and executables or tests without an entry root of their own."""
    at = (
        entry_roots.select("symbol_id", "kind").join(occurrences.where("role = 1").select("symbol_id", "revision_id"), "symbol_id")
        .join(revisions.select(F.col("id").alias("revision_id"), "tu_id"), "revision_id").join(memberships, "tu_id").select("target_id", "symbol_id", "kind").distinct()
    )
    twice = at.where("kind = 0").groupBy("target_id").agg(F.count_distinct("symbol_id").alias("n")).where("n > 1").select(F.lit("target.multiple-process-entries").alias("code"), F.col("target_id").alias("id"))
    none = targets.where(F.col("kind").isin(1, 5)).join(at.select(F.col("target_id").alias("id")), "id", "left_anti").select(F.lit("roots.target-missing"), "id")
    return twice.union(none)


def readiness(model, reachable: DataFrame | None = None) -> DataFrame:
    """(seq, code, n): what stands against high confidence, in order; no rows mean ready."""
    from .canon import completeness

    if reachable is None:
        reachable = reachable_symbols(model.edges, model.symbols, roots(model.symbols, model.occurrences, model.entry_roots))
    state = completeness(model.revisions).select(F.lit(1).alias("seq"), F.lit("coverage.incomplete").alias("code"), (F.col("total") - F.col("complete")).alias("n"), (F.col("total") == 0).alias("bad"))
    state = state.where("bad or n > 0").drop("bad")
    closed = model.build_targets.select("id").join(open_targets(model.build_targets, model.target_dependencies).withColumn("open", F.lit(1)), "id", "left").agg(F.count("*").alias("all"), F.count("open").alias("n"))
    closed = closed.where("n > 0 or all = 0").select(F.lit(2), F.lit("target.topology-unproven"), "n")
    rootless = model.entry_roots.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(3), F.lit("roots.missing"), "n")
    issues = target_root_issues(model.build_targets, model.target_memberships, model.revisions, model.occurrences, model.entry_roots)
    per = issues.groupBy("code").agg(F.count("*").alias("n")).select(F.when(F.col("code").startswith("target"), 4).otherwise(5), "code", "n")
    bind = stranded_bindings(model.edges, model.symbols, model.occurrences).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(6), F.lit("binding.declaration-only-target"), "n")
    order = F.when(F.col("class").contains("project"), 7).when(F.col("class").contains("indirect"), 8).otherwise(9)
    calls = unresolved_reachable(model.edges, reachable, model.summaries).select(order, "class", "n")
    return reduce(DataFrame.union, [state, closed, rootless, per, bind, calls])


def dead_code(symbols: DataFrame, occurrences: DataFrame, reachable: DataFrame) -> DataFrame:
    """(representative, group_key, variants, linkage, visibility): logical symbols, or symbols without one, that have an explicitly defined,
    unexported callable, and none of whose variants is reached. The representative is the least of these callables; all variants count."""
    explicit = occurrences.where("role = 1 and not implicit").select(F.col("symbol_id").alias("id"))
    key = F.coalesce(F.concat(F.lit("logical:"), "logical_id"), F.concat(F.lit("symbol:"), F.col("id").cast("string"))).alias("group_key")
    some = symbols.where(F.col("kind").isin(*S.CALLABLE) & ~F.col("exported")).join(explicit, "id", "left_semi")
    some = some.groupBy(key).agg(F.min("id").alias("representative"), F.min_by("linkage", "id").alias("linkage"), F.min_by("visibility", "id").alias("visibility"))
    groups = symbols.select("id", key).join(reachable.select("id", F.lit(True).alias("hit")), "id", "left").groupBy("group_key").agg(F.count("*").alias("variants"), F.count("hit").alias("hits"))
    return some.join(groups.where("hits = 0"), "group_key").select("group_key", "representative", "variants", "linkage", "visibility")


def confidence(ready: bool, basics: bool, linkage="linkage", visibility="visibility"):
    """High for what nothing outside can name, given a ready model; Medium if parse, roots, bindings and project calls hold; else Low."""
    local = F.col(linkage).isin(1, 2) | (F.col(visibility) == 1)
    return F.when(F.lit(ready) & local, "High").when(F.lit(basics), "Medium").otherwise("Low")


# fixed values: what stands for a code in readiness records, and the two reasons of a candidate
MESSAGES = {
    "coverage.incomplete": "one or more translation units are incomplete",
    "target.topology-unproven": "build-target membership or closure is not authoritative",
    "roots.missing": "no entry roots are available",
    "target.multiple-process-entries": "one target contains multiple distinct process-entry symbols: ",
    "roots.target-missing": "an executable or test target has no target-owned entry root: ",
    "binding.declaration-only-target": "a resolved call targets a declaration while a same-USR definition is stranded outside its logical group: ",
    "calls.project-unresolved": " reachable project-owned call observation(s) are unresolved",
    "calls.indirect-unresolved": " reachable indirect call observation(s) have no complete target set",
    "calls.unclassified-unresolved": " reachable call observation(s) cannot be classified",
}
READY = "unreachable from all authoritative roots in a complete, closed, fully resolved logical graph"
GATED = "unreachable from known roots; confidence gated by "
#: Codes that keep a candidate at Low.
BASICS = {"coverage.incomplete", "roots.missing", "roots.target-missing", "binding.declaration-only-target", "calls.project-unresolved", "calls.unclassified-unresolved"}


def readiness_reason(codes: list[str]) -> str:
    """Why a candidate has its confidence; each code once, in order."""
    return GATED + ", ".join(codes) if codes else READY


def _judged(model) -> tuple[DataFrame, DataFrame, list[str]]:
    """Reached symbols, readiness and its codes in order (nine at most)."""
    from ..sources.scratch import table

    seen = table(reachable_symbols(model.edges, model.symbols, roots(model.symbols, model.occurrences, model.entry_roots)), "reachable")
    state = table(readiness(model, seen), "readiness")
    return seen, state, [r["code"] for r in state.orderBy("seq", "code").collect()]


def confident_dead_code(model) -> DataFrame:
    """Dead-code candidates with their confidence and its reason."""
    seen, _, codes = _judged(model)
    found = dead_code(model.symbols, model.occurrences, seen)
    return found.withColumns({"confidence": confidence(not codes, not BASICS & set(codes)), "reason": F.lit(readiness_reason(codes))})


def readiness_records(model, reachable: DataFrame, json_lines: bool = False) -> DataFrame:
    """(seq, line) of what stands against high confidence: a record for each target, binding or class of calls concerned."""
    state = readiness(model, reachable)
    plain = state.where("seq in (1, 2, 3)").select("seq", "code", F.lit("").alias("what"))
    issues = target_root_issues(model.build_targets, model.target_memberships, model.revisions, model.occurrences, model.entry_roots)
    named = issues.join(model.build_targets.select("id", "name"), "id", "left")
    each = named.select(F.when(F.col("code").startswith("target"), 4).otherwise(5).alias("seq"), "code", F.when(F.col("code").startswith("target"), F.col("id").cast("string")).otherwise(F.col("name")).alias("what"))
    bound = stranded_bindings(model.edges, model.symbols, model.occurrences).join(model.symbols.select(F.col("id").alias("target_symbol"), "qualified_name"), "target_symbol")
    calls = state.where("seq > 6").select("seq", "code", F.col("n").cast("string").alias("what"))
    rows = reduce(DataFrame.union, [plain, each, bound.select(F.lit(6), F.lit("binding.declaration-only-target"), "qualified_name"), calls])
    texts = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    said = F.try_element_at(texts, F.col("code"))
    message = F.when(F.col("seq") > 6, F.concat("what", said)).otherwise(F.concat(said, "what"))
    line = F.to_json(F.struct(F.lit("analysis_readiness").alias("record"), "code", message.alias("message"))) if json_lines else F.concat(F.lit("readiness|"), "code", F.lit("|"), message)
    return rows.select("seq", line.alias("line"))


def export_candidates(model, json_lines: bool = False) -> DataFrame:
    """(line): readiness records, then one for each dead-code candidate with where it is defined, seen and built, in order of its group."""
    seen, _, codes = _judged(model)
    found = dead_code(model.symbols, model.occurrences, seen).withColumn("confidence", confidence(not codes, not BASICS & set(codes)))
    group = F.coalesce(F.concat(F.lit("logical:"), "logical_id"), F.concat(F.lit("symbol:"), F.col("id").cast("string"))).alias("group_key")
    variants = model.symbols.select(group, F.col("id").alias("symbol_id")).join(found.select("group_key"), "group_key", "left_semi")
    at = model.revisions.select(F.col("id").alias("revision_id"), "tu_id").join(model.translation_units.select(F.col("id").alias("tu_id"), "configuration_id"), "tu_id")
    spots = variants.join(model.occurrences.select("symbol_id", "revision_id", "role", "file_version_id", "begin_line"), "symbol_id").join(at, "revision_id")
    paths = model.file_versions.select(F.col("id").alias("file_version_id"), "file_id").join(model.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    names = model.target_memberships.join(model.build_targets.select(F.col("id").alias("target_id"), "name"), "target_id").select("tu_id", F.col("name").alias("target"))
    spots = spots.join(paths, "file_version_id", "left").join(names, "tu_id", "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    spots = spots.groupBy("group_key").agg(
        listed(F.col("configuration_id").cast("string")).alias("configurations"), listed("target").alias("targets"),
        listed(F.when(F.col("role") == 1, F.concat("path", F.lit(":"), F.col("begin_line").cast("string")))).alias("definitions"),
    )
    own = model.symbols.select(F.col("id").alias("representative"), "kind", "qualified_name", "logical_id", "type_id", "template_flags", "function_flags")
    rows = found.join(own, "representative").join(model.types.select(F.col("id").alias("type_id"), F.col("canonical_spelling").alias("signature")), "type_id", "left").join(spots, "group_key", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    reason, kind = F.lit(readiness_reason(codes)), S.enum_name(F.col("kind"), "symbol")
    primary, defaulted = X.flag(F.col("template_flags"), 0), X.flag(F.col("function_flags"), 13)
    if json_lines:
        line = F.to_json(F.struct(
            F.lit("dead_code_candidate").alias("record"), F.col("representative").cast("string").alias("symbol_id"), text("logical_id").alias("logical_symbol_id"), F.col("variants").alias("variant_count"), F.col("qualified_name").alias("symbol"),
            text("signature"), text("definitions"), kind.alias("kind"), text("configurations"), text("targets"), primary.alias("template_primary"), defaulted.alias("defaulted"), "confidence", reason.alias("reason"),
        ))
    else:
        bar = F.lit("|")
        line = F.concat(
            F.lit("candidate|"), "confidence", bar, kind, bar, "qualified_name", bar, text("signature"), bar, reason, bar, F.col("representative").cast("string"), F.lit("|logical:"), text("logical_id"), F.lit("|variants:"), F.col("variants").cast("string"),
            F.lit("|definitions:"), text("definitions"), F.lit("|configurations:"), text("configurations"), F.lit("|targets:"), text("targets"), F.lit("|template-primary:"), primary.cast("int").cast("string"), F.lit("|defaulted:"), defaulted.cast("int").cast("string"),
        )
    lines = readiness_records(model, seen, json_lines).select("seq", F.lit("").alias("g"), "line").union(rows.select(F.lit(99), "group_key", line))
    return lines.orderBy("seq", "g", "line").select("line")

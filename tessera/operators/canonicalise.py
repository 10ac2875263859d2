"""Raw facts of compilation units to a canonical model: identities by content hash, merged observations, resolved names.

All units of a window are canonicalised at once. What depends on the order of units (names that are unique *so far* in a
configuration, attributes of the first observation) goes by a unit's place, its (source file, configuration) ids: a name
resolves where the one symbol that has it stands at an earlier place and a second one doesn't. A prior model has the
place ''. Fact tables have ``tu`` (a name of the unit within the window) and ``seq`` (order within the unit); ranges are
the columns path, begin_line, begin_column, begin_offset, end_line, end_column, end_offset.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..sources.scratch import table
from . import canon

RANGE = ["begin_line", "begin_column", "begin_offset", "end_line", "end_column", "end_offset"]
FACTS = ("units", "types", "symbols", "relationships", "macro_definitions", "macro_expansions", "includes", "diagnostics", "hashes")
OBSERVED = ("occurrences", "edges", "macro_definitions", "macro_expansions", "includes", "diagnostics")


def _none() -> Column:
    return F.lit(None).cast("string")


def _sha(*parts) -> Column:
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def units(facts: DataFrame, workspace: str) -> DataFrame:
    """facts (tu, source_path, configuration_key, source_hash, fingerprint, extractor_version, quality, project_roots) with the ids of file, configuration, unit and revision, and the unit's place."""
    out = facts.withColumns({"source_file": _sha(f"file|{workspace}|", F.col("source_path")), "configuration_id": F.sha2("configuration_key", 256)})
    out = out.withColumn("tu_id", _sha("tu|", F.col("source_file"), "|", F.col("configuration_id")))
    revision = _sha("tu-revision|", F.col("tu_id"), "|", F.col("source_hash"), "|", F.col("fingerprint"), "|", F.col("extractor_version"))
    return out.withColumns({"revision_id": revision, "place": F.concat("source_file", "configuration_id")})


def files(rows: DataFrame, hashes: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """(files, versions) of rows (path, source_path, project_roots): a file is external unless it is a unit's source or a root of a unit that names it holds it.

    hashes (path, content_hash, size) are the files that exist; others have a hash that says they are missing, and size 0.
    """
    inside = F.exists(F.coalesce("project_roots", F.array().cast("array<string>")), lambda r: X.path_is_within(F.col("path"), r)) | (F.col("path") == F.col("source_path"))
    found = rows.groupBy("path").agg((~F.bool_or(inside)).alias("external"))
    found = found.select(_sha(f"file|{workspace}|", F.col("path")).alias("id"), F.lit(workspace).alias("workspace_id"), "path", "external")
    content = F.coalesce("content_hash", F.concat(F.lit("missing:"), F.sha2("path", 256)))
    versions = found.join(hashes.select("path", "content_hash", "size"), "path", "left").select(F.col("id").alias("file_id"), content.alias("content_hash"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    return found, versions.select(_sha("file-version|", F.col("file_id"), "|", F.col("content_hash")).alias("id"), "file_id", "content_hash", "size")


def types(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, local, conflicts) of type facts: local (tu, local_identity, type_id) names the last fact of an identity; conflicts are keys with several lists of children."""
    joined = lambda c, tag: F.aggregate(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit("").cast("string"), lambda acc, x: F.concat(acc, F.lit(f"|{tag}:"), x))
    mark = lambda c, x: F.when(F.col(c), x).otherwise("")
    key = F.concat(
        F.lit("type|"), F.col("kind").cast("string"), F.lit("|"), "canonical_spelling", F.lit("|"), mark("is_const", "c"), mark("is_volatile", "v"), mark("is_restrict", "r"),
        joined("children", "child"), joined("template_arguments", "arg"), F.coalesce(F.concat(F.lit("|extent:"), F.col("array_extent").cast("string")), F.lit("")),
        F.lit("|variadic:"), F.col("variadic").cast("int").cast("string"), F.lit("|dependent:"), F.col("dependent").cast("int").cast("string"),
    )
    rows = facts.withColumn("canonical_key", key).withColumn("id", F.sha2("canonical_key", 256))
    local = rows.groupBy("tu", "local_identity").agg(F.max_by("id", "seq").alias("type_id"))
    child = rows.select("tu", "seq", "id", F.posexplode("children").alias("position", "local_identity")).join(local, ["tu", "local_identity"])
    lists = child.groupBy("tu", "seq", "id").agg(F.array_sort(F.collect_list(F.struct("position", "type_id"))).alias("c"))
    lists = lists.select("id", F.col("c.type_id").alias("children")).distinct()
    conflicts = lists.groupBy("id").count().where("count > 1").select(F.lit("type.children").alias("code"), F.col("id").alias("key"))
    rest = ["canonical_key", "kind", "is_const", "is_volatile", "is_restrict", "spelling", "canonical_spelling", "template_arguments", "array_extent", "variadic", "dependent"]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("place", "seq")).alias("r")).select("id", "r.*")
    return first.join(lists.groupBy("id").agg(F.min("children").alias("children")), "id", "left"), local, conflicts


def representatives(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first fact of each local identity of a unit, conflicts): the facts of one identity must agree in USR, kind and parent."""
    same = F.struct("usr", "kind", "semantic_parent")
    rest = [c for c in facts.columns if c not in ("tu", "local_identity")]
    rows = facts.groupBy("tu", "local_identity").agg(F.min_by(F.struct(*rest), "seq").alias("r"), F.collect_set(same).alias("s"))
    return rows.select("tu", "local_identity", "r.*"), rows.where(F.size("s") > 1).select(F.lit("symbol.observations").alias("code"), F.col("local_identity").alias("key"))


def usr_index(rows: DataFrame) -> DataFrame:
    """(configuration_id, usr, id, since, until) of rows (configuration_id, usr, id, place): the one symbol of a USR, from the place it has first up to that of the second one."""
    first = rows.where("usr <> '' and configuration_id is not null").groupBy("configuration_id", "usr", "id").agg(F.min("place").alias("place"))
    two = first.groupBy("configuration_id", "usr").agg(F.slice(F.array_sort(F.collect_set(F.struct("place", "id"))), 1, 2).alias("t"))
    return two.select("configuration_id", "usr", F.col("t")[0]["id"].alias("id"), F.col("t")[0]["place"].alias("since"), F.get("t", F.lit(1))["place"].alias("until"))


def _process_entry() -> Column:
    return (F.col("kind") == S.FUNCTION) & F.col("name").isin("main", "wmain", "WinMain", "wWinMain")


def symbol_ids(reps: DataFrame, prior: DataFrame, workspace: str) -> DataFrame:
    """reps with parent_id, canonical_key and id: parents before children, level by level.

    A parent is the unit's own symbol of that local identity, else (for 'usr:...') the one symbol of the USR that earlier
    places of the configuration have. prior (configuration_id, usr, id, place) are the symbols of a prior model. A cycle of
    parents is a ValueError. Each level is written to the shared folder.
    """
    reps = table(reps, "representatives")
    node = reps.select("tu", "local_identity")
    up = reps.where("semantic_parent is not null").select("tu", "local_identity", F.col("semantic_parent").alias("up"), "configuration_id", "place")
    local = up.join(node.withColumnRenamed("local_identity", "up"), ["tu", "up"], "left_semi").select("tu", "local_identity", F.col("tu").alias("up_tu"), "up")
    wide = up.where(F.col("up").startswith("usr:")).join(node.withColumnRenamed("local_identity", "up"), ["tu", "up"], "left_anti")
    wide = table(wide.select("tu", "local_identity", "configuration_id", "place", F.substring("up", F.lit(5), F.length("up")).alias("usr")), "by-usr")
    named = reps.where("usr <> ''").select("configuration_id", "usr", F.col("tu").alias("up_tu"), F.col("local_identity").alias("up"), F.col("place").alias("at"))
    waits = wide.join(named, ["configuration_id", "usr"]).where("at < place").select("tu", "local_identity", "up_tu", "up")
    waits = table(local.union(waits), "waits")
    pending, done = table(node, "pending"), None
    while not pending.isEmpty():
        blocked = waits.join(pending.select(F.col("tu").alias("up_tu"), F.col("local_identity").alias("up")), ["up_tu", "up"], "left_semi").select("tu", "local_identity").distinct()
        blocked = table(pending.join(blocked, ["tu", "local_identity"], "left_semi"), "blocked")
        ready = reps.join(pending.join(blocked, ["tu", "local_identity"], "left_anti"), ["tu", "local_identity"], "left_semi")
        if ready.isEmpty():
            raise ValueError("cycle of semantic parents among raw symbols")
        by_usr = usr_index(prior if done is None else prior.unionByName(done.select("configuration_id", "usr", "id", "place")))
        far = wide.join(by_usr, ["configuration_id", "usr"]).where("since < place and (until is null or until >= place)").select("tu", "local_identity", F.col("id").alias("far"))
        ready = ready.join(far, ["tu", "local_identity"], "left")
        if done is None:
            ready = ready.withColumn("near", _none())
        else:
            near = local.join(done.select(F.col("tu").alias("up_tu"), F.col("local_identity").alias("up"), F.col("id").alias("near")), ["up_tu", "up"]).select("tu", "local_identity", "near")
            ready = ready.join(near, ["tu", "local_identity"], "left")
        parent = F.coalesce("near", "far")
        at = F.coalesce(parent, F.concat(F.lit("unresolved-parent:"), F.col("semantic_parent")), F.lit("global"))
        own = (F.col("linkage") == 2) | F.col("is_anonymous")
        strong = F.concat(F.lit("usr|"), "usr", F.lit("|configuration|"), "configuration_id", F.lit("|parent|"), at, F.when(own | _process_entry(), F.concat(F.lit("|linkage-scope|"), "source_file")).otherwise(""))
        kind = S.enum_name(F.col("kind"), "symbol")
        weak = F.concat(
            F.lit(f"fallback|{workspace}|"), kind, F.lit("|parent|"), at, F.lit("|"), "qualified_name", F.lit("|"), "signature", F.lit("|"), F.col("linkage").cast("string"),
            F.when(own | kind.isin("LocalVariable", "Lambda"), F.concat(F.lit("|file|"), "source_file")).otherwise(""),
        )
        level = ready.withColumns({"parent_id": parent, "canonical_key": F.when(F.col("usr") != "", strong).otherwise(weak)}).drop("near", "far")
        level = table(level.withColumn("id", F.sha2("canonical_key", 256)), "level")
        done, pending = level if done is None else done.unionByName(level), blocked
    return reps.withColumns({c: _none() for c in ("parent_id", "canonical_key", "id")}) if done is None else done


def _signature(symbols: DataFrame, local_types: DataFrame) -> DataFrame:
    """symbols with signature: result and parameter types and what a member function is qualified with."""
    bit = lambda k: X.flag(F.col("function_flags"), k).cast("int").cast("string")
    keys = symbols.select("tu", "seq", F.posexplode(F.concat(F.array("result_type_key"), F.coalesce("parameter_type_keys", F.array().cast("array<string>")))).alias("k", "local_identity")).where("local_identity <> '' or k > 0")
    keys = keys.join(local_types, ["tu", "local_identity"], "left")
    text = F.when(F.col("k") == 0, "result:").otherwise("|param:")
    identity = F.when(F.col("local_identity") == "", "").otherwise(F.coalesce("type_id", F.concat(F.lit("unresolved-type:"), "local_identity")))
    made = keys.groupBy("tu", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(text, identity).alias("t")))), lambda r: r["t"]), "").alias("s"))
    tail = F.concat(F.lit("|const:"), bit(6), F.lit("|volatile:"), bit(7), F.lit("|ref:"), bit(8), bit(9))
    return symbols.join(made, ["tu", "seq"], "left").withColumn("signature", F.concat(F.coalesce("s", F.lit("")), tail)).drop("s")


def logical_key(workspace: str) -> Column:
    """Key of the logical symbol over all configurations; null without a USR."""
    own = (F.col("linkage") == 2) | F.col("is_anonymous") | _process_entry()
    key = F.concat(F.lit(f"logical-symbol|{workspace}|usr|"), "usr", F.lit("|linkage|"), F.col("linkage").cast("string"), F.when(own, F.concat(F.lit("|file|"), "source_file")).otherwise(""))
    return F.when(F.col("usr") != "", key)


def occurrences(seen: DataFrame) -> DataFrame:
    """Occurrences of located symbol facts (revision_id, symbol_id, file_version_id, range, role, ...): those of one place and role are merged."""
    key = _sha("occurrence|", F.col("revision_id"), "|", F.col("symbol_id"), "|", F.col("file_version_id"), "|", F.col("begin_offset"), "|", F.col("role"))
    last = ["symbol_id", "revision_id", "file_version_id", *RANGE, "role", "implicit"]
    return seen.withColumn("id", key).groupBy("id").agg(
        F.max_by(F.struct(*last), "seq").alias("r"), F.max_by("type_id", F.when(F.col("type_id").isNotNull(), F.col("seq"))).alias("type_id"),
        *[F.bit_or(c).alias(c) for c in ("function_flags", "variable_flags", "template_flags")], F.bool_or("exported").alias("exported"),
    ).select("id", "r.*", "type_id", "function_flags", "variable_flags", "template_flags", "exported")


def parent_edges(seen: DataFrame) -> DataFrame:
    """SemanticParent edges of located symbol facts with parent_id: exact, derived, one for each place."""
    key = _sha("semantic-parent|", F.col("revision_id"), "|", F.col("symbol_id"), "|", F.col("parent_id"), "|", F.col("file_version_id"), "|", F.col("begin_offset"))
    rows = seen.where("parent_id is not null").withColumn("id", key).groupBy("id").agg(F.max_by(F.struct("symbol_id", "parent_id", "revision_id", "file_version_id", *RANGE), "seq").alias("r"))
    zero = F.lit(0)
    return rows.select(
        "id", F.lit(2).alias("kind"), F.col("r.symbol_id").alias("source_id"), F.col("r.parent_id").alias("target_symbol"), _none().alias("target_type"), F.lit("").alias("unresolved_target"),
        F.lit("").alias("observed_target_usr"), F.lit("").alias("observed_target_spelling"), F.col("r.revision_id").alias("revision_id"), F.col("r.file_version_id").alias("file_version_id"), *[F.col(f"r.{c}").alias(c) for c in RANGE],
        zero.alias("resolution"), zero.alias("dispatch"), F.lit(S.CANONICAL).alias("origin"), zero.alias("target_domain"), zero.alias("resolution_failure"), zero.alias("access"), F.lit(False).alias("is_virtual"), F.lit(False).alias("is_dependent"),
    )


def resolution(target: Column, target_type: Column) -> dict[str, Column]:
    """Status and failure of an edge: exact ones without a target become unresolved; a missing reason follows from the domain."""
    none = target.isNull() & target_type.isNull()
    reason = F.when(F.col("target_domain") == 1, 7).when(F.col("target_domain") == 0, 1).when(F.col("target_domain") == 2, 5).when(F.col("target_domain") == 3, 6).otherwise(8)
    return {
        "resolution": F.when(none & (F.col("resolution") == S.EXACT), S.UNRESOLVED).otherwise(F.col("resolution")),
        "resolution_failure": F.when(none & (F.col("resolution_failure") == 0), reason).otherwise(F.col("resolution_failure")),
    }


def relationships(facts: DataFrame, local: DataFrame, local_types: DataFrame, index: DataFrame) -> DataFrame:
    """Edges of located relationship facts; those whose source is unknown go. Targets: the unit's own symbol, else the one of the USR so far; types by local identity. Of one id the last stays."""
    own = lambda a, b: local.select("tu", F.col("local_identity").alias(a), F.col("id").alias(b))
    rows = facts.join(own("source_local_key", "source_id"), ["tu", "source_local_key"]).join(own("target_local_key", "near"), ["tu", "target_local_key"], "left")
    rows = rows.join(local_types.select("tu", F.col("local_identity").alias("target_type_key"), F.col("type_id").alias("target_type")), ["tu", "target_type_key"], "left")
    far = index.select("configuration_id", F.col("usr").alias("target_usr"), F.col("id").alias("far"), "since", "until")
    rows = rows.join(far, ["configuration_id", "target_usr"], "left")
    in_force = (F.col("since") <= F.col("place")) & (F.col("until").isNull() | (F.col("place") < F.col("until")))
    rows = rows.withColumn("target_symbol", F.coalesce("near", F.when(in_force, F.col("far"))))
    rows = rows.withColumns(resolution(F.col("target_symbol"), F.col("target_type")))
    key = _sha("relationship|", F.col("revision_id"), "|", F.col("kind"), "|", F.col("source_id"), "|", F.coalesce("target_symbol", "target_type", "unresolved_target"), "|", F.col("file_version_id"), "|", F.col("begin_offset"))
    rest = ["kind", "source_id", "target_symbol", "target_type", "unresolved_target", "observed_target_usr", "observed_target_spelling", "revision_id", "file_version_id", *RANGE, "resolution", "dispatch", "origin", "target_domain", "resolution_failure", "access", "is_virtual", "is_dependent"]
    return rows.withColumn("observed_target_usr", F.col("target_usr")).withColumn("id", key).groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")


def _last(rows: DataFrame, key: Column, *rest: str) -> DataFrame:
    return rows.withColumn("id", key).groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")


def includes(rows: DataFrame) -> DataFrame:
    """Include edges of rows with revision_id, includer (file version), included (file) and the directive's place."""
    key = _sha("include|", F.col("revision_id"), "|", F.col("includer"), "|", F.col("included"), "|", F.col("offset"))
    return _last(rows, key, "revision_id", "includer", "included", "path", "line", "column", "offset", "kind", "resolved")


def diagnostics(rows: DataFrame) -> DataFrame:
    key = _sha("diagnostic|", F.col("revision_id"), "|", F.col("severity"), "|", F.col("message"), "|", F.col("begin_offset"))
    return _last(rows, key, "revision_id", "severity", "message", "option_name", "file_version_id", *RANGE)


def detached(model: SimpleNamespace, tus: DataFrame) -> SimpleNamespace:
    """model without what the active revisions of units tus (tu_id) have observed, and without these revisions."""
    gone = table(model.revisions.join(tus, "tu_id", "left_semi").select(F.col("id").alias("revision_id")), "detached")
    out = SimpleNamespace(**vars(model))
    for name in OBSERVED:
        setattr(out, name, getattr(model, name).join(gone, "revision_id", "left_anti"))
    out.revisions = model.revisions.join(gone.withColumnRenamed("revision_id", "id"), "id", "left_anti")
    return out


def recomputed(model: SimpleNamespace) -> SimpleNamespace:
    """model with symbol properties, logical symbols, active revisions and completeness as its observations have them."""
    out = SimpleNamespace(**vars(model))
    made = canon.properties(model.occurrences, ("function_flags", "variable_flags", "template_flags"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kept = [c for c in model.symbols.columns if c not in ("type_id", "exported", "function_flags", "variable_flags", "template_flags")]
    out.symbols = model.symbols.select(*kept).join(made.withColumnRenamed("symbol_id", "id"), "id", "left").select(
        *kept, "type_id", zero("function_flags"), zero("variable_flags"), zero("template_flags"), F.coalesce("exported", F.lit(False)).alias("exported")
    )
    out.logical_symbols = model.logical_symbols.drop("variants").join(model.symbols.where("logical_id is not null").groupBy(F.col("logical_id").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("variants")), "id")
    out.active = model.revisions.select("tu_id", F.col("id").alias("revision_id"))
    q = lambda k: F.count_if(F.col("quality") == k)
    out.completeness = model.revisions.agg(F.count("*").alias("total"), q(0).alias("complete"), q(1).alias("warning"), q(2).alias("partial"), q(3).alias("failed"))
    return out


def apply(facts: SimpleNamespace, workspace: str, model: SimpleNamespace | None = None) -> SimpleNamespace:
    """model (or none) with the units of facts (FACTS) in place of what it had of them.

    Rows of one id are the same entity: what the prior model has stays, else the first observation by (place, seq) gives the
    attributes. ValueError on a cycle of parents, or on facts that contradict each other (lists of children of a type,
    observations of a local identity, parents of a symbol).
    """
    unit = table(units(facts.units, workspace), "units")
    on = unit.select("tu", "place", "tu_id", "revision_id", "configuration_id", "source_file", "source_path", "project_roots")
    at = lambda name: getattr(facts, name).join(on, "tu")
    path = F.when(F.coalesce("path", F.lit("")) == "", F.col("source_path")).otherwise(F.col("path")).alias("path")
    named = [at(n).select(path, "source_path", "project_roots") for n in ("symbols", "relationships", "macro_definitions", "macro_expansions", "diagnostics")]
    named += [at("includes").select(F.col(c).alias("path"), "source_path", "project_roots") for c in ("including_path", "included_path")]
    rows = unit.select(F.col("source_path").alias("path"), "source_path", "project_roots")
    for x in named:
        rows = rows.unionByName(x)
    made_files, made_versions = (table(x, "files") for x in files(rows, facts.hashes, workspace))
    where = made_files.select("path", F.col("id").alias("file_id")).join(made_versions.select("file_id", F.col("id").alias("file_version_id")), "file_id")
    located = lambda df: df.withColumn("path", path).join(where.select("path", "file_version_id"), "path")

    made_types, local_types, bad = types(at("types"))
    local_types = table(local_types, "local-types")
    raw = table(_signature(at("symbols"), local_types), "raw-symbols")
    reps, more = representatives(raw)
    prior = SimpleNamespace(symbols=None) if model is None else detached(model, unit.select("tu_id"))
    old = unit.sparkSession.createDataFrame([], "configuration_id string, usr string, id string, place string")
    if model is not None:
        old = prior.symbols.select(F.regexp_extract("canonical_key", "\\|configuration\\|([^|]*)", 1).alias("configuration_id"), "usr", "id", F.lit("").alias("place")).where("usr <> ''")
    if (issue := bad.union(more).first()) is not None:
        raise ValueError(f"facts contradict each other: {issue['code']} {issue['key']}")
    ids = table(symbol_ids(reps, old, workspace), "symbol-ids")
    local = ids.select("tu", "local_identity", "id")
    index = table(usr_index(old.unionByName(ids.select("configuration_id", "usr", "id", "place"))), "usr-index")

    # parents once more, as every symbol of a unit is known now
    near = local.select("tu", F.col("local_identity").alias("semantic_parent"), F.col("id").alias("near"))
    far = index.select("configuration_id", F.concat(F.lit("usr:"), "usr").alias("semantic_parent"), F.col("id").alias("far"), "since", "until")
    in_force = (F.col("since") <= F.col("place")) & (F.col("until").isNull() | (F.col("place") < F.col("until")))
    seen = raw.join(local.withColumnRenamed("id", "symbol_id"), ["tu", "local_identity"]).join(near, ["tu", "semantic_parent"], "left").join(far, ["configuration_id", "semantic_parent"], "left")
    seen = seen.withColumn("parent_id", F.coalesce("near", F.when(in_force, F.col("far")))).join(local_types.select("tu", F.col("local_identity").alias("type_key"), "type_id"), ["tu", "type_key"], "left")
    role = F.when(F.col("is_definition"), 1).when(F.col("is_implicit"), 3).otherwise(0)
    seen = table(located(seen).withColumns({"role": role, "implicit": F.col("is_implicit")}), "seen")
    parents = seen.where("parent_id is not null").select("symbol_id", "parent_id")
    if model is not None:
        parents = parents.union(prior.symbols.where("semantic_parent is not null").select("id", "semantic_parent"))
    parents = parents.groupBy(F.col("symbol_id").alias("id")).agg(F.collect_set("parent_id").alias("p"))
    if (issue := parents.where(F.size("p") > 1).first()) is not None:
        raise ValueError(f"facts contradict each other: symbol.parent {issue['id']}")

    attributes = ["canonical_key", "usr", "logical_id", "kind", "name", "qualified_name", "linkage", "visibility"]
    keyed = ids.withColumn("logical_key", logical_key(workspace)).withColumn("logical_id", F.sha2("logical_key", 256))
    made_symbols = keyed.groupBy("id").agg(F.min_by(F.struct(*attributes), F.struct("place", "seq")).alias("r")).select("id", "r.*")
    logical = keyed.where("logical_key is not null").groupBy(F.col("logical_id").alias("id")).agg(F.first("logical_key").alias("canonical_key"), F.first("usr").alias("usr"), F.first("linkage").alias("linkage"))
    new = {
        "configurations": unit.select(F.col("configuration_id").alias("id"), F.col("configuration_key").alias("canonical_key"), _sha("compilation-fingerprint|", F.col("configuration_key")).alias("fingerprint")).distinct(),
        "files": made_files, "file_versions": made_versions, "types": made_types, "logical_symbols": logical,
        "translation_units": unit.select(F.col("tu_id").alias("id"), "source_file", "configuration_id").distinct(),
        "revisions": unit.select(F.col("revision_id").alias("id"), "tu_id", "source_hash", F.col("fingerprint").alias("compilation_fingerprint"), "extractor_version", "quality"),
        "symbols": made_symbols, "occurrences": occurrences(seen),
        "edges": parent_edges(seen).unionByName(relationships(located(at("relationships")), local, local_types, index)),
        "macro_definitions": _last(located(at("macro_definitions")), _sha("macro-definition|", F.col("revision_id"), "|", F.col("name"), "|", F.col("begin_offset")), "name", "replacement", "revision_id", "file_version_id", *RANGE, "seq"),
        "diagnostics": diagnostics(located(at("diagnostics"))),
    }
    expanded = _last(located(at("macro_expansions")), _sha("macro-expansion|", F.col("revision_id"), "|", F.col("name"), "|", F.col("begin_offset")), "name", "revision_id", "file_version_id", *RANGE)
    new["macro_expansions"] = canon.macro_bindings(expanded, new["macro_definitions"])
    new["macro_definitions"] = new["macro_definitions"].drop("seq")
    files_of = where.select(F.col("path").alias("including_path"), F.col("file_version_id").alias("includer"))
    included = at("includes").join(files_of, "including_path").join(where.select(F.col("path").alias("included_path"), F.col("file_id").alias("included")), "included_path")
    new["includes"] = includes(included)

    out = SimpleNamespace()
    for name, rows in new.items():
        if model is not None:
            had = getattr(prior, name).select(*[c for c in rows.columns if c in getattr(prior, name).columns])
            # files keep their id but may change sides; what is observed anew replaces, all else keeps what it had
            fresh = name in ("files", "translation_units", "revisions")
            rows = rows.unionByName(had.join(rows.select("id"), "id", "left_anti"), True) if fresh else had.unionByName(rows.join(had.select("id"), "id", "left_anti"), True)
        setattr(out, name, table(rows, name))
    out.symbols = out.symbols.join(parents.select("id", F.col("p")[0].alias("semantic_parent")), "id", "left")
    out.workspace, out.active = workspace, None
    for name in ("build_targets", "target_memberships", "target_dependencies", "entry_roots", "summaries"):
        setattr(out, name, getattr(prior, name, None))
    done = recomputed(out)
    done.symbols, done.logical_symbols = table(done.symbols, "symbols"), table(done.logical_symbols, "logical-symbols")
    return done

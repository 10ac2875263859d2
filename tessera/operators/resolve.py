"""Derived call edges and call-target sets. Tables: see plans/adapter.py; every function returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..sources.scratch import table
from . import fixpoint

SITE = ["source_id", "revision_id", "file_version_id", "bo", "eo"]


def observed(edges: DataFrame) -> DataFrame:
    """Edges without what resolution itself derived, so that resolving twice changes nothing."""
    by_canon = (F.col("origin") == S.CANONICAL) & (((F.col("dispatch") == S.VIRTUAL) & (F.col("resolution") == S.CONSERVATIVE)) | (F.col("dispatch") == S.DYNAMIC))
    return edges.where(~((F.col("kind") == S.CALLS) & (F.col("origin").isin(S.LOGICAL, S.FLOW) | by_canon)))


def virtual_dispatch(edges: DataFrame) -> DataFrame:
    """Calls to all transitive overriders of the target of each exact virtual call; only targets that are called are followed."""
    over = edges.where((F.col("kind") == S.OVERRIDES) & F.col("target_symbol").isNotNull()).select(F.col("target_symbol").alias("src"), F.col("source_id").alias("dst"))
    calls = edges.where((F.col("kind") == S.CALLS) & (F.col("dispatch") == S.VIRTUAL) & (F.col("resolution") == S.EXACT) & F.col("target_symbol").isNotNull())
    reach = fixpoint.propagate(over, calls.select(F.col("target_symbol").alias("node"), F.col("target_symbol").alias("value"))).where("node <> value")
    return calls.join(reach, calls["target_symbol"] == reach["value"]).select(
        F.col("id").alias("call_id"), "source_id", F.col("node").alias("target_symbol"), "revision_id",
        F.lit(S.CONSERVATIVE).alias("resolution"), F.lit(S.VIRTUAL).alias("dispatch"), F.lit(S.CANONICAL).alias("origin"), F.lit(True).alias("is_virtual"),
    ).distinct()


def cross_configuration(edges: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Unresolved project calls bound to defined symbols of the observed USR."""
    defined = occurrences.where(F.col("role") == 1).select(F.col("symbol_id").alias("id")).distinct()
    targets = symbols.where("usr is not null and usr <> ''").join(defined, "id", "left_semi").select(F.col("id").alias("t"), "usr")
    calls = edges.where(
        (F.col("kind") == S.CALLS) & (F.col("resolution") == S.UNRESOLVED) & (F.col("target_domain") == S.PROJECT)
    )
    return calls.join(targets, calls["observed_target_usr"] == targets["usr"]).select(
        F.col("id").alias("call_id"), "source_id", F.col("t").alias("target_symbol"), "revision_id", F.lit(S.CONSERVATIVE).alias("resolution"),
        F.lit(S.LOGICAL).alias("origin"), F.lit(3).alias("resolution_failure"),
    )


def flow_values(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(revision_id, storage, value): callables that can reach each local storage, over copies and cycles, by revision."""
    flow = edges.where((F.col("kind") == S.VALUE_FLOW) & (F.col("origin") == S.AST) & F.col("target_symbol").isNotNull())
    kinds = symbols.select(F.col("id").alias("target_symbol"), F.col("kind").alias("target_kind"))
    flow = flow.join(kinds, "target_symbol")
    node = lambda c: F.struct("revision_id", F.col(c).alias("storage"))
    copies = flow.where(F.col("target_kind") == S.LOCAL_VARIABLE).select(node("target_symbol").alias("src"), node("source_id").alias("dst"))
    seeds = flow.where(F.col("target_kind") != S.LOCAL_VARIABLE).select(node("source_id").alias("node"), F.col("target_symbol").alias("value"))
    return fixpoint.propagate(copies, seeds).select("node.revision_id", "node.storage", "value")


def indirect_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unresolved dynamic calls joined to what they invoke at the same site (by the least edge, if there are several), and on to its values."""
    values = flow_values(edges, symbols)
    calls = edges.where(
        (F.col("kind") == S.CALLS) & (F.col("resolution") == S.UNRESOLVED) & (F.col("dispatch") == S.DYNAMIC) & (F.col("origin") == S.AST)
    ).select(F.col("id").alias("call_id"), *SITE)
    invokes = edges.where((F.col("kind") == S.INVOKES) & (F.col("origin") == S.AST) & F.col("target_symbol").isNotNull())
    invokes = invokes.groupBy(*SITE).agg(F.min_by("target_symbol", "id").alias("storage"))
    return (
        calls.join(invokes, SITE).join(values, ["revision_id", "storage"])
        .select("call_id", "source_id", F.col("value").alias("target_symbol"), "revision_id").distinct()
        .withColumns({"resolution": F.lit(S.CONSERVATIVE), "dispatch": F.lit(S.DYNAMIC), "origin": F.lit(S.CANONICAL), "target_domain": F.lit(S.PROJECT), "resolution_failure": F.lit(0)})
    )


def call_target_sets(edges: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(observation, completeness, n_targets, targets): per observed call, the targets of all calls at its site.

    completeness 0: complete, 1: incomplete, 2: external only.
    """
    calls = edges.where(F.col("kind") == S.CALLS)
    sites = calls.where("target_symbol is not null").groupBy(*SITE).agg(F.array_sort(F.collect_set("target_symbol")).alias("targets"))
    seen = calls.where(F.col("origin") == S.AST)
    cond = [seen[c].eqNullSafe(sites[c]) for c in SITE]
    out = seen.join(sites, cond, "left").select(seen["*"], F.coalesce(sites["targets"], F.array().cast("array<bigint>")).alias("targets"))
    closed = F.lit(False)
    if summaries is not None:
        done = summaries.where("complete and not storage_escapes").select(F.col("call_observation").alias("id"), F.lit(True).alias("closed")).distinct()
        out = out.join(done, "id", "left")
        closed = F.coalesce("closed", F.lit(False))
    static = F.col("dispatch") == S.STATIC
    whole = (static & (F.col("resolution") == S.EXACT) & F.col("target_symbol").isNotNull()) | closed
    outside = static & (F.col("target_domain") == S.EXTERNAL) & (F.size("targets") == 0)
    return out.select(
        F.col("id").alias("observation"), F.when(whole, 0).when(outside, 2).otherwise(1).alias("completeness"),
        F.size("targets").cast("bigint").alias("n_targets"), F.array_join(F.transform("targets", lambda t: t.cast("string")), ",").alias("targets"),
    )


#: Why summaries prove nothing yet, and the version they are made by.
CANDIDATES_ONLY = "source-pattern candidates only; execution order, index semantics, and escape safety are unproved"
FLOW_VERSION = 3


def _within(outer: str, inner: str):
    return (F.col(f"{outer}.bo") <= F.col(f"{inner}.bo")) & (F.col(f"{outer}.eo") >= F.col(f"{inner}.eo"))


def dispatch_tables(edges: DataFrame, symbols: DataFrame, occurrences: DataFrame, texts: DataFrame) -> DataFrame:
    """Dynamic calls through a closed table: (call_id, revision_id, storage_provider, index_provider, stored_targets, modeled_addresses).

    texts (file_version_id, text) are whole project files. A call whose source reads table()[index(...)] qualifies if
    both names stand for one callee each within the call; the table's provider has no linkage outside, its address isn't
    taken and no call to it lies outside an unresolved call; both are defined in the call's file and revision, one as a closed table, the other as
    a mask of at most 12 bits below the table's extent; the table's definition takes each stored target's address as often as it
    stores it, names are unique among the addresses taken there, and none of the targets has its address taken anywhere else.
    """
    x = lambda df, a: df.alias(a)
    calls = edges.where((F.col("kind") == S.CALLS) & (F.col("resolution") == S.UNRESOLVED) & (F.col("dispatch") == S.DYNAMIC) & (F.col("origin") == S.AST))
    piece = X.source_slice(F.col("text"), F.col("bo"), F.col("eo"))
    calls = calls.join(texts, "file_version_id").withColumn("piece", piece).where((F.octet_length("piece") <= 16384) & F.col("piece").rlike(X.DISPATCH))
    calls = table(calls.select(F.col("id").alias("call_id"), "source_id", "revision_id", "file_version_id", "bo", "eo", F.regexp_extract("piece", X.DISPATCH, 1).alias("t_name"), F.regexp_extract("piece", X.DISPATCH, 2).alias("i_name")), "table-calls")
    known = edges.where((F.col("kind") == S.CALLS) & F.col("target_symbol").isNotNull())
    named = symbols.select(F.col("id").alias("target_symbol"), F.col("name").alias("callee"))
    site = ["source_id", "revision_id", "file_version_id"]
    inner = x(calls, "c").join(x(known.select(*site, "bo", "eo", "target_symbol"), "k"), site).where(_within("c", "k")).join(named, "target_symbol")
    one = lambda name, c: inner.where(F.col("callee") == F.col(name)).groupBy("call_id").agg(F.min("target_symbol").alias(c), F.max("target_symbol").alias("other")).where(f"{c} = other").select("call_id", c)
    found = calls.join(one("t_name", "storage_provider"), "call_id").join(one("i_name", "index_provider"), "call_id")

    taken = edges.where((F.col("kind") == S.TAKES_ADDRESS) & F.col("target_symbol").isNotNull()).select(F.col("id").alias("address"), "target_symbol", "revision_id", "file_version_id", "bo", "eo")
    own = symbols.where(F.col("linkage").isin(1, 2)).select(F.col("id").alias("storage_provider"))
    found = found.join(own, "storage_provider", "left_semi").join(taken.select(F.col("target_symbol").alias("storage_provider")), "storage_provider", "left_anti")
    open_calls = edges.where((F.col("kind") == S.CALLS) & (F.col("resolution") == S.UNRESOLVED)).select(*site, "bo", "eo")
    uses = known.where(F.col("resolution") != S.UNRESOLVED).select("id", "target_symbol", *site, "bo", "eo").join(found.select(F.col("storage_provider").alias("target_symbol")).distinct(), "target_symbol", "left_semi")
    covered = x(uses, "u").join(x(open_calls, "o"), site).where(_within("o", "u")).select("id").distinct()
    found = found.join(uses.join(covered, "id", "left_anti").select(F.col("target_symbol").alias("storage_provider")), "storage_provider", "left_anti")

    first = occurrences.where("role = 1").groupBy("symbol_id", "revision_id").agg(F.min_by(F.struct("file_version_id", "bo", "eo"), "id").alias("at")).select("symbol_id", "revision_id", "at.*")
    body = lambda c, name: first.join(found.select(F.col(c).alias("symbol_id"), "revision_id").distinct(), ["symbol_id", "revision_id"], "left_semi").join(texts, "file_version_id").select(
        F.col("symbol_id").alias(c), "revision_id", "file_version_id", F.col("bo").alias(f"{name}_bo"), F.col("eo").alias(f"{name}_eo"), X.source_slice(F.col("text"), F.col("bo"), F.col("eo")).alias(f"{name}_body")
    )
    found = found.join(body("storage_provider", "t"), ["storage_provider", "revision_id", "file_version_id"]).join(body("index_provider", "i"), ["index_provider", "revision_id", "file_version_id"])
    found = found.withColumns({"t": X.parse_closed_table(F.col("t_body")), "d": X.parse_bounded_index(F.col("i_body"))}).where("t is not null and d.values is not null")
    found = found.where(F.array_max("d.values") < F.col("t.extent")).withColumn("names", F.concat(F.array("t.default"), F.transform("t.slots", lambda v: v["name"])))
    found = table(found.select("call_id", "revision_id", "file_version_id", "storage_provider", "index_provider", "t_bo", "t_eo", "t_body", "names"), "tables")

    inside = found.select("call_id", "revision_id", "file_version_id", "t_bo", "t_eo").join(taken, ["revision_id", "file_version_id"]).where("t_bo <= bo and t_eo >= eo").join(named, "target_symbol")
    unclear = inside.groupBy("call_id", "callee").agg(F.count_distinct("target_symbol").alias("k")).where("k > 1").select("call_id")
    stored = found.select("call_id", "t_body", F.explode("names").alias("callee")).groupBy("call_id", "t_body", "callee").agg(F.count("*").alias("times"))
    stored = stored.withColumn("seen", F.regexp_count("t_body", F.concat(F.lit("&\\s*"), "callee", F.lit("\\b"))))
    target = inside.groupBy("call_id", "callee").agg(F.min("target_symbol").alias("target_symbol"), F.collect_set("address").alias("addresses"))
    stored = table(stored.join(target, ["call_id", "callee"], "left"), "stored")
    bad = stored.where("target_symbol is null or seen <> times").select("call_id").union(unclear)
    elsewhere = stored.select("call_id", "target_symbol").distinct().join(taken.select("target_symbol", "address"), "target_symbol").join(stored.select("call_id", F.explode("addresses").alias("address")).distinct(), ["call_id", "address"], "left_anti").select("call_id")
    good = stored.join(bad.union(elsewhere).distinct(), "call_id", "left_anti").groupBy("call_id").agg(
        F.array_sort(F.collect_set("target_symbol")).alias("stored_targets"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("addresses")))).alias("modeled_addresses")
    )
    return found.select("call_id", "revision_id", "storage_provider", "index_provider").join(good, "call_id")


def table_summaries(found: DataFrame, revisions: DataFrame, units: DataFrame) -> DataFrame:
    """Summaries of dispatch_tables(): every stored target may be selected, nothing is proved complete, storage counts as escaping."""
    at = revisions.select(F.col("id").alias("revision_id"), "tu_id").join(units.select(F.col("id").alias("tu_id"), "configuration_id"), "tu_id").drop("tu_id")
    key = X.digest("indirect-summary", F.col("call_id"), F.col("revision_id"), F.col("configuration_id"), F.lit(FLOW_VERSION))
    none = F.lit(0).cast("decimal(20,0)")
    return found.join(at, "revision_id").select(
        key.alias("id"), F.col("call_id").alias("call_observation"), "revision_id", "configuration_id", F.lit(FLOW_VERSION).alias("analyzer_version"), "storage_provider", "index_provider",
        F.lit(0).alias("domain_kind"), none.alias("domain_minimum"), none.alias("domain_maximum"), none.alias("known_zero_mask"), "stored_targets", F.col("stored_targets").alias("selectable_targets"), "modeled_addresses",
        F.lit(True).alias("storage_escapes"), F.lit(False).alias("complete"), F.lit(CANDIDATES_ONLY).alias("reason"),
    )


#: What begins the id of a derived call, by its pass.
DERIVED = {"logical": "logical-call", "virtual": "virtual-dispatch", "indirect": "indirect-call", "table": "flow-dispatch"}


def resolve_calls(edges: DataFrame, symbols: DataFrame, occurrences: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Observed edges with all derived ones, which carry call_id; resolving the result again gives the same rows.

    A derived call has the columns of the call it is made from but for its target and how that was found. With texts (file_version_id,
    text) the calls through closed tables are derived too. Ids are digests where edges have text ids, else null.
    """
    base = observed(edges)
    usr = symbols.select(F.col("id").alias("target_symbol"), *[F.col(c).alias(f"_{c}") for c in ("usr", "qualified_name") if c in symbols.columns])
    passes = {"logical": cross_configuration(base, symbols, occurrences), "virtual": virtual_dispatch(base), "indirect": indirect_calls(base, symbols)}
    if texts is not None:
        found = dispatch_tables(base, symbols, occurrences, texts).select("call_id", F.explode("stored_targets").alias("target_symbol"))
        passes["table"] = found.withColumns({"resolution": F.lit(S.CONSERVATIVE), "dispatch": F.lit(S.DYNAMIC), "origin": F.lit(S.FLOW), "target_domain": F.lit(S.PROJECT), "resolution_failure": F.lit(0)})
    out = base.withColumn("call_id", F.lit(None).cast(base.schema["id"].dataType))
    by_text = base.schema["id"].dataType.simpleString() == "string"
    for name, new in passes.items():
        made = [c for c in new.columns if c in base.columns and c not in ("source_id", "revision_id")]
        rows = base.drop(*made).withColumnRenamed("id", "call_id").join(new.select("call_id", *made), "call_id")
        tail = F.concat(F.lit("|"), F.lit(str(FLOW_VERSION))) if name == "table" else F.lit("")
        key = F.sha2(F.concat(F.lit(f"{DERIVED[name]}|"), "call_id", F.lit("|"), "target_symbol", tail), 256) if by_text else F.lit(None).cast("bigint")
        rows = rows.withColumn("id", key)
        if "unresolved_target" in base.columns:
            rows = rows.withColumn("unresolved_target", F.lit("") if name != "virtual" else F.col("unresolved_target"))
        if name in ("indirect", "table") and {"_usr", "_qualified_name"} <= set(usr.columns):
            rows = rows.join(usr, "target_symbol").withColumns({"observed_target_usr": F.col("_usr"), "observed_target_spelling": F.col("_qualified_name")}).drop("_usr", "_qualified_name")
        out = out.unionByName(rows)
    return out

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis, audit, canon, fixpoint, incremental, resolve, validate
from tessera.plans import queries
from tessera.sources import commands, snapshot
from tessera.streaming import ingest

EDGE = (
    "id long, kind int, source_id long, target_symbol long, target_type long, unresolved_target string, observed_target_usr string, observed_target_spelling string, revision_id long, "
    "file_version_id long, bo long, eo long, resolution int, dispatch int, origin int, target_domain int, resolution_failure int, access int, is_virtual boolean, is_dependent boolean"
)


def edge(id, kind, source, target, bo=0, resolution=0, dispatch=0, usr="", domain=0, rev=1):
    return (id, kind, source, target, None, "", usr, "", rev, 1, bo, bo + 1, resolution, dispatch, 0, domain, 0, 1, False, False)


def symbols(spark, rows):
    return spark.createDataFrame([(i, k, u, f"n{i}") for i, k, u in rows], "id long, kind int, usr string, qualified_name string")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_fixpoints(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "src long, dst long")
    assert [r[0] for r in fixpoint.reachable(e, spark.createDataFrame([(1,)], "id long")).orderBy("id").collect()] == [1, 2, 3]
    assert pairs(fixpoint.closure(e)) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(4, 5)]
    p = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 3), (6, 9)], "id long, parent long")
    assert [r[0] for r in fixpoint.cyclic(p).orderBy("id").collect()] == [3, 4, 5]
    assert fixpoint.closure(e.limit(0)).count() == 0


def test_virtual_dispatch_is_transitive_and_idempotent(spark):
    e = spark.createDataFrame([edge(1, 13, 11, 10), edge(2, 13, 12, 11), edge(3, 8, 50, 10, dispatch=2), edge(4, 8, 50, 10, dispatch=1)], EDGE)
    s, o = symbols(spark, [(10, 7, "a"), (11, 7, "b"), (12, 7, "c"), (50, 6, "d")]), spark.createDataFrame([], "symbol_id long, role int")
    assert pairs(resolve.virtual_dispatch(e).select("call_id", "target_symbol")) == [(3, 11), (3, 12)]
    once = resolve.resolve_calls(e, s, o)
    twice = resolve.resolve_calls(once.drop("call_id"), s, o)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_flow_follows_copies_and_cycles(spark):
    e = spark.createDataFrame([edge(1, 21, 100, 10), edge(2, 21, 101, 100), edge(3, 21, 100, 101), edge(4, 22, 50, 101, bo=7), edge(5, 8, 50, None, bo=7, resolution=3, dispatch=3), edge(6, 21, 102, 11, rev=2)], EDGE)
    s = symbols(spark, [(10, 6, "f"), (11, 6, "g"), (100, 30, "p"), (101, 30, "q"), (102, 30, "r"), (50, 6, "m")])
    assert pairs(resolve.flow_values(e, s)) == [(1, 100, 10), (1, 101, 10), (2, 102, 11)]
    assert pairs(resolve.indirect_calls(e, s).select("call_id", "target_symbol")) == [(5, 10)]


def test_call_target_sets(spark):
    e = spark.createDataFrame([edge(1, 8, 1, 2, bo=1, dispatch=1), edge(2, 8, 1, None, bo=2, resolution=3, dispatch=1, domain=1), edge(3, 8, 1, None, bo=3, resolution=3, dispatch=3)], EDGE)
    assert pairs(resolve.call_target_sets(e).select("observation", "completeness", "n_targets")) == [(1, 0, 1), (2, 2, 0), (3, 1, 0)]


TABLE_SOURCE = """using F = int (*)();
static std::array<F, 4> table() { std::array<F, 4> t{}; t.fill(&f); t[0x1] = &g; t[2u] = &g; return t; }
static int index(int x) { return static_cast<int>(x & 3u); }
int run(int x) { return table()[index(x)](); }
"""


def dispatch_model(spark, source, linkage=2, more=()):
    """Calls, addresses and definitions as a front end sees them in TABLE_SOURCE: f 10, g 11, table 20, index 21, run 22."""
    at = lambda text, k=0: [m.start() for m in re.finditer(re.escape(text), source)][k]
    row = lambda id, kind, source_id, target, a, b, resolution=0, dispatch=1, rev=1: (id, kind, source_id, target, None, "", "", "", rev, 1, a, b, resolution, dispatch, 0, 0, 0, 1, False, False)
    call = at("table()[")
    edges = [
        row(1, 8, 22, None, call, call + len("table()[index(x)]()"), 3, 3), row(2, 8, 22, 20, call, call + 7), row(3, 8, 22, 21, at("index(x)]"), at("index(x)]") + 8),
        *[row(4 + k, 11, 20, 10 if name == "&f" else 11, at(name, n), at(name, n) + 2) for k, (name, n) in enumerate((("&f", 0), ("&g", 0), ("&g", 1)))], *[row(*x) for x in more],
    ]
    names = {10: "f", 11: "g", 20: "table", 21: "index", 22: "run"}
    s = spark.createDataFrame([(i, n, f"c:{n}", n, linkage if i == 20 else 4, 6) for i, n in names.items()], "id long, name string, usr string, qualified_name string, linkage int, kind int")
    ends = lambda text: (at(text), source.index("}\n", at(text)) + 1)
    o = spark.createDataFrame([(k, i, 1, 1, *ends(t), 1) for k, (i, t) in enumerate(((20, "static std"), (21, "static int"), (22, "int run")))], "id long, symbol_id long, revision_id long, file_version_id long, bo long, eo long, role int")
    return spark.createDataFrame(edges, EDGE), s, o, spark.createDataFrame([(1, source)], "file_version_id long, text string")


def test_dispatch_tables(spark):
    m = dispatch_model(spark, TABLE_SOURCE)
    assert [tuple(r) for r in resolve.dispatch_tables(*m).collect()] == [(1, 1, 20, 21, [10, 11], [4, 5, 6])]
    revisions, units = spark.createDataFrame([(1, 7)], "id long, tu_id long"), spark.createDataFrame([(7, "c")], "id long, configuration_id string")
    r = resolve.table_summaries(resolve.dispatch_tables(*m), revisions, units).first()
    assert (r["call_observation"], r["stored_targets"], r["selectable_targets"], r["complete"], r["storage_escapes"]) == (1, [10, 11], [10, 11], False, True)
    assert pairs(resolve.resolve_calls(*m).where("origin = 5").select("call_id", "target_symbol")) == [(1, 10), (1, 11)]
    broken = {
        "mask beyond the table": dispatch_model(spark, TABLE_SOURCE.replace("3u", "7u")),
        "a second use": dispatch_model(spark, TABLE_SOURCE.replace("return t;", "use(t); return t;")),
        "an address more": dispatch_model(spark, TABLE_SOURCE.replace("t.fill", "h(&f); t.fill")),
        "external provider": dispatch_model(spark, TABLE_SOURCE, linkage=4),
        "provider's address": dispatch_model(spark, TABLE_SOURCE, more=[(9, 11, 22, 20, 0, 1)]),
        "target's address elsewhere": dispatch_model(spark, TABLE_SOURCE, more=[(9, 11, 22, 10, 0, 1)]),
        "another call of the provider": dispatch_model(spark, TABLE_SOURCE, more=[(9, 8, 22, 20, 0, 1)]),
    }
    assert [k for k, x in broken.items() if not resolve.dispatch_tables(*x).isEmpty()] == []


def test_families_reach_like_cliques(spark):
    s = spark.createDataFrame([(3, "L", "x", "u"), (1, "L", "y", "u"), (2, None, "z", "u")], "id long, logical_id string, qualified_name string, usr string")
    assert pairs(analysis.families(s)) == [(1, 3), (3, 1)]


def test_properties_take_the_best_type(spark):
    o = spark.createDataFrame([(1, 9, 0, False, 5, 1, False), (2, 9, 1, False, None, 2, True), (3, 9, 3, True, 6, 4, False)], "id long, symbol_id long, role int, implicit boolean, type_id long, function_flags int, exported boolean")
    assert pairs(canon.properties(o)) == [(9, 7, True, 5)]


def test_parent_paths(spark):
    s = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, semantic_parent long")
    s = s.union(spark.createDataFrame([(7, 99)], s.schema))
    got = {r["id"]: r["path"] for r in canon.parent_paths(s.withColumn("semantic_parent", F.coalesce("semantic_parent", F.lit(-1)))).collect()}
    assert got == {1: "1", 2: "1/2", 3: "1/2/3", 7: "7"}


def test_diff_counts_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert pairs(audit.semantic_diff(a, b)) == [(1, "-", 1), (2, "-", 1), (3, "+", 1)]
    with pytest.raises(ValueError):
        audit.sql_check(spark, {}, "drop table x")


def test_positions(spark):
    t = spark.createDataFrame([(1, "ab\ncé\nd")], "file_id long, text string")
    at = spark.createDataFrame([(1, 0), (1, 3), (1, 7)], "file_id long, offset long")
    assert pairs(audit.positions(t, at)) == [(1, 0, 1, 1), (1, 3, 2, 1), (1, 7, 3, 1)]


def test_positions_of_whole_documents(spark, tmp_path):
    texts = [(1, "ab\ncé\nd", "fr"), (2, None, "en"), (3, "", "en"), (4, "\n\n", "de"), (5, "ñandú " * 30 + "\nend", "es"), (6, "no newline at all, and plain text beyond twenty characters", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    raw = {i: (t or "").encode() for i, t, _ in texts}
    want = []
    for i, t, _ in texts:
        for k in [*(k for k, c in enumerate(raw[i]) if c == 10), len(raw[i])]:
            head = raw[i][:k]
            want.append((i, k, None, None) if t is None else (i, k, head.count(b"\n") + 1, k - head.rfind(b"\n")))
    got = queries.queries()["ver07_positions"](spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    far = spark.createDataFrame([(1, 99), (1, -3), (1, None)], "file_id long, offset long")
    assert sorted(map(tuple, audit.positions(spark.createDataFrame([(1, "a\nb")], "file_id long, text string"), far).collect()), key=str) == [(1, -3, 1, 1), (1, 99, 2, 2), (1, None, None, None)]
    pieces = {(r["doc_id"], r["part"]): r["piece"] for r in queries.queries()["fn11_source_slice"](spark, f"file://{tmp_path}").collect()}
    cut = lambda t: len(t) // 2
    assert pieces == {(i, p): None if t is None else f(t) for i, t, _ in texts for p, f in (("all", str), ("head", lambda t: t[: cut(t)]), ("tail", lambda t: t[cut(t) :]))}


class Tables:
    """A model of given tables."""

    def __init__(self, spark, **tables):
        self._spark = spark
        for name, (rows, schema) in tables.items():
            setattr(self, name, spark.createDataFrame(rows, schema))


def test_operators_take_whole_tables(spark):
    run = lambda name, m: sorted(map(tuple, queries.Q[name][0](m).collect()), key=str)
    types = ([(k, 0, f"t{k}") for k in range(1, 8)], "id long, kind int, canonical_spelling string")
    s = ([(1, "u", "A", 1), (2, "u", "B", None)], "id long, usr string, logical_id string, type_id long")
    o = ([(1, 1, 10, 1, 3), (2, 2, 20, 0, None)], "id long, symbol_id long, revision_id long, role int, type_id long")
    m = Tables(spark, types=types, type_children=([(1, 0, 2), (3, 0, 4), (5, 0, 6)], "type_id long, position int, child_id long"), symbols=s, occurrences=o)
    assert [r[0] for r in run("can18_live_types", m)] == [1, 2, 3, 4]  # none of them from type 7
    m.edges = spark.createDataFrame([edge(5, 8, 9, 2, rev=20), edge(6, 8, 9, 1, rev=10), edge(7, 8, 9, 1, rev=0)], EDGE)
    assert run("ana10_stranded_bindings", m) == [(5, 2)]  # the definition is that of symbol 1
    m.revisions = spark.createDataFrame([(10, 3, 1, 0), (20, 3, 2, 1)], "id long, tu_id long, seen_at long, quality int")
    assert run("can02_detach", m) == [("edges", 2), ("occurrences", 1)]
    assert run("ver05_semantic_diff", m) == [(8, 9, 1, 0, 0, "-", 1), (8, 9, 2, 0, 0, "+", 1)]


def test_exports_hold_every_table(spark):
    m = Tables(
        spark, edges=([edge(5, 8, 9, 2, rev=20), edge(6, 8, 9, 2, rev=21)], EDGE),
        symbols=([(2, 6, "u", "A", "n::f", 4, True, 3), (9, 6, "v", None, "g|h", 4, False, None)], "id long, kind int, usr string, logical_id string, qualified_name string, linkage int, exported boolean, type_id long"),
        types=([(3, 2, "T")], "id long, kind int, canonical_spelling string"), type_children=([(3, 1, 8), (3, 0, 7)], "type_id long, position int, child_id long"),
        revisions=([(20, 1, 1, 0), (21, 2, 1, 1)], "id long, tu_id long, seen_at long, quality int"), translation_units=([(1, 4, "c1"), (2, 4, "c2")], "id long, source_file long, configuration_id string"),
        occurrences=([(1, 2, 20)], "id long, symbol_id long, revision_id long"), files=([(4, "a.c", False)], "id long, path string, external boolean"),
        build_targets=([(1, "app", 1, True)], "id long, name string, kind int, topology_authoritative boolean"), target_dependencies=([(1, 2)], "consumer_id long, dependency_id long"),
        entry_roots=([(1, 2, 0, "r", "c1")], "id long, symbol_id long, kind int, reason string, configuration_id string"), summaries=([(5, True, False)], "call_observation long, complete boolean, storage_escapes boolean"),
    )
    run = lambda name: [r[0] for r in queries.Q[name][0](m).collect()]
    got = run("snk07_normalised_snapshot")
    kinds = ["config"] * 2 + ["file"] + ["tu"] * 2 + ["revision"] * 2 + ["type", "logical-symbol"] + ["symbol"] * 2 + ["occurrence"] + ["relationship"] * 2
    assert [x.split("|")[0] for x in got] == kinds + ["build-target", "target-dependency", "entry-root", "indirect-summary"] + ["active"] * 2 + ["completeness"]
    assert "type|3||2|||T|||||child:7|child:8" in got and "logical-symbol|A||u|4|variant:2" in got and "active|2|21" in got and got[-1] == "completeness|2|1|1|0|0"
    assert "relationship|5|8|9|2||||" in got[12] and got[12].endswith("|20|1|::0-::1|0|0|0|0|0|1|0|0")
    call = "relationship|Calls|g\\|h|n::f|Exact|None|CompilerAST|domain:Project|failure:None|observed-usr:|observed-spelling:|evidence:"
    assert run("snk05_edge_records") == [call + "2|configurations:c1,c2"]
    assert sorted(run("snk03_export_records")) == sorted([
        "symbol|Function|n::f|2|logical:A|exported:1", "symbol|Function|g\\|h|9|logical:|exported:0", call + "1|configurations:c1", call + "1|configurations:c2", "build-target|app|Executable||1|authoritative:1",
        "target-dependency|1|2", "entry-root|ProcessEntry|n::f|r|configuration:c1", "indirect-call-summary||call:5|version:|domain:..|stored:0|selectable:0|escapes:0|complete:1|",
    ])


def test_validator_finds_what_is_broken(spark):
    one = lambda *cols: ([tuple(9 for _ in cols)], ", ".join(f"{c} long" for c in cols))
    m = Tables(
        spark, symbols=([(1, 6, 5, "L"), (2, 6, None, "K")], "id long, kind int, semantic_parent long, logical_id string"), edges=([edge(7, 2, 1, 2), edge(8, 2, 1, 5)], EDGE),
        translation_units=([(1, "c1")], "id long, configuration_id string"), configurations=([("c2",)], "id string"), revisions=([(20, 1, 1, 0)], "id long, tu_id long, seen_at long, quality int"),
        active=([(3, 20)], "tu_id long, revision_id long"), completeness=([(2, 1, 0, 0, 0)], "total long, complete long, warning long, partial long, failed long"), file_versions=([(1,)], "id long"),
        logical_symbols=([("L", [1, 2, 3])], "id string, variants array<long>"), build_targets=([(1,)], "id long"), target_dependencies=([(4, 1)], "consumer_id long, dependency_id long"),
        summaries=([(7, True, False, [1, 6], [], [77], 1, 1)], "call_observation long, complete boolean, storage_escapes boolean, stored_targets array<long>, selectable_targets array<long>, modeled_addresses array<long>, storage_provider long, index_provider long"),
        macro_definitions=one("id", "revision_id", "file_version_id"), macro_expansions=([(1, 20, 1, 4)], "id long, revision_id long, file_version_id long, definition_id long"),
        occurrences=one("symbol_id", "file_version_id"), diagnostics=one("revision_id", "file_version_id"), includes=one("revision_id"), entry_roots=([("c3",)], "configuration_id string"),
    )
    got = pairs(validate.consistency(m).union(validate.more_references(m)))
    assert got == sorted([
        ("hierarchy.semantic-parent-edge", "7"), ("analysis.indirect-unsound-complete", "7"), ("reference.logical-membership", "2"), ("reference.logical-variant", "3"), ("lifetime.orphan-configuration", "c2"),
        ("revision.active-map", "3"), ("publication.completeness", "1"), ("reference.tu-config", "c1"), ("reference.occurrence-file", "9"), ("reference.symbol-logical", "K"), ("reference.include-revision", "9"),
        ("reference.diagnostic-revision", "9"), ("reference.diagnostic-file", "9"), ("reference.macro-revision", "9"), ("reference.macro-file", "9"), ("reference.expansion-definition", "4"),
        ("reference.target-dependency", "4"), ("reference.entry-root-configuration", "c3"), ("reference.indirect-stored-target", "6"), ("reference.indirect-address", "77"),
    ])


def test_plan_compares_source_and_fingerprint(spark):
    units = spark.createDataFrame([(1, 4, "s", "f"), (2, 4, "t", "f"), (3, 4, "s", "g"), (4, 4, "s", "f")], "id long, source_file long, source_hash string, compilation_fingerprint string")
    revisions = spark.createDataFrame([(10 * k, k, 1, 15, "s", "f") for k in (1, 2, 3)], "id long, tu_id long, seen_at long, extractor_version int, source_hash string, compilation_fingerprint string")
    got = incremental.plan(units, revisions, spark.createDataFrame([], "id long"), 15)
    assert pairs(got) == [(1, "reuse", "unchanged"), (2, "extract", "source"), (3, "extract", "fingerprint"), (4, "extract", "new")]


def test_snapshot_is_atomic(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    one = spark.createDataFrame([(1, "a")], "id long, x string")
    snapshot.publish({"t": one}, path)
    with pytest.raises(ValueError):
        snapshot.publish({"t": one.union(one)}, path, lambda t: t["t"].groupBy("id").count().where("count > 1"))
    assert pairs(snapshot.load(spark, path)["t"]) == [(1, "a")]
    snapshot.publish({"t": one.union(one)}, path)
    assert snapshot.load(spark, path)["t"].count() == 2
    with pytest.raises(ValueError):
        snapshot.load(spark, f"file://{tmp_path}/none")


def test_commands_and_manifest(spark, tmp_path):
    (tmp_path / "db.json").write_text('[{"directory": "/w", "file": "a.cpp", "command": "ccache clang++ -Iinc -c a.cpp -o a.o"}, {"directory": "/w", "file": "b.c", "arguments": ["cc", "-DX", "b.c"]}]')
    got = {r["source"]: r for r in commands.read_commands(spark, f"file://{tmp_path}/db.json").collect()}
    assert got["/w/a.cpp"]["semantic"] == ["-I/w/inc"] and got["/w/a.cpp"]["compiler"] == "clang++" and got["/w/b.c"]["settings"]["language"] == 0
    (tmp_path / "m.txt").write_text("# c\r\ntarget|app|executable\r\nmember|app|/w/a.cpp\ntarget|lib|static-library\ndepends|app|lib\n")
    units = spark.createDataFrame([(5, "/w/a.cpp")], "tu_id long, path string")
    t, m, d = commands.read_manifest(spark, f"file://{tmp_path}/m.txt", units)
    assert sorted((r["name"], r["kind"]) for r in t.collect()) == [("app", 1), ("lib", 2)] and m.count() == 1 and d.count() == 1
    (tmp_path / "bad.txt").write_text("root|x|y\n")
    with pytest.raises(Exception, match="malformed manifest"):
        commands.read_manifest(spark, f"file://{tmp_path}/bad.txt", units)[0].collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, k % 3, k * 10 % 7) for k in range(1, 12)]
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], "id long, tu_id long, seen_at long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    ingest.ingest(spark, f"file://{tmp_path}/in", "id long, tu_id long, seen_at long", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", 1)
    got = pairs(snapshot.load(spark, f"file://{tmp_path}/out")["revisions"].select("tu_id", "id"))
    assert got == pairs(canon.active_revisions(spark.createDataFrame(rows, "id long, tu_id long, seen_at long")).select("tu_id", "revision_id"))

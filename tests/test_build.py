from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera.operators import build, canonicalise, incremental, validate
from tessera.sources import snapshot

RANGE = "path string, begin_line int, begin_column int, begin_offset long, end_line int, end_column int, end_offset long"
SCHEMAS = {
    "units": "tu string, source_path string, configuration_key string, source_hash string, fingerprint string, extractor_version int, quality int, project_roots array<string>",
    "types": "tu string, seq int, local_identity string, kind int, is_const boolean, is_volatile boolean, is_restrict boolean, spelling string, canonical_spelling string, children array<string>, template_arguments array<string>, array_extent long, variadic boolean, dependent boolean",
    "symbols": f"tu string, seq int, local_identity string, kind int, usr string, name string, qualified_name string, semantic_parent string, linkage int, visibility int, is_definition boolean, is_implicit boolean, is_anonymous boolean, exported boolean, type_key string, result_type_key string, parameter_type_keys array<string>, function_flags int, variable_flags int, template_flags int, {RANGE}",
    "relationships": f"tu string, seq int, kind int, source_local_key string, target_usr string, target_local_key string, target_type_key string, unresolved_target string, observed_target_spelling string, resolution int, dispatch int, origin int, target_domain int, resolution_failure int, access int, is_virtual boolean, is_dependent boolean, {RANGE}",
    "macro_definitions": f"tu string, seq int, name string, replacement string, {RANGE}",
    "macro_expansions": f"tu string, seq int, name string, {RANGE}",
    "includes": "tu string, seq int, including_path string, included_path string, path string, line int, column int, offset long, kind int, resolved boolean",
    "diagnostics": f"tu string, seq int, severity int, message string, option_name string, {RANGE}",
    "hashes": "path string, content_hash string, size long",
}


def at(path, k):
    return (path, 1, k, k, 1, k + 5, k + 5)


def symbol(tu, seq, local, usr, name, parent=None, kind=6, linkage=4, defined=True, type_key="", path=None, flags=0, offset=None):
    return (tu, seq, local, kind, usr, name.split("::")[-1], name, parent, linkage, 3, defined, False, False, False, type_key, "", [], flags, 0, 0, *at(path, seq if offset is None else offset))


def call(tu, seq, source, usr="", target="", path=None, domain=0):
    return (tu, seq, 8, source, usr, target, "", "x" if not target else "", "x", 0, 1, 0, domain, 0, 0, False, False, *at(path, 100 + seq))


def facts(spark, **rows):
    return SimpleNamespace(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def unit(tu, source, configuration="cfg", content="h0", fingerprint="f0"):
    return (tu, source, configuration, content, fingerprint, 15, 0, ["/w"])


def program(spark, content_b="h0"):
    """Two units: b calls what a defines; both include a header, one an external one."""
    a, b, h = "/w/a.cpp", "/w/b.cpp", "/w/h.hpp"
    t = lambda tu, seq, local, spelling, children=(): (tu, seq, local, 1, False, False, False, spelling, spelling, list(children), [], None, False, False)
    return facts(
        spark, units=[unit("A", a), unit("B", b, content=content_b)], hashes=[(a, "h0", 3), (b, content_b, 4), (h, "hh", 5)],
        types=[t("A", 0, "int", "int"), t("A", 1, "ptr", "int *", ["int"]), t("B", 0, "int", "int"), t("B", 1, "ptr", "int *", ["int"])],
        symbols=[
            symbol("A", 0, "n", "", "N", kind=1, path=h), symbol("A", 1, "usr:f", "c:@F@f#", "N::f", "n", type_key="ptr", path=h, defined=False), symbol("A", 2, "usr:f", "c:@F@f#", "N::f", "n", type_key="int", flags=64, path=a),
            symbol("B", 0, "m", "", "N", kind=1, path=h), symbol("B", 1, "usr:f", "c:@F@f#", "N::f", "m", path=h, defined=False, offset=1), symbol("B", 2, "usr:main", "c:@F@main#", "main", path=b),
            symbol("B", 3, "k", "c:@F@k#", "k", "usr:elsewhere", path=b, linkage=2),
        ],
        relationships=[call("B", 0, "usr:main", "c:@F@f#", "usr:f", b), call("B", 1, "usr:main", "c:@F@g#", "", b), call("B", 2, "nothing", "c:@F@f#", "", b)],
        macro_definitions=[("A", 0, "M", "1", *at(a, 50)), ("A", 1, "M", "2", *at(a, 60))], macro_expansions=[("A", 0, "M", *at(a, 70)), ("B", 0, "M", *at(b, 70))],
        includes=[("A", 0, a, h, a, 1, 1, 0, 0, True), ("B", 0, b, h, b, 1, 1, 0, 0, True), ("B", 1, b, "/usr/x.hpp", b, 2, 1, 9, 1, False)], diagnostics=[("B", 0, 2, "unused", "-Wunused", *at(b, 80))],
    )


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_units_share_what_they_have_in_common(spark):
    m = canonicalise.apply(program(spark), "w")
    # N and f come from both units and are one symbol each, as parents have keys without local names
    assert rows(m.symbols, "qualified_name") == [("N",), ("N::f",), ("k",), ("main",)]
    ids = {r["qualified_name"]: r for r in m.symbols.collect()}
    assert ids["N::f"]["semantic_parent"] == ids["N"]["id"] and ids["N::f"]["function_flags"] == 64
    assert "|parent|unresolved-parent:usr:elsewhere|linkage-scope|" in ids["k"]["canonical_key"] and ids["main"]["canonical_key"].endswith("|parent|global|linkage-scope|" + m.files.where("path = '/w/b.cpp'").first()["id"])
    names = {r["id"]: n for n, r in ids.items()}
    t = {r["id"]: r["canonical_spelling"] for r in m.types.collect()}
    assert t[ids["N::f"]["type_id"]] == "int"  # the definition's, not the declaration's
    assert [t[c] for c in m.types.where("canonical_spelling = 'int *'").first()["children"]] == ["int"]
    assert {(names.get(r["target_symbol"]), r["resolution"], r["resolution_failure"]) for r in m.edges.where("kind = 8").collect()} == {("N::f", 0, 0), (None, 3, 1)}
    assert {(names[r["source_id"]], names[r["target_symbol"]]) for r in m.edges.where("kind = 2").collect()} == {("N::f", "N")}
    assert rows(m.files, "path", "external") == [("/usr/x.hpp", True), ("/w/a.cpp", False), ("/w/b.cpp", False), ("/w/h.hpp", False)]
    bound = {r["id"]: r["replacement"] for r in m.macro_definitions.collect()}
    assert sorted((bound.get(r["definition_id"]) for r in m.macro_expansions.collect()), key=str) == ["2", None]
    assert m.occurrences.where("role = 1").count() == 5 and m.includes.count() == 3 and m.diagnostics.count() == 1
    assert tuple(m.completeness.first()) == (2, 2, 0, 0, 0)
    assert validate.identities(m).isEmpty()


def test_names_resolve_as_of_a_units_place(spark):
    """A USR that a later unit makes ambiguous resolves in earlier units and not from there on."""
    order = sorted(("/w/1.cpp", "/w/2.cpp", "/w/3.cpp"), key=lambda p: spark.range(1).select(F.sha2(F.lit(f"file|w|{p}"), 256)).first()[0])
    f = facts(
        spark, units=[unit(f"T{k}", p) for k, p in enumerate(order)],
        symbols=[symbol("T0", 0, "g", "c:@g", "g", path=order[0])] + [symbol(f"T{k}", 1, f"h{k}", f"c:@h{k}", f"h{k}", path=p) for k, p in enumerate(order)] + [symbol("T2", 2, "g", "c:@g", "g", path=order[2], linkage=2)],
        relationships=[call(f"T{k}", 0, f"h{k}", "c:@g", path=p) for k, p in enumerate(order)],
    )
    m = canonicalise.apply(f, "w")
    names = {r["id"]: r["qualified_name"] for r in m.symbols.collect()}
    assert sorted(((names[r["source_id"]], names.get(r["target_symbol"])) for r in m.edges.where("kind = 8").collect()), key=str) == [("h0", "g"), ("h1", "g"), ("h2", None)]


def test_facts_that_contradict_each_other(spark):
    one = [unit("A", "/w/a.cpp")]
    with pytest.raises(ValueError, match="cycle"):
        canonicalise.apply(facts(spark, units=one, symbols=[symbol("A", 0, "p", "c:p", "p", "q", path="/w/a.cpp"), symbol("A", 1, "q", "c:q", "q", "p", path="/w/a.cpp")]), "w")
    with pytest.raises(ValueError, match="symbol.observations"):
        canonicalise.apply(facts(spark, units=one, symbols=[symbol("A", 0, "p", "c:p", "p", path="/w/a.cpp"), symbol("A", 1, "p", "c:other", "p", path="/w/a.cpp")]), "w")


def test_build_is_incremental(spark, tmp_path):
    path, asked = f"file://{tmp_path}/model", []

    def extract(f):
        def run(units):
            tus = units.select("tu")
            asked.append(sorted(r[0] for r in tus.collect()))
            return SimpleNamespace(**{n: getattr(f, n).join(tus, "tu", "left_semi") for n in canonicalise.FACTS if n not in ("units", "hashes")})

        return run

    one, two = program(spark), program(spark, "h1")
    go = lambda f, out=path, **more: build.build(spark, "/w", f.units, extract(f), f.hashes, out, **more)
    assert go(one) == {"extracted": 2, "reused": 0}
    assert go(two) == {"extracted": 1, "reused": 1} and asked == [["A", "B"], ["B"]]
    assert not snapshot.load(spark, path)["symbols"].isEmpty()


def test_complete_gate(spark):
    of = lambda *q: spark.createDataFrame([(k, k, 0, x) for k, x in enumerate(q)], "id long, tu_id long, seen_at long, quality int")
    incremental.complete_gate(of(0, 0))
    for bad in (of(0, 2), of()):
        with pytest.raises(ValueError, match="gate"):
            incremental.complete_gate(bad)

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_split():
    assert X.split('cc -DX="a b" \'c d\'') == ["cc", "-DX=a b", "c d"]
    assert X.split('a\\\\"b c"') == ["a\\b c"]
    assert X.split('a\\"b') == ['a"b']
    assert X.split("  ") == []
    with pytest.raises(ValueError):
        X.split('a "b')


def test_response_files():
    files = {"r": "-DA @s", "s": "-DB", "loop": "@loop"}
    assert X.expand(["@r", "x"], files.__getitem__) == ["-DA", "-DB", "x"]
    with pytest.raises(ValueError):
        X.expand(["@loop"], files.__getitem__)


def test_wrapper():
    assert X.driver_position(["/usr/bin/ccache", "cc", "a.c"]) == 1
    assert X.driver_position(["ccache"]) == 0


def test_meaning():
    args = ["-c", "-o", "x.o", "-Iinc", "-isystem", "../sys", "a.cpp", "-DX", "-MD"]
    assert X.meaning(args, "/w/src", "a.cpp", "clang++") == ["-I/w/src/inc", "-isystem", "/w/sys", "-DX"]
    assert X.meaning(["/Tpa.cpp", "/Foout"], "/w", "a.cpp", "cl.exe") == ["--driver-mode=cl", "/TP", "-Wno-unknown-argument"]
    with pytest.raises(ValueError):
        X.meaning(["-I"], "/w", "a.cpp", "cc")


def test_settings():
    got = X.settings(["-x", "c", "-std=c11", "-I/a", "-DX=1", "-D", "Y", "-UZ", "--target=t"], "/w", "a.cpp")
    assert (got["language"], got["standard"], got["include_paths"], got["defines"], got["undefines"], got["triple"]) == (0, "c11", ["/a"], [("X", "1"), ("Y", "1")], ["Z"], "t")
    assert X.settings([], "/w", "a.c")["language"] == 0


def test_digest_vector(spark):
    assert one(spark, F.sha2(F.lit("abc"), 256))[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_literals(spark):
    rows = spark.createDataFrame([("0x1Fu",), ("010",), ("42UL",), ("18446744073709551615",), ("18446744073709551616",), ("x",), ("",)], "v string")
    assert [r[0] if r[0] is None else int(r[0]) for r in rows.select(X.unsigned_literal(F.col("v"))).collect()] == [31, 8, 42, 2**64 - 1, None, None, None]


def test_slice(spark):
    s = lambda b, e: one(spark, X.source_slice(F.lit("aéb"), F.lit(b), F.lit(e)))[0]
    assert (s(0, 3), s(3, 4), s(2, 9)) == ("aé", "b", None)


def test_tables(spark):
    body = "std::array<Fn, 3> t{}; t.fill(&f); t[1] = &g; return t;"
    got = one(spark, X.parse_closed_table(F.lit(body)))[0]
    assert got["extent"] == 3 and got["default"] == "f" and [tuple(x) for x in got["slots"]] == [(1, "g")]
    assert [int(x[0]) for x in one(spark, X.parse_closed_table(F.lit(body.replace("t[1]", "t[0x2u]"))))[0]["slots"]] == [2]
    assert one(spark, X.parse_closed_table(F.lit(body.replace(", 3>", ", 100000>"))))[0]["extent"] == 100_000
    for bad in (body + " use(t);", body.replace("t[1]", "t[7]"), body.replace("return", "t[1] = &h; return"), ""):
        assert one(spark, X.parse_closed_table(F.lit(bad)))[0] is None
    assert int(one(spark, X.parse_bounded_index(F.lit("return static_cast<int>(x & 0x3u);")))[0]["mask"]) == 3
    assert one(spark, X.parse_bounded_index(F.lit("return static_cast<int>(x & 5);")))[0]["values"] == [0, 1, 4, 5]
    assert one(spark, X.parse_bounded_index(F.lit("return static_cast<int>(x & 0xffff);")))[0]["values"] is None
    assert one(spark, X.parse_bounded_index(F.lit("if (x) return 1; return static_cast<int>(x & 3);")))[0] is None
    assert one(spark, X.popcount_subsets(F.lit(5).cast("bigint")))[0] == [0, 1, 4, 5]


def test_escapes_and_keys(spark):
    r = one(spark, X.record_escape(F.lit("a|b\\c\nd")), X.json_escape(F.lit('a"b')), X.append_key(F.lit("é"), F.lit(None).cast("string")), X.usr_suffix(F.lit("c:@F@a@F@b")), X.state_string(F.lit(5), 4))
    assert tuple(r) == ("a\\|b\\\\c\\nd", 'a\\"b', "2:é;0:;", "@F@b", "1010")


def test_enum(spark):
    r = one(spark, *[schema.enum_name(F.lit(k), "dispatch") for k in (1, 9, -1)], schema.enum_name(F.lit(None).cast("int"), "symbol"))
    assert tuple(r) == ("Static", "Invalid", "Invalid", "Invalid")

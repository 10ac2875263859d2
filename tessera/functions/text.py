"""Row functions: paths, keys, flags, literals, command lines and closed source patterns."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Command-line flags by what they mean.
OUTPUT_ONLY = {"-c", "/c", "-S", "-E", "-M", "-MM", "-MD", "-MMD", "-MP", "-MG", "-save-temps", "-fsyntax-only", "/showIncludes", "/P", "/EP", "/E"}
OUTPUT_OPERAND = {"-o", "--output", "-MF", "-MT", "-MQ", "-MJ", "--serialize-diagnostics", "/sourceDependencies"}
OUTPUT_JOINED = ("--output=", "--serialize-diagnostics=", "/sourceDependencies:")
OUTPUT_JOINED_CL = ("/Fo", "/Fd", "/Fe", "/Fa", "/Fi")
PATH_OPERAND = {
    "-I", "-isystem", "-iquote", "-idirafter", "-iframework", "-F", "-include", "-imacros", "-include-pch", "-isysroot", "--sysroot", "-resource-dir",
    "-fmodule-map-file", "-fmodules-cache-path", "/I", "/FI", "/imsvc", "/external:I",
}
PATH_JOINED = ("--sysroot=", "-fmodule-map-file=", "-fmodules-cache-path=", "/external:I", "/imsvc", "/FI", "/I", "-I")
WRAPPERS = {"ccache", "sccache", "distcc"}
CL = {"cl", "cl.exe", "clang-cl", "clang-cl.exe"}


def normal_path(path: str, base: str = "") -> str:
    """Absolute on base, '.' and '..' removed, '/' separators, no trailing '/'."""
    return posixpath.normpath(posixpath.join(base or "", path.replace("\\", "/"))) if path else ""


@F.pandas_udf(T.StringType())
def normalize_path(path: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else normal_path(p, b or "") for p, b in zip(path, base)])


def path_is_within(path: Column, root: Column) -> Column:
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def append_key(*parts: Column) -> Column:
    """Length-prefixed parts; null counts as ''."""
    one = lambda c: F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")), F.lit(";"))
    return F.concat(*[one(p) for p in parts])


def digest(prefix: str, *parts: Column) -> Column:
    """SHA-256 of prefix and parts with '|' between; null counts as ''."""
    out = [F.lit(prefix)]
    for p in parts:
        out += [F.lit("|"), F.coalesce(p.cast("string"), F.lit(""))]
    return F.sha2(F.concat(*out), 256)


def record_escape(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def json_escape(c: Column) -> Column:
    """c as the inside of a JSON string."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def pack_flags(*bits: Column) -> Column:
    out = F.lit(0)
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.when(b, F.lit(1 << k)).otherwise(0))
    return out


def flag(packed: Column, k: int) -> Column:
    return F.getbit(packed, F.lit(k)) == 1


def state_string(packed: Column, width: int) -> Column:
    """0/1 per flag, the first flag first."""
    return F.reverse(F.lpad(F.bin(packed), width, "0"))


def usr_suffix(usr: Column) -> Column:
    """From the last '@F@' on; '' without one."""
    return F.regexp_extract(usr, ".*(@F@.*)$", 1)


def unsigned_literal(c: Column) -> Column:
    """Decimal, hexadecimal or octal literal with u/l suffixes as decimal(20,0); null if it is none."""
    x = F.regexp_replace(c, "[uUlL]*$", "")
    based = (
        F.when(x.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(x, F.lit(3), F.length(x)), 16, 10))
        .when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^[0-9]+$"), x)
    )
    value = F.try_to_number(based, F.lit("9" * 25)).cast("decimal(25,0)") if hasattr(F, "try_to_number") else based.cast("decimal(25,0)")
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(25,0)"), value.cast("decimal(20,0)"))


def source_slice(text: Column, begin: Column, end: Column) -> Column:
    """Bytes begin..end of a text, half open; null outside it."""
    raw = F.encode(text, "UTF-8")
    ok = (begin >= 0) & (begin <= end) & (end <= F.length(raw))
    return F.when(ok, F.decode(F.substring(raw, begin + 1, end - begin), "UTF-8"))


def popcount_subsets(mask: Column) -> Column:
    """All sub-masks of a mask with at most 12 bits, ascending; null for more."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1)
    return F.when(
        F.bit_count(mask) <= 12,
        F.transform(
            F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(bits)) - 1),
            lambda s: F.aggregate(
                F.transform(bits, lambda b, i: F.when(F.getbit(s, i) == 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
                F.lit(0).cast("bigint"), lambda a, b: a + b,
            ),
        ),
    )


# fixed values: the source patterns of closed dispatch tables; V stands for the table's variable
DISPATCH = r"([A-Za-z_]\w*)\s*\(\s*\)\s*\[\s*([A-Za-z_]\w*)\s*\([^\]]*\)\s*\]"
TABLE = r"std\s*::\s*array\s*<[^;{}]+,\s*([0-9]+)[uUlL]*\s*>\s*([A-Za-z_]\w*)\s*\{\s*\}\s*;"
TABLE_FILL = r"\bV\s*\.\s*fill\s*\(\s*&\s*([A-Za-z_]\w*)\s*\)\s*;"
TABLE_SLOT = r"\bV\s*\[\s*(0[xX][0-9A-Fa-f]+|[0-9]+)[uUlL]*\s*\]\s*=\s*&\s*([A-Za-z_]\w*)\s*;"
TABLE_RETURN = r"\breturn\s+V\s*;"
MASKED = r"return\s+static_cast\s*<[^>]+>\s*\(\s*[^;]*&\s*(0[xX][0-9A-Fa-f]+|[0-9]+)[uUlL]*\s*\)\s*;"


def parse_bounded_index(body: Column) -> Column:
    """struct(mask, values) of a body whose one return casts an expression masked by a literal; else null. values: all sub-masks, null for more than 12 bits."""
    mask = unsigned_literal(F.regexp_extract(body, MASKED, 1))
    small = F.when(mask <= F.lit((1 << 63) - 1).cast("decimal(20,0)"), mask.cast("bigint"))
    return F.when((F.regexp_count(body, F.lit("\\breturn\\b")) == 1) & body.rlike(MASKED) & mask.isNotNull(), F.struct(mask.alias("mask"), popcount_subsets(small).alias("values")))


def parse_closed_table(body: Column) -> Column:
    """struct(extent, default, slots array<struct<index, name>>) of a body that declares one array, fills it, sets slots to addresses
    by literal and returns it, and does nothing else with it; else null."""
    var = F.regexp_extract(body, TABLE, 2)
    extent = unsigned_literal(F.regexp_replace(F.regexp_extract(body, TABLE, 1), "^0+(?=[0-9])", ""))
    of = lambda pattern: F.regexp_replace(F.lit(pattern), F.lit("V"), var)
    at = F.transform(F.regexp_extract_all(body, of(TABLE_SLOT), F.lit(1)), unsigned_literal)
    slots = F.zip_with(at, F.regexp_extract_all(body, of(TABLE_SLOT), F.lit(2)), lambda i, name: F.struct(i.alias("index"), name.alias("name")))
    default = F.get(F.regexp_extract_all(body, of(TABLE_FILL), F.lit(1)), F.lit(0))
    uses = F.regexp_count(body, of(r"\bV\b"))
    ok = (
        body.rlike(TABLE) & (extent > 0) & default.isNotNull() & (F.regexp_count(body, of(TABLE_RETURN)) > 0) & (uses == 3 + F.size(at))
        & (F.size(F.array_distinct(at)) == F.size(at)) & ~F.exists(at, lambda i: i.isNull() | (i >= extent))
    )
    return F.when(ok, F.struct(extent.alias("extent"), default.alias("default"), slots.alias("slots")))


def split(command: str) -> list[str]:
    """Arguments of a command line; backslashes before a double quote count in pairs; ValueError on an open quote."""
    out, word, quote, k = [], [], "", 0
    while k < len(command):
        c = command[k]
        if c == "\\" and quote != "'":
            run = len(command[k:]) - len(command[k:].lstrip("\\"))
            k += run
            if command[k : k + 1] == '"':
                word.append("\\" * (run // 2))
                if run % 2:
                    word.append('"')
                else:
                    quote = "" if quote == '"' else '"'
                k += 1
            else:
                word.append("\\" * run)
            continue
        if c in "\"'" and quote in ("", c):
            quote = "" if quote else c
        elif c.isspace() and not quote:
            if "".join(word):
                out.append("".join(word))
            word = []
        else:
            word.append(c)
        k += 1
    if quote:
        raise ValueError("unterminated quote in compile command")
    return out + (["".join(word)] if "".join(word) else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_command(command: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else split(c) for c in command])


def expand(args: list[str], read, depth: int = 0, open_files: tuple[str, ...] = ()) -> list[str]:
    """args with @file replaced by the arguments read(file) has; ValueError beyond 16 levels or on a cycle."""
    out: list[str] = []
    for a in args:
        if not (a.startswith("@") and len(a) > 1):
            out.append(a)
            continue
        if depth >= 16 or a in open_files:
            raise ValueError("response files nest too deeply or in a cycle")
        out += expand(split(read(a[1:])), read, depth + 1, (*open_files, a))
    return out


def driver_position(args: list[str]) -> int:
    """Place of the compiler itself, behind wrappers such as ccache while something follows."""
    k = 0
    while k + 1 < len(args) and posixpath.basename(args[k].replace("\\", "/")).lower().removesuffix(".exe") in WRAPPERS:
        k += 1
    return k


def meaning(args: list[str], wd: str, source: str, compiler: str) -> list[str]:
    """Arguments that bear on a translation unit's meaning, with paths made absolute."""
    src, out, it = normal_path(source, wd), [], iter(args)

    def operand(a: str) -> str:
        try:
            return next(it)
        except StopIteration:
            raise ValueError(f"missing operand for compilation flag {a}") from None

    for a in it:
        joined = next((p for p in PATH_JOINED if a.startswith(p) and len(a) > len(p)), None)
        if (a.startswith("/") or not a.startswith("-")) and normal_path(a, wd) == src:
            continue
        if a in OUTPUT_ONLY or a.startswith(OUTPUT_JOINED) or (len(a) > 3 and a.startswith(OUTPUT_JOINED_CL)):
            continue
        if a in OUTPUT_OPERAND:
            operand(a)
        elif a in PATH_OPERAND:
            out += [a, normal_path(operand(a), wd)]
        elif joined:
            out.append(joined + normal_path(a[len(joined) :], wd))
        elif a[:3] in ("/Tc", "/Tp") and len(a) > 3 and normal_path(a[3:], wd) == src:
            out.append(a[:3].upper())
        else:
            out.append(a)
    if posixpath.basename(compiler.replace("\\", "/")).lower() in CL:
        out = ["--driver-mode=cl", *out, "-Wno-unknown-argument"]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def semantic_arguments(args: pd.Series, wd: pd.Series, source: pd.Series, compiler: pd.Series) -> pd.Series:
    return pd.Series([meaning(list(a), w, s, c) for a, w, s, c in zip(args, wd, source, compiler)])


def settings(args: list[str], wd: str, source: str) -> dict:
    """Language, standard, include paths, macros and target that arguments say."""
    got: dict = {"language": None, "standard": "", "include_paths": [], "system_include_paths": [], "defines": [], "undefines": [], "forced_includes": [], "triple": ""}
    it = iter(args)

    def operand(a: str, joined: str = "") -> str:
        if joined:
            return joined
        try:
            return next(it)
        except StopIteration:
            raise ValueError(f"missing operand for compilation flag {a}") from None

    for a in it:
        if a == "-x":
            got["language"] = 1 if "++" in operand(a) else 0
        elif a in ("/TC", "/TP"):
            got["language"] = int(a == "/TP")
        elif a.startswith(("-std=", "/std:")) or a == "-std":
            got["standard"] = a[5:] if len(a) > 4 else operand(a)
        elif a in ("-isystem", "/imsvc", "/external:I"):
            got["system_include_paths"].append(normal_path(operand(a), wd))
        elif a == "-include" or a.startswith("/FI"):
            got["forced_includes"].append(normal_path(operand(a, a[3:] if a.startswith("/FI") else ""), wd))
        elif a[:2] in ("-I", "/I"):
            got["include_paths"].append(normal_path(operand(a, a[2:]), wd))
        elif a[:2] in ("-D", "/D"):
            name, eq, value = operand(a, a[2:]).partition("=")
            got["defines"].append((name, value if eq else "1"))
        elif a[:2] in ("-U", "/U"):
            got["undefines"].append(operand(a, a[2:]))
        elif a.startswith("--target="):
            got["triple"] = a[9:]
        elif a == "-target":
            got["triple"] = operand(a)
    if got["language"] is None:
        got["language"] = 0 if posixpath.splitext(source)[1] == ".c" else 1
    return got


SETTINGS = T.StructType([
    T.StructField("language", T.IntegerType()), T.StructField("standard", T.StringType()),
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("include_paths", "system_include_paths")],
    T.StructField("defines", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("undefines", "forced_includes")], T.StructField("triple", T.StringType()),
])


@F.pandas_udf(SETTINGS)
def interpret(args: pd.Series, wd: pd.Series, source: pd.Series) -> pd.DataFrame:
    rows = [settings(list(a), w, s) for a, w, s in zip(args, wd, source)]
    for r in rows:
        r["defines"] = [{"name": n, "value": v} for n, v in r["defines"]]
    return pd.DataFrame(rows, columns=SETTINGS.fieldNames())

import math
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h ^= b
        h = (h * 1099511628211) % 2**64
    return h


def test_uuid5_equals_library(spark):
    space, repo = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.com/x"), "00112233-4455-6677-8899-aabbccddeeff"
    names = ["a", "naïve()", "p::q(int,int)", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.scope_id(space, F.lit(repo), F.lit("method"), "n", F.lit("c0ffee")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(space, f"{repo}\0method\0{n}\0c0ffee")) for n in names}


def test_fnv_and_hold_out(spark):
    keys = [f"ep{i}" for i in range(500)] + ["", "é"]
    assert S.fnv64a(pd.Series(keys)).tolist() == [fnv(k.encode()) for k in keys]
    held = {r.k: r.h for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.hold_out("k", 0.1).alias("h")).collect()}
    assert held == {k: (fnv(k.encode()) & (2**53 - 1)) / 2**53 < 0.1 for k in keys}


def test_blended_effort(spark):
    u = uuid.uuid4()
    got = one(spark, S.blended_effort(F.lit("split_class"), F.lit(2.5), F.lit(str(u)), F.lit("r"), "v1", 7).alias("x")).x
    share = fnv(b"v1\0" + f"{7:016x}".encode() + b"\0" + u.bytes + b"\0r\0split_class\0" + b"2.500000") % 10001 / 10000
    assert got == pytest.approx(8 + (40 - 8) * share)


@pytest.mark.parametrize(
    "raw,want",
    [("f ( int  a , int b )", "f(int a,int b)"), ("f(a /* b, c */ , d)", "f(a,d)"), ("f(x) // tail", "f(x)"), ("f(x # c\n, y)", "f(x,y)"), ("f(/* open", "f("), ("", ""), (" a  b ", "a b")],
)
def test_normalise_signature(spark, raw, want):
    assert one(spark, S.normalise_signature(F.lit(raw)).alias("x")).x == want


@pytest.mark.parametrize("raw,want", [("f(int a, int b)", "int a,int b"), ("f(g(x), (y))", "g(x),(y)"), ("(a)(b , c)", "b,c"), ("int a", "int a"), ("f(a, b", "a,b"), ("", ""), ("()", "")])
def test_normalise_params(spark, raw, want):
    assert one(spark, S.normalise_params(F.lit(raw)).alias("x")).x == want


@pytest.mark.parametrize("raw,want", [(r"a\b\c.py", "a/b/c.py"), ("./a//b/", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("../../a/..", "../.."), ("/../a", "/a"), (".", ""), ("", ""), (None, ""), ("a/./b/../../c", "c")])
def test_normalise_path(spark, raw, want):
    assert one(spark, S.normalise_path(F.lit(raw).cast("string")).alias("x")).x == want


@pytest.mark.parametrize("raw,want", [("a/b/c.py", "a/b"), ("c.py", "."), ("/c.py", "/")])
def test_dirname(spark, raw, want):
    assert one(spark, S.dirname(F.lit(raw)).alias("x")).x == want


@pytest.mark.parametrize("glob,text,want", [("p*", "p17", True), ("p?", "p17", False), ("p?7", "p17", True), ("a.b", "axb", False), ("a.b", "a.b", True), ("[x]*", "[x]y", True), ("*", "", True), ("a+(b)", "a+(b)", True), (r"a\b", r"a\b", True), ("a*", "a\nb", True)])
def test_glob(spark, glob, text, want):
    assert one(spark, F.rlike(F.lit(text), S.glob_regex(F.lit(glob))).alias("x")).x is want


def test_like_escape(spark):
    assert one(spark, S.like_escape(F.lit("50%_a\\b")).alias("x")).x == "50\\%\\_a\\\\b"


def test_numbers(spark):
    z = [-1000.0, -31.0, -1.0, 0.0, 1.0, 31.0, 1000.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", S.sigmoid("z").alias("s"), S.softplus("z").alias("p"), S.clamp("z").alias("c")).collect()
    for r in rows:
        assert r.s == pytest.approx(1 / (1 + math.exp(-r.z)) if r.z > -700 else 0.0)
        assert r.p == pytest.approx(r.z if r.z > 30 else 0.0 if r.z < -30 else math.log1p(math.exp(r.z)))
        assert r.c == min(1.0, max(0.0, r.z))


def test_effort_and_kinds(spark):
    rules = {"solid.srp.x": "split_class", "solid.ocp.y": "extract_method", "solid.dip": "invert_dependency", "decoupling.cycle_member": "break_cycle", "decoupling.duplication.z": "consolidate_duplication", "decoupling.fan_in": "invert_dependency", "other": None}
    rows = spark.createDataFrame([(k,) for k in rules], "r string").select("r", S.task_kind("r").alias("k")).collect()
    assert {r.r: r.k for r in rows} == rules
    got = one(spark, *[S.effort(F.lit(k), F.lit(s)).alias(f"c{i}") for i, (k, s) in enumerate([("split_class", 2.0), ("split_class", 99.0), ("extract_method", -5.0), ("extract_method", float("nan")), ("?", 1.0)])])
    assert tuple(got) == (24.0, 40.0, 2.0, 2.0, 2.0)


def test_set_signature_is_order_free(spark):
    a, b, c = one(spark, S.set_signature(F.array(F.lit("x:1"), F.lit("y:2"), F.lit("x:1"))).alias("a"), S.set_signature(F.array(F.lit("y:2"), F.lit("x:1"))).alias("b"), S.set_signature(F.array().cast("array<string>")).alias("c"))
    assert a == b and a and c is None


def test_fnv_of_token_windows(spark):
    text = ["a", "bc", "é", "", "long" * 300, "a", "bc", "é", "x"]
    want = [fnv(b"".join(t.encode() + b"\0" for t in text[i : i + 3])) for i in range(len(text) - 2)]
    assert S.fnv64a_windows_of(text, 3).tolist() == want and want[0] != want[1]
    assert S.fnv64a_windows_of(text[:2], 3).tolist() == []
    df = spark.createDataFrame([(1, text), (2, None), (3, ["a"])], "i int, t array<string>")
    got = {r.i: r.h for r in df.select("i", S.fnv64a_windows("t", 3).alias("h")).collect()}
    assert [h % 2**64 for h in got[1]] == want and got[2] is None and got[3] == []


def test_fnv_of_windows_of_lists_together(monkeypatch):
    """Lists of all lengths, tokens of none, one and many bytes, windows parted at odd places."""
    import random

    rng = random.Random(3)
    lists = [["".join(rng.choices("aé漢", k=rng.choice([0, 1, 2, 40]))) for _ in range(rng.choice([0, 2, 3, 4, 30]))] for _ in range(25)]
    monkeypatch.setattr(S, "WINDOWS_AT_A_TIME", 7)

    def plain(tokens):
        h = 0xCBF29CE484222325
        for byte in b"".join(t.encode() + b"\0" for t in tokens):
            h = (h ^ byte) * 0x100000001B3 % (1 << 64)
        return h

    assert [x.tolist() for x in S.fnv64a_windows_of_all(lists, 3)] == [[plain(t[i : i + 3]) for i in range(len(t) - 2)] for t in lists]
    assert S.fnv64a_windows_of_all([], 3) == [] and S.fnv64a_windows_of_all([["a"]], 3)[0].tolist() == []

"""Column helpers against independent Python implementations and properties."""

import base64
import hashlib
import hmac
import string
from urllib.parse import quote, quote_plus

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.escaping import escape_code, unescape_code
from lectern.functions.paths import classify_block, clean_path, join_dir_name, repl_ref, split_dir_name
from lectern.functions.security import hmac_sha1_hex
from lectern.functions.text import (global_id, intl, topics_array, topics_csv, url_path_segment_escape,
                                    url_query_escape)
from lectern.operators.content import card_edit_url


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_split_dir_name_cases(spark):
    vals = ["02_Intro", "10_a_b", "x_y", "nounderscore", "-3_neg", " 2_space", "2_"]
    out = _one(spark, [(v,) for v in vals], "s string", split_dir_name(F.col("s")))
    assert [(o.idx, o.name) for o in out] == [(2, "Intro"), (10, "a_b"), (None, None), (None, None), (-3, "neg"),
                                              (None, None), (2, "")]


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.text(alphabet=string.ascii_letters + "_ -#", max_size=12))
def test_split_join_roundtrip(spark, i, name):
    out = _one(spark, [(i, name)], "i int, n string", split_dir_name(join_dir_name(F.col("i"), F.col("n"))))[0]
    assert (out.idx, out.name) == (i, name)


def test_classify_block(spark):
    names = ["a.prob.md", "b.md", "c.repl.yaml", "d.prob.repl.yaml", "e.txt", "index.yaml"]
    assert _one(spark, [(n,) for n in names], "n string", classify_block(F.col("n"))) == [
        "problem", "html", "exleditor", None, None, None]


def test_repl_ref_and_clean(spark):
    vals = ["#!exl::repl('01_x.prob.repl.yaml')", "#!exl::repl('./a//b.yaml')", "#!other", "plain"]
    assert _one(spark, [(v,) for v in vals], "s string", repl_ref(F.col("s"))) == [
        "01_x.prob.repl.yaml", "a/b.yaml", None, None]
    assert _one(spark, [("./a//b/",), ("",)], "s string", clean_path(F.col("s"))) == ["a/b", "."]


def test_global_id_matches_base64(spark):
    ids = ["x", "a" * 100, "ünï"]
    got = _one(spark, [(i,) for i in ids], "s string", global_id("Card", F.col("s")))
    assert got == [base64.b64encode(f"Card:{i}".encode()).decode() for i in ids]


def test_topics_roundtrip(spark):
    got = _one(spark, [(["a", "b"],), ([],)], "t array<string>", topics_array(topics_csv(F.col("t"))))
    assert got == [["a", "b"], [""]]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab`|&<> \n", max_size=40))
def test_escape_roundtrip(spark, text):
    out = _one(spark, [(text,)], "s string", unescape_code(escape_code(F.col("s"))))[0]
    assert out == text


def test_escape_examples(spark):
    got = _one(spark, [("x `a|b&c` y",), ("```\n<x> | y\n```",)], "s string", escape_code(F.col("s")))
    assert got == ["x `a&amp;pipe;b&amp;c` y", "```\n&lt;x&gt; &amp;pipe; y\n```"]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=string.printable + "é~*", max_size=30))
def test_url_escapes_match_python(spark, s):
    q, p = _one(spark, [(s,)], "s string", F.array(url_query_escape(F.col("s")), url_path_segment_escape(F.col("s"))))[0]
    assert q == quote_plus(s, safe="")
    assert p == quote(s, safe="$&+:=@")


def test_hmac_matches_python(spark):
    bodies = ["", "{}", "x" * 300, "ünïcode body"]
    got = _one(spark, [(b,) for b in bodies], "b string", hmac_sha1_hex("secret", F.col("b")))
    assert got == [hmac.new(b"secret", b.encode(), hashlib.sha1).hexdigest() for b in bodies]
    long_key = "k" * 100
    got = _one(spark, [("m",)], "b string", hmac_sha1_hex(long_key, F.col("b")))
    assert got == [hmac.new(long_key.encode(), b"m", hashlib.sha1).hexdigest()]


def test_card_edit_url(spark):
    rows = [("https://github.com/acme/c1", "01_A/02_B c/03_#x/00_t.md"), ("https://gitlab.com/acme/c0", "a/b/c/d.md")]
    got = _one(spark, rows, "r string, p string", card_edit_url(F.col("r"), F.col("p")))
    assert got == ["https://github.com/acme/c1/edit/master/01_A/02_B%20c/03_%23x/00_t.md", ""]


def test_intl(spark):
    got = _one(spark, [("Title", "en")], "t string, l string", intl(F.col("t"), F.col("l")))[0]
    assert [(e.content, e.is_default, e.locale) for e in got] == [("Title", True, "en")]


def test_changed_rows_sees_microseconds(spark):
    from lectern.operators.changes import changed_rows
    sql = "SELECT 1 AS id, TIMESTAMP '{0}' AS t, TIMESTAMP_NTZ '{1}' AS w, CAST(NULL AS INT) AS n"
    old = spark.sql(sql.format("2024-05-06 07:08:09.123001", "2024-05-06 07:08:09.123001"))
    for a, b in (("123999", "123001"), ("123001", "123999")):
        new = spark.sql(sql.format(f"2024-05-06 07:08:09.{a}", f"2024-05-06 07:08:09.{b}"))
        assert sorted(r.side for r in changed_rows(old, new).collect()) == ["new", "old"]
    assert changed_rows(old, old).count() == 0

"""URL templates: the tree to its full depth, purity along it, and the SQL on random deep paths."""

import random

import duckdb
import pandas as pd

from lectern.llm import url_templates


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"]: r.asDict() for r in url_templates.judge(df).collect()}


def test_variable_segment_in_the_middle(spark):
    """Names in a segment are generalised apart from what follows them."""
    urls = [f"http://x.io/a/user/n{chr(97 + i)}{chr(97 + j)}/{tail}" for i in range(6) for j in range(4) for tail in ("posts/1/raw", "spam")]
    urls += ["http://x.io", "http://x.io/", "http://x.io/a", "http://x.io/a/", None]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    assert {r["template"] for k, r in got.items() if "posts" in (urls[k] or "")} <= {"/a/user/*/posts/#/raw", "/a/*/*/*/#/raw", "/*/*/*/*/#/raw"}
    assert (got[48]["template"], got[52]["template"]) == ("", "") and got[52]["host"] == ""


def test_purity_reaches_unruled_pages(spark):
    """A host of which nearly all is blocked by rules: its few other pages go too; a host with one
    blocked folder keeps the others, and so does one without labels."""
    rules = tuple(("block", "bad.com", f"/{c}") for c in "abcdefgh")
    urls = [f"http://bad.com/{c}{i}/x" for c in "abcdefgh" for i in range(20)] + ["http://bad.com/z/x"]
    urls += [f"http://www.ok.com/{c}/{i}" for c in ("de", "en", "fr") for i in range(40)] + ["http://new.com/a/b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r for r in url_templates.judge(df, (*rules, ("block", "ok.com", "/de/"))).collect()}
    assert got["http://bad.com/z/x"]["rule"] is None and got["http://bad.com/z/x"]["verdict"] == "block"
    assert {r["verdict"] for u, r in got.items() if "ok.com/de" in u} == {"block"}
    assert {r["verdict"] for u, r in got.items() if "ok.com" in u and "/de/" not in u} == {"allow"}
    assert got["http://new.com/a/b"]["verdict"] == "allow"


def test_random_paths_equal_sql(spark):
    rng = random.Random(3)
    hosts = ["example.com", "a.example.net", "b.org", "c.io", "EXAMPLE.com"]
    urls = [f"http://{rng.choice(hosts)}" + "".join("/" + rng.choice(["de", "en", "fr", "user", "", "*", f"n{rng.randrange(40)}x", rng.choice("abcdefghijklmnopqrstu")])
                                                     for _ in range(rng.randrange(8))) + rng.choice(["", "?q=/a", "#f"]) for _ in range(900)] + [None, "none"]
    want = duckdb.connect()
    want.register("pages", pd.DataFrame({"page_id": range(len(urls)), "url": urls}))
    rows = want.execute(url_templates.oracle_sql()).fetchall()
    cols = [d[0] for d in want.description]
    got = judged(spark, urls)
    assert len(rows) == len(got) == len(urls)
    for row in (dict(zip(cols, r)) for r in rows):
        assert got[row["page_id"]] == row
    assert sum(r["template"].count("/") > 3 for r in got.values()) > 100

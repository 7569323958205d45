"""Every operator and pipeline stage on awkward rows: nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns whose names clash with the operators' own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import (bestfit_packing, bpe_lexicon, language_id, quality_fm, robust_rules, simhash_pivot, substring_cover, url_templates,
                         vector_sharding, vector_topk)

CLASHES = ["_kept", "_id", "_th", "m0", "_m1", "row", "fp", "root"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size long, th long, route long, z0 long, shard int, length long, unit string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))


def _row(i, text, lang="en", source="s", n=5):
    return (i, text, lang, source, n, 0.5, 7, 7, 7, 7, 7, 7, 7, "u")


ROWS = [_row(1, "the quick brown fox"), _row(1, "the quick brown fox"), _row(2, None), _row(3, ""), _row(4, "   \n\t"), _row(None, "no id here"),
        _row(None, None, None, None, None), _row(5, LONG), _row(6, LONG), _row(7, "123 456 !!!"), _row(8, "el rápido zorro", "es"),
        _row(9, "der schnelle Fuchs", "de"), _row(10, "<|endoftext|> x\x00y \U0001F600", None, None, None), _row(11, "a " * 300, "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _labels(docs):
    return docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).alias("quality"))


def _quality(d):
    return quality_fm.train(d, _labels(d), F.lit(True))


OPERATORS = {
    "quality": lambda d: quality_fm.score(d.select("doc_id", "text", "n_chars"), _quality(d)),
    "language": lambda d: language_id.predict(d.select("doc_id", "text"), language_id.train(d, F.lit(True))),
    "sharding": lambda d: vector_sharding.assign(d, 4),
    "simhash": lambda d: simhash_pivot.near_duplicates(d),
    "rules": lambda d: robust_rules.judge(d),
    "substring": lambda d: substring_cover.digest_report(d),
    "bpe": lambda d: bpe_lexicon.encode_decode(d, BYTE_BPE, size=50),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each_and_empty(name, docs, empty):
    assert OPERATORS[name](docs).count() == len(ROWS)
    assert OPERATORS[name](empty).count() == 0


def test_packing(docs, empty):
    got = bestfit_packing.pack_documents(docs, WORD_BPE).collect()
    assert sum(r["piece"] == 0 for r in got) == len(ROWS)
    assert bestfit_packing.pack_documents(empty, WORD_BPE).count() == 0


def test_stages_keep_columns(docs, empty):
    """Filters and edits return the columns they got; duplicates keep one row a component."""
    model, quality = language_id.train(docs, F.lit(True)), _quality(docs)
    for stage in (lambda d: language_id.keep_known(d, model), lambda d: quality_fm.keep_good(d, quality),
                  simhash_pivot.drop_near_duplicates, substring_cover.remove_repeats):
        got = stage(docs)
        assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
        assert got.count() <= len(ROWS)
        assert stage(empty).count() == 0
    named = [r["doc_id"] for r in simhash_pivot.drop_near_duplicates(docs).collect()]
    # 2, 3, 4 and the row without id and text are wordless and link; 5 and 6 are copies
    assert sorted(x for x in named if x is not None) == [1, 2, 5, 7, 8, 9, 10, 11] and named.count(None) == 1
    known = {r["doc_id"] for r in language_id.keep_known(docs.where("doc_id is not null"), model).collect()}
    assert known == {1, 5, 6, 8, 9, 10, 11}


def test_stages_with_clashing_columns(docs):
    wide = docs.select("doc_id", "text", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    plain = docs.select("doc_id", "text", "n_chars")
    for stage in (simhash_pivot.drop_near_duplicates, substring_cover.remove_repeats):
        got = stage(wide)
        assert got.columns == wide.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(len(CLASHES)))}
        rows = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
        assert rows(got) == rows(stage(plain))


def test_language_cases(docs, spark):
    got = {(r["doc_id"], r["text"]): r for r in language_id.predict(docs.select("doc_id", "text"), language_id.train(docs, F.lit(True))).collect()}
    for text in (None, "", "123 456 !!!"):
        row = next(r for k, r in got.items() if k[1] == text)
        assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    unlearned = language_id.train(docs, F.lit(False))
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), unlearned).collect()} == {"und"}


def test_quality_without_labels(docs, empty):
    model = quality_fm.train(docs, _labels(empty), F.lit(True))
    assert {r["score"] for r in quality_fm.score(docs.select("doc_id", "text", "n_chars"), model).collect()} == {0.5}


def test_rules_cases(docs):
    got = {r["doc_id"]: r for r in robust_rules.judge(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[11]["n_repeat_words"] == 300 and got[11]["base_failed"]


def test_substring_cases(docs):
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_cover.digest_report(docs).collect()}
    assert got[(5, 120_000)] == 0 and got[(6, 120_000)] == 120_000  # the copy with the larger id
    assert got[(11, 300)] == 0 and got[(1, 4)] == 0


URLS = ["https://a.example.net/en/1", None, "nonsense", "http://X.ORG/fr/2?q#f", "http://net/", "http://net", "http://b.example.com/de/", "http://b.example.com/de",
        "ftp://deep.example.org//x//y/z/9", "http://a.example.net/en/1", "a://b://c/d"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "rule") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "rule")], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge(pages).collect()}
    assert len(url_templates.judge(pages).collect()) == len(URLS) + 1
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("x.org", "/fr/2", "org/fr/", "allow")
    assert got[4] == ("net", "/", "net/", "block") and got[5] == ("net", "", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2] is None
    assert got[10][:2] == ("b:", "//c/d")
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 9.0], 1), (2, [0.5, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [inf, 1.0], 1),
            (6, [float("nan"), 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (50, [], 1), (100, [0.0, 1e-9], 1), (8, [-0.001, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in vector_topk.top_k(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 128 * 256), (0, 2, 2, 128 * 256), (0, 3, 100, 0), (0, 4, 8, -256)]
    assert [g[1:] for g in got if g[0] == 100] == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 8, 0)]
    assert not [g for g in got if g[0] == 50]
    assert vector_topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0

"""Small tables with known answers."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tabulens.functions import pvalues, text as X
from tabulens.functions.lexicon import MISSING_TOKENS
from tabulens.operators import clean, column_types as ct, extract, impute, models, sampling, textstats
from tabulens.operators.profile import column_profile
from tabulens.sources import files
from tabulens.sources.runs import merge_maps


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_missing_tokens(spark):
    df = spark.createDataFrame([(t.upper() + " ",) for t in MISSING_TOKENS] + [("ok",), (None,)], "a string")
    assert clean.standardize_missing(df).where("a is not null").collect()[0]["a"] == "ok"
    assert clean.missing_token_counts(df).first()["cells"] == len(MISSING_TOKENS)


@pytest.mark.parametrize("raw, want", [("أحمد إلى المدرسة", "احمد الي المدرسه"), ("شـــكراً", "شكرا"), ("  نص   عربي ", "نص عربي"), ("", "")])
def test_arabic(spark, raw, want):
    assert one(spark, X.normalize_arabic(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("مرحبا بالعالم", "arabic"), ("hello", "english"), ("abc مرح", "mixed"), ("  ", "unknown"), ("", "unknown")])
def test_language(spark, raw, want):
    assert one(spark, X.cell_language(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("", 0), ("  ", 0), ("a", 1), (" a\u00a0b\u2003 c ", 3), ("one\ttwo\n\nthree", 3), ("x\u200by", 1), (None, 0)])
def test_words(spark, raw, want):
    assert one(spark, X.word_count(F.lit(raw).cast("string"))) == want


def test_text_features_need_no_list_of_words(spark):
    rows = [(1, " Hello\u00a0big  World\n"), (2, ""), (3, None), (4, " \t"), (5, "one")]
    got = textstats.text_features(spark.createDataFrame(rows, "id long, t string"), ["t"])
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "hello big world", 15, 3, "english"), (2, "", 0, 0, "unknown"), (3, None, 0, 0, "unknown"), (4, "", 0, 0, "unknown"), (5, "one", 3, 1, "english")]
    both = textstats.text_features(spark.createDataFrame([(1, "مرحبا  بالعالم"), (2, "abc مرح"), (3, "hello there"), (4, None)], "id long, t string"), ["t"])
    assert sorted(tuple(r)[2:] for r in both.collect()) == [(0, 0, "unknown"), (7, 2, "mixed"), (11, 2, "english"), (13, 2, "arabic")]


def test_a_word_count_makes_no_match_of_every_word(spark):
    assert "regexp_extract_all" not in spark.range(1).select(X.word_count(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("ref", ["/x", "x/y", "../z", "../../../q", "./a/./b", "?a=1", "#t", "//h.org/p", "http://o.org/", "a/..", ".", "", "a?u=/b/../c"])
@pytest.mark.parametrize("base", ["http://h.com/a/b/c.html?q=1#f", "http://h.com", "https://h.com/d/"])
def test_urls(spark, base, ref):
    want = urljoin(base, ref) if ref else base
    got = one(spark, X.resolve_url(F.lit(base), F.lit(ref)))
    assert got.rstrip("/") == want.rstrip("/")


def test_price_and_rating(spark):
    assert one(spark, X.clean_price(F.lit(" £1,234.50\n"))) == "1234.50"
    assert one(spark, X.looks_like_price(F.lit("$1,000"))) is True
    assert one(spark, X.looks_like_price(F.lit("1000"))) is False
    assert one(spark, X.star_rating(F.lit("star-rating Four"))) == "4"


def test_types_of_a_dirty_table(spark):
    rows = [(i, ["?", f"{i * 3 % 97 + 0.5}"][i % 30 != 0], f"2024-01-{i % 28 + 1:02d}", ["retail", "corp", "gov", "other"][i % 4],
             f"note number {i} with enough words to be a text", "vendor" if i % 2 else "x") for i in range(150)]
    df = spark.createDataFrame(rows, "transaction_id long, unit_price string, when_txt string, segment string, product_notes string, gender string")
    types = {r.column_name: r.col_type for r in ct.infer_types(column_profile(clean.standardize_missing(df))).collect()}
    assert types == {"transaction_id": "id", "unit_price": "float", "when_txt": "datetime", "segment": "categorical", "product_notes": "id", "gender": "bool"}
    loose = {r.column_name: r.col_type for r in ct.infer_types(column_profile(df), compat=True).collect()}
    assert loose["gender"] == "datetime"  # "end" inside the name


def test_strategy_choice():
    assert impute.choose_strategy(100, [0.2, 0.2, 0.2]) == "mice"
    assert impute.choose_strategy(300, [0.12, 0.12, 0.0]) == "knn"
    assert impute.choose_strategy(50, [0.2, 0.2, 0.2]) == "simple"
    assert impute.choose_strategy(500, [0.0]) == "simple"


def test_p_values():
    assert pvalues.p_correlation(0.5, 20) == pytest.approx(0.0248, abs=1e-3)
    assert pvalues.p_anova(4.0, 2, 27) == pytest.approx(0.0301, abs=1e-3)
    assert pvalues.p_ks(1.0, 50, 50) < 1e-9 and pvalues.p_ks(0.02, 100, 100) > 0.99


def test_split_rules():
    assert sampling.choose_split(0.5, 10) == "group"
    assert sampling.choose_split(1.0, 10) == "stratified"
    assert sampling.choose_split(1.0, 1) == "shuffle"
    assert [sampling.fold_count(n) for n in (1, 2, 9)] == [2, 2, 3]


def test_group_split_keeps_texts_together(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("txt"))
    parts = sampling.holdout(df, ["id"], "group", group="txt").groupBy("txt").agg(F.count_distinct("part").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1


HTML = """<html><body><div class="list"><div class="item"><h2>A &amp; B<p>first<p>second</div>
<div class="item"><h2>C</h2><img data-src="i.png"><a href="../x?y=1">go</a><span class="star-rating Three"></span><b class=price>£ 9,10</b></div>
<div class="item"> </div></div><ul><li>one<li>two<li>three <a href="/t">t</a></ul></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "http://h.com/a/b.html", HTML)], "page_id long, url string, html string")
    fields = [{"name": "title", "selector": "h2", "type": "text"}, {"name": "img", "selector": "img", "type": "image"}, {"name": "link", "selector": "a", "type": "link"},
              {"name": "stars", "selector": "span", "type": "text"}, {"name": "price", "selector": "b.price", "type": "price"}]
    long = extract.extract_items(pages, ".list", ".item", fields)
    wide = extract.long_to_wide(extract.number_items(long), ["item_index"], "field_name", "value", ["title", "img", "link", "stars", "price"]).orderBy("item_index").collect()
    assert len(wide) == 2 and wide[1].asDict() == {"item_index": 1, "title": "C", "img": "http://h.com/a/i.png", "link": "http://h.com/x?y=1", "stars": "3", "price": "9.10".replace(".", "")}
    assert extract.page_progress(long).first().asDict() == {"page_id": 1, "items": 2, "failed": 1}
    assert extract.detect_patterns(pages).where("selector = 'li'").count() == 0  # the first item has no fields
    assert [n.text().strip() for n in extract.select(extract.parse(HTML), extract.compile_selector("ul > li"))] == ["one", "two", "three t"]
    assert [n.tag for n in extract.select(extract.parse(HTML), extract.compile_selector(".item:nth-of-type(2) img"))] == ["img"]


def test_csv_encodings_and_failures(spark, tmp_path):
    for enc in ("utf-8", "cp1256"):
        f = tmp_path / f"{enc}.csv"
        f.write_bytes(" name ,n\nشكوى,1\nخدمة,2\n".encode(enc))
        df = files.read_csv(spark, str(f))
        assert df.columns == ["name", "n"] and {r["name"] for r in df.collect()} == {"شكوى", "خدمة"}
    with pytest.raises(files.UnusableTable) as e:
        files.require(spark.range(3), 10)
    assert e.value.row(spark).first()["status"] == "failed"
    with pytest.raises(files.UnusableTable):
        files.read_table(spark, "x.pdf")


def test_merge_maps(spark):
    got = one(spark, merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))))
    assert got == {"a": 1, "b": 2}


def test_class_weights_and_failed_candidates(spark):
    df = spark.range(60).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("a"))
    w = {r.y: r.weight for r in models.add_class_weights(df, "y").select("y", "weight").distinct().collect()}
    assert w == {1: pytest.approx(60 / 40), 0: pytest.approx(60 / 80)}
    spec = models.Spec("y", "classification", ["id"], ["a"])
    p = models.prepare(df, spec)

    def broken():
        raise RuntimeError("no")

    board = {r.model_name: r.status for r in models.leaderboard(p.train, {"bad": broken, "none": None, "LR": models.candidates_for(p)["LogisticRegression"]}, spec, p.folds).collect()}
    assert board == {"bad": "failed", "none": "skipped", "LR": "success"}

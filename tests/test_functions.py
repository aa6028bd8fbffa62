from pyspark.sql import functions as F

from corpusloom.functions import scalars as sc
from corpusloom.functions.tokens import sentences, tokenize_en, tokenize_zh


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tokenize_en(F.lit("The café, trade_war 2019 of!"))) == ["café", "trade_war", "2019"]
    assert one(spark, tokenize_en(F.lit(None).cast("string"))) == []
    assert one(spark, tokenize_zh(F.lit("中国a发展了"))) == ["中国", "发展", "展了"]
    assert one(spark, sentences(F.lit("Short. This one is long enough! 太短。"))) == ["This one is long enough"]


def test_language_and_cleaning(spark):
    assert [one(spark, sc.detect_language(F.lit(t))) for t in ("", "中国abc", "中abcdef", None)] == ["unknown", "zh", "en", "unknown"]
    assert one(spark, sc.clean_text(F.lit("<b>a</b> https://x.y/z  b"))) == "a b"
    assert one(spark, sc.clean_text(F.lit(None).cast("string"))) == ""


def test_addresses_and_names(spark):
    assert one(spark, sc.normalize_url(F.lit("  http://a/b#c "))) == "http://a/b"
    assert one(spark, sc.safe_name(F.lit("??"))) == "untitled"
    assert one(spark, sc.normalize_country(F.lit("中国-中非论坛"))) == "China"
    assert one(spark, sc.normalize_country(F.lit("New Land"))) == "New_Land"
    assert one(spark, sc.src_file_of_name(F.lit("nigeria_links.txt_a77dfdc60859de0d_T.txt"))) == "nigeria_links.txt"
    assert one(spark, sc.country_of_name(F.lit("x_china_y.txt"))) == "China"
    assert one(spark, sc.is_binary_url(F.lit("https://a/b/c.PDF?x=1"))) is True
    assert one(spark, sc.hit_type(F.lit("t"), F.lit("https://a/x.php?q"))) is None
    assert one(spark, sc.hit_date(F.lit("am 2021年3月4日"), F.lit(None), F.lit("u"))) == "2021年3月4日"
    assert one(spark, sc.resolve_url(F.lit("http://h/a/b"), F.lit("../c"))) == "http://h/c"

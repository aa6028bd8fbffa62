import __spark_entry__ as entry
import pytest


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["group", "term", "cnt", "rank"]


def test_file_formats(spark, tmp_path):
    from corpusloom.sources import files

    (tmp_path / "seeds.txt").write_text("# c\n====\nhttp://a/ | 中国 | k | a\nbad | line\n")
    assert [tuple(r) for r in files.read_sites(spark, str(tmp_path / "seeds.txt")).collect()] == [("http://a/", "中国", "k", "a")]
    links = tmp_path / "links"
    links.mkdir()
    (links / "a_links.txt").write_text("x\n   URL: http://a/1#f\nhttp://a/1\nhttp://a/2\n")
    (links / "summary_report.txt").write_text("URL: http://no/")
    got = {(r.seed_url, r.src_file, r.src_line) for r in files.harvest_urls(files.read_link_files(spark, str(links))).collect()}
    assert got == {("http://a/1", "a_links.txt", 2), ("http://a/2", "a_links.txt", 4)}
    arts = tmp_path / "arts"
    arts.mkdir()
    head = "seed_url: s\nfinal_url: f\ntitle: T: x\ndate: d\nvia: v\nhttp_status: 200\ncontent_type: c\nnote: ok\n\n"
    (arts / "kenya_links.txt_ab_a b+%.txt").write_text(head + "body " * 40)
    r = files.read_articles(spark, str(arts)).first()
    assert (r.file_name, r.country, r.header["title"], r.text[:4]) == ("kenya_links.txt_ab_a b+%.txt", "kenya", "T: x", "body")
    assert files.read_articles_by_header(spark, str(arts)).first()["url"] == "f"
    assert files.read_mapping(spark, str(tmp_path / "none.json")).count() == 0


def test_stream_of_actions(spark, tmp_path):
    from corpusloom.streaming.incremental import action_counts_by_time

    src, out = str(tmp_path / "src"), str(tmp_path / "cp")
    spark.createDataFrame([(1, "China will trade a lot with others.")], "doc_id bigint, text string").selectExpr("*", "timestamp'2024-01-01 00:10:00' AS seen_at").write.parquet(src)
    stream = spark.readStream.schema("doc_id bigint, text string, seen_at timestamp").parquet(src)
    q = action_counts_by_time(stream).writeStream.format("memory").queryName("acts").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.type, r.cnt) for r in spark.table("acts").collect()] == [("trade", 1)]


@pytest.mark.parametrize("name", ["first_urls", "docs_by_country", "qualified_articles"])
def test_small_queries_against_sql(spark, name):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    df = entry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)

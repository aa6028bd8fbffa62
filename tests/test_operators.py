import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dates, extract, html, mapping, stats, topics


def toks(spark, rows):
    return spark.createDataFrame(rows, '"group" string, doc_id bigint, tokens array<string>'.replace('"group"', "`group`"))


def test_cooccurrence_counts_twice(spark):
    got = {(r.w1, r.w2): r.cnt for r in stats.cooccurrence(toks(spark, [("g", 1, ["a", "b", "a"])])).collect()}
    assert got == {("a", "b"): 4, ("a", "a"): 2}


@pytest.mark.parametrize("n", [2, 3])
def test_ngrams_over_documents(spark, n):
    docs = [("g", 1, ["x", "y"]), ("g", 2, []), ("g", 3, ["x"]), ("g", 20_001, ["y", "x", "y"]), ("h", 4, ["x"])]
    stream = ["x", "y", "x", "y", "x", "y"]
    want: dict = {}
    for i in range(len(stream) - n + 1):
        k = " ".join(stream[i : i + n])
        want[k] = want.get(k, 0) + 1
    assert {r.term: r.cnt for r in stats.ngram_counts(toks(spark, docs), n).collect()} == want


def test_similarity_and_empty(spark):
    same = toks(spark, [("g", 1, ["a", "b"]), ("g", 2, ["a", "b"])])
    assert stats.mean_similarity(same).first()["avg_similarity"] == 1.0
    none = toks(spark, []).where("false")
    assert stats.top_terms(none).count() == stats.pmi(none).count() == stats.ngram_counts(none, 2).count() == 0


def test_sentiment(spark):
    r = stats.sentiment(toks(spark, [("g", 1, ["growth"] * 13)])).first()
    assert (r.positive_count, r.negative_count, r.ratio) == (13, 0, 13.0)


def test_capitalised_over_lines(spark):
    df = spark.createDataFrame([("g", "Citic Dicastal\nNewsletter. Citic Dicastal\nNewsletter")], "k string, text string")
    assert [tuple(r) for r in stats.capitalised_entities(df, "k").collect()] == [("g", "Citic Dicastal\nNewsletter", 2)]


def test_actions_and_relations(spark):
    docs = spark.createDataFrame([(1, "He said it was important. China trades with all of them. China and trade once more."), (2, None), (3, "")], "doc_id bigint, text string")
    acts = extract.actions(docs)
    assert {(r.type, r.keyword) for r in acts.where("sent_no = 0").collect()} == {("trade", "import"), ("support", "aid")}
    ents = extract.entities(docs)
    assert {r.entity for r in ents.collect()} == {"China"}
    rel = extract.relations(docs).where("keyword = 'trade'")
    assert rel.agg(F.sum("n")).first()[0] == 4


def test_entity_rules(spark):
    docs = spark.createDataFrame([(1, "The UN met."), (2, "南非与中国签署了协议，王毅说。")], "doc_id bigint, text string")
    got = {(r.doc_id, r.entity_type, r.entity) for r in extract.entities(docs).collect()}
    assert not any(e == "UN" for _, _, e in got) and (2, "countries", "中国") in got and (2, "countries", "南非") not in got


def test_all_entity_types_against_brute_force(spark, tmp_path):
    import re
    from collections import Counter

    from corpusloom import lexicons as lex
    from corpusloom.plans.queries import _HERE_ZH, QUERIES

    texts = ["王毅在北京同代表团讨论合作事项。张伟 和王毅都表示双方愿意继续推进合作。", "李娜 在贸易会议上同中国代表团讨论贸易往来。天气很好没有别的事情可说。"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    surname = re.compile("(?:" + "|".join(dict.fromkeys(lex.SURNAMES_ZH)) + r")[\u4e00-\u9fff]{1,2}(?![^\u4e00-\u9fff\s])")
    want, people = Counter(), Counter()
    for d, text in enumerate(texts):
        own = {p for p in [*(p for p in lex.PERSONS_ZH if p in text), *surname.findall(text)] if p not in lex.INVALID_ENTITIES}
        people.update(own)
        parts = [s for s in text.split("。") if len(s) >= 10]
        acts = Counter((k, next(v for v in verbs if v in s)) for s in parts for k, verbs in _HERE_ZH.items() if any(v in s for v in verbs))
        want.update({(d, i, p, k, v, n): 1 for i, s in enumerate(parts) for p in own if p in s for (k, v), n in acts.items() if v in s})
    run = {k: QUERIES[k](spark, str(tmp_path)).collect() for k in ("entity_top20", "relations", "extraction_totals", "entities")}
    got = Counter((r.doc_id, r.sent_no, r.actant, r.action, r.keyword, r.n) for r in run["relations"] if r.actant_type == "persons")
    assert got == want and want
    assert {r.entity: r.cnt for r in run["entity_top20"] if r.entity_type == "persons"} == people
    total = run["extraction_totals"][0]
    assert total.entities == len(run["entities"]) and total.relations == sum(r.n for r in run["relations"])


PAGE = """<html><head><title>T</title><meta name="date" content=" 2024-05-01 "></head><body><nav><a href="/n">x</a></nav>
<h1>Head <b>line</b></h1><div class="content"><p>{}</p><p>Next</p><a href="/news/2024/5/1/a-12345.html">a</a><a href="b?page=2#f">b</a><a href="mailto:x@y.z">m</a></div>
<script>var a = '</p>';</script></body></html>""".format("word " * 80)


def test_page(spark):
    df = spark.createDataFrame([("http://h.example/x", PAGE), ("http://h.example/y", None)], "url string, html string")
    rows = {r.url: r for r in html.extract_pages(df).collect()}
    r = rows["http://h.example/x"]
    assert (r.title, r.date) == ("Head line", "2024-05-01") and "Next" not in r.text.splitlines()
    assert r.page_links == ["http://h.example/news/2024/5/1/a-12345.html", "http://h.example/b?page=2"]
    assert rows["http://h.example/y"].text == ""
    best = html.article_links(html.extract_pages(df)).collect()
    assert [(b.link, b.score, b["rank"]) for b in best] == [("http://h.example/news/2024/5/1/a-12345.html", 12, 1)]


def test_crawl_states(spark):
    links = "".join(f'<a href="/news/2024/1/{i}/x-2024.html">l</a>' for i in range(1, 9))
    seeds = spark.createDataFrame([("f", i, u) for i, u in enumerate(["http://h.e/list", "http://h.e/ok", "http://h.e/gone", "http://h.e/a.pdf", "http://h.e/b.zip"], 1)], "src_file string, src_line int, seed_url string")
    got = [("http://h.e/list", "<body>" + links + "</body>", None), ("http://h.e/ok", PAGE, None), ("http://h.e/a.pdf", None, "text"), ("http://h.e/b.zip", None, ""), ("http://h.e/news/2024/1/1/x-2024.html", PAGE, None)]
    fetched = spark.createDataFrame([(u, u, "requests", 200, "text/html" if h else "", h, b) for u, h, b in got], "url string, final_url string, via string, http_status int, content_type string, html string, binary_text string")
    notes = sorted((r.seed_url.rsplit("/", 1)[1], r.note) for r in html.crawl_records(seeds, fetched).collect())
    assert notes == sorted([("list", "directory"), ("list", "follow_ok"), ("list", "follow_fetch_failed"), ("list", "follow_fetch_failed"), ("ok", "ok"), ("gone", "fetch_failed"), ("a.pdf", "pdf_extracted"), ("b.zip", "binary_unsupported")])


def test_site_parsers(spark):
    page = "<h1>A long title</h1><main><p>short</p><p>A paragraph that is long enough to stay.</p><p>A paragraph that is long enough to stay.</p></main><li>May.3, 2024 <a href='/p/1.html'>A title of length</a></li><li>May 4, 2024 <a href='/p/2.html'>A month without a dot</a></li><div class=g><a href='http://x.e/a.doc'>k</a><h3>Hit 2021-03-04</h3></div>"
    df = spark.createDataFrame([("http://h.e/", page)], "url string, html string")
    assert html.site_articles(df, strict=True).first()["content"] == "A paragraph that is long enough to stay."
    assert [tuple(r)[1:] for r in html.dated_items(df, "http://d.e").collect()] == [("http://d.e/p/1.html", "A title of length")]
    assert html.keyword_links(df, "title").first()["link"] == "http://h.e/p/1.html"
    hit = html.search_hits(df).first()
    assert (hit.link_type, hit.hit_date) == ("DOC", "2021-03-04")


def test_mapping(spark):
    m = spark.createDataFrame([("a_links.txt", "A")], "src_file string, country string")
    names = spark.createDataFrame([("a_links.txt_1f_x.txt",), ("mongolia_china.txt",)], "name string")
    assert {r.name: r.country for r in mapping.prefix_country(names, "name", m).collect()} == {"a_links.txt_1f_x.txt": "A", "mongolia_china.txt": None}
    assert {r.country for r in mapping.prefix_country(names, "name", m, compat=True).collect()} == {"A", "China"}


def test_topics(spark):
    rows = [("g", i, ["rail", "port", "road"] * 3 if i % 2 else ["tax", "law", "court"] * 3) for i in range(20)]
    t = topics.topic_words(toks(spark, rows), k=2, words=3)
    assert t.count() == 6
    assert all(-1 <= r.c_v <= 1.0001 for r in topics.coherence(toks(spark, rows), t).collect())


def test_topics_of_each_group(spark, tmp_path):
    from corpusloom.plans.queries import QUERIES

    rows = [(100 * g + i, "rail port road " * 3 if i % 2 else "tax law court " * 3, name) for g, (name, n) in enumerate([("a", 12), ("b", 10), ("c", 9)]) for i in range(n)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.group for r in QUERIES["lda_topics"](spark, str(tmp_path)).collect()} == {"a", "b"}
    assert {(r.group, r.topic_id) for r in QUERIES["lda_coherence"](spark, str(tmp_path)).collect()} == {(g, k) for g in "ab" for k in range(5)}


SITES = [("u", "c", "k", "a", "Europe/Belgrade", "dmy"), ("u", "c", "k", "b", "America/Panama", "mdy"), ("u", "c", "k", "z", None, "dmy")]
CASES = [
    ("a", "17 May 2021", "2021-05-17"), ("a", "03/02/21", "2021-02-03"), ("b", "03/02/21", "2021-03-02"), ("a", "31/02/2022", None), ("a", "2 hours ago", None), ("a", None, None), ("a", "", None),
    ("a", "2021", None), ("a", "{{date}}", None), ("b", "6/30/2018 2:17 AM", "2018-06-30T07:17:00Z"), ("a", "28.10.2018. - 02:30", "2018-10-28T00:30:00Z"), ("a", "2019-03-31 02:30", "2019-03-31T01:30:00Z"),
    ("a", "June 2, 2022 4:56 PM UTC+02:00", "2022-06-02T14:56:00Z"), ("a", "2023-07-09 05:35:48 -05:00", "2023-07-09T10:35:48Z"), ("a", "1578092945", "2020-01-03T23:09:05Z"), ("a", "1670740879659", "2022-12-11T06:41:19Z"),
    ("a", "20190603T171508Z", "2019-06-03T17:15:08Z"), ("a", "2018年07月28日 下午11:08", "2018-07-28T21:08:00Z"), ("a", "le 1er août 2025", "2025-08-01"), ("a", "Mon Oct 02 2023 12:26:37 GMT+0300", "2023-10-02T09:26:37Z"),
    ("a", "3 Agustus 2018 22.39 WIB", "2018-08-03T15:39:00Z"), ("z", "2020-01-01 12:00", "2020-01-01T04:00:00Z"), ("z", "2020-06-01 10:00", "2020-06-01T02:00:00Z"), ("z", "2020-09-01 08:00", "2020-09-01T00:00:00Z"),
]


def test_dates(spark):
    sites = spark.createDataFrame(SITES, "url string, country string, keyword string, file_prefix string, tz_name string, date_order string")
    crawl = {"z": ["2020-01-01 04:00:30", "2020-06-01 02:00:10", "2020-09-01 00:00:20"]}
    rows = [(i, f" {p.upper()}_links.txt", d, crawl["z"].pop(0) if p == "z" else "2025-11-01 00:00:00") for i, (p, d, _) in enumerate(CASES)]
    arts = spark.createDataFrame(rows, "article_id bigint, src_file string, date string, crawl_time string")
    got = {r.article_id: r.date_norm for r in dates.normalise_dates(arts, sites).collect()}
    assert [(CASES[i][1], got.get(i)) for i in range(len(CASES))] == [(d, want) for _, d, want in CASES]
    assert dates.normalise_dates(arts.where("false"), sites).count() == 0


def test_zones_are_estimated_from_what_ties_them_down(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    def stamps(source, zone, late, named=(), n=40, start=dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)):
        """Moments over a year, ingested `late(i)` seconds later; those in `named` state their offset."""
        for i in range(n):
            utc = start + dt.timedelta(days=9 * i, hours=i % 24)
            local = utc.astimezone(ZoneInfo(zone))
            offset = int(local.utcoffset().total_seconds())
            yield source, int(utc.timestamp()) + offset, int(utc.timestamp()) + late(i), offset if i in named else None

    days = 86400
    rows = [
        *stamps("live", "Europe/Belgrade", lambda i: 60 * (i % 5) + 20),  # through two changes of the clock
        *stamps("mixed", "Asia/Jakarta", lambda i: 60 + i % 7 * days),  # some at once, some late
        *stamps("late", "Asia/Shanghai", lambda i: 3 * days + i * 977 % days),  # crawled days later: nothing tells the zone
        *stamps("named", "Africa/Cairo", lambda i: 3 * days, named=(3, 20, 33)),  # crawled late, but some values name their zone
        ("empty", None, 5, None), ("alone", 1_700_000_000, None, None),
    ]
    df = spark.createDataFrame(rows, "source string, local_s bigint, ingested_s bigint, offset_s bigint")
    got = {r.source: r.zone for r in dates.estimate_zones(df).collect()}
    assert got == {"live": "Europe/Belgrade", "mixed": "Asia/Jakarta", "late": None, "named": "Africa/Cairo"}


def test_clusters_take_words_of_earlier_clusters(spark):
    pairs = [("a", "b", 9.0), ("b", "c", 8.0), ("x", "y", 7.0), ("c", "y", 6.0), ("p", "q", 5.0)]
    df = spark.createDataFrame([("g", a, b, p) for a, b, p in pairs], "group string, w1 string, w2 string, pmi double")
    # the first start takes a, b, c and, through (c, y), y; x and y can't start as y is taken; p and q stay two words
    assert [(r.cluster_id, sorted(r.members)) for r in stats.semantic_clusters(df).collect()] == [(0, ["a", "b", "c", "y"])]
    df = spark.createDataFrame([("g", a, b, p) for a, b, p in [("a", "b", 9.0), ("a", "c", 8.0), ("x", "y", 7.0), ("c", "z", 1.0), ("x", "z", 0.5)]], "group string, w1 string, w2 string, pmi double")
    got = {r.cluster_id: sorted(r.members) for r in stats.semantic_clusters(df, sweep=4).collect()}
    assert got == {0: ["a", "b", "c", "z"]}
    got = {r.cluster_id: sorted(r.members) for r in stats.semantic_clusters(df.where("w2 <> 'z' or w1 <> 'c'"), sweep=5).collect()}
    assert got == {0: ["a", "b", "c"], 1: ["x", "y", "z"]}


def test_relations_count_each_action_of_the_document(spark):
    text = "Russia and China trade grain today. Kenya will trade with China soon. Nothing else was said here."
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5)], "doc_id bigint, text string, type int")
    rel = {(r.actant, r.sent_no): r.n for r in extract.relations(df).where("keyword = 'trade'").collect()}
    assert rel == {("Russia", 0): 2, ("China", 0): 2, ("Kenya", 1): 2, ("China", 1): 2}
    first = extract.relation_contexts(extract.relations(df), most=1).collect()
    assert len(first) == 1 and first[0]["rank"] == 1 and first[0].context.endswith("...")

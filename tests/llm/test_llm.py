import random

import pytest
from corpusloom.llm import boilerplate, bpe, language, leaks, lines, neardup, residue, tokens, truncation
from pyspark.sql import functions as F

ART = "article_id bigint, src_file string, final_url string, seed_url string, via string, http_status int, is_directory boolean, title string, text string, source string"


def articles(spark, rows):
    return spark.createDataFrame([(i, s, f"http://{s}.example/{i}", None, "requests", st, False, ti, tx, "clash") for i, s, st, ti, tx in rows], ART)


def test_encoding_equals_library(spark):
    import tiktoken

    import public_tokenizers as P

    texts = ["", None, " a  b\n\n c's", "数字贸易 Привет <|endoftext|> naïve x　y", "x" * 3000, "1234567 😀!!", "\t\r\n  end "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()} == {i: len(v) for i, v in got.items()}
    assert tokens.encode(df.where("false")).count() == 0


def test_perfect_hash():
    ranks = {str(i).encode(): i for i in range(3000)}
    h = bpe.PerfectHash(ranks)
    assert sorted(h.ids) == list(range(3000)) and all(h.get(k) == v for k, v in ranks.items()) and h.get(b"none") == -1


def test_totals(spark):
    df = spark.createDataFrame([(1, "s", "h", "en", 5), (2, "s", None, "fr", 7), (3, None, "h", None, 1)], "article_id bigint, source string, host string, lang string, n_tokens bigint")
    got = {(r.level, r.key): r.n_tokens for r in tokens.token_totals(df).collect()}
    assert got[("all", None)] == 13 and got[("source", "s")] == 12 and got[("lang", None)] == 1 and got[("host", "h")] == 6


def test_repeated_lines(spark):
    rows = [(i, "A ", 200, "t", f"Share me {i}!\n\nown line {'abcdefghij'[i]}") for i in range(6)] + [(9, "a", 200, None, None), (10, "b", 200, "", "")]
    df = articles(spark, rows)
    assert sorted(tuple(r) for r in lines.repeated_line_places(df).collect()) == [(i, 1) for i in range(6)]
    texts = {r.article_id: r.text for r in lines.without_repeated_lines(df).collect()}
    assert texts[0] == "\nown line a" and texts[9] is None and texts[10] == ""
    assert lines.repeated_line_places(df.where("false")).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(30)), " ".join(word() for _ in range(15)), word()) for i in range(20)]
    items += [(98, items[0][1], None, None), (99, "too short", "", "")]
    docs = []
    for d in range(40):
        w = [word() for _ in range(60)]
        for _ in range(rng.randrange(3)):
            src = rng.choice(items[:20])[1 + rng.randrange(2)].split()
            at, n = rng.randrange(len(w)), rng.randrange(11, 16)
            w[at:at] = src[rng.randrange(max(1, len(src) - n)) :][:n]
        docs.append((d, ", ".join(x.upper() for x in w)))
    docs += [(100, None), (101, "")]

    def grams(t):
        w = (t or "").lower().replace(",", "").split()
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, i) for d, t in docs for i, p, q, _ in items if grams(t) & (grams(p) | grams(q))}
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string, question string, answer string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 10


def test_block_max_wand_finds_all():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    index = leaks.ItemIndex([(i, " ".join(rng.choice(words) for _ in range(20)), "", "") for i in range(60)], block=4)
    ids = {i: f for f, (i, _, _) in enumerate(index.fields)}
    for i, f in ids.items():
        for start in (0, 3, 7):
            assert f in index.retrieve(index.fields[f][2][start : start + 13].tolist())


def test_slices_of_batches():
    import pyarrow as pa

    from corpusloom.llm.codes import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "", "b" * 50, "c", "d"])], names=["t"])
    for most, rows in ((1, 10), (6, 10), (1000, 4), (1000, 1)):
        parts = list(slices(batch, 0, most, rows))
        assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and all(0 < len(p) <= rows for p in parts)
    assert list(slices(batch.slice(0, 0), 0, 10)) == []


def test_more_items_than_fit_one_pass(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20)), f"q{i}", "a") for i in range(12)] + [(12, None, None, None)]
    docs = [(i, "x " + " ".join(p.split()[2:16]) + " y") for i, p, _, _ in items[:12]] + [(20, None), (21, "")]
    items_df = spark.createDataFrame(items, "item_id bigint, passage string, question string, answer string")
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for most in (4, 1, 100):
        got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs_df, items_df, most_items=most).collect()}
        assert got == {(i, i) for i in range(12)}


@pytest.mark.parametrize("n, similarity", [(3, 0.5), (5, 0.5), (3, 0.8)])
def test_near_duplicates_against_brute_force(spark, n, similarity):
    rng = random.Random(n)
    frame = [f"f{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 9, 20, 60, 120]))]
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(rng.choice([[], frame]) + w[: rng.choice([len(w), max(3, len(w) * 2 // 3)])]))
    texts += [texts[0], texts[0], "", "a b", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "article_id bigint, text string")

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [grams(t) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    got = [tuple(r) for r in neardup.near_duplicates(df, n=n, similarity=similarity, salt=1).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > (30 if similarity < 0.8 else 5)
    links = {r.article_id: (r.class_id, r.n_links) for r in neardup.link_counts(df, n=n, similarity=similarity).collect()}
    assert links[len(texts) - 1][0] == len(texts) - 3 and len(links) == len(texts) - 1
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    different = df.where(F.col("article_id").isin(sorted(first.values())))
    split = neardup.similar_pairs(different, n=n, similarity=similarity, rare=1, hot=3, per_bucket=500)
    assert set(map(tuple, split.select("a", "b").collect())) == {(i, j) for i, j in want if texts[i] != texts[j] and first[texts[i]] == i and first[texts[j]] == j}


def test_languages(spark):
    rng = random.Random(5)
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(22))
    english, french = "the of and road port was in to ministry said that spring ready with from", "le de et route port la dans ministère dit que printemps les travaux avec du"
    rows = [(i, "a", 200, say(english if i % 3 else french), "\n".join(say(english if i < 20 else french) for _ in range(4))) for i in range(40)]
    rows += [(50, "a", 200, None, say(english) + "\n" + say(english) + "\n" + say(french)), (51, "a", 200, "", None), (52, "a", 200, "x", "数字贸易是重点。" * 9)]
    df = articles(spark, rows)
    labels = spark.createDataFrame([(i, "English" if i < 20 else "fr-FR", "2024-01-01 00:00:00") for i in range(40)] + [(50, "und", "2024-01-01 00:00:00")] + [(1, "ru", "2023-01-01 00:00:00")], "article_id bigint, lang_label string, t string").select("article_id", "lang_label", F.col("t").cast("timestamp").alias("labelled_at"))
    found = language.label_lines(df, language.train(df, labels))
    main = {r.article_id: r.lang for r in language.article_languages(found).collect()}
    assert main[1] == "en" and main[30] == "fr" and main[50] == "en" and main[52] == "zh" and 51 not in main
    faults = {tuple(r) for r in language.label_faults(found, labels).collect()}
    assert {(50, 0, "en"), (50, 3, "fr"), (52, 0, "zh"), (22, -1, "en")} <= faults and not any(a == 2 for a, _, _ in faults)
    assert language.segments(found).where("article_id = 50").count() == 2


def test_segments_within_a_line(spark, tmp_path):
    from corpusloom.llm.queries import p1_segments

    rng = random.Random(6)
    say = lambda words, n: " ".join(rng.choice(words.split()) for _ in range(n))
    english, french = "the of and road port was in to ministry said that spring ready with from", "le de et route port la dans ministère dit que printemps les travaux avec du"
    rows = [(i, "a", 200, None, "\n".join(say(english if i < 20 else french, 22) for _ in range(4))) for i in range(40)]
    rows += [(50, "a", 200, say(english, 9), say(english, 30) + " " + say(french, 14) + " " + say(english, 30) + "\n" + say(english, 22))]
    articles(spark, rows).coalesce(1).write.parquet(str(tmp_path / "articles.parquet"))
    labels = spark.createDataFrame([(i, "en" if i < 20 else "fr") for i in range(40)], "article_id bigint, lang_label string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS labelled_at")
    labels.coalesce(1).write.parquet(str(tmp_path / "article_labels.parquet"))
    got = p1_segments(spark, str(tmp_path)).where("article_id = 50").orderBy("first_line", "first_word").collect()
    assert [(r.first_line, r.last_line, r.lang) for r in got] == [(0, 0, "en"), (1, 1, "en"), (1, 1, "fr"), (1, 2, "en")]
    assert abs(got[2].first_word - 31) <= 2 and abs(got[2].last_word - 44) <= 2
    assert [r.first_word for r in got[:2]] == [1, 1] and got[3].last_word == 22 and sum(r.n_words for r in got[1:]) == 96


def test_residue(spark):
    story = "The council of {} met the delegation of the port on the road to the sea in May. Trade grew by nine per cent in the year after the talks ended."
    rows = [(i, f"s{i % 4}", 200, "t", story.format("town" + chr(97 + i % 26) + chr(97 + i // 26)) + f"\nA second paragraph about case {chr(97 + i % 26)}{chr(97 + i // 26)} closes the report of the day." + "".join(f"\nThe talks of {chr(97 + i % 26)}{chr(97 + i // 26)}{x} went on in the evening, and both sides said they were content with what had been reached." for x in "pqr")) for i in range(60)]
    rows += [(100 + i, f"s{i % 4}", 404, "t", "Page not found\nSorry, the page is gone.") for i in range(8)] + [(200, "s1", 200, "t", "Page not found\nSorry, the page is gone.")]
    rows += [(300, "s1", 200, "t", "In {{ year }}, {{ city }} signed a deal with {{ country }}.\nThe {{ org }} met {{ name }} in the city."), (301, "s1", 200, "t", None), (302, "s1", 200, "t", "")]
    got = {r.article_id for r in residue.judge_records(articles(spark, rows)).where("is_residue").collect()}
    assert got == {*range(100, 108), 200, 300}


@pytest.mark.parametrize("near", [False, True])
def test_residue_keeps_copies(spark, near):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    story = lambda x: "\n".join(f"The {w} of {x} met the delegation of the port on the road to the sea, and both sides said that they were content with what had been reached." for w in ("council", "ministry", "chamber", "guild"))
    rows = [(i, "s", 200, "t", "Home of the site\n" + story("town" + name(i))) for i in range(60)]
    # near copies leave out one of the lines, so that each line stands in many different texts
    rows += [(100 + i, "s", 200, "t", "Home of the site\n" + "\n".join(x for j, x in enumerate(story("copyham").split("\n") + [f"{w.title()} talks on the copyham road ended well for all sides." for w in ("rail", "sea", "air")]) if not near or j != i % 7)) for i in range(35)]
    rows += [(200 + i, f"e{i % 3}", 404, "t", "Page not found\nSorry, the page is gone.") for i in range(8)]
    got = {r.article_id for r in residue.judge_records(articles(spark, rows)).where("is_residue").collect()}
    assert got == {*range(200, 208)}


def test_boilerplate():
    pages = [["Home | News | About", f"Headline of story {chr(97 + i)} in the town", f"Paragraph {chr(97 + i)} says something of its own at some length today.", "", "Latest", "1. Some other story here now", "Another story is told there", f"Views: {i}"] for i in range(20)]
    kinds = boilerplate.page_furniture(pages, [""] * 20)
    assert [k.tolist() for k in kinds] == [[2, 1, 1, 0, 2, 2, 2, 2]] * 20
    assert boilerplate.page_furniture([], []) == [] and boilerplate.page_furniture([[""]], [""])[0].tolist() == [0]


def test_boilerplate_places(spark):
    rows = [(i, "h", 200, None, f"Menu of the site\nOwn words of page {chr(97 + i)} stand here.") for i in range(9)] + [(20, "h", 200, None, None), (21, "h", 200, None, "")]
    df = articles(spark, rows)
    assert {tuple(r) for r in boilerplate.furniture_places(df).collect()} == {(i, 1) for i in range(9)}
    texts = {r.article_id: r.text for r in boilerplate.main_texts(df).collect()}
    assert texts[0] == "Own words of page a stand here." and texts[20] is None and texts[21] == ""


def test_boilerplate_counts_all_blocks_of_a_host(spark):
    def words(i, n):
        r = random.Random(i)
        return " ".join("".join(r.choices("bdfgklmnprst", k=6)) for _ in range(n))

    notice = words(-1, 22)
    rows = []
    for i in range(120):
        lines = ["Home", f"{words(i, 12)}."]
        if i % 10 == 0:  # 12 of 120 pages: too few in most blocks
            lines += ["Get our app", f"{words(1000 + i, 1)} {notice} {words(2000 + i, 1)}."]
        if i % 24 == 1:  # 5 pages, between other lines each time
            lines += [f"{words(3000 + i, 9)}.", "This portal is kept by the chancery of the port.", f"{words(4000 + i, 9)}."]
        if i % 10 == 3:
            lines += [f"Shown under: {words(5000 + i, 3)}, {words(6000 + i, 1)}, {words(7000 + i, 1)}"]
        if i % 8 == 5:
            lines += ["Read next", words(8000 + i, 7), words(9000 + i, 7)]
        rows.append((i, "h", 200, None, "\n".join(lines)))
    df = articles(spark, rows)
    want = {(i, n + 1) for i, *_, t in rows for n, x in enumerate(t.split("\n")) if x == "Home" or x == "Get our app" or notice in x or x.startswith(("This portal", "Shown", "Read"))}
    want |= {(i, n) for i in range(120) if i % 8 == 5 for n in (len(rows[i][4].split("\n")) - 1, len(rows[i][4].split("\n")))}
    for block in (10**6, 30, 8):
        assert {tuple(r) for r in boilerplate.furniture_places(df, block=block, percent=10.0).collect()} == want, block


def test_truncation(spark):
    whole = [f"The town of Abel met number {i} and they agreed to the plan.\nNext steps\nThey will go on with it later." for i in range(40)]
    cut = ["The town of Abel met number 3 and they agr", "It is so. They will go on wi", "Text (more)", "The end is here �"]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(100 + i, "s", t) for i, t in enumerate(cut)] + [(200, "s", None), (201, "s", "  "), (202, "s", "They go on.\nNext steps"), (203, "s", "They go on.\n***")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r.doc_id for r in truncation.judge_endings(df).where("reason is not null").collect()}
    assert got == {100, 101, 102, 103}
    share = truncation.truncated_share(truncation.judge_endings(df)).first()
    assert (share.n_documents, share.n_truncated) == (46, 4)


def test_truncation_within_first_sentence(spark):
    start = "The delegation of the town of Abel met the council of the port and the guild of the road and they agreed to the plan of the sea and the land"
    texts = [(i, "s", f"{start} number {i} and more.\nThey will go on with it later.") for i in range(40)]
    texts += [(100, "s", start + " and the"), (101, "s", start + " and the lan"), (102, "s", start + ",")]
    # a field limit: twelve different texts of 150 characters, the last words of which end lines elsewhere
    texts += [(200 + i, "f", (f"{start} {'abcdefghijkl'[i]}".ljust(138, "x") + " " + "go on later")[:150].ljust(150, "r")) for i in range(12)]
    texts += [(300 + i, "g", "They go on\nNext steps\n" + "and then on " * 10 + "\nNext steps") for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id bigint, source string, text string")
    got = {r.doc_id: r.reason for r in truncation.judge_endings(df).where("reason is not null").collect()}
    assert set(got) == {100, 101, 102, *range(200, 212)} and got[200] == "spike" and got[102] == "open"


def test_length_spikes(spark):
    rows = [("s", "chars", 100)] * 30 + [("s", "chars", n) for n in range(40, 160)]
    assert [r.spike for r in truncation.length_spikes(spark.createDataFrame(rows, "source string, unit string, n int")).collect()] == [100]

"""The queries of the core and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import lexicons as lex
from corpusloom.functions import scalars as sc
from corpusloom.functions.text import SPACE
from corpusloom.functions.tokens import tokenize_zh
from corpusloom.operators import dates, extract, html, mapping, stats, topics
from corpusloom.plans.report import corpus_report, statistics_report
from corpusloom.sources import files
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Words that occur in the test documents, for operators whose own lists hardly do.
ACTIONS_HERE = {
    "agree": ["agree", "signed", "approved"], "build": ["construction", "began", "build"], "trade": ["trade", "freight", "customs"], "warn": ["warned", "concern", "denied"],
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_TOK = rf"""
tok AS (
  SELECT source AS "group", doc_id, [w for w in regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') if length(w) >= 3 AND w NOT IN {_list(lex.STOPWORDS_EN)}] AS tokens
  FROM documents WHERE trim(text, ' ') <> ''
), term AS (SELECT "group", term, count(*) AS cnt FROM (SELECT "group", unnest(tokens) AS term FROM tok) GROUP BY ALL)"""


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tokenized(table(spark, folder, "documents"), "source")


@query()
def p5_found(spark, folder):
    return dates.normalise_dates(table(spark, folder, "articles"), table(spark, folder, "seed_sites"))


@query(f"WITH {_TOK} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY \"group\" ORDER BY cnt DESC, term) AS INTEGER) AS rank FROM term) WHERE rank <= 30")
def top_terms_by_source(spark, folder):
    return stats.top_terms(_tokens(spark, folder))


@query(f"""WITH {_TOK} SELECT "group", count(*) AS docs, CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) AS total_words,
  coalesce((SELECT count(*) FROM term WHERE term."group" = tok."group"), 0) AS unique_words FROM tok GROUP BY "group" """)
def corpus_size_by_source(spark, folder):
    return stats.corpus_size(_tokens(spark, folder))


def _ngram_sql(n: int, k: int, least: int) -> str:
    leads = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, n))
    gram = " || ' ' || ".join(["w", *(f"w{i}" for i in range(1, n))])
    return f"""WITH {_TOK}, flat AS (SELECT "group", doc_id, unnest(tokens) AS w, unnest(range(len(tokens))) AS pos FROM tok),
g AS (SELECT "group", w, {leads} FROM flat WINDOW o AS (PARTITION BY "group" ORDER BY doc_id, pos)),
c AS (SELECT "group", {gram} AS term, count(*) AS cnt FROM g WHERE w{n - 1} IS NOT NULL GROUP BY ALL HAVING count(*) >= {least})
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY cnt DESC, term) AS INTEGER) AS rank FROM c) WHERE rank <= {k}"""


@query(_ngram_sql(2, 15, 2))
def bigrams_by_source(spark, folder):
    return stats.top_ngrams(_tokens(spark, folder), 2, 15)


@query(_ngram_sql(3, 10, 2))
def trigrams_by_source(spark, folder):
    return stats.top_ngrams(_tokens(spark, folder), 3, 10)


@query(_ngram_sql(2, 20, 1))
def keyword_bigrams(spark, folder):
    return stats.top_ngrams(_tokens(spark, folder), 2, 20, least=1)


_PAIRS = """pairs AS (
  SELECT "group", least(a, b) AS w1, greatest(a, b) AS w2, 2 * count(*) AS cnt FROM (
    SELECT "group", unnest(tokens[1:len(tokens) - o]) AS a, unnest(tokens[1 + o:len(tokens)]) AS b FROM tok, (SELECT unnest(range(1, 6)) AS o) WHERE len(tokens) > o
  ) GROUP BY ALL
), top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY cnt DESC, w1, w2) AS INTEGER) AS rank FROM pairs) WHERE rank <= 30)"""


@query(f"WITH {_TOK}, {_PAIRS} SELECT * FROM top")
def cooccurrence_top30(spark, folder):
    return stats.top_pairs(_tokens(spark, folder))


@query(f"""WITH {_TOK}, {_PAIRS}, n AS (SELECT "group", sum(cnt) AS n FROM term GROUP BY "group")
SELECT top."group", w1, w2, top.cnt, round(log2((top.cnt / n.n) / ((a.cnt / n.n) * (b.cnt / n.n))), 4) AS pmi FROM top
JOIN n ON n."group" = top."group" JOIN term a ON a."group" = top."group" AND a.term = w1 JOIN term b ON b."group" = top."group" AND b.term = w2""")
def pmi_pairs(spark, folder):
    return stats.pmi(_tokens(spark, folder))


@query()
def semantic_clusters(spark, folder):
    return stats.semantic_clusters(stats.pmi(_tokens(spark, folder)))


def _weights_sql(limit: str) -> str:
    return f"""n AS (SELECT "group", count(*) AS n FROM tok GROUP BY "group" HAVING count(*) > 1),
tf AS (SELECT "group", doc_id, term, count(*) AS tf FROM (SELECT "group", doc_id, unnest(tokens) AS term FROM tok) {limit} GROUP BY ALL),
df AS (SELECT "group", term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT tf."group", doc_id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w, n FROM tf JOIN df USING ("group", term) JOIN n ON n."group" = tf."group"),
x AS (SELECT "group", doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY "group", doc_id)) AS x, n FROM w)"""


@query(f"""WITH {_TOK}, {_weights_sql('SEMI JOIN (SELECT "group", term FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY cnt DESC, term) AS r FROM term) WHERE r <= 50) v USING ("group", term)')}
SELECT "group", term, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, term) AS rank FROM (SELECT "group", term, round(sum(x) / any_value(n), 6) AS score FROM x GROUP BY "group", term)
) WHERE rank <= 20""")
def tfidf_top20(spark, folder):
    return stats.tfidf_keywords(_tokens(spark, folder))


@query(f"""WITH {_TOK}, {_weights_sql("")}, s AS (SELECT "group", sum(s * s) AS q FROM (SELECT "group", term, sum(x) AS s FROM x GROUP BY ALL) GROUP BY "group")
SELECT n."group", n, round((coalesce(q, 0) - n) / (n * (n - 1)), 4) AS avg_similarity FROM n LEFT JOIN s USING ("group")""")
def avg_similarity(spark, folder):
    return stats.mean_similarity(_tokens(spark, folder))


_FOLD = r"regexp_replace(regexp_replace(regexp_replace({0}, '[\p{{Z}}\x0B\x1C-\x1F\x{{85}}]', ' ', 'g'), '[^\p{{L}}\p{{N}}\x00-\x7F]', '.', 'g'), '[^\x00-\x7F]', '_', 'g')"


@query(rf"""SELECT "group", entity, count(*) AS cnt FROM (SELECT source AS "group", unnest(regexp_extract_all({_FOLD.format("text")}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')) AS entity FROM documents)
WHERE entity NOT IN {_list(lex.NO_ENTITIES)} GROUP BY ALL HAVING count(*) > 1""")
def capitalised_entities(spark, folder):
    return stats.capitalised_entities(table(spark, folder, "documents"), "source")


@query(f"""WITH {_TOK}, c AS (SELECT "group", sum(len([w for w in tokens if w IN {_list(lex.POSITIVE_EN)}])) AS p, sum(len([w for w in tokens if w IN {_list(lex.NEGATIVE_EN)}])) AS m FROM tok GROUP BY "group")
SELECT "group", CAST(p AS BIGINT) AS positive_count, CAST(m AS BIGINT) AS negative_count, round(p / (m + 1), 4) AS ratio FROM c""")
def sentiment_by_source(spark, folder):
    return stats.sentiment(_tokens(spark, folder))


@query(f"""WITH {_TOK} SELECT "group", polarity, term, cnt, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "group", polarity ORDER BY cnt DESC, term) AS INTEGER) AS rank FROM (
    SELECT *, CASE WHEN term IN {_list(lex.POSITIVE_EN)} THEN 'positive' WHEN term IN {_list(lex.NEGATIVE_EN)} THEN 'negative' END AS polarity FROM term) WHERE polarity IS NOT NULL) WHERE rank <= 10""")
def sentiment_words(spark, folder):
    return stats.sentiment_words(_tokens(spark, folder))


@query(f"""WITH {_TOK} SELECT "group", count(*) AS docs, CASE WHEN count(*) >= 10 THEN 'lda' ELSE 'statistical' END AS method FROM tok GROUP BY "group" """)
def method_router(spark, folder):
    return stats.route_methods(_tokens(spark, folder))


@query(r"""SELECT "group", term, cnt, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY cnt DESC, term) AS INTEGER) AS rank FROM (
  SELECT "group", term, count(*) AS cnt FROM (SELECT source AS "group", unnest([substr(text, i, 2) for i in range(1, length(text))]) AS term FROM documents WHERE lang = 'zh' AND trim(text, ' ') <> '')
  WHERE regexp_full_match(term, '[\x{4E00}-\x{9FA5}]{2}') AND term NOT IN """ + _list(lex.STOPWORDS_ZH) + r""" GROUP BY ALL)) WHERE rank <= 20""")
def chinese_terms(spark, folder):
    docs = table(spark, folder, "documents").where("lang = 'zh'")
    return stats.top_terms(stats.tokenized(docs, "source", tokens=tokenize_zh("text")), 20)


_ZH = r"""zh AS (SELECT source AS "group", unnest([substr(text, i, 2) for i in range(1, length(text))]) AS term FROM documents WHERE lang = 'zh' AND trim(text, ' ') <> '')"""


@query(f"""WITH {_ZH}, g AS (SELECT DISTINCT source AS "group" FROM documents WHERE lang = 'zh' AND trim(text, ' ') <> ''),
n AS (SELECT g."group", count(*) FILTER (WHERE term IN {_list(lex.POSITIVE_ZH)}) AS positive_count, count(*) FILTER (WHERE term IN {_list(lex.NEGATIVE_ZH)}) AS negative_count FROM g LEFT JOIN zh USING ("group") GROUP BY g."group")
SELECT *, round(positive_count / (negative_count + 1), 4) AS ratio FROM n""")
def chinese_sentiment(spark, folder):
    docs = table(spark, folder, "documents").where("lang = 'zh'")
    return stats.sentiment(stats.tokenized(docs, "source", tokens=tokenize_zh("text")), lex.POSITIVE_ZH, lex.NEGATIVE_ZH)


@query()
def chinese_keywords(spark, folder):
    docs = table(spark, folder, "documents").where("lang = 'zh'")
    return stats.tfidf_keywords(stats.tokenized(docs, "source", tokens=tokenize_zh("text")))


@query()
def chinese_textrank(spark, folder):
    docs = table(spark, folder, "documents").where("lang = 'zh'")
    return stats.textrank(stats.tokenized(docs, "lang", tokens=tokenize_zh("text")), k=15)


_LANG = r"""CASE WHEN length(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) = 0 THEN 'unknown'
WHEN length(regexp_replace(coalesce({0}, ''), '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')) / length(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) > 0.3 THEN 'zh' ELSE 'en' END"""


@query(rf"""SELECT doc_id, {_LANG.format("text")} AS language,
coalesce(length(regexp_replace(text, '[^\x{{4E00}}-\x{{9FA5}}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g')), 0) > 0.3, false) AS chinese FROM documents""")
def detect_language(spark, folder):
    return table(spark, folder, "documents").select("doc_id", sc.detect_language("text").alias("language"), F.coalesce(sc.is_chinese("text"), F.lit(False)).alias("chinese"))


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), 'https?://[^{SPACE}]+', '', 'g'), '[{SPACE}]+', ' ', 'g'), ' ') AS cleaned FROM documents""")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", sc.clean_text("text").alias("cleaned"))


def _entities(spark, folder):
    return extract.entities(table(spark, folder, "documents"))


def _entity_sql() -> str:
    def found(lang: str, kind: str, source: str, patterns: list[str]) -> str:
        each = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all({source}, '(?i){p}')) AS entity FROM d WHERE language {lang} 'zh'" for p in patterns)
        return f"SELECT doc_id, '{kind}' AS entity_type, entity FROM ({each})"

    cases = ", ".join(rf"CASE WHEN CASE WHEN language = 'zh' THEN contains(text, '{c}') ELSE regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){c}(?:$|[^\p{{L}}\p{{N}}_])') END THEN '{c}' END" for c in lex.COUNTRIES)
    countries = f"SELECT doc_id, 'countries' AS entity_type, unnest([{cases}]) AS entity FROM d"
    # a Chinese character before a sign that is neither Chinese nor white space ends no name: it is blotted out, as this engine has no lookahead
    han = r"\x{4E00}-\x{9FFF}"
    seen = rf"regexp_replace(text, '[{han}]([^{han} \t\n\x0B\f\r])', '#\1', 'g')"
    known = ", ".join(f"CASE WHEN contains(text, '{p}') THEN '{p}' END" for p in lex.PERSONS_ZH)
    persons = rf"""SELECT doc_id, 'persons' AS entity_type, unnest(list_concat([{known}], regexp_extract_all({seen}, '(?:{"|".join(dict.fromkeys(lex.SURNAMES_ZH))})[{han}]{{1,2}}'))) AS entity FROM d WHERE language = 'zh'"""
    parts = [
        countries, persons, found("<>", "organizations", "folded", lex.ORGANISATIONS_EN), found("=", "organizations", "text", lex.ORGANISATIONS_ZH),
        found("<>", "projects", "folded", lex.PROJECTS_EN), found("=", "projects", "text", lex.PROJECTS_ZH),
    ]
    return rf"""d AS MATERIALIZED (SELECT doc_id, text, {_LANG.format("text")} AS language, {_FOLD.format("text")} AS folded FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, entity_type, regexp_replace(entity, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS entity, language FROM ({" UNION ALL ".join(parts)}) JOIN d USING (doc_id) WHERE entity IS NOT NULL),
ent AS MATERIALIZED (SELECT doc_id, entity_type, entity FROM e WHERE length(entity) >= CASE WHEN language = 'zh' THEN 2 ELSE 3 END AND entity NOT IN {_list(lex.INVALID_ENTITIES)} AND regexp_matches(entity, '[\p{{L}}_]'))"""


@query(f"WITH {_entity_sql()} SELECT * FROM ent")
def entities(spark, folder):
    return _entities(spark, folder)


@query(f"WITH {_entity_sql()} SELECT * FROM ent WHERE entity_type = 'persons'")
def persons(spark, folder):
    return _entities(spark, folder).where("entity_type = 'persons'")


@query(f"""WITH {_entity_sql()} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY cnt DESC, entity) AS INTEGER) AS rank FROM (
  SELECT entity_type, entity, count(*) AS cnt FROM ent GROUP BY ALL)) WHERE rank <= 20""")
def entity_top20(spark, folder):
    return extract.top_entities(_entities(spark, folder))


def _action_sql(verbs_en: dict, verbs_zh: dict) -> str:
    kinds = ", ".join(f"{{'type': '{k}', 'en': [{', '.join(repr(v) for v in verbs_en[k])}], 'zh': [{', '.join(repr(v) for v in verbs_zh[k])}]}}" for k in verbs_en)
    return rf"""s0 AS (SELECT doc_id, {_LANG.format("text")} AS language, [x for x in [regexp_replace(p, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') for p in string_split_regex(text, '[。！？.!?]')] if length(x) >= 10] AS ss FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, language, unnest(ss) AS s, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_no FROM s0),
act AS (SELECT doc_id, sent_no, k.type AS type, [v for v in (CASE WHEN language = 'zh' THEN k.zh ELSE k.en END) if contains(lower(s), v)][1] AS keyword, substr(s, 1, 200) AS sentence FROM s, (SELECT unnest([{kinds}]) AS k))"""


_HERE_ZH = {"agree": lex.ACTIONS_ZH["cooperation"], "build": lex.ACTIONS_ZH["construction"], "trade": lex.ACTIONS_ZH["trade"], "warn": lex.ACTIONS_ZH["oppose"]}


@query(f"WITH {_action_sql(lex.ACTIONS_EN, lex.ACTIONS_ZH)} SELECT * FROM act WHERE keyword IS NOT NULL")
def actions(spark, folder):
    return extract.actions(table(spark, folder, "documents"))


@query(f"WITH {_action_sql(lex.ACTIONS_EN, lex.ACTIONS_ZH)} SELECT type, count(*) AS cnt FROM act WHERE keyword IS NOT NULL GROUP BY type")
def action_counts(spark, folder):
    return extract.action_counts(extract.actions(table(spark, folder, "documents")))


def _relation_sql(verbs_en: dict, verbs_zh: dict) -> str:
    return f"""{_entity_sql()}, {_action_sql(verbs_en, verbs_zh)}, an AS (SELECT doc_id, type, keyword, count(*) AS n FROM act WHERE keyword IS NOT NULL GROUP BY ALL),
rel AS (SELECT s.doc_id, sent_no, ent.entity AS actant, ent.entity_type AS actant_type, an.type AS action, an.keyword, substr(s, 1, 200) AS sentence, an.n
FROM s JOIN ent ON ent.doc_id = s.doc_id AND contains(s.s, ent.entity) JOIN an ON an.doc_id = s.doc_id AND contains(lower(s.s), an.keyword))"""


_REL = _relation_sql(ACTIONS_HERE, _HERE_ZH)


def _relations(spark, folder):
    return extract.relations(table(spark, folder, "documents"), verbs_en=ACTIONS_HERE, verbs_zh=_HERE_ZH)


@query(f"WITH {_REL} SELECT * FROM rel")
def relations(spark, folder):
    return _relations(spark, folder)


@query(f"""WITH {_REL} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM act WHERE keyword IS NOT NULL) AS actions, (SELECT CAST(sum(n) AS BIGINT) FROM rel) AS relations""")
def extraction_totals(spark, folder):
    acts = extract.actions(table(spark, folder, "documents"), verbs_en=ACTIONS_HERE, verbs_zh=_HERE_ZH)
    return extract.extraction_totals(_entities(spark, folder), acts, _relations(spark, folder))


@query(f"""WITH {_REL} SELECT CAST(row_number() OVER (ORDER BY doc_id, sent_no, actant_type, actant, action, keyword) AS INTEGER) AS rank, actant, actant_type, action, substr(sentence, 1, 100) || '...' AS context
FROM (SELECT * FROM rel ORDER BY doc_id, sent_no, actant_type, actant, action, keyword LIMIT 50)""")
def relation_contexts(spark, folder):
    return extract.relation_contexts(_relations(spark, folder))


@query(f"""WITH {_entity_sql()} SELECT entity_type, entity, country AS "group", count(*) AS cnt FROM ent JOIN documents USING (doc_id) GROUP BY ALL""")
def country_actants(spark, folder):
    groups = table(spark, folder, "documents").select("doc_id", F.col("country").alias("group"))
    return extract.group_actants(_entities(spark, folder), groups)


_KINDS = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE action = '{k}'), 0) AS BIGINT) AS \"{k}\"" for k in lex.ACTIONS_EN)


@query(f"WITH {_relation_sql(lex.ACTIONS_EN, lex.ACTIONS_ZH)} SELECT actant, {_KINDS} FROM rel GROUP BY actant")
def action_entity_matrix(spark, folder):
    return extract.action_entity_matrix(extract.relations(table(spark, folder, "documents")))


_SITES = """m AS (SELECT file_prefix || '_links.txt' AS src_file, max_by(CASE """ + " ".join(f"WHEN contains(country, '{a}') THEN '{b}'" for a, b in lex.COUNTRY_NAMES) + """ ELSE translate(country, ' -', '__') END, coalesce(url, '')) AS country
FROM seed_sites WHERE file_prefix IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_SITES} SELECT * FROM m")
def seed_mapping(spark, folder):
    return mapping.seed_mapping(table(spark, folder, "seed_sites"))


def _article_files(spark, folder):
    return table(spark, folder, "articles").select(F.lower(F.trim("src_file")).alias("src_file"))


@query(f"""WITH {_SITES}, f AS (SELECT DISTINCT lower(trim(src_file, ' ')) AS src_file FROM articles)
SELECT f.src_file, coalesce(c.country, m.country) AS country FROM f LEFT JOIN country_mapping c USING (src_file) LEFT JOIN m USING (src_file) WHERE coalesce(c.country, m.country) IS NOT NULL""")
def country_of_files(spark, folder):
    found = _article_files(spark, folder).distinct()
    return mapping.country_of_files(found, table(spark, folder, "country_mapping"), mapping.seed_mapping(table(spark, folder, "seed_sites")))


@query("SELECT country, count(*) AS docs FROM articles JOIN country_mapping c ON c.src_file = lower(trim(articles.src_file, ' ')) GROUP BY country")
def docs_by_country(spark, folder):
    return mapping.docs_by_country(_article_files(spark, folder), table(spark, folder, "country_mapping"))


@query("SELECT lower(trim(src_file, ' ')) AS src_file, count(*) AS docs FROM articles WHERE NOT EXISTS (SELECT 1 FROM country_mapping c WHERE c.src_file = lower(trim(articles.src_file, ' '))) GROUP BY 1")
def unmatched_files(spark, folder):
    return mapping.unmatched(_article_files(spark, folder), table(spark, folder, "country_mapping"))


@query("""WITH c AS (SELECT src_file, count(*) AS links FROM link_hits WHERE url IS NOT NULL GROUP BY 1), m AS (SELECT src_file, min(country) AS country FROM country_mapping GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY src_file) AS INTEGER) AS no, coalesce(country, src_file) AS country, src_file, links, count(*) OVER () AS total_files, CAST(sum(links) OVER () AS BIGINT) AS total_links FROM c LEFT JOIN m USING (src_file)""")
def link_summary(spark, folder):
    lines = files.link_file_lines(table(spark, folder, "link_hits").where("url is not null")).select("src_file", F.regexp_extract("block", r"(?m)^   (URL:) ", 1).alias("value"))
    return mapping.link_summary(mapping.link_counts(lines), table(spark, folder, "country_mapping"))


@query()
def mapping_summary(spark, folder):
    return mapping.mapping_summary(mapping.seed_mapping(table(spark, folder, "seed_sites")), _article_files(spark, folder))


@query(r"""WITH u AS (SELECT split_part(trim(coalesce(url, ''), ' '), '#', 1) AS url, src_file, line_no FROM link_hits)
SELECT url, src_file, line_no FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src_file, line_no) AS r FROM u WHERE regexp_matches(url, '^https?://')) WHERE r = 1""")
def first_urls(spark, folder):
    return mapping.first_urls(table(spark, folder, "link_hits"))


@query("SELECT src_file, count(*) AS links FROM link_hits GROUP BY src_file")
def link_counts(spark, folder):
    blocks = files.link_file_lines(table(spark, folder, "link_hits"))
    return mapping.link_counts(blocks.select("src_file", F.col("block").alias("value")))


@query(r"""SELECT hit_id, regexp_extract(coalesce(title, '') || coalesce(description, '') || coalesce(url, ''), '20[0-2]\d[-/年]\d{1,2}[-/月]\d{1,2}日?') AS found_date,
CASE WHEN contains(lower(url), '.php') OR lower(url) LIKE '%.pdf' THEN NULL WHEN contains(title, '[PDF]') THEN 'PDF' WHEN lower(url) LIKE '%.doc' OR lower(url) LIKE '%.docx' THEN 'DOC' ELSE 'HTML' END AS found_type FROM link_hits""")
def hit_fields(spark, folder):
    hits = table(spark, folder, "link_hits")
    return hits.select("hit_id", sc.hit_date("title", "description", "url").alias("found_date"), sc.hit_type("title", "url").alias("found_type"))


@query(r"""SELECT hit_id, split_part(trim(coalesce(url, ''), ' '), '#', 1) AS clean_url, substr(sha1(url), 1, 16) AS url_hash,
coalesce(nullif(substr(trim(regexp_replace(title, '[^\p{L}\p{N}_.\-]+', '_', 'g'), '_'), 1, 180), ''), 'untitled') AS name, trim(substr(regexp_replace(title, '[\\/*?:"<>|]', '', 'g'), 1, 100), ' ') AS file_name,
coalesce(regexp_extract(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '\.([^.]*)$', 1) IN """ + _list(lex.BINARY_EXTENSIONS) + """, false) AS is_binary FROM link_hits""")
def url_fields(spark, folder):
    hits = table(spark, folder, "link_hits")
    return hits.select(
        "hit_id", sc.normalize_url("url").alias("clean_url"), sc.sha16("url").alias("url_hash"), sc.safe_name("title").alias("name"), sc.clean_filename("title").alias("file_name"),
        F.coalesce(sc.is_binary_url("url"), F.lit(False)).alias("is_binary"),
    )


@query("SELECT url, keyword || ' site:' || rtrim(replace(replace(url, 'https://', ''), 'http://', ''), '/') || ' -filetype:pdf -inurl:.php' AS query FROM seed_sites")
def search_queries(spark, folder):
    return table(spark, folder, "seed_sites").select("url", sc.search_query("keyword", "url").alias("query"))


@query(r"""SELECT article_id, coalesce(nullif(substr(trim(regexp_replace(concat_ws('_', src_file, substr(sha1(final_url), 1, 16), coalesce(nullif(substr(title, 1, 80), ''), 'no_title')), '[^\p{L}\p{N}_.\-]+', '_', 'g'), '_'), 1, 180), ''), 'untitled') || '.txt' AS file_name
FROM articles WHERE NOT coalesce(is_directory, false) AND length(trim(coalesce(text, ''), ' ')) >= 350""")
def qualified_articles(spark, folder):
    return files.qualified(table(spark, folder, "articles")).select("article_id", "file_name")


@query(r"""SELECT src_file, CAST(n AS INTEGER) AS n, n || '. ' || coalesce(title, '') || chr(10) || '   URL: ' || url || chr(10) || '   类型: ' || link_type || CASE WHEN trim(coalesce(hit_date, ''), ' ') <> '' THEN ' | 日期: ' || hit_date ELSE '' END
|| CASE WHEN trim(coalesce(description, ''), ' ') <> '' THEN chr(10) || '   描述: ' || description ELSE '' END AS block FROM (SELECT *, row_number() OVER (PARTITION BY src_file ORDER BY line_no, hit_id) AS n FROM link_hits)""")
def link_blocks(spark, folder):
    return files.link_file_lines(table(spark, folder, "link_hits"))


def _pages(spark, folder) -> DataFrame:
    """Articles as pages: title, headline, menu, a paragraph for each line, and links to the hits of the same file with near line numbers."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    title = esc(F.coalesce("title", F.lit("")))
    links = F.concat(F.lit('<a href="/news/2024/5/17/story-1234.html">a</a><a href="/tag/x/">b</a><a href="#top">c</a><a href="mailto:d@e.example">d</a><a href="/detail/'), F.col("article_id"), F.lit('">e</a>'))
    page = F.concat(F.lit("<html><head><title>"), title, F.lit("</title><script>var a = '</p>';</script></head><body><nav><a href='/menu'>Menu</a></nav><article><h1>"), title, F.lit("</h1>"), lines, links, F.lit("</article></body></html>"))
    return table(spark, folder, "articles").select("article_id", F.col("final_url").alias("url"), page.alias("html"))


@query()
def page_texts(spark, folder):
    return html.extract_pages(_pages(spark, folder)).select("url", "title", "date", F.length("text").alias("n_chars"), F.round("link_density", 4).alias("link_density"), html.is_directory().alias("is_directory"))


@query(r"""SELECT DISTINCT regexp_extract(final_url, '^(https?://[^/?#]*)', 1) || l.path AS link, l.score, l.rank, final_url AS url FROM articles,
(SELECT unnest([{'path': '/news/2024/5/17/story-1234.html', 's': 12, 'r': 1}, {'path': '/detail/', 's': 0, 'r': 0}]) AS x), (SELECT x.path AS path, CAST(x.s AS INTEGER) AS score, CAST(x.r AS INTEGER) AS rank) l
WHERE x.s > 0 AND regexp_matches(final_url, '^https?://') AND split_part(final_url, '#', 1) <> regexp_extract(final_url, '^(https?://[^/?#]*)', 1) || l.path""")
def page_links_ranked(spark, folder):
    pages = html.extract_pages(_pages(spark, folder).where("url is not null").dropDuplicates(["url"]))
    return html.article_links(pages).where("rank = 1").select("link", "score", "rank", "url")


def _topics(spark, folder, rows_of: Callable[[DataFrame], DataFrame], columns: str) -> DataFrame:
    """`rows_of` for each group that `route_methods` sends to topic modelling."""
    toks = _tokens(spark, folder)
    groups = sorted((r["group"] for r in stats.route_methods(toks).where("method = 'lda'").collect()), key=lambda g: (g is not None, g))
    return topics.by_group(toks, groups, rows_of) if groups else spark.createDataFrame([], f"`group` string, {columns}")


@query()
def lda_topics(spark, folder):
    return _topics(spark, folder, topics.topic_words, "topic_id int, rank int, word string, prob double")


@query()
def lda_coherence(spark, folder):
    return _topics(spark, folder, lambda toks: topics.coherence(toks, topics.topic_words(toks)), "topic_id int, c_v double")


@query(f"""WITH {_TOK}, u AS (SELECT "group", count(*) AS u FROM term GROUP BY "group") SELECT tok."group", CASE WHEN count(*) >= 10 THEN 'lda' ELSE 'statistical' END AS method,
count(*) AS docs, CAST(sum(len(tokens)) AS BIGINT) AS total_words, coalesce(any_value(u), 0) AS unique_words FROM tok LEFT JOIN u ON u."group" = tok."group" GROUP BY tok."group" """)
def corpus_summary(spark, folder):
    return corpus_report(_tokens(spark, folder))


@query()
def statistics_sections(spark, folder):
    return statistics_report(table(spark, folder, "documents"), "source")

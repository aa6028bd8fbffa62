"""Entities, actions and relations of documents. Entities and actions are computed in each row; nothing is shuffled before the counts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import lexicons as lex
from corpusloom.functions.scalars import detect_language
from corpusloom.functions.text import SPACE
from corpusloom.functions.tokens import ascii_fold, sentences


def _each(values: Column | str) -> Column:
    """One row for each value, and one for an empty array. A plain explode makes the optimizer filter on the array's size first, and
    with that compute all that the array is made of a second time."""
    return F.explode_outer(values)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _all(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(flags + p), F.lit(0)) for p in patterns]))


def _typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda e: F.struct(F.lit(kind).alias("entity_type"), F.regexp_replace(e, rf"^[{SPACE}]+|[{SPACE}]+$", "").alias("entity")))


def _entity_array(zh: Column, t: Column, low: Column, folded: Column, countries: list[str], extra: Column | None) -> Column:
    """The entities of a text as an array of `struct(entity_type, entity)`. Patterns are literals, so each is compiled once."""
    edge = r"(?i)(?:^|[^\p{L}\p{N}_])%s(?:$|[^\p{L}\p{N}_])"
    named = lambda c: F.contains(low, F.lit(c.lower())) & t.rlike(edge % c)
    country = F.array_compact(F.array(*[F.when(F.when(zh, F.contains(t, F.lit(c))).otherwise(named(c)), F.lit(c)) for c in countries]))
    surname = "|".join(dict.fromkeys(lex.SURNAMES_ZH))
    by_surname = F.regexp_extract_all(t, F.lit(rf"(?:{surname})[\x{{4E00}}-\x{{9FFF}}]{{1,2}}(?![^\x{{4E00}}-\x{{9FFF}}\s])"), F.lit(0))
    persons = F.concat(F.filter(_strings(lex.PERSONS_ZH), lambda p: F.contains(t, p)), by_surname)
    none = F.array().cast("array<string>")
    found = F.concat(
        _typed("countries", country),
        _typed("organizations", F.when(zh, _all(t, lex.ORGANISATIONS_ZH)).otherwise(_all(folded, lex.ORGANISATIONS_EN))),
        _typed("persons", F.when(zh, persons).otherwise(none)),
        _typed("projects", F.when(zh, _all(t, lex.PROJECTS_ZH)).otherwise(_all(folded, lex.PROJECTS_EN))),
        *([extra] if extra is not None else []),
    )
    return F.filter(
        F.array_distinct(found),
        lambda x: (F.length(x["entity"]) >= F.when(zh, 2).otherwise(3)) & ~F.array_contains(_strings(lex.INVALID_ENTITIES), x["entity"]) & ~x["entity"].rlike(r"^\p{Nd}+$") & x["entity"].rlike(r"[\p{L}\p{N}_]"),
    )


def _with_entities(docs: DataFrame, doc_id: str, text: str, countries: list[str], extra: Column | None) -> DataFrame:
    """`doc_id, t, low, lang, ents`, one row for each text that isn't null. The language is computed once for each text, below any explode."""
    t = F.col(text)
    more = [extra.alias("extra")] if extra is not None else []
    base = docs.where(t.isNotNull()).select(F.col(doc_id).alias("doc_id"), t.alias("t"), detect_language(t).alias("lang"), F.lower(t).alias("low"), *more)
    base = base.withColumn("folded", F.when(F.col("lang") != "zh", ascii_fold("t")))
    ents = _entity_array(F.col("lang") == "zh", F.col("t"), F.col("low"), F.col("folded"), countries, F.col("extra") if more else None)
    return base.select("doc_id", "t", "low", "lang", ents.alias("ents"))


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", countries: list[str] = lex.COUNTRIES, extra: Column | None = None) -> DataFrame:
    """`doc_id, entity_type, entity`, distinct in each document.

    Chinese texts (`detect_language`): country names and known persons as substrings, persons by surname, patterns of organisations and
    projects. Others: country names between word edges, patterns, upper and lower case the same. Kept are entities of at least two
    characters (three in other texts) that are no invalid ones, no numbers and no signs. `extra` may add an array of
    `struct(entity_type, entity)`, such as a recogniser's output. Null texts have none.
    """
    return _with_entities(docs, doc_id, text, countries, extra).select("doc_id", _each("ents").alias("x")).where("x is not null").select("doc_id", "x.entity_type", "x.entity")


def _first_verb(low: Column, verbs: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in verbs])


def actions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", verbs_en: dict = lex.ACTIONS_EN, verbs_zh: dict = lex.ACTIONS_ZH) -> DataFrame:
    """`doc_id, sent_no, type, keyword, sentence`: in each sentence the first verb of each kind that it contains; sentences are cut at 200 characters."""
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), (detect_language(text) == "zh").alias("zh"), sentences(text).alias("ss"))
    each = base.select("doc_id", "zh", F.posexplode_outer("ss").alias("sent_no", "s")).where("s is not null").withColumn("low", F.lower("s"))
    kinds = [F.struct(F.lit(k).alias("type"), F.when(F.col("zh"), _first_verb(F.col("low"), verbs_zh[k])).otherwise(_first_verb(F.col("low"), verbs_en[k])).alias("keyword")) for k in verbs_en]
    found = F.filter(F.array(*kinds), lambda x: x["keyword"].isNotNull())
    return each.select("doc_id", "sent_no", "s", _each(found).alias("x")).where("x is not null").select("doc_id", "sent_no", "x.type", "x.keyword", F.substring("s", 1, 200).alias("sentence"))


def relations(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", countries: list[str] = lex.COUNTRIES, extra: Column | None = None, verbs_en: dict = lex.ACTIONS_EN, verbs_zh: dict = lex.ACTIONS_ZH
) -> DataFrame:
    """`doc_id, sent_no, actant, actant_type, action, keyword, sentence, n`: entities in a sentence with each of the document's actions whose verb the sentence has.

    `n` is how often the document has that action, so multiplicity is kept without repeating rows. Entities and actions are functions of the
    row, so all of it is one projection over the documents: no join, no shuffle.
    """
    base = _with_entities(docs, doc_id, text, countries, extra).select("doc_id", "low", (F.col("lang") == "zh").alias("zh"), "ents", sentences("t").alias("ss"))
    base = base.withColumn("lows", F.transform("ss", F.lower))

    def first_is(verb: str, before: list[str]) -> Callable[[Column], Column]:
        return lambda s: F.contains(s, F.lit(verb)) & ~F.coalesce(*[F.when(F.contains(s, F.lit(w)), F.lit(True)) for w in before], F.lit(False))

    def counted(verbs: dict) -> Column:
        """Each verb with the number of sentences in which it is the first of its kind: those that have it and none of the verbs before it."""
        out = []
        for kind, words in verbs.items():
            for i, verb in enumerate(words):
                out.append(F.struct(F.lit(kind).alias("type"), F.lit(verb).alias("keyword"), F.when(F.contains("low", F.lit(verb)), F.size(F.filter("lows", first_is(verb, words[:i])))).otherwise(0).cast("bigint").alias("n")))
        return F.filter(F.array(*out), lambda a: a["n"] > 0)

    base = base.withColumn("acts", F.when(F.col("zh"), counted(verbs_zh)).otherwise(counted(verbs_en)))
    each = base.select("doc_id", "ents", "acts", F.posexplode_outer(F.arrays_zip("ss", "lows")).alias("sent_no", "x")).where("x is not null").select("doc_id", "sent_no", "ents", "acts", F.col("x.ss").alias("s"), F.col("x.lows").alias("low"))
    hit = each.select("doc_id", "sent_no", "s", F.filter("acts", lambda a: F.contains(F.col("low"), a["keyword"])).alias("acts"), F.filter("ents", lambda e: F.contains(F.col("s"), e["entity"])).alias("ents"))
    pairs = hit.select("doc_id", "sent_no", "s", "acts", _each("ents").alias("e")).where("e is not null").select("doc_id", "sent_no", "s", "e", _each("acts").alias("a")).where("a is not null")
    return pairs.select(
        "doc_id", "sent_no", F.col("e.entity").alias("actant"), F.col("e.entity_type").alias("actant_type"), F.col("a.type").alias("action"), F.col("a.keyword").alias("keyword"), F.substring("s", 1, 200).alias("sentence"), F.col("a.n").alias("n")
    )


def relation_contexts(doc_relations: DataFrame, most: int = 50, width: int = 100) -> DataFrame:
    """`rank, actant, actant_type, action, context`: the first `most` relations by document and sentence, each with `width` characters of its sentence and `...`."""
    order = ["doc_id", "sent_no", "actant_type", "actant", "action", "keyword"]
    first = doc_relations.orderBy(*order).limit(most)
    context = F.concat(F.substring("sentence", 1, width), F.lit("..."))
    return first.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "actant", "actant_type", "action", context.alias("context"))


def top_entities(doc_entities: DataFrame, k: int = 20) -> DataFrame:
    """`entity_type, entity, cnt, rank`: entities by the documents that have them."""
    counts = doc_entities.groupBy("entity_type", "entity").agg(F.count("*").alias("cnt"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("entity_type").orderBy(F.desc("cnt"), "entity"))).where(F.col("rank") <= k)


def action_counts(doc_actions: DataFrame) -> DataFrame:
    return doc_actions.groupBy("type").agg(F.count("*").alias("cnt"))


def extraction_totals(doc_entities: DataFrame, doc_actions: DataFrame, doc_relations: DataFrame) -> DataFrame:
    """One row: `entities, actions, relations`."""
    one = lambda df, c, name: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)).withColumn("k", F.lit(1))
    return one(doc_entities, F.lit(1), "entities").join(one(doc_actions, F.lit(1), "actions"), "k").join(one(doc_relations, F.col("n"), "relations"), "k").drop("k")


def group_actants(doc_entities: DataFrame, groups: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """`entity` by group: how many documents of each group have it; `groups` gives `doc_id, group`."""
    joined = doc_entities.join(groups, "doc_id").groupBy("entity_type", "entity", "group").agg(F.count("*").alias("cnt"))
    return joined if kinds is None else joined.where(F.col("entity_type").isin(kinds))


def action_entity_matrix(doc_relations: DataFrame) -> DataFrame:
    """`actant, <action>...`: how often each entity meets each kind of action."""
    return doc_relations.groupBy("actant").pivot("action", list(lex.ACTIONS_EN)).agg(F.sum("n")).na.fill(0)



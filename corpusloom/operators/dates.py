"""Days and moments written in many notations, brought to one form. Built from column expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import source_of

#: Month names and abbreviations of the seven languages, by month.
MONTHS = {
    1: "january jan janvier janv enero ene января январь янв januari januar јануар јан".split(),
    2: "february feb février fevrier févr febrero февраля февраль фев februari februar фебруар феб".split(),
    3: "march mar mars marzo марта март мар maret mart".split(),
    4: "april apr avril avr abril abr апреля апрель апр април".split(),
    5: "may mai mayo мая май mei maj мај".split(),
    6: "june jun juin junio июня июнь июн juni јун".split(),
    7: "july jul juillet juil julio июля июль июл juli јул".split(),
    8: "august aug août aout agosto ago августа август авг agustus agu avgust avg".split(),
    9: "september sep sept septembre septiembre setiembre сентября сентябрь сен сент septembar септембар септ".split(),
    10: "october oct octobre octubre октября октябрь окт oktober okt oktobar октобар".split(),
    11: "november nov novembre noviembre ноября ноябрь ноя novembar новембар нов".split(),
    12: "december dec décembre decembre déc diciembre dic декабря декабрь дек desember des decembar децембар дец".split(),
}
#: Zone abbreviations that name one offset, in minutes east of Greenwich.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "wat": 60, "cest": 120, "cat": 120, "eet": 120, "sast": 120,
    "eest": 180, "msk": 180, "eat": 180, "trt": 180, "gst": 240, "pkt": 300, "uzt": 300, "npt": 345, "wib": 420, "ict": 420, "wita": 480,
    "sgt": 480, "hkt": 480, "wit": 540, "jst": 540, "kst": 540, "aest": 600, "art": -180, "brt": -180, "cot": -300, "est": -300, "edt": -240, "pst": -480, "pdt": -420,
}
#: Offset histories tried for a site whose zone is not known.
ZONES = (
    "UTC", "Asia/Shanghai", "Europe/Moscow", "Asia/Aqtobe", "Asia/Jakarta", "Africa/Cairo", "Africa/Lagos", "Africa/Addis_Ababa", "Asia/Ulaanbaatar",
    "Europe/Belgrade", "Asia/Tashkent", "Asia/Karachi", "Europe/Athens", "America/Panama", "America/Bogota", "America/New_York",
)

_NAME = "|".join(sorted({n for names in MONTHS.values() for n in names}, key=lambda n: (-len(n), n)))
_YMD = r"(?<!\d)(\d{4})\s*(?:[-/.]|年)\s*(\d{1,2})\s*(?:[-/.]|月)\s*(\d{1,2})(?!\d)日?"
_DIGITS = r"(?<![\d:.,/-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)\.?"
_DAY_FIRST = rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th|er|º|ª)?\.?[\s-]+(?:de\s+|of\s+)?({_NAME})(?!\p{{L}})\.?,?[\s-]+(?:de\s+|del\s+)?(\d{{4}})(?!\d)"
_MONTH_FIRST = rf"(?<!\p{{L}})({_NAME})(?!\p{{L}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)"
_TIME = r"(?<![\d:.+\-−])(\d{1,2})(?:[:.]|\s?h\s?)(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?![\d:])\s*(am|pm|a\.m\.|p\.m\.)?"
_OFFSET = r"(?:utc|gmt|z)?\s*([+\-−])\s*(\d{1,2}?)(?::?(\d{2}))?(?!\d)"
_ABBREVIATION = rf"(?<!\p{{L}})({'|'.join(sorted(ABBREVIATIONS, key=lambda n: (-len(n), n)))})(?!\p{{L}})"


def _get(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names for x in (n, m)])
    return F.element_at(table, name)


def parse_moments(df: DataFrame, date_col: str = "date", order_col: str = "date_order") -> DataFrame:
    """Adds `_day` (date), `_second` (seconds since midnight, null without a time), `_offset` (minutes east of Greenwich, null
    without a zone) and `_epoch` (seconds, for values that are a Unix time). All four are null if no full, existing day is named.

    `order_col` (dmy, mdy, ymd; null counts as dmy) gives the order of all-digit dates; a year of two digits is 20xx.
    """
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(date_col), r"[\s<>\[\]\x{A0}\x{202F}\x{3000}]+", " "))), r"(?<=\d)(?:上午|下午)", " $0")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2}):?(\d{2}):?(\d{2})((?:\.\d+)?\s?(?:z|[+-]\d{2}:?\d{2})?))?$", "$1-$2-$3 $4:$5:$6$7")
    df = df.withColumn("_epoch", F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint")).when(s.rlike(r"^\d{13}$"), F.floor(s.try_cast("bigint") / 1000)))
    # each date becomes <year;month;day>, or <?a;b;c> for all digits with the year last; each time becomes [hour;minute;second;half]
    s = F.regexp_replace(s, _YMD, "<$1;$2;$3>")
    s = F.regexp_replace(F.regexp_replace(s, _DAY_FIRST, "<$3;$2;$1>"), _MONTH_FIRST, "<$3;$1;$2>")
    s = F.regexp_replace(F.regexp_replace(s, _DIGITS, "<?$1;$3;$4>"), r"> ?t(?=\d)", "> ")
    s = F.regexp_replace(F.regexp_replace(s, r"上午", " am "), r"下午", " pm ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<!\p{L})(am|pm)\s+(\d{1,2}:\d{2})", "$2 $1"), _TIME, "[$1;$2;$3;$4]")
    df = df.withColumn("_s", s)
    s = F.col("_s")
    df = df.withColumn("_p", F.split(F.regexp_extract(s, r"<([^>]*)>", 1), ";")).withColumn("_t", F.split(F.regexp_extract(s, r"\[([^\]]*)\]", 1), ";"))
    df = df.withColumn("_z", F.regexp_replace(s, r"<[^>]*>|\[[^\]]*\]", " "))
    part = lambda c, i: F.try_element_at(F.col(c), F.lit(i))
    digits = part("_p", 1).startswith("?")
    order = F.lower(F.trim(F.coalesce(F.col(order_col), F.lit("dmy"))))
    order = F.when(~digits, "ymd").when((order == "ymd") & (F.length(part("_p", 3)) == 4), "dmy").otherwise(order)
    df = df.withColumn("_o", order).withColumn("_p", F.transform("_p", lambda x: F.ltrim(x, F.lit("?"))))
    year = _int(F.when(F.col("_o") == "ymd", part("_p", 1)).otherwise(part("_p", 3)))
    month = F.when(F.col("_o") == "dmy", part("_p", 2)).when(F.col("_o") == "mdy", part("_p", 1)).otherwise(part("_p", 2))
    day = _int(F.when(F.col("_o") == "ymd", part("_p", 3)).when(F.col("_o") == "mdy", part("_p", 2)).otherwise(part("_p", 1)))
    df = df.withColumn("_y", year).withColumn("_m", F.coalesce(_int(month), _month(month))).withColumn("_d", day)
    y = F.when(F.col("_y") < 100, F.col("_y") + 2000).otherwise(F.col("_y"))
    text = F.when(y >= 1000, F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(F.col("_m").cast("string"), 2, "0"), F.lpad(F.col("_d").cast("string"), 2, "0")))
    hour, minute, second = _int(part("_t", 1)), _int(part("_t", 2)), F.coalesce(_int(part("_t", 3)), F.lit(0))
    half = F.substring(part("_t", 4), 1, 1)
    hour = F.when(half.isin("a", "p") & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(hour)
    z = F.col("_z")
    sign = F.when(_get(z, _OFFSET, 1) == "+", 1).otherwise(-1)
    offset = F.coalesce(
        sign * (_int(_get(z, _OFFSET, 2)) * 60 + F.coalesce(_int(_get(z, _OFFSET, 3)), F.lit(0))),
        F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), _get(z, _ABBREVIATION, 1)),
    )
    ok = (hour < 24) & (minute < 60) & (second < 60)
    return (
        df.withColumn("_day", text.try_cast("date"))
        .withColumn("_second", F.when(F.col("_day").isNotNull() & ok, hour * 3600 + minute * 60 + second))
        .withColumn("_offset", F.when(F.col("_second").isNotNull(), offset))
        .drop("_s", "_p", "_t", "_z", "_o", "_y", "_m", "_d")
    )


def _zone_offset(utc_s: Column, zone: Column) -> Column:
    """Seconds east of Greenwich that the zone's history has at a moment."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_s), zone)) - utc_s


def estimate_zones(moments: DataFrame, zones: tuple[str, ...] = ZONES, tight: int = 3600, least: int = 3) -> DataFrame:
    """`source, zone` for each source of `moments` whose zone the data tell; `zone` is null for the others.

    `moments` has `source`, `local_s` (local seconds), `ingested_s` (seconds of the ingestion), `offset_s` (seconds east of Greenwich where the
    value names a zone itself, else null). Each candidate offset history is tried on all of a source's moments. Violations of it are:

    * a moment without a zone that lies after its own ingestion;
    * a moment with a zone whose offset isn't the history's at that moment;
    * a break of the sequence: of two moments, one after the other in the order of ingestion within a day, one with and one without
      a zone, the one that was ingested later is the earlier moment.

    The history with the fewest violations is chosen; among equals the one that leaves the least waiting, then the first name. A choice counts only if
    something ties it down: a moment with a zone that agrees with it, or `least` moments that it puts less than `tight` seconds
    before their ingestion. Otherwise, as after late crawls, every zone far enough east fits, and the result is null.
    Rows are pre-aggregated by source and zone, the sequence is looked at by day, so a source that holds most rows is no hot group.
    """
    zone = F.col("zone")
    aligned = moments.where(F.col("local_s").isNotNull() & F.col("ingested_s").isNotNull()).select(
        "source", "local_s", "ingested_s", "offset_s", F.explode(F.array(*[F.lit(z) for z in zones])).alias("zone")
    )
    own = F.col("local_s") - F.col("offset_s")
    aligned = aligned.withColumn("utc", F.coalesce(own, F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("local_s"), zone))))
    order = W.partitionBy("source", "zone", F.floor(F.col("ingested_s") / 86400)).orderBy("ingested_s", "local_s", "offset_s")
    named = F.col("offset_s").isNotNull()
    before = lambda c: F.lag(c).over(order)
    mixed = before(named) != named
    back = mixed & (before("ingested_s") < F.col("ingested_s")) & (before("utc") > F.col("utc"))
    aligned = aligned.withColumn("back", F.coalesce(back, F.lit(False)))
    wait = F.col("ingested_s") - F.col("utc")
    agrees = _zone_offset(F.col("utc"), zone) == F.col("offset_s")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    scored = aligned.groupBy("source", "zone").agg(
        (count(~named & (wait < 0)) + count(named & ~agrees) + count(F.col("back"))).alias("violations"),
        F.sum(F.when(~named, F.abs(wait)).otherwise(0)).alias("waiting"),
        (count(named & agrees) * least + count(~named & wait.between(0, tight - 1))).alias("ties"),
    )
    best = scored.groupBy("source").agg(F.min_by(F.struct("zone", "ties"), F.struct("violations", "waiting", "zone")).alias("best"))
    return best.select("source", F.when(F.col("best.ties") >= least, F.col("best.zone")).alias("zone"))


def normalise_dates(articles: DataFrame, sites: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """`article_id, date_norm` for each article whose `date` names a full, existing day.

    A day gives `yyyy-MM-dd`. With a time of day it gives UTC `yyyy-MM-ddTHH:mm:ssZ`: a written zone or offset holds; else the
    `tz_name` of the site (`file_prefix` + `_links.txt` is the source); else the zone that `estimate_zones` finds for the source,
    from `crawl_time` (UTC) and from the source's values that name a zone; else UTC. A local time that occurs twice means the first, one that is skipped is read with the offset before
    the change. Null, empty and relative dates, bare years and months, days that don't exist: no row. Articles that share an id keep
    one row each; several sites with one prefix: the least by (tz_name, date_order) holds.
    """
    site = (
        sites.where(F.col("file_prefix").isNotNull())
        .groupBy(F.concat(F.lower(F.trim("file_prefix")), F.lit("_links.txt")).alias("source"))
        .agg(F.min(F.struct("tz_name", "date_order")).alias("site"))
        .select("source", F.nullif(F.trim("site.tz_name"), F.lit("")).alias("tz_name"), "site.date_order")
    )
    base = articles.where(F.length(F.trim("date")) > 0).select("article_id", source_of("src_file").alias("source"), "date", "crawl_time")
    parsed = parse_moments(base.join(site, "source", "left"))
    parsed = parsed.where(F.col("_day").isNotNull() | F.col("_epoch").isNotNull())
    parsed = parsed.withColumn("local_s", F.datediff("_day", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.col("_second"))
    ingested = F.unix_seconds(F.concat(F.trim("crawl_time"), F.when(F.col("crawl_time").rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})\s*$"), "").otherwise("Z")).try_cast("timestamp"))
    open_ = parsed.where(F.col("tz_name").isNull() & F.col("local_s").isNotNull())
    guessed = estimate_zones(open_.select("source", "local_s", ingested.alias("ingested_s"), (F.col("_offset").cast("bigint") * 60).alias("offset_s")), zones)
    parsed = parsed.join(guessed, "source", "left")
    zone = F.coalesce("tz_name", "zone", F.lit("UTC"))
    by_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("local_s"), zone))
    utc = F.coalesce(F.col("_epoch"), F.col("local_s") - F.col("_offset").cast("bigint") * 60, by_zone)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(utc / 86400).cast("int")).cast("string")
    clock = F.pmod(utc, F.lit(86400))
    moment = F.concat(day, F.format_string("T%02d:%02d:%02dZ", F.floor(clock / 3600), F.floor(clock % 3600 / 60), clock % 60))
    return parsed.select("article_id", F.coalesce(moment, F.col("_day").cast("string")).alias("date_norm"))

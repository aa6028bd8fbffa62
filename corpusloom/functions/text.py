"""Column expressions shared by all operators. Everything here stays inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: one Han character, or an unbroken run of other letters and digits.
WORD = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"

#: Members of a character class: white space as Unicode has it, the same in every engine.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def words(text: Column | str) -> Column:
    """Lower-case words of a text, in order; an empty array for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def letters_key(line: Column | str) -> Column:
    """Lower case, letters only: two lines with the same key count as the same line."""
    c = F.col(line) if isinstance(line, str) else line
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def source_of(src_file: Column | str) -> Column:
    """The trimmed, lower-case link file name; null stays null."""
    c = F.col(src_file) if isinstance(src_file, str) else src_file
    return F.lower(F.trim(c))


def host_of(url: Column | str) -> Column:
    """Lower-case host without user, port, and a leading www. or m.; null where there is none."""
    c = F.col(url) if isinstance(url, str) else url
    h = F.regexp_extract(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?(?:www\.|m\.)?([^/:?#]+)", 1)
    return F.nullif(h, F.lit(""))

"""Scalar expressions on transcripts; all are Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"


def format_timestamp_ms(ms: Column, separator: str = ".") -> Column:
    """HH:MM:SS and milliseconds; hours have two digits or more."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))


def format_timestamp(seconds: Column, separator: str = ".") -> Column:
    return format_timestamp_ms(F.round(seconds * 1000).cast("long"), separator)


def normalized_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), WORD_BREAK, "")


def normalized_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def bag_overlap(a: Column, b: Column) -> Column:
    """Words that two bags share, counted with their repeats."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda total, w: total + F.least(count(a, w), count(b, w)))


def echo_words_match(a: Column, b: Column) -> Column:
    """Equal, or at least three words each with containment of 80 % and Dice of 72 %."""
    na, nb = F.size(a), F.size(b)
    # Lengths alone rule most pairs out: Dice of 72 % with the shorter list in common.
    may = (F.least(na, nb) >= 3) & (F.least(na, nb) * 200 >= (na + nb) * 72)
    shared = F.when(may, bag_overlap(a, b)).otherwise(F.lit(0))
    close = may & (shared * 5 >= F.least(na, nb) * 4) & (shared * 200 >= (na + nb) * 72)
    return F.coalesce((na > 0) & (nb > 0) & ((a == b) | close), F.lit(False))


def echo_text_matches(a: Column, b: Column) -> Column:
    return echo_words_match(normalized_words(a), normalized_words(b))


def canonical_folder_id(folder_id: Column, device: Column) -> Column:
    known = folder_id.rlike("^drive-folder-[0-9a-f]{64}$")
    return F.when(known, folder_id).otherwise(F.concat(F.lit("drive-folder-"), F.sha2(F.concat(device, F.lit(":"), folder_id).cast("binary"), 256)))


def archive_timestamp(ms: Column) -> Column:
    """UTC yyyyMMdd-HHmmss, whatever the session's time zone; years from 10000 have their digits, without a sign."""
    s = F.floor(ms / 1000).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86_400).cast("int"))
    rest = F.pmod(s, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    # A date format puts a plus before years of five digits.
    year = F.when(F.year(day).between(0, 9999), F.lpad(F.year(day).cast("string"), 4, "0")).otherwise(F.year(day).cast("string"))
    return F.concat(year, two(F.month(day)), two(F.dayofmonth(day)), F.lit("-"), two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))


def upper_letters(text: Column) -> Column:
    """``text`` in upper case, character by character: ß becomes ẞ, others whose upper case has several characters stay."""
    upper = lambda c: F.when(c == "ß", "ẞ").when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    # Where the length stays, no character has several.
    each = F.array_join(F.transform(F.split(text, ""), upper), "")
    return F.when(F.char_length(F.upper(text)) == F.char_length(text), F.upper(text)).otherwise(each)


def newer_stable_version(candidate: Column, current: Column) -> Column:
    """Numeric comparison of ``v?a.b.c``; pre-releases and malformed versions are never newer."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)$"
    parts = lambda v: F.struct(*[F.regexp_extract(v, pattern, k).try_cast("long") for k in (1, 2, 3)])
    ok = candidate.rlike(pattern) & current.rlike(pattern)
    return F.coalesce(ok & (parts(candidate) > parts(current)), F.lit(False))


def ends_sentence(text: Column) -> Column:
    """Whether the text ends in ``. ! ? …``, blanks and then closing quotes and brackets aside."""
    return F.regexp_replace(trimmed_end(text), r"""["'»)\]]+$""", "").rlike(r"[.!?…]$")


def trimmed_end(text: Column) -> Column:
    """Without white space of any script at the end."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def trimmed_start(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def speaker_label(speaker: Column, track: Column) -> Column:
    return F.coalesce(speaker, F.when(track.isin("microphone", "system"), track), F.lit(""))


def speaker_key(speaker: Column, track: Column) -> Column:
    return F.concat(track, F.lit(":"), F.coalesce(speaker, F.lit("")))


def snapshot_identity(original: Column, recording: Column) -> Column:
    """The original id if it isn't blank, else the recording's; null if both are blank."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(original), blank(recording))


def parent_revision(parent: Column) -> Column:
    return F.when((F.trim(parent) != "") & (parent != "legacy"), parent)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def like_ascii(text: Column, query: str) -> Column:
    """Whether ``text`` contains ``query``, A-Z and a-z alike; no character is a wildcard."""
    return ascii_lower(text).contains(query.translate(str.maketrans(UPPER, LOWER)))


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions of the expressions above, for use in spark.sql()."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalized_text(t STRING) RETURNS STRING RETURN regexp_replace(lower(t), '[^\\\\p{IsAlphabetic}\\\\p{N}]+', '')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION shared_words(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS INT RETURN "
        "aggregate(array_distinct(a), 0, (t, w) -> t + least(size(filter(a, x -> x = w)), size(filter(b, x -> x = w))))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalized_words(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(t), '[^\\\\p{IsAlphabetic}\\\\p{N}]+'), w -> w <> '')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION format_timestamp(s DOUBLE, sep STRING) RETURNS STRING RETURN "
        "concat(CASE WHEN round(s * 1000) < 360000000 THEN lpad(CAST(floor(round(s * 1000) / 3600000) AS STRING), 2, '0') ELSE CAST(floor(round(s * 1000) / 3600000) AS STRING) END, ':', "
        "lpad(CAST(CAST(floor(round(s * 1000) / 60000) AS BIGINT) % 60 AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor(round(s * 1000) / 1000) AS BIGINT) % 60 AS STRING), 2, '0'), sep, lpad(CAST(CAST(round(s * 1000) AS BIGINT) % 1000 AS STRING), 3, '0'))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION canonical_folder_id(id STRING, device STRING) RETURNS STRING RETURN "
        "CASE WHEN id RLIKE '^drive-folder-[0-9a-f]{64}$' THEN id ELSE concat('drive-folder-', sha2(CAST(concat(device, ':', id) AS BINARY), 256)) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION echo_word_lists_match(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS BOOLEAN RETURN "
        "coalesce(size(a) > 0 AND size(b) > 0 AND (a = b OR (least(size(a), size(b)) >= 3 AND shared_words(a, b) * 5 >= least(size(a), size(b)) * 4 AND shared_words(a, b) * 200 >= (size(a) + size(b)) * 72)), false)"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION echo_text_matches(a STRING, b STRING) RETURNS BOOLEAN RETURN echo_word_lists_match(normalized_words(a), normalized_words(b))")

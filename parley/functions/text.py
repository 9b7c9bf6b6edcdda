"""Text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Line ends in the Unicode sense.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# White space in the Unicode sense; the plain \s of the regex engine is ASCII only.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# The same characters one by one, for trimming: only the two ends are looked at.
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``.

    Inside a lambda an expression is evaluated per element; a bound value is evaluated per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space; stops at the first other character."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{SPACE[1:]}")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def norm_text(c: Column) -> Column:
    """Trimmed lower case; the form in which texts and labels are compared."""
    return F.lower(strip(c))


def squeeze_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    """White-space separated words; null and blank text have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words, at least 1."""
    return F.greatest(F.size(words(c)), F.lit(1))


def safe_name(c: Column) -> Column:
    """White space and slashes become an underscore."""
    return F.regexp_replace(c, rf"[{SPACE[1:-1]}/\\]+", "_")


def safe_suffix(*cols: Column, limit: int = 80, keep: int = 60) -> Column:
    """Column names joined into a file-name suffix; long ones are cut and get a hash of the whole."""
    def suffix(both: Column) -> Column:
        raw, safe = both["raw"], both["safe"]
        short = F.concat(F.substring(safe, 1, keep), F.lit("_"), F.substring(F.sha1(raw), 1, 8))
        return F.when(raw == "", F.lit("nogroups")).when(F.length(safe) > limit, short).otherwise(safe)

    joined = F.concat_ws("_", *[blank_to_null(strip(c)) for c in cols])
    cleaned = lambda raw: F.struct(raw.alias("raw"), F.regexp_replace(raw, r"[^A-Za-z0-9_.-]+", "_").alias("safe"))
    return let(let(joined, cleaned), suffix)


def preview(c: Column, n: int = 120) -> Column:
    """The first ``n`` characters, with an ellipsis when there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def join_lines(values: Column) -> Column:
    """Non-blank values of an array, trimmed, one per line."""
    clean = F.transform(values, lambda v: strip(F.coalesce(v, F.lit(""))))
    return F.array_join(F.filter(clean, lambda v: v != ""), "\n")


def percent_encode(c: Column) -> Column:
    """RFC 3986 escapes: the form encoder writes '+', '*' and '%7E' where this form has '%20', '%2A' and '~'."""
    e = F.url_encode(c)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def last_line_url(c: Column, n: int = 80) -> Column:
    """The last non-blank line, cut to ``n`` characters and percent-encoded."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda s: s != "")
    return F.when(F.size(lines) > 0, percent_encode(F.substring(F.element_at(lines, -1), 1, n)))


def gloss_clean(answer: Column, source: Column) -> Column:
    """One upper-case line of gloss without quotes or heading; the source itself when nothing is left."""
    unquoted = F.regexp_replace(strip(answer), r"""^["']+|["']+$""", "")
    body = strip(F.regexp_replace(unquoted, r"(?i)^asl\s+gloss\s*:\s*", ""))
    line = F.upper(F.regexp_replace(strip(F.split(body, LINE_BREAK)[0]), f"{SPACE}+", " "))
    return F.coalesce(blank_to_null(line), F.upper(F.regexp_replace(source, f"{SPACE}+", " ")))


def fingerspell(c: Column) -> Column:
    """Words with their letters and digits, upper case."""
    return F.transform(
        words(c),
        lambda w: F.struct(
            F.upper(w).alias("word"),
            F.filter(F.split(F.upper(w), ""), lambda ch: ch.rlike(r"[\p{L}\p{N}]")).alias("letters"),
        ),
    )


# What counts as "no source text".
NULL_WORDS = ("nan", "none", "<na>", "nat")
NO_SPEECH = "(no speech)"


def has_source(c: Column) -> Column:
    """True when there is text to translate."""
    t = norm_text(F.coalesce(c, F.lit("")))
    return ~t.isin("", NO_SPEECH, *NULL_WORDS)


# Transcripts that are noise.
NOISE_PHRASES = (
    "thank you", "thank you.", "thank you for watching", "thank you for watching.",
    "bye", "bye.", "thanks", "thanks.",
)


def is_speech_text(c: Column, min_words: int = 2) -> Column:
    """Not a noise phrase, and at least ``min_words`` words with a Latin letter."""
    t = strip(F.coalesce(c, F.lit("")))
    lettered = F.filter(words(t), lambda w: w.rlike("[A-Za-z]"))
    return ~F.lower(t).isin(*NOISE_PHRASES) & (F.size(lettered) >= min_words)


def round4(c: Column) -> Column:
    return F.round(c, 4)


def gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")

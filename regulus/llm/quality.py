"""Line-first cleaning with built-in functions only.

Every line with a word is judged by its punctuation, as navigation and as boilerplate; lines that fail are
removed, and a text that loses more than ``max_lost`` of its words (or fails the base counts) is rejected.
One pass over the table, no shuffle, no Python: arrays never leave their row.

A NULL text counts as an empty one: all counts 0, rejected. Lines without a word are kept and judged
nowhere. Repeated rows are judged one by one; an empty table gives an empty result; other columns pass
through ``clean`` unchanged, and none of them can clash because results are computed in one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# Phrases of lines that belong to a site, not to a text.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum",
    "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter", "click here to",
    "skip to content", "back to top",
)
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "sign up", "next", "previous", "read more", "share", "search",
    "contact us", "about us", "share on facebook", "share on twitter",
)
SEPARATOR = r"(?:^|[\x20\x09])[|»›•·>/]+(?=[\x20\x09]|$)"
PUNCTUATION = r"[!-/:-@\[-`{-~«»…“”„]"
SENTENCE_MARK = r"[.!?,;:…。。！？]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _covered(starts: Column) -> Column:
    """Words under windows of ``WINDOW`` words that begin at the ascending ``starts``."""
    return F.aggregate(
        F.transform(starts, lambda d, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - d, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)


def _twice(pairs: Column) -> Column:
    """Starts of windows whose hash stands next to an equal one in the ascending (hash, start) ``pairs``."""
    kept = F.filter(pairs, lambda p, j: (F.coalesce(F.get(pairs, j - 1)["h"] == p["h"], F.lit(False)))
                    | F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False)))
    return F.sort_array(F.transform(kept, lambda p: p["i"]))


def repeated_words(words: Column) -> Column:
    """Number of words in 5-word windows that occur at least twice in ``words``."""
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(pairs, lambda p: let(_twice(p), _covered)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(let(hashes, windows), count))


def line_fails(line: Column) -> Column:
    """Whether a line with a word is removed: bad punctuation, navigation, or boilerplate."""
    low = F.lower(line)
    marks = F.size(F.regexp_extract_all(line, F.lit(PUNCTUATION), F.lit(0)))
    no_mark = ~line.rlike(SENTENCE_MARK) & (F.size(_words(line)) >= 25)
    separators = F.size(F.regexp_extract_all(line, F.lit(SEPARATOR), F.lit(0)))
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return ((marks * 10 > F.length(line) * 3) | no_mark
            | (line.rlike(SEPARATOR) & (separators >= 3) & (separators * 4 >= F.size(_words(line))))
            | F.btrim(low, F.lit(BLANKS + ".:>|")).isin(*NAVIGATION) | boilerplate)


def judge(text: Column, max_lost: float = 0.5) -> Column:
    """A struct of the counts, the verdicts and the cleaned text of one text."""
    def result(t: Column, words: Column, lines: Column) -> Column:
        n_words = F.size(words)
        full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        dup = let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        bad = F.filter(full, line_fails)
        lost = F.aggregate(bad, F.lit(0), lambda a, x: a + F.size(_words(x)))

        def verdict(repeats: Column, removed: Column, gone: Column) -> Column:
            failed = (n_words < 10) | (repeats.cast("long") * 100 > n_words.cast("long") * 20)
            return F.struct(
                n_words.cast("long").alias("n_words"), F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
                F.size(F.regexp_extract_all(t, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
                dup.cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
                failed.alias("base_failed"), (~failed & (gone <= n_words * F.lit(max_lost))).alias("kept"),
                gone.cast("long").alias("n_lost_words"),
                F.when(F.size(removed) == 0, t).otherwise(
                    F.array_join(F.filter(lines, lambda x: ~F.array_contains(removed, x)), "\n")).alias("clean_text"))

        return let(repeated_words(words), lambda r: let(
            F.array_distinct(bad), lambda b: let(lost, lambda g: verdict(r, b, g))))

    t = F.coalesce(text, F.lit(""))
    return let(t, lambda x: let(_words(x), lambda w: let(F.split(x, "\n", -1), lambda ls: result(x, w, ls))))


def assess(docs: DataFrame, text: str = "text", max_lost: float = 0.5, into: str = "quality") -> DataFrame:
    """Every row of ``docs`` with the struct column ``into`` (it replaces a column of that name)."""
    return docs.withColumn(into, judge(F.col(text), max_lost))


def clean(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """The rows that pass, in their own columns, with failing lines taken out of the text."""
    q = assess(docs, text, max_lost, "_quality_of_row").where(F.col("_quality_of_row.kept"))
    return q.withColumn(text, F.col("_quality_of_row.clean_text")).drop("_quality_of_row")

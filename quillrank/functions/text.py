"""Text analysis and the small string rules of the document model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.lets import let

# Fixed patterns: analysed words, whitespace runs and the synopsis layout.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
SPACE_PATTERN = r"[\s\p{Z}]+"
AUTHORS_PATTERN = r" by (.+?)\. Published"
YEAR_PATTERN = r"Published in (\d{4})"
SUBJECTS_PATTERN = r"(?i)Subjects?: (.+?)\.?\s*$"


# Classes of the Unicode word boundary rules (fixed values).
_EXTEND = r"[\p{M}\p{Cf}&&[^\x{200B}]]*"
_UNSPACED = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
_KANA = r"\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
_LETTER = rf"[\p{{L}}\p{{Nl}}&&[^\p{{IsHan}}\p{{IsHiragana}}{_KANA}{_UNSPACED}]]{_EXTEND}"
_DIGIT = rf"\p{{Nd}}{_EXTEND}"
_EITHER = r".'\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
_BETWEEN_LETTERS = rf"[{_EITHER}:\x{{B7}}\x{{387}}\x{{55F}}\x{{5F4}}\x{{2027}}\x{{FE13}}\x{{FE55}}\x{{FF1A}}]{_EXTEND}"
_BETWEEN_DIGITS = rf"[{_EITHER},;\x{{37E}}\x{{589}}\x{{60C}}\x{{66C}}\x{{FE10}}\x{{FE14}}\x{{FE50}}\x{{FE54}}\x{{FF0C}}\x{{FF1B}}]{_EXTEND}"
_CONNECT = rf"[\p{{Pc}}\x{{202F}}]{_EXTEND}"


def _word_pattern() -> str:
    """Words by the Unicode rules: letters and digits with the marks allowed between
    them, runs of katakana, and single ideographs and hiragana. Scripts of South East
    Asia that need a dictionary stay in one piece."""
    letters = rf"(?:{_LETTER})+(?:{_BETWEEN_LETTERS}(?:{_LETTER})+)*"
    digits = rf"(?:{_DIGIT})+(?:{_BETWEEN_DIGITS}(?:{_DIGIT})+)*"
    part = rf"(?:(?:{letters}|{digits})+|(?:[{_KANA}]{_EXTEND})+)"
    joined = rf"(?:{_CONNECT})*{part}(?:(?:{_CONNECT})+{part})*(?:{_CONNECT})*"
    single = rf"[\p{{IsHan}}\p{{IsHiragana}}]{_EXTEND}"
    unspaced = rf"(?:[{_UNSPACED}&&[\p{{L}}\p{{M}}]]{_EXTEND})+"
    return f"{joined}|{single}|{unspaced}"


WORD_PATTERN = _word_pattern()
LONGEST_WORD = 255
ANALYZERS = ("spaced", "unicode")


def tokenize(text: Column, analyzer: str = "spaced") -> Column:
    """Lower-cased words in reading order, repeats kept; NULL gives no words.

    ``spaced`` takes runs of letters and digits, which suits scripts that put spaces
    between words. ``unicode`` follows the Unicode word boundary rules in all scripts
    and cuts words after 255 characters.
    """
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if analyzer == "spaced":
        return F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERN), F.lit(0))
    found = F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0))

    def pieces(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(word), F.lit(LONGEST_WORD))
        return F.transform(starts, lambda at: F.substring(word, at, F.lit(LONGEST_WORD)))

    short = lambda w: F.length(w) <= LONGEST_WORD
    return let(found, lambda words: F.when(F.forall(words, short), words).otherwise(
        F.flatten(F.transform(words, pieces))))


def tokenize_list(values: Column, analyzer: str = "spaced") -> Column:
    """Words of every element of a string array, one after the other."""
    present = F.coalesce(values, F.array().cast("array<string>"))
    return F.flatten(F.transform(present, lambda text: tokenize(text, analyzer)))


def build_text(title: Column, synopsis: Column) -> Column:
    """The text that gets embedded and reranked."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(synopsis, F.lit("")))


def first_non_empty(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty, else ``''``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def clean_list(values: Column) -> Column:
    """Array without NULL and empty elements; NULL becomes an empty array."""
    present = F.coalesce(values, F.array().cast("array<string>"))
    return F.filter(present, lambda x: x.isNotNull() & (x != ""))


def split_words(text: Column) -> Column:
    """Whitespace-separated pieces without empty ones."""
    pieces = F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN)
    return F.filter(pieces, lambda w: w != "")


def term_frequencies(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, computed inside the row.

    The tokens are sorted, the start of every run of equal tokens is located and
    the distance to the next start is the frequency. Nothing is exploded and
    nothing is shuffled.
    """

    def runs(words: Column) -> Column:
        size = F.size(words)
        positions = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.filter(
            positions,
            lambda p: (p == 1) | (F.get(words, p - 1) != F.get(words, p - 2)),
        )
        return let(starts, lambda s: F.transform(
            s,
            lambda p, i: F.struct(
                F.get(words, p - 1).alias("term"),
                (F.coalesce(F.get(s, i + 1), size + 1) - p).cast("int").alias("tf"),
            ),
        ))

    return let(F.sort_array(tokens), runs)


def _trimmed_parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda part: F.trim(part))


def synopsis_authors(synopsis: Column) -> Column:
    """Authors named in a synopsis, or an empty array."""
    found = F.nullif(F.regexp_extract(synopsis, AUTHORS_PATTERN, 1), F.lit(""))
    return F.coalesce(_trimmed_parts(found), F.array().cast("array<string>"))


def synopsis_year(synopsis: Column) -> Column:
    """Four-digit year of publication, or NULL."""
    return F.nullif(F.regexp_extract(synopsis, YEAR_PATTERN, 1), F.lit(""))


def synopsis_subjects(synopsis: Column) -> Column:
    """Non-empty subjects named at the end of a synopsis, or an empty array."""
    found = F.nullif(F.regexp_extract(synopsis, SUBJECTS_PATTERN, 1), F.lit(""))
    return clean_list(_trimmed_parts(found))

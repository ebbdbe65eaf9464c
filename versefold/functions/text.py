"""Text functions on Columns: normalising, tokenising, putting tokens together again."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versefold.config import CAPTCHA, CHALLENGE, ORDINARY_MARKS

#: White space as Unicode has it and the separators U+001C..1F; RE2 and Java read it alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Punctuation that is a token of its own in source text.
ASCII_MARKS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]"
CJK_MARKS = "[。！？；：，、（）「」『』“”‘’…]"
#: Punctuation that lexical scores leave out.
ALL_MARKS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~。！？；：，、（）【】「」『』〈〉《》“”‘’…—·]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def nfc(text: Column) -> Column:
    """NFC. Text below U+0300 is in that form already; only other texts go through Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), text)), text)


def strip(text: Column) -> Column:
    """Without white space at either end; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_text(text: Column) -> Column:
    """NFC, runs of white space to one space, ends stripped."""
    return squeezed(nfc(F.coalesce(text, F.lit(""))))


def tokenize_source(text: Column, normalized: bool = False) -> Column:
    """Words and single punctuation marks."""
    text = text if normalized else normalize_text(text)
    for marks in (ASCII_MARKS, CJK_MARKS):
        text = F.regexp_replace(text, f"({marks})", " $1 ")
    return F.filter(F.split(text, " +"), lambda t: t != "")


def tokenize_target(text: Column, normalized: bool = False) -> Column:
    """One token a code point, white space left out."""
    text = text if normalized else normalize_text(text)
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda t: t != "")


def normalize_target(text: Column, ignore_punctuation: bool = False) -> Column:
    """NFC without white space, and without punctuation if asked for."""
    out = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), SPACE, "")
    return F.regexp_replace(out, ALL_MARKS, "") if ignore_punctuation else out


def detokenize_source(tokens: Column) -> Column:
    """Tokens joined by spaces, closed up before closing marks and after opening ones."""
    text = F.array_join(tokens, " ")
    text = F.regexp_replace(text, f"{SPACE}+([,.!?;:])", "$1")
    text = F.regexp_replace(text, f"{SPACE}+([。！？；：，、）】」』])", "$1")
    return F.regexp_replace(text, f"([（【「『]){SPACE}+", "$1")


def detokenize_target(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def text_lines(text: Column) -> Column:
    """Non-blank lines, each in NFC with single spaces; all line ends of Unicode count."""
    lines = F.split(nfc(F.coalesce(text, F.lit(""))), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.filter(F.transform(lines, squeezed), lambda line: line != "")


def ascii_stem(title: Column) -> Column:
    """Letters and digits of a title in ASCII lower case; empty if there are none."""
    plain = F.translate(F.coalesce(title, F.lit("")), "Đđ", "Dd")
    folded = F.coalesce(_ascii_fold(F.when(plain.rlike(r"[^\x{0}-\x{7f}]"), plain)), plain)
    return F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "")


def stem_with_uid(stem: Column, uid: Column, limit: int = 180, uid_limit: int = 48) -> Column:
    """stem-uid within the limit; a uid without safe characters is replaced by its hash."""
    safe = F.substring(F.regexp_replace(F.coalesce(uid, F.lit("")), "[^A-Za-z0-9_-]+", ""), 1, uid_limit)
    safe = F.when(safe == "", F.substring(F.sha2(F.coalesce(uid, F.lit("")).cast("binary"), 256), 1, 16)).otherwise(safe)
    return F.concat(F.substr(stem, F.lit(1), F.greatest(F.lit(1), limit - F.length(safe) - 1)), F.lit("-"), safe)


def filename_stem(title: Column, uid: Column | None = None, limit: int = 180) -> Column:
    """A title's stem; null if it has none; a long one is cut and gets the uid or a hash."""
    stem = ascii_stem(title)
    tail = F.substring(F.sha2(title.cast("binary"), 256), 1, 16)
    tail = tail if uid is None else F.coalesce(F.nullif(uid, F.lit("")), tail)
    return F.when(F.length(stem) > limit, stem_with_uid(stem, tail, limit)).when(stem != "", stem)


def dotted_int(text: Column) -> Column:
    """1.234 to 1234."""
    return F.replace(text, F.lit("."), F.lit("")).try_cast("int")


def result_count(text: Column) -> Column:
    """The number of results that a result page's text states in either of two ways, else null."""
    stated = [r"tổng số\s+\d+\s+trang\s+\(([\d.]+)\s+bài thơ\)", r"Có quá nhiều\s+\(([\d.]+)\)\s+kết quả"]
    return F.coalesce(*(dotted_int(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in stated))


def is_access_challenge(html: Column) -> Column:
    """A page that asks to prove one is human: it says so, or it has a captcha and none of the
    marks of an ordinary page."""
    ordinary = F.lit(False)
    for mark in ORDINARY_MARKS:
        ordinary |= F.contains(html, F.lit(mark))
    return F.contains(html, F.lit(CHALLENGE)) | (F.contains(html, F.lit(CAPTCHA)) & ~ordinary)

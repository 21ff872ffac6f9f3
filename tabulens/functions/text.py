"""Bilingual text clean-up and features, as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import GARBLED_MARKERS, MISSING_TOKENS, PRICE_CHARS, RATING_WORDS

# fixed values: Unicode classes used by every rule below
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WORD = r"[\p{L}\p{N}_]"
ARABIC = r"[\u0600-\u06FF]"
ARABIC_WIDE = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF]"
DIACRITICS_A = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06E4\u06EA-\u06ED]"
DIACRITICS_B = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E4\u06E7\u06E8\u06EA-\u06ED]"
DIACRITICS_C = r"[\u064B-\u065F\u0610-\u061A\u06D6-\u06DC\u06DF-\u06E4\u06E7-\u06ED]"
TATWEEL = "\u0640"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_missing_token(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(MISSING_TOKENS), F.lit(False))


def null_missing(c: Column) -> Column:
    return F.when(~is_missing_token(c), c)


def normalize_arabic(c: Column, variant: str = "clean") -> Column:
    """Three rule sets: `clean` (tables), `model` (model text), `column` (column language)."""
    if variant == "clean":
        c = F.regexp_replace(c, DIACRITICS_A, "")
        c = F.translate(c, "أإآىة" + TATWEEL, "ااايه")
    elif variant == "model":
        c = F.regexp_replace(c, DIACRITICS_B, "")
        c = F.translate(c, "أإآ" + TATWEEL, "ااا")
    elif variant == "column":
        c = F.regexp_replace(c, DIACRITICS_C, "")
        c = F.translate(c, "أإآة" + TATWEEL, "اااه")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return squeeze(c)


def normalize_english(c: Column) -> Column:
    return squeeze(F.lower(c))


def has_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(ARABIC), F.lit(False))


def cell_language(c: Column) -> Column:
    """arabic / mixed / english by the share of Arabic characters; unknown when empty."""
    return language_of(F.regexp_count(c, F.lit(ARABIC)), F.length(F.regexp_replace(c, SPACE, "")))


def language_of(arabic: Column, total: Column) -> Column:
    """Language by the Arabic characters among all that are not white space."""
    ratio = arabic / F.nullif(total, F.lit(0))
    return (F.when(ratio > 0.6, "arabic").when(ratio > 0.2, "mixed")
            .when(ratio.isNotNull(), "english").otherwise("unknown"))


def cell_language_by_runs(c: Column) -> Column:
    """Variant that weighs runs of Arabic characters against Latin letters."""
    ar = F.regexp_count(c, F.lit(ARABIC_WIDE + "+"))
    ratio = ar / F.nullif(ar + F.regexp_count(c, F.lit("[a-zA-Z]")), F.lit(0))
    return (F.when(ratio >= 0.60, "arabic").when(ratio <= 0.15, "english")
            .when(ratio.isNotNull(), "mixed").otherwise("unknown"))


def word_count(c: Column) -> Column:
    # by the pieces between white space: a match object for every word takes several times as long
    return F.coalesce(F.array_size(F.array_remove(F.split(c, f"{SPACE}+"), "")), F.lit(0))


def spaces(c: Column) -> Column:
    """Number of spaces; in a text that `squeeze` has been through they are all its white space."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def tokens(c: Column) -> Column:
    """Lower-case words of two or more characters, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}{{2,}})"), 1)


def ngrams12(words: Column) -> Column:
    """Single words followed by adjacent word pairs."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)),
                       lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(words) > 1,
                  F.concat(words, F.slice(pairs, F.lit(1), F.size(words) - 1))).otherwise(words)


def clean_price(c: Column) -> Column:
    return strip(F.translate(c, PRICE_CHARS, ""))


def looks_like_price(c: Column) -> Column:
    s = strip(c)
    return s.rlike(r"^[£$€¥₹][\d,]+\.?\d*$") | s.rlike(r"^[\d,]+\.?\d*[£$€¥₹]$")


def star_rating(css_class: Column) -> Column:
    """Digit for a rating word inside a class attribute, NULL when there is none."""
    words = "|".join(RATING_WORDS)
    found = F.lower(F.regexp_extract(css_class, rf"(?i)\b({words})\b", 1))
    pairs = [x for i, w in enumerate(RATING_WORDS, 1) for x in (F.lit(w), F.lit(str(i)))]
    return F.element_at(F.create_map(*pairs), F.nullif(found, F.lit("")))


def host_name(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of `ref` seen from page `base`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    joined = F.when(ref_path.startswith("/"), ref_path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), ref_path))
    parts = F.aggregate(
        F.slice(F.split(joined, "/"), F.lit(2), F.size(F.split(joined, "/"))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    ends_open = joined.rlike(r"/\.{1,2}$")
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"), F.when(ends_open, "/").otherwise(""))
    return (F.when(ref == "", base)
            .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
            .when(ref.startswith("?"), F.concat(origin, path, ref))
            .otherwise(F.concat(origin, clean, tail)))


def first_sentence(c: Column) -> Column:
    return F.regexp_extract(squeeze(c), r"^(.*?[.!?])(?: |$)", 1)


def is_garbled(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{GARBLED_MARKERS}]"), F.lit(False))

"""Text functions as Column expressions.  Unicode classes are spelt out: Java's defaults are ASCII."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Native digits and their ASCII counterparts.
NATIVE_DIGITS = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯"
ASCII_DIGITS = "01234567890123456789"
#: Legal forms dropped from dealer names, as one pattern; and in sequence before matching.
DEALER_FORMS = r"pvt\.?\s*ltd\.?|ltd\.?|private\s+limited|limited|co\.?|company|enterprises?|traders?|agency|agencies|prop\.?"
MATCH_FORMS = [
    r"\bpvt\.?\s*ltd\.?\b",
    r"\bltd\.?\b",
    r"\bco\.?\b",
    r"\bprivate\s+limited\b",
    r"\blimited\b",
    r"\btraders?\b",
    r"\bagenc(?:y|ies)\b",
    r"\benterprises?\b",
]
#: Words that mark a row of totals, and tractor brands.
TOTAL_WORDS = ["total", "grand total", "योग", "कुल", "जमा", "amount", "net amount", "grand", "sum"]
BRANDS = [
    "mahindra", "swaraj", "eicher", "powertrac", "sonalika", "john deere", "new holland", "kubota", "escorts", "farmtrac",
    "force", "indo farm", "captain", "vst", "preet", "standard", "tafe", "massey", "massey ferguson",
]


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition.  ASCII is composed already: the function gets a null in its place, so such texts never
    leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_digits(text: Column) -> Column:
    return F.translate(text, NATIVE_DIGITS, ASCII_DIGITS)


def clean_text(text: Column, compose: bool = True) -> Column:
    """Compose, ASCII digits, one space between words.  ``compose=False`` skips the only step that leaves the
    JVM, for text known to be composed."""
    return collapse(normalise_digits(nfc(text) if compose else text))


def _upper(letter: Column) -> Column:
    """Upper case of one character; the general function costs far more than an ASCII letter needs."""
    ascii_ = F.translate(letter, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(letter.between("a", "z"), ascii_).when(letter > "~", F.upper(letter)).otherwise(letter)


def title(text: Column) -> Column:
    """Upper-case after anything that isn't a letter, lower-case after a letter (initcap looks at spaces only)."""
    tokens = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.concat(_upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))), "")


def normalise_model_name(text: Column, compose: bool = True) -> Column:
    return F.upper(collapse(F.regexp_replace(clean_text(text, compose), r"[^\p{L}\p{N}_\s\-.]", "")))


def normalise_dealer_name(text: Column, compose: bool = True) -> Column:
    """A name for matching.  Trailing punctuation goes after the last trim, so a space may be left over."""
    t = F.regexp_replace(clean_text(text, compose), r"\.(?=[A-Za-z])", ". ")
    t = collapse(F.regexp_replace(t, rf"(?iU)\b(?:{DEALER_FORMS})\b", ""))
    return title(F.regexp_replace(t, r"[.,/\\\-]+$", ""))


def match_key(text: Column) -> Column:
    """Lower-case, collapsed, without legal forms (dropped one after the other); null gives an empty key."""
    t = collapse(F.lower(F.coalesce(text, F.lit(""))))
    for form in MATCH_FORMS:
        t = strip(F.regexp_replace(t, f"(?iU){form}", ""))
    return collapse(t)


def remove_noise(text: Column) -> Column:
    """Drop runs of five or more of one character, then isolated symbols."""
    t = F.regexp_replace(text, r"(.)\1{4,}", "")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])[^A-Za-z0-9ऀ-ॿ઀-૿](?![\p{L}\p{N}_])", " ")
    return collapse(t)


def split_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[\n\r]+"), strip), lambda t: t != "")


def contains_any(text: Column, words: list[str]) -> Column:
    """Left-semi match of lower-cased text against a closed list of substrings."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return found


def is_total_row(text: Column) -> Column:
    return contains_any(text, TOTAL_WORDS)


def has_brand(text: Column) -> Column:
    return contains_any(text, BRANDS)


def contains_idfc(text: Column) -> Column:
    t = F.lower(text)
    return F.contains(t, F.lit("idfc")) | (F.contains(t, F.lit("first")) & F.contains(t, F.lit("bank")))


def non_ascii_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1))


def script_hint(text: Column, threshold: float = 0.3) -> Column:
    return F.when(non_ascii_share(text) > threshold, "hi").otherwise("en")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(strip(text)), r"(?U)\s+"), lambda t: t != ""))


def text_agree(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(strip(a)) == F.lower(strip(b)), F.lit(False))


def text_partial_agree(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Shared tokens over those of the longer side; false if a side has none."""
    x, y = tokens(a), tokens(b)
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (share >= threshold), F.lit(False))


def doc_id_from_path(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def is_dealer_candidate(text: Column) -> Column:
    """Three characters or more, and neither a tax number, a phone number, a date nor digits only."""
    t = strip(text)
    bad = t.rlike(r"(?U)\b\d{15}\b") | t.rlike(r"(?U)\d{10}") | t.rlike(r"(?U)\d{2}[/-]\d{2}[/-]\d{2,4}") | t.rlike(r"(?U)^\d+$")
    return (F.length(t) >= 3) & ~bad

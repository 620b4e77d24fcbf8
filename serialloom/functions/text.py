"""Scalar text functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and device names that file names must not hold.
ILLEGAL_IN_NAMES = r'[<>:"/\\|?*\x00-\x1F]'
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
# Wordings that mark a gate in place of a chapter.
GATE_PHRASES = (
    "requires a free account",
    "log in to continue",
    "log in to keep reading",
    "sign in to continue",
    "sign up to continue",
    "create a free account",
    "subscribe to continue reading",
)
# Fixed value: a text of more characters is no gate.
STUB_MAX_CHARS = 2000
# Inline tags that are dropped from plain text.
INLINE_TAGS = ("em", "strong", "i", "b", "u", "s", "sup", "sub", "br")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_all(s: Column) -> Column:
    """Without white space of any kind (Unicode's) at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def null_if_empty(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def normalize_title(s: Column) -> Column:
    """Letters and digits only, in lower case: two spellings of one title are equal."""
    return F.lower(F.regexp_replace(s, r"[^\p{IsAlphabetic}\p{N}]", ""))


def sanitize_filename(s: Column) -> Column:
    clean = trim_all(F.regexp_replace(F.regexp_replace(s, ILLEGAL_IN_NAMES, "_"), r"[. ]+$", ""))
    base = ascii_upper(F.split(clean, r"\.")[0])
    named = F.when(base.isin(*RESERVED_NAMES), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(named.rlike("^_*$"), F.lit("untitled")).otherwise(named)


def _rest_or_whole(s: Column, pattern: str) -> Column:
    """What ``pattern``'s group leaves of the trimmed text; the trimmed text if that is nothing."""
    whole = trim_all(s)
    rest = trim_all(F.regexp_extract(whole, pattern, 1))
    return F.when(rest != "", rest).otherwise(whole)


def clean_chapter_title(s: Column) -> Column:
    """Without a leading "Chapter N" and one separator, if anything follows. Possessive: digits are never given back."""
    return _rest_or_whole(s, r"(?s)^(?i:chapter) *+[0-9]++ *+[-:|–—]?+(.+)$")


def strip_number_colon(s: Column) -> Column:
    """Without a leading "N:"."""
    return trim_all(F.regexp_replace(s, r"^\s*+[0-9]++\s*+:", ""))


def strip_number_mark(s: Column) -> Column:
    """Without a leading "N." or "N:", if anything follows."""
    return _rest_or_whole(s, r"(?s)^[0-9]++\s*+[.:](.+)$")


def strip_chapter_mark(s: Column) -> Column:
    """Without an optional "Chapter ", then without "N" and one of . : - ; "Chapter " alone goes too."""
    bare = trim_all(F.regexp_replace(trim_all(s), r"^(?i:chapter )\s*", ""))
    rest = trim_all(F.regexp_extract(bare, r"(?s)^[0-9]++\s*+[.:-](.*)$", 1))
    return F.when(rest != "", rest).otherwise(bare)


def strip_site_suffix(s: Column, site: str = "free web novel") -> Column:
    """Without the last |-segment, if that is the site's name."""
    return F.regexp_replace(s, r"\s*\|\s*(?i:" + site + r")\s*$", "")


def page_chapter_title(title: Column) -> Column:
    """A chapter's title out of a page's <title>: what follows the first " - Chapter ", cleaned."""
    bare = strip_site_suffix(trim_all(title))
    at = F.instr(bare, " - Chapter ")
    return null_if_empty(clean_chapter_title(F.when(at > 0, F.substring(bare, at + 3, F.lit(1 << 30))).otherwise(bare)))


def display_title(title: Column, number: Column) -> Column:
    clean = strip_number_colon(clean_chapter_title(F.coalesce(title, F.lit(""))))
    return F.coalesce(null_if_empty(clean), F.concat(F.lit("Chapter "), number.cast("string")))


def head_before_bar(s: Column) -> Column:
    """A page title up to its last |."""
    return trim_all(F.regexp_replace(s, r"\|[^|]*$", ""))


def count_in_tail(s: Column) -> Column:
    """The number that begins the last " - " segment."""
    return F.split(trim_all(F.element_at(F.split(s, " - "), -1)), r"\s+")[0].try_cast("bigint")


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "").try_cast("bigint")


def after_colon(s: Column) -> Column:
    """What follows the first colon, or all of it."""
    return trim_all(F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, r"(?s)^[^:]*:", "")).otherwise(s))


def real_cover(url: Column, placeholder: str = "noimagefound") -> Column:
    return F.when(~F.contains(url, F.lit(placeholder)), url)


def xml_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_gate_stub(body: Column, phrases: tuple[str, ...] = GATE_PHRASES, most: int = STUB_MAX_CHARS) -> Column:
    """Whether a short text (paragraphs joined) asks for an account in place of prose."""
    low = F.lower(body)
    return (F.char_length(body) <= most) & F.coalesce(F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p)), F.lit(False))


def strip_inline_markup(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)<\s*/?\s*(?:" + "|".join(INLINE_TAGS) + r")\s*/?\s*>", "")


def body_paragraphs(s: Column) -> Column:
    """Paragraphs of a plain text: its lines, trimmed, without blank ones and inline tags."""
    return F.filter(F.transform(F.split(s, "\n"), lambda p: trim_all(strip_inline_markup(p))), lambda p: p != "")


def join_paragraphs(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def split_body(body: Column) -> Column:
    return F.split(body, "\n\n")


def overlap_key(s: Column) -> Column:
    """What two copies of a paragraph are compared by."""
    return F.substring(normalize_title(s), 1, 160)


def preview(paragraphs: Column) -> Column:
    return F.substring(F.coalesce(F.get(paragraphs, F.lit(0)), F.lit("")), 1, 90)


def listed_numbers(numbers: Column, most: int = 15) -> Column:
    """"1, 2, 3" in order, and how many more there are beyond ``most``."""
    n = F.size(numbers)
    text = F.array_join(F.transform(F.slice(F.array_sort(numbers), 1, most), lambda x: x.cast("string")), ", ")
    return F.when(n > most, F.concat(text, F.lit(", … (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(text)


def cover_filename(mime: Column) -> Column:
    """The cover's name by its content type; null unless that is an image."""
    kind = F.lower(trim_all(F.split(mime, ";")[0]))
    ext = F.when(kind == "image/png", "png").when(kind == "image/gif", "gif").when(kind == "image/webp", "webp").otherwise("jpg")
    return F.when(F.startswith(kind, F.lit("image/")), F.concat(F.lit("cover."), ext))

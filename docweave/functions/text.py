"""Scalar text expressions.

White space means what Python's ``str`` means by it, so that results agree
with a row-at-a-time reading of the same rules; Java's ``\\s`` is narrower.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
_DASH, _COUNT = "[‐‑–—-]", "[0-9]{1,9}"
FORM = rf"[\[(][^\])]*별지[{SPACE}]*(?:제[{SPACE}]*)?{_COUNT}(?:{_DASH}{_COUNT})?[{SPACE}]*호(?:[{SPACE}]*서식)?[^\])]*[\])]"
BACK_PAGE = r"^\(?[{s}]*(?:[앞뒤][{s}]*쪽|앞면|뒷면|을지)[{s}]*\)?$".replace("{s}", SPACE)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
STOP_KEYWORDS = tuple("table rows columns context row col chunk".split())


#: Every white space character, and those of them that break lines.
SPACES = "".join(x for x in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", x))
BREAKS = "".join(x for x in SPACES if re.match(LINE_BREAK, x))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def normalize_space(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends.  A lone blank, as most are, is no match and so is not replaced; plain letters fail at the first test."""
    return F.trim(F.regexp_replace(c, f"(?![!-~])(?: [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*)", " "))


def lines(c: Column) -> Column:
    """As splitlines: a final line break adds no line, an empty text has none."""
    parts = F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})$", ""), LINE_BREAK)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(parts)


def clipped(c: Column, limit: int) -> Column:
    """Stripped; if longer than limit, cut with an ellipsis as its last character."""
    text = strip(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 1)), F.lit("…")))


def clipped_clean(c: Column, limit: int) -> Column:
    """Not stripped first; white space before the ellipsis goes."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(rstrip(F.left(c, F.lit(max(0, limit - 1)))), F.lit("…")))


def estimated_tokens(c: Column) -> Column:
    """A quarter of each ASCII word's length, rounded up, and one for any other visible character.

    Words are matched in pieces of at most four characters, so the number of
    matches is the sum.
    """
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(rf"[A-Za-z0-9_]{{1,4}}|[^{SPACE}A-Za-z0-9_]")).cast("long")


def keywords(c: Column, limit: int = 8) -> Column:
    """The first distinct alphanumeric or Hangul words of two characters or more."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9A-Za-z가-힣]{2,}"), 0)), 1, limit)


def keywords_without_stops(c: Column, limit: int = 8) -> Column:
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9A-Za-z가-힣]{2,}"), 0))
    return F.slice(F.filter(found, lambda x: ~F.lower(x).isin(*STOP_KEYWORDS)), 1, limit)


def _top(c: Column) -> Column:
    """The first line that isn't blank, without white space before it; nothing after it is looked at."""
    return F.regexp_extract(c, f"^[{SPACE}]*+([^{BREAKS}]*+)", 1)


def first_line(c: Column, limit: int) -> Column:
    """The first line that isn't blank, stripped and cut; empty if there is none."""
    return F.coalesce(F.left(strip(_top(c)), F.lit(limit)), F.lit(""))


def flat_summary(c: Column, limit: int = 500) -> Column:
    return F.replace(F.left(strip(c), F.lit(limit)), F.lit("\n"), F.lit(" "))


def first_sentence(c: Column, limit: int = 300) -> Column:
    text = normalize_space(c)
    return clipped_clean(F.split(text, rf"(?<=[.!?。！？])[{SPACE}]+")[0], limit)


def topic(c: Column) -> Column:
    """The first line that isn't blank, normalised, at most 80 characters."""
    once = F.transform(F.array(normalize_space(_top(c))), lambda x: clipped_clean(x, 80))
    return F.coalesce(F.get(once, F.lit(0)), F.lit(""))


def question_about(c: Column) -> Column:
    base = strip(c)
    return F.concat(F.when(base == "", F.lit("이 청크")).otherwise(base), F.lit("에 대해 무엇을 알 수 있나요?"))


def clean_question(c: Column) -> Column:
    text = normalize_space(c)
    return F.when((text == "") | text.rlike("[?？]$"), text).otherwise(F.concat(F.regexp_replace(text, "[.。]+$", ""), F.lit("?")))


def is_question_label(c: Column) -> Column:
    low = F.lower(c)
    return F.contains(c, F.lit("질의")) | F.contains(c, F.lit("질문")) | low.isin(*"q qa q&a question".split()) | F.startswith(low, F.lit("q "))


def looks_like_heading(c: Column) -> Column:
    """Short, one line: a number or Hangul letter with a full stop, or a form marker with little after it."""
    text = normalize_space(c)
    s = f"[{SPACE}]"
    marked = text.rlike(rf"^[0-9]{{1,2}}\.{s}+[^{SPACE}]") | text.rlike(rf"^[가-힣]\.{s}+[^{SPACE}]") | text.rlike(rf"^{FORM}{s}*$") | text.rlike(rf"^{FORM}{s}*[^.?!]{{1,60}}$")
    return (text != "") & (F.length(text) <= 120) & ~F.contains(strip(c), F.lit("\n")) & marked


def is_deleted_form(c: Column) -> Column:
    return normalize_space(c).rlike(rf"^{FORM}[{SPACE}]*<[^>]*삭[{SPACE}]*제[^>]*>$")


def is_form_heading(c: Column) -> Column:
    text = normalize_space(c)
    return text.rlike(f"^{FORM}") & (F.length(text) <= 120)


def is_back_page(c: Column) -> Column:
    return F.left(normalize_space(c), F.lit(20)).rlike(BACK_PAGE)


def starts_form(c: Column) -> Column:
    text = normalize_space(c)
    return (text != "") & ~is_back_page(c) & F.left(text, F.lit(300)).rlike(FORM)


def starts_case(c: Column) -> Column:
    return normalize_space(c).rlike(rf"^[○●]?[{SPACE}]*사례[{SPACE}]*[0-9]+(?:[^0-9]|$)")


def ends_form(c: Column) -> Column:
    text, s = normalize_space(c), f"[{SPACE}]*"
    paper = text.rlike("신문용지|일반용지|재활용품|g/m|g/㎡")
    side = f"[0-9]{{2,3}}{s}m{{1,3}}"
    return text.rlike(f"{side}{s}[xX×]{s}{side}") & paper


def heading_stripped(c: Column) -> Column:
    return strip(F.regexp_replace(c, "^#+", ""))


def with_section(path: Column, c: Column) -> Column:
    return F.when(F.size(path) == 0, c).otherwise(F.concat(F.lit("section: "), F.array_join(path, " > "), F.lit("\n"), c))


def suffix(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.startswith(low, F.lit(".")), low).otherwise(F.concat(F.lit("."), low))


def public_url(uri: Column, endpoint: str) -> Column:
    """Path-style address of an s3://bucket/key uri below an endpoint; each part of the path quoted."""
    base = endpoint.rstrip("/")
    path = F.regexp_replace(uri, "^s3://", "")
    quoted = F.transform(F.split(path, "/"), lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    return F.concat(F.lit(base + "/"), F.replace(F.array_join(quoted, "/"), F.lit("%7E"), F.lit("~")))


def chat_url(c: Column) -> Column:
    """The chat endpoint of a service address."""
    base = F.regexp_replace(strip(c), "/+$", "")
    return F.when(F.endswith(base, F.lit("/chat/completions")), base).when(F.endswith(base, F.lit("/v1")), F.concat(base, F.lit("/chat/completions"))).otherwise(F.concat(base, F.lit("/v1/chat/completions")))


def mime_of(c: Column) -> Column:
    """By the first bytes of binary content."""
    starts = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp")]
    out = None
    for hexed, mime in starts:
        hit = F.startswith(c, F.unhex(F.lit(hexed)))
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    return out.otherwise("application/octet-stream")


def is_compound_file(c: Column) -> Column:
    return F.startswith(c, F.unhex(F.lit("D0CF11E0A1B11AE1")))


def safe_id(c: Column) -> Column:
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), F.lit(120))


def file_family(key: Column, extension: str = ".hwpx") -> Column:
    """A file's name without what varies between editions: brackets, numbers, dates, marks."""
    name = F.element_at(F.split(key, "/"), -1)
    name = F.regexp_replace(name, f"{extension.replace('.', '[.]')}$", "")
    name = F.translate(name, "+_", "  ")
    s = f"[{SPACE}]*"
    for pattern in (r"\([^)]*\)", r"\[[^\]]*\]", rf"제{s}[0-9]{{4}}{s}-{s}[0-9]+{s}호", r"[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}", r"[0-9]+", r"[-¸,.;:]+"):
        name = F.regexp_replace(name, pattern, " ")
    name = F.lower(normalize_space(name))
    return F.when(name == "", key).otherwise(name)


def loose_json(c: Column) -> Column:
    """A text's JSON, or else what lies between its first opening and last closing brace or bracket; null if neither parses."""
    inner = F.regexp_extract(c, r"(?s)([{\[].*[}\]])", 1)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.when(inner != "", inner)))

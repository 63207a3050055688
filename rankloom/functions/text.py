"""Page text: markdown cleaning, de-tagging, structure flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .urls import WS, trim_ws

CONTENT_CHARS = 1600
ELLIPSIS = "…"

# Named entities that are decoded; any other name stays as it is.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
    "mdash": "—", "ndash": "–", "hellip": "…", "rsaquo": "›",
}
# What an entity, a line of nothing but a link, hidden parts, block ends and tags look like.
_ENTITY = r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);"

# Hexadecimal digits of a code point, without what pads it.
_HEX_CODE = r"^#x0*(10[0-9a-fA-F]{4}|[0-9a-fA-F]{1,5})$"
_LINK_LINE = rf"(?m)^{WS}*[-*]?{WS}*\[[^\]]*\]\([^)]*\){WS}*$"
_HIDDEN_NAMES = ["script", "style", "noscript", "svg", "head"]
_HIDDEN = rf"(?is)<({'|'.join(_HIDDEN_NAMES)})\b[^>]*>.*?</\1>"
_COMMENT = r"(?s)<!--.*?-->"
_BLOCK_END = r"(?i)</(p|div|li|h[1-6]|tr|section|article|br)\s*>"
_TAG = r"<[^>]+>"
# Stands behind the < of what opens but never closes; a code point that is no character.
_SEAL = "\ufdd0"
_FEW_OPENINGS = 32

# Presence tests on the text a provider returned.
HEADING = r"(?m)^#{1,6}\s"
LINK = r"\[[^\]]+\]\([^)]+\)"
BOLD = r"\*\*[^*]+\*\*"
LIST_ITEM = r"(?m)^[-*] "
IMAGE = r"!\["
TABLE_RULE = r"(?m)^\|[\s:|-]+\|\s*$"


def clip(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def clean_markdown(md: Column, limit: int = CONTENT_CHARS) -> Column:
    """Drop carriage returns, lines that are only a link, and blank runs; then clip."""
    text = F.regexp_replace(md, "\r", "")
    text = F.when(F.contains(md, F.lit("]")), F.regexp_replace(text, _LINK_LINE, "")).otherwise(text)  # a link has one
    text = trim_ws(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    return F.when(F.length(text) > limit, F.concat(clip(text, limit), F.lit(ELLIPSIS))).otherwise(text)


def _decode_one(token: Column) -> Column:
    name = F.substring(token, 2, 1 << 30)
    name = F.substring(name, F.lit(1), F.length(name) - 1)
    known = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])
    named = F.try_element_at(known, name)
    hexed = F.conv(F.when(name.startswith("#x"), F.nullif(F.regexp_extract(name, _HEX_CODE, 1), F.lit(""))), 16, 10)
    code = F.when(name.startswith("#"), F.coalesce(hexed, F.substring(name, 2, 1 << 30)).try_cast("bigint"))
    usable = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(usable, code)), 8, "0")), "UTF-32")
    return F.coalesce(named, char, token)


def decode_entities(text: Column) -> Column:
    """One pass over the entities, so an escaped entity is decoded only once."""
    parts = F.split(text, _ENTITY)
    tokens = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    decoded = F.zip_with(
        parts, tokens, lambda p, t: F.concat(p, F.coalesce(_decode_one(t), F.lit("")))
    )
    return F.when(F.size(tokens) == 0, text).otherwise(F.array_join(decoded, ""))


def _sealed(text: Column, opening: str, upto: str, many: Column) -> Column:
    """``text`` with its openings sealed behind group 1 of ``upto``, where nothing closes them."""
    def split(head: Column) -> Column:
        rest = F.substring(text, F.length(head) + 1, F.length(text))
        sealed = F.concat(head, F.regexp_replace(rest, rf"(?i)<(?={opening})", f"<{_SEAL}"))
        return F.when(many, sealed).otherwise(text)

    return let(F.when(many, F.regexp_extract(text, upto, 1)), split)


def _replace_closed(text: Column) -> Column:
    """Spaces for hidden parts, then for comments.

    A pattern tried at an opening that nothing closes reads to the end of the
    page. Pages with more than a few openings seal those first, so the time
    stays linear in the text; the result is the same either way.
    """
    def hidden(many: Column) -> Column:
        out = text
        for name in _HIDDEN_NAMES:
            out = let(_sealed(out, rf"{name}\b", rf"(?is)^(.*>)[^>]*</{name}>", many), lambda t: t)
        return unsealed(F.regexp_replace(out, _HIDDEN, " "), many)

    def comments(t: Column) -> Column:
        return let(often(t, "<!--"), lambda many: unsealed(
            F.regexp_replace(_sealed(t, "!--", r"(?s)^(.*)-->", many), _COMMENT, " "), many))

    def often(t: Column, openings: str) -> Column:
        return F.regexp_count(t, F.lit(openings)) > _FEW_OPENINGS

    def unsealed(t: Column, many: Column) -> Column:
        return let(t, lambda u: F.when(many, F.replace(u, F.lit(f"<{_SEAL}"), F.lit("<"))).otherwise(u))

    return let(let(often(text, rf"(?i)<(?:{'|'.join(_HIDDEN_NAMES)})"), hidden), comments)


def _without_tags(text: Column) -> Column:
    """A < with no > behind it is text, and no pattern is tried there."""
    def split(tail: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        parted = F.concat(F.regexp_replace(head, _TAG, " "), tail)
        return F.when(tail.contains("<"), parted).otherwise(F.regexp_replace(text, _TAG, " "))

    return let(F.substring_index(text, ">", -1), split)


def strip_tags(html: Column) -> Column:
    """HTML to text: no script, style or comments; block ends become line breaks.

    A tag or comment that is never closed stays as text. Null stays null.
    """
    text = F.regexp_replace(_replace_closed(html), _BLOCK_END, "\n")
    text = let(let(text, _without_tags), decode_entities)
    text = F.regexp_replace(text, r"[ \t\u00a0]+", " ")
    text = F.regexp_replace(text, r"\n[ \t]+", "\n")
    return trim_ws(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def challenge_kind(html: Column) -> Column:
    """Why a page of results holds none: a captcha, changed markup, or neither."""
    return (
        F.when(html.rlike(rf"(?i)<title>{WS}*Captcha"), "captcha")
        .when(~html.contains("results-standard"), "markup")
    )


def has_headings(t: Column) -> Column:
    return t.rlike(HEADING)


def has_links(t: Column) -> Column:
    return t.rlike(LINK)


def has_images(t: Column) -> Column:
    return t.rlike(IMAGE)


def has_tables(t: Column) -> Column:
    return t.rlike(TABLE_RULE)


def has_markdown(t: Column) -> Column:
    return has_headings(t) | has_links(t) | t.rlike(BOLD) | t.rlike(LIST_ITEM)


def was_truncated(t: Column) -> Column:
    return t.endswith(ELLIPSIS)


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))

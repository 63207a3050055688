"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import inline, let

WS = r"[\s\u00a0]"
# Every character that counts as white space at the edges of a text.
EDGE_WS = " \t\n\u000b\f\r\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))
# scheme, user info, host, port, path, query, fragment
_PARTS = r"(?is)^(https?|wss?|ftp)://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:@\s<>^|%]+)(:\d*)?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
# URLs that are in normal form as they stand: lower-case scheme and host, a path without a last slash, nothing else.
_NORMAL = r"^(?:https?|wss?|ftp)://[a-z0-9.-]+/[A-Za-z0-9._~%+,;=&!*'()@:/-]*[A-Za-z0-9._~%+,;=&!*'()@:-]\z"
# Parameters that never identify a different page.
_TRACKING = r"(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|igshid)(=.*)?$"
_MARK = "\u0001"
# Default port of each scheme.
_DEFAULT_PORTS = {"http": ":80", "https": ":443", "ws": ":80", "wss": ":443", "ftp": ":21"}


def trim_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(EDGE_WS))


def _split_url(s: Column) -> Column:
    """[scheme, user, host, port, path, query, fragment] in one match; one element when it does not parse."""
    marks = _MARK.join(f"${i}" for i in range(1, 8))
    return F.split(F.regexp_replace(s, _PARTS, marks), _MARK)


def _without_tracking(query: Column) -> Column:
    def clean(params: Column) -> Column:
        def joined(kept: Column) -> Column:
            rest = F.array_join(F.filter(kept, lambda p: p != ""), "&")
            return F.when(F.size(kept) == F.size(params), query).when(rest == "", "").otherwise(F.concat(F.lit("?"), rest))

        return let(F.filter(params, lambda p: ~p.rlike(_TRACKING)), joined)

    return F.when(query == "", "").otherwise(let(F.split(F.substring(query, 2, 1 << 30), "&"), clean))


def normalize_url(raw: Column) -> Column:
    """One key per page: no fragment, no tracking parameters, lower-case host,
    no default port, one trailing slash less. Anything that does not parse
    comes back trimmed. Other percent-encoding is left as it is. URLs that one
    plain pattern shows to be in this form skip the parts (null for them).
    """
    ports = F.create_map(*[F.lit(x) for kv in _DEFAULT_PORTS.items() for x in kv])

    def rebuilt(p: Column) -> Column:
        scheme, port = F.lower(F.get(p, 0)), F.get(p, 3)
        shown = F.when((port == ":") | (port == F.try_element_at(ports, scheme)), "").otherwise(port)
        whole = F.concat(
            scheme, F.lit("://"), F.get(p, 1), F.lower(F.get(p, 2)), shown,
            F.when(F.get(p, 4) == "", "/").otherwise(F.get(p, 4)), _without_tracking(F.get(p, 5)),
        )
        return F.regexp_replace(whole, "/$", "")

    def split(s: Column) -> Column:
        return _split_url(F.when(~s.rlike(_NORMAL), s))

    return let(trim_ws(raw), lambda s: let(split(s), lambda p: F.when(p.isNotNull() & (F.size(p) == 7), rebuilt(p)).otherwise(s)))


def host(url: Column) -> Column:
    """Host without a leading www., empty when the URL does not parse."""
    return F.regexp_replace(F.lower(F.regexp_extract(trim_ws(url), _PARTS, 3)), r"^www\.", "")


def returned_urls(sources: Column) -> Column:
    """Normalised distinct URLs of one returned set, order kept."""
    with inline():
        urls = F.transform(sources, lambda s: normalize_url(s["url"]))
    return F.array_distinct(F.filter(urls, lambda u: u != ""))


def body_text(source: Column) -> Column:
    """Content, else snippet, else empty; an empty content is still content."""
    return F.coalesce(source["content"], source["snippet"], F.lit(""))


def safe_href(url: Column) -> Column:
    s = trim_ws(url)
    return F.when(s.rlike(r"(?i)^https?://"), s)

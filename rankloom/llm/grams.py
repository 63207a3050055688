"""Hashed byte trigrams and visible text of pages. Runs inside tasks; sent there by value."""

from __future__ import annotations

import html
import re

import numpy as np

BUCKETS = 1 << 15
_TAG = re.compile(r"<[^>]*>")
_OPENS = {"script": r"<script\b", "style": r"<style\b", "": "<!--"}
_CLOSES = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "": re.compile("-->")}
_ROOT = re.compile(r"<html\b[^>]*", re.I)
_DECLARED = re.compile(r"\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
_HOST = re.compile(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def buckets(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the lower-cased text, spaces and digits as one space each."""
    data = np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letter, data, 32)[np.concatenate([[True], letter[1:] | letter[:-1]])].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    h = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(17)).astype(np.int64)


def untagged(page: str) -> str:
    """The page with a space for each script, style sheet, comment and tag, in one pass from left to right.

    What has no end ahead is no such part but read as a plain tag. The next end
    of each kind is looked for once and kept until it is passed, so openings
    without an end cost nothing each.
    """
    # Every part ends with this sign; what follows the last one is text.
    end = page.rfind(">") + 1
    out, at, after = [], 0, 0
    ends = {kind: found.span() for kind, close in _CLOSES.items() if (found := close.search(page))}
    opens = None
    while ends:
        if opens is None:
            opens = re.compile("|".join(_OPENS[kind] for kind in ends), re.I)
        found = opens.search(page, after, end)
        if found is None:
            break
        kind = found.group()[1:].lower() if found.group() != "<!--" else ""
        after = found.end()
        # A tag that began before and has not ended holds this opening.
        tag = page.rfind("<", at, found.start())
        if tag >= 0:
            close = page.find(">", tag, end)
            if close >= after or close < 0:
                after = end if close < 0 else close + 1
                continue
        if ends[kind][0] < after:
            close = _CLOSES[kind].search(page, after, end)
            if close:
                ends[kind] = close.span()
            else:
                del ends[kind]
                opens = None
        if kind in ends:
            out += [_TAG.sub(" ", page[at:found.start()]), " "]
            at = after = ends[kind][1]
        else:
            after = page.find(">", found.start(), end) + 1
    out += [_TAG.sub(" ", page[at:end]), page[end:]]
    return "".join(out)


def visible(page: str | None) -> str:
    return html.unescape(untagged(page or ""))


def declared(page: str | None) -> str | None:
    """Language of the first html tag of the page that declares one, wherever it stands."""
    for tag in _ROOT.finditer(page or ""):
        found = _DECLARED.search(tag.group())
        if found:
            return found.group(1).lower()
    return None


def host(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found.group(1).lower().strip(".") or None if found else None

"""From raw judge output to a typed verdict, or null with the reason."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .stats import half_up
from .urls import trim_ws

UNPARSEABLE = "judge returned unparseable output"
BASELINE_VERDICTS = ["knew", "partial", "wrong", "unknown"]


def unfence_json(text: Column) -> Column:
    """The JSON object inside a code fence or surrounding prose."""
    fence = r"(?s)^```(?:json)?\s*\n?(.*?)\n?\s*```$"

    def braces(body: Column) -> Column:
        inner = F.when(~body.startswith("{"), F.regexp_extract(body, r"(?s)\{.*\}", 0))
        return let(inner, lambda x: F.when(body.startswith("{") | (x == ""), body).otherwise(x))

    def opened(s: Column) -> Column:
        fenced = F.when(s.startswith("```") & s.rlike(fence), trim_ws(F.regexp_extract(s, fence, 1))).otherwise(s)
        return F.when(s.startswith("{"), s).otherwise(let(fenced, braces))

    return let(trim_ws(text), opened)


def is_json(raw: Column) -> Column:
    """One whole JSON value: the parser alone would let text after it pass."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1, F.lit(False))


_FIELDS = "ARRAY<STRUCT<rung: STRING, score: STRING, verdict: STRING, rationale: STRING>>"


def _parsed(raw: Column, body) -> Column:
    """``body`` of (is it JSON, field reader), an object being read in one pass.

    It is read as the only element of an array, so text after the object makes
    it unreadable. Every field is read as text; JSON numbers and numeric
    strings become numbers later, anything else does not.
    """
    wrapped = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), _FIELDS)
    objects = F.when(raw.startswith("{"), wrapped)

    def read(found: Column) -> Column:
        one = F.size(found) == 1
        other = ~raw.startswith("{") & (raw != "null") & is_json(raw)
        usable = F.coalesce(one, F.lit(False)) | F.coalesce(other, F.lit(False))
        return let(usable, lambda ok: body(ok, lambda name: F.try_element_at(found, F.lit(1))[name]))

    return let(objects, read)


def _number(text: Column) -> Column:
    def rounded(n: Column) -> Column:
        return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), half_up(n))

    return let(text.try_cast("double"), rounded)


def _verdict(value: Column, rationale: Column) -> Column:
    return F.struct(value.alias("value"), rationale.alias("rationale"))


def parse_scale(raw: Column, field: str, top: int = 3) -> Column:
    """STRUCT<value INT, rationale STRING>; off the 0..top scale is null, never 0."""
    def body(ok: Column, get) -> Column:
        def typed(n: Column) -> Column:
            good = ok & F.coalesce(n.between(0, top), F.lit(False))
            why = (
                F.when(~ok, UNPARSEABLE)
                .when(good, F.coalesce(get("rationale"), F.lit("")))
                .otherwise(f"judge returned an out-of-range or missing {field}")
            )
            return _verdict(F.when(good, n).cast("int"), why)

        return let(_number(get(field)), typed)

    return let(trim_ws(raw), lambda s: _parsed(s, body))


def parse_rung(raw: Column) -> Column:
    return parse_scale(raw, "rung")


def parse_set_score(raw: Column) -> Column:
    return parse_scale(raw, "score")


def parse_clamped(raw: Column, unparseable: str = UNPARSEABLE) -> Column:
    """The older 0-10 rule: clamp into range, garbage becomes a 0."""
    def body(ok: Column, get) -> Column:
        score = F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(_number(get("score")), F.lit(0))))
        return _verdict(
            F.when(ok, score).otherwise(0).cast("int"),
            F.when(ok, F.coalesce(get("rationale"), F.lit(""))).otherwise(unparseable),
        )

    return let(trim_ws(raw), lambda s: _parsed(s, body))


def parse_baseline(raw: Column) -> Column:
    """STRUCT<value STRING, rationale STRING>; the value is one of four words or null."""
    def body(ok: Column, get) -> Column:
        def typed(word: Column) -> Column:
            known = ok & F.coalesce(word.isin(BASELINE_VERDICTS), F.lit(False))
            why = (
                F.when(~ok, "grader returned unparseable output")
                .when(known, F.coalesce(get("rationale"), F.lit("")))
                .otherwise("grader returned an unrecognised verdict")
            )
            return _verdict(F.when(known, word), why)

        return let(F.lower(trim_ws(get("verdict"))), typed)

    return let(trim_ws(raw), lambda s: _parsed(s, body))

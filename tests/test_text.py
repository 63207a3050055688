"""URLs, dates, text, verdicts."""

import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import dates, labels, text, urls, verdicts
from rankloom.functions.binding import with_rules

NOW = "2026-08-18 00:00:00"


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_url_variants_merge(spark):
    got = apply(
        spark, urls.normalize_url, "https://A.com/x/", "https://a.com/x#top", "https://a.com/x?utm_source=a&UTM_medium=b",
        "https://a.com/x?fbclid=1", " https://a.com:443/x ", "HTTPS://a.com/x",
    )
    assert set(got) == {"https://a.com/x"}


def test_url_differences_are_kept(spark):
    got = apply(spark, urls.normalize_url, "https://a.com/p?id=2", "https://a.com/p?id=3&gclid=9", "https://www.a.com/p", "not a url", "https://a.com", "https://a.com/p?b=1&a=2", "https://a.com/?q=x/")
    assert got == ["https://a.com/p?id=2", "https://a.com/p?id=3", "https://www.a.com/p", "not a url", "https://a.com", "https://a.com/p?b=1&a=2", "https://a.com/?q=x"]


def test_host(spark):
    assert apply(spark, urls.host, "https://www.A.com/x", "nope", "http://b.org:8080") == ["a.com", "", "b.org"]


def test_safe_links(spark):
    assert apply(spark, urls.safe_href, " https://a.com", "javascript:alert(1)", None) == ["https://a.com", None, None]


@pytest.mark.parametrize("raw,want", [
    ("2026-07-02T04:27:42Z", "2026-07-02"), ("July 2, 2026", "2026-07-02"), ("Oct. 18 2025", "2025-10-18"),
    ("1 month ago", "2026-07-19"), ("5 days ago - more", "2026-08-13"), ("yesterday", "2026-08-17"), ("Today", "2026-08-18"),
    ("1999-12-31", None), ("2026-08-20", None), ("Foo 3, 2024", None), ("", None), (None, None), ("2026-13-45", None),
    ("Feb 31, 2024", "2024-03-02"), ("99999999 hours ago", None),
])
def test_published_dates(spark, raw, want):
    got = apply(spark, lambda c: dates.parse_published(c, F.lit(NOW).cast("timestamp")).cast("string"), raw)
    assert got == [want]


def test_dates_in_paths_roll_over(spark):
    got = apply(spark, lambda c: dates.date_from_url(c, F.lit(NOW).cast("timestamp")).cast("string"),
                "https://x/2026/06/18/a", "https://x/2026/06/a", "https://x/2024/13/a/", "https://x/1999/06/", "https://x/2026/06/18")
    assert got == ["2026-06-18", "2026-06-01", "2025-01-01", None, "2026-06-01"]


def test_detagging(spark):
    got = apply(spark, text.strip_tags, "<p>A &amp; B</p><p>C</p>", "caf&#233;", "&#x1F600;&amp;lt;&nope;", "<script>x</script>a<!-- c -->b<br/>c")
    assert got == ["A & B\nC", "café", "\U0001F600&lt;&nope;", "a b c"]


def test_clean_markdown(spark):
    md = "[Home](/)\r\n* [News](/n)\nText [a](b) stays\n\n\n\nend  "
    assert apply(spark, text.clean_markdown, md, "x" * 1601) == ["Text [a](b) stays\n\nend", "x" * 1600 + "…"]


def test_challenge_kinds(spark):
    assert apply(spark, text.challenge_kind, "<title> Captcha</title>", "<p>", "<ul class=results-standard>") == ["captcha", "markup", None]


def test_unfencing(spark):
    got = apply(spark, verdicts.unfence_json, '```json\n{"a": 1}\n```', 'It is.\n\n{"a": "b}c"} done', '{"a": 1}', "none")
    assert got == ['{"a": 1}', '{"a": "b}c"}', '{"a": 1}', "none"]


@pytest.mark.parametrize("raw,value,why", [
    ('{"rung": 2, "rationale": "ok"}', 2, "ok"), ('{"rung": "3"}', 3, ""), ('{"rung": 2.5}', 3, ""), ('{"rung": -0.4}', 0, ""),
    ('{"rung": 4}', None, "judge returned an out-of-range or missing rung"), ('{"rung": null}', None, "judge returned an out-of-range or missing rung"),
    ("{}", None, "judge returned an out-of-range or missing rung"), ('{"rung": "high"}', None, "judge returned an out-of-range or missing rung"),
    ("oops", None, "judge returned unparseable output"), ('{"rung": 2} tail', None, "judge returned unparseable output"),
    ("null", None, "judge returned unparseable output"), ('{"rung": true}', None, "judge returned an out-of-range or missing rung"),
])
def test_rung_verdicts(spark, raw, value, why):
    assert [tuple(r) for r in apply(spark, verdicts.parse_rung, raw)] == [(value, why)]


def test_clamped_and_baseline_verdicts(spark):
    got = [tuple(r) for r in apply(spark, verdicts.parse_clamped, '{"score": 14}', '{"score": -3}', '{"score": "x"}', "junk")]
    assert got == [(10, ""), (0, ""), (0, ""), (0, "judge returned unparseable output")]
    got = [r[0] for r in apply(spark, verdicts.parse_baseline, '{"verdict": " KNEW "}', '{"verdict": "sure"}', "junk")]
    assert got == ["knew", None, None]


def test_labels(spark):
    assert apply(spark, labels.judge_label, "lab/models/m", "m", "m/") == ["m", "m", "m/"]
    assert apply(spark, labels.model_lab, "groq/x", "gpt", "unknown/x") == ["groq", "openai", "openai"]
    ages = spark.createDataFrame([(None,), (0,), (59,), (60,), (75,)], "d int").select(labels.age_label(F.col("d")), labels.fresh_status(F.col("d")))
    assert [tuple(r) for r in ages.collect()] == [("undated", "neutral"), ("today", "good"), ("59d ago", "warning"), ("2mo ago", "warning"), ("3mo ago", "warning")]


def test_padded_counts_and_entities_are_read(spark):
    now = F.lit("2026-08-18 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("0000003 days ago",), ("3 days ago",), ("99999999999999999999 days ago",), ("900000000000000000 days ago",)], "s string")
    got = [r[0] for r in df.select(dates.relative_date(F.col("s"), now).cast("string")).collect()]
    assert got == ["2026-08-15", "2026-08-15", None, None]
    df = spark.createDataFrame([("&#00000065;&#x0000000041;&#0;&#99999999999999999999;&#xfffffffffffffffffff;&#x1F600;",)], "s string")
    assert df.select(text.decode_entities(F.col("s"))).first()[0] == "AA\x00&#99999999999999999999;&#xfffffffffffffffffff;😀"


def test_the_last_rating_of_a_page_counts_across_url_variants(spark):
    from rankloom.operators import agreement

    js = spark.createDataFrame([("q", "u", "a", 3, 1), ("q", "u", "a", 1, 2), ("q", "u", "b", 2, 1)], "query_id string, url string, judge string, rung int, seq int")
    assert agreement.ratings_wide(js, ["a", "b"], order=("seq",)).first()[2:] == (1, 2)


def _plain_strip(html):
    """The rule as a list of replacements in order."""
    import re

    out = re.sub(r"(?is)<(script|style|noscript|svg|head)\b[^>]*>.*?</\1>", " ", html)
    out = re.sub(r"(?s)<!--.*?-->", " ", out)
    out = re.sub(r"(?i)</(p|div|li|h[1-6]|tr|section|article|br)\s*>", "\n", out)
    out = re.sub(r"<[^>]+>", " ", out)
    out = re.sub(r"[ \t ]+", " ", out)
    out = re.sub(r"\n[ \t]+", "\n", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip(" \t\n")


def test_tags_are_removed_alike_in_lifted_and_inline_rules(spark):
    import random

    rng = random.Random(7)
    bits = ["<script>", "</script>", "<SCRIPT a='b'", ">", "<", "<style>", "</style>", "<svg", "</svg>", "<head>", "</HEAD>", "<!--", "-->", "<!-->",
            "<noscript>", "</noscript>", "</p>", "<b>", "x", " y ", "\n", "é", "<scripty>", "", "</script"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([8, 25, 300]))) for _ in range(900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, html string")
    lifted = {r.id: r.t for r in with_rules(df, t=lambda: text.strip_tags(F.col("html"))).collect()}
    inlined = {r.id: r.t for r in df.limit(200).select("id", text.strip_tags(F.col("html")).alias("t")).collect()}
    assert [lifted[i] for i in range(len(texts))] == [_plain_strip(t) for t in texts] and lifted[len(texts)] is None
    assert inlined == {i: lifted[i] for i in inlined}


@pytest.mark.parametrize("bit", ["<script>", "<script", "<!--", "<", "<style>x</script>", "<head></svg", "<script <style>"])
def test_long_pages_of_unclosed_openings_take_linear_time(spark, bit):
    import time

    n = 2_000_000 // len(bit)
    df = spark.createDataFrame([(bit,)], "b string").select(F.repeat("b", F.lit(n)).alias("html"))
    began = time.time()
    for end in ("", "</script>", "-->"):
        whole = df.select(F.concat("html", F.lit(end)).alias("html"))
        assert with_rules(whole, t=lambda: text.strip_tags(F.col("html"))).select(F.length("t")).first()[0] is not None
    assert time.time() - began < 30


def test_lifted_rules_equal_inline_ones(spark):
    raw = ["{\"rung\": 2}", "```json\n{\"rung\": \"3\"}\n```", "so {\"rung\": 1} it is", "", None, "5", "null", "[", "{\"rung\": 2} {", "x {y"]
    url = ["https://A.b:443/?utm_x=1&q=2#f", "nope", "", None, "http://h", "ftp://u@h:21/p/?gclid=1"]
    when = ["2024-05-06", "3 days ago", "Jan 5, 2024", "yesterday", "never", None, "", "2024-13-45"]
    df = spark.createDataFrame([(raw[i % 10], url[i % 6], when[i % 8]) for i in range(240)], "raw string, url string, d string")
    now = F.lit("2024-06-01").cast("timestamp")
    rules = {
        "v": lambda: verdicts.parse_rung(verdicts.unfence_json(F.col("raw"))), "b": lambda: verdicts.parse_baseline(F.col("raw")),
        "c": lambda: verdicts.parse_clamped(F.col("raw")), "u": lambda: urls.normalize_url(F.col("url")), "p": lambda: dates.parse_published(F.col("d"), now),
        "s": lambda: dates.date_from_snippet(F.col("d"), now), "_let0": lambda: F.lit(1),
    }
    lifted = with_rules(df, **rules)
    assert lifted.columns == [*df.columns, *rules]
    assert " transform(" not in lifted._jdf.queryExecution().optimizedPlan().toString()
    plain = df.select("*", *[r().alias(n) for n, r in rules.items()])
    assert sorted(map(repr, lifted.collect())) == sorted(map(repr, plain.collect()))


def test_date_rules_scan_a_text_once_for_each_pattern(spark):
    """Groups are read off what a pattern found, not off the whole text again."""
    for rule, texts in ((dates.date_from_content, ["_let0", "_let1"]), (dates.date_from_url, ["s"])):
        df = with_rules(spark.createDataFrame([("x",)], "s string"), d=lambda: rule(F.col("s"), F.lit(NOW).cast("timestamp")))
        read = re.findall(r"regexp_extract\((\w+)#", df._jdf.queryExecution().analyzed().toString())
        assert [read.count(t) for t in texts] == [1] * len(texts)

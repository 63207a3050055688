"""Question and anchor sets: reading, validation, union, tags.

A set is a JSON array or one object per line. Rows that break a rule go to a
rejects table with the reason; nothing is dropped silently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.labels import TYPE_ORDER
from ..functions.urls import trim_ws
from ..functions.verdicts import is_json

SHARPNESS = ["sharp", "open"]
GENRES = ["software", "business", "science", "sports", "policy", "everyday"]
HARD_FACTORS = ["trap", "buried", "multi", "obscure"]
ANCHOR_KINDS = ["anchor", "probe"]


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """Entries of set files as (file, pos, raw): array elements, or lines that are neither blank nor comments.

    Files are read by lines in splits. What a file is shows in the first
    character that is not blank. Lines are numbered by (file, block, line); the
    elements of an array are cut from its lines in order, one at a time, by the
    task that has the file. What is left of an array that does not end well is
    an entry of its own, so it is rejected and not lost.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = lines.where(trim_ws(F.col("value")) != "")
    kinds = lines.groupBy("file").agg(F.min(F.struct("block", "id", F.substring(trim_ws(F.col("value")), 1, 1).alias("c"))).alias("first"))
    lines = lines.join(kinds.select("file", (F.col("first.c") == "[").alias("array")), "file")
    # By a hash of the file and not the file: a repartition by the key of the join before it is left out, and the
    # join's own shuffle is read map by map when the join becomes a broadcast, so a file's splits would part.
    elements = lines.where("array").repartition(F.xxhash64("file")).sortWithinPartitions("file", "block", "id").select("file", "value")
    return _numbered(lines.where("not array")).unionByName(elements.mapInPandas(_elements, "file string, pos int, raw string"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines that are no comments with their place in the file: numbered in their block, blocks set off by what comes before."""
    kept = lines.withColumn("raw", trim_ws(F.col("value"))).where(~F.col("raw").startswith("//"))
    sizes = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return kept.withColumn("_i", inside).join(offsets, ["file", "block"]).select("file", (F.col("from") + F.col("_i")).cast("int").alias("pos"), "raw")


class _Cutter:
    """Cuts the elements out of a JSON array that arrives line by line; holds one element."""

    MARK = re.compile(r'["\\\[\]{},]')

    def __init__(self):
        self.depth, self.quoted, self.over, self.held = 0, False, False, []

    def feed(self, line: str) -> Iterator[str]:
        start, skip = 0, -1
        for m in self.MARK.finditer(line) if not self.over else ():
            at, c = m.start(), m.group()
            if at == skip:
                continue
            if self.quoted:
                if c == "\\":
                    skip = at + 1
                elif c == '"':
                    self.quoted = False
            elif c == '"':
                self.quoted = True
            elif c in "[{":
                self.depth += 1
                if self.depth == 1:
                    start = at + 1
            elif c in "]}" or self.depth == 1:
                self.depth -= c != ","
                if c == "," or self.depth == 0:
                    self.held.append(line[start:at])
                    yield from self.done(c == ",")
                    start = at + 1
                if self.depth == 0:
                    self.over = True
                    break
        self.held += [line[start:], "\n"]

    def done(self, more: bool) -> Iterator[str]:
        """The element held, if there is one; before a comma there must be."""
        raw = "".join(self.held).strip()
        self.held = []
        if raw or more:
            yield raw

    def rest(self) -> Iterator[str]:
        """What is left at the end of a file: nothing, an array that was not closed, or text after it; no valid JSON."""
        if not self.over and self.depth:
            yield "[" + "".join(self.held).strip()
        else:
            yield from ("]" + raw for raw in self.done(False))


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    file, cut, pos = None, _Cutter(), 0
    for batch in batches:
        out = []
        for name, line in zip(batch["file"], batch["value"]):
            if name != file:
                out += [(file, pos + i, raw) for i, raw in enumerate(cut.rest())]
                file, cut, pos = name, _Cutter(), 0
            for raw in cut.feed(line):
                out.append((file, pos, raw))
                pos += 1
        if out:
            yield pd.DataFrame(out, columns=["file", "pos", "raw"])
    yield pd.DataFrame([(file, pos + i, raw) for i, raw in enumerate(cut.rest())], columns=["file", "pos", "raw"])


def _json(raw: Column) -> Column:
    return F.when(is_json(raw), F.try_parse_json(raw))


def _quoted(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))


def _string(v: Column, path: str) -> Column:
    """The field when it is a JSON string, else null."""
    t = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.when(t == "STRING", F.try_variant_get(v, path, "string"))


def _present(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant").isNotNull()


def _with_duplicates(df: DataFrame, scope: list[str]) -> DataFrame:
    """Marks an id already used by an earlier entry of the same set.

    First uses are aggregated before the join, so an id that fills a set is
    one row there.
    """
    first = df.groupBy(*scope, "id").agg(F.min("pos").alias("_first"))
    return df.join(first, [*scope, "id"]).withColumn("_dup", F.col("pos") > F.col("_first"))


def _split(df: DataFrame, keep: list[str], scope: list[str]) -> tuple[DataFrame, DataFrame]:
    good = df.where("reason is null").select(*scope, "pos", *keep)
    bad = df.where("reason is not null").select(*scope, "pos", "raw", "reason")
    return good, bad


def parse_questions(entries: DataFrame, scope: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(questions, rejects) from (scope..., pos, raw) entries."""
    df = entries.withColumn("v", _json(F.col("raw")))
    given = trim_ws(_string(F.col("v"), "$.id"))
    number = F.col("pos") + 1
    default_id = F.concat(F.lit("q-"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))
    df = df.withColumns({
        "id": F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(default_id),
        "type": _string(F.col("v"), "$.type"),
        "query": trim_ws(_string(F.col("v"), "$.query")),
        "note": _string(F.col("v"), "$.note"),
        "sharpness": _string(F.col("v"), "$.sharpness"),
        "genre": _string(F.col("v"), "$.genre"),
    })
    df = _with_duplicates(df, scope)

    def wrong_tag(name: str, allowed: list[str]) -> Column:
        return _present(F.col("v"), f"$.{name}") & ~F.coalesce(F.col(name).isin(allowed), F.lit(False))

    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    reason = (
        F.when(F.col("v").isNull(), "is not valid JSON")
        .when(~is_object, "is not an object")
        .when(F.coalesce(F.col("query"), F.lit("")) == "", "has no `query`")
        .when(~F.coalesce(F.col("type").isin(TYPE_ORDER), F.lit(False)), F.concat(F.lit("has type "), _quoted(F.col("type"))))
        .when(F.col("_dup"), F.concat(F.lit("reuses the id "), _quoted(F.col("id"))))
        .when(wrong_tag("sharpness", SHARPNESS), F.concat(F.lit("has sharpness "), _quoted(F.col("sharpness"))))
        .when(wrong_tag("genre", GENRES), F.concat(F.lit("has genre "), _quoted(F.col("genre"))))
    )
    df = df.withColumn("reason", F.when(reason.isNotNull(), F.concat(F.lit("query "), number.cast("string"), F.lit(" "), reason)))
    return _split(df, ["id", "type", "query", "note", "sharpness", "genre"], scope)


def parse_anchors(entries: DataFrame, scope: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(anchors, rejects): a probe must expect 0, a rung is 0-3, every note is required."""
    df = entries.withColumn("v", _json(F.col("raw")))

    def text(path: str) -> Column:
        return _string(F.col("v"), path)

    rung = F.try_variant_get("v", "$.expected_rung", "double")
    numeric = ~F.coalesce(F.schema_of_variant(F.variant_get("v", "$.expected_rung", "variant")) == "STRING", F.lit(True))
    df = df.withColumns({
        "id": F.coalesce(trim_ws(text("$.id")), F.lit("")),
        "kind": text("$.kind"),
        "query": F.coalesce(trim_ws(text("$.query")), F.lit("")),
        "page": F.struct(
            F.coalesce(text("$.page.title"), F.lit("")).alias("title"),
            F.coalesce(text("$.page.domain"), F.lit("")).alias("domain"),
            F.coalesce(text("$.page.url"), F.lit("")).alias("url"),
            text("$.page.published").alias("published"),
            F.coalesce(trim_ws(text("$.page.content")), F.lit("")).alias("content"),
        ),
        "expected_rung": F.when(numeric & (rung == F.floor(rung)) & rung.between(0, 3), rung.cast("int")),
        "note": text("$.note"),
    })
    df = _with_duplicates(df, scope)
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    reason = (
        F.when(F.col("v").isNull(), "is not valid JSON")
        .when(~is_object, "is not an object")
        .when(F.col("id") == "", "has no `id`")
        .when(F.col("_dup"), F.concat(F.lit("reuses the id "), _quoted(F.col("id"))))
        .when(~F.coalesce(F.col("kind").isin(ANCHOR_KINDS), F.lit(False)), F.concat(F.lit("has kind "), _quoted(F.col("kind"))))
        .when(F.col("query") == "", "has no `query`")
        .when(F.col("page.content") == "", "has no `page.content`")
        .when(F.col("expected_rung").isNull(), "has an expected_rung outside 0-3")
        .when((F.col("kind") == "probe") & (F.col("expected_rung") != 0), "is a probe with a non-zero expected_rung")
        .when(F.coalesce(trim_ws(F.col("note")), F.lit("")) == "", "has no `note`")
    )
    number = (F.col("pos") + 1).cast("string")
    df = df.withColumn("reason", F.when(reason.isNotNull(), F.concat(F.lit("entry "), number, F.lit(" "), reason)))
    return _split(df, ["id", "kind", "query", "page", "expected_rung", "note"], scope)


def require_no_rejects(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """The accepted rows; reading them fails when any entry was rejected."""
    n = rejects.agg(F.count(F.lit(1)).alias("n"), F.min("reason").alias("r"))
    ok = n.select(F.assert_true(F.col("n") == 0, F.col("r")).alias("ok")).scalar()
    return good.where(ok.isNull())


def union_report(*sets: tuple[str, DataFrame, str, int]) -> tuple[DataFrame, DataFrame]:
    """(union, report) of named sets given as (name, rows, id prefix, expected count)."""
    union, spec = None, []
    for name, rows, prefix, count in sets:
        part = rows.withColumn("set", F.lit(name))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
        spec.append(F.struct(F.lit(name).alias("set"), F.lit(prefix).alias("prefix"), F.lit(count).cast("bigint").alias("want")))
    wanted = union.sparkSession.range(1).select(F.inline(F.array(*spec)))
    per_id = union.groupBy("set", "id").agg(F.count(F.lit(1)).alias("n"))
    clash = per_id.groupBy("id").agg(F.sum("n").alias("uses"))
    got = per_id.join(clash, "id").join(wanted, "set").groupBy("set", "prefix", "want").agg(
        F.sum("n").alias("n"), F.bool_and(F.col("id").startswith(F.col("prefix"))).alias("prefix_ok"),
        F.sum(F.when(F.col("uses") > 1, F.col("n")).otherwise(0)).alias("clashing"),
    )
    ok = (F.col("n") == F.col("want")) & F.col("prefix_ok") & (F.col("clashing") == 0)
    return union, got.withColumn("ok", ok)


def union_sets(*sets: tuple[str, DataFrame, str, int]) -> DataFrame:
    """The union; reading it fails when a count, a prefix or global uniqueness is off."""
    union, got = union_report(*sets)
    ok = got.agg(F.assert_true(F.bool_and("ok"), F.lit("question sets do not add up")).alias("ok")).scalar()
    return union.where(ok.isNull())


def hard_factors(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factors in fixed order, rejects) from the HARD(a+b) prefix of each note."""
    pattern = r"^HARD\(([^)]*)\)"
    note = F.coalesce("note", F.lit(""))
    tags = F.filter(F.transform(F.split(F.regexp_extract(note, pattern, 1), r"\+"), lambda t: trim_ws(t)), lambda t: t != "")
    vocabulary = F.array(*[F.lit(f) for f in HARD_FACTORS])
    df = questions.withColumn("tags", tags).withColumns({
        "factors": F.array_intersect(vocabulary, "tags"), "unknown": F.array_except("tags", vocabulary),
    })
    reason = F.when(~note.rlike(pattern), F.lit("note does not start with HARD(...)")).when(
        F.size("unknown") > 0, F.concat(F.lit("unknown factors: "), F.array_join("unknown", ", "))
    )
    df = df.withColumn("reason", reason)
    return df.where("reason is null").select("id", "factors"), df.where("reason is not null").select("id", "reason")

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, langid, licenses, merkle, minhash, mixing, neighbours, periodic, pieces, quality, spotsigs, toxicity, warc
from .common import Scratch, table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP2_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
   else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
x as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 80 * (na.n + nb.n - common)),
e as materialized (select a, b from l union all select b, a from l),
r(doc_id, seen) as (select doc_id, doc_id from documents union select e.b, r.seen from r join e on e.a = r.doc_id),
c as (select doc_id, min(seen) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c using (doc_id) left join n using (doc_id)
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, seen) as (select vec_id, vec_id from embeddings union select l.b, r.seen from r join l on l.a = r.vec_id),
c as (select vec_id, min(seen) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join c using (vec_id) left join n using (vec_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan, mix = mixing.mixture(docs.withColumn("size", mixing.words(F.col("text"))))
    return mixing.taken(plan, mix).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP7_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  md5('7:' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as ss, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, case i % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as w from s),
o as (select *, 2.0 * ss / w as r from w),
k as (select *, coalesce(sum(2.0 * ss) over (order by r, i rows between unbounded preceding and 1 preceding), 0) as capped,
  sum(w) over (order by r, i rows between current row and unbounded following) as open_w, sum(1.5 * ss) over () as t from o),
lam as (select coalesce(arg_min((t - capped) / open_w, r) filter ((t - capped) / open_w <= r), max(r)) as lam from k),
g as (select source, ss, least(2.0 * ss, w * lam) as target from w, lam),
p as (select d.*, ss, target, round(target)::bigint as lim,
  coalesce(sum(size) over (partition by d.source order by h, size rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from d join g on d.source is not distinct from g.source)
select doc_id, size, ss as source_size, round(target, 6) as target,
 greatest(0, least(size, lim - pos))::bigint + greatest(0, least(size, lim - ss - pos))::bigint as taken from p
"""


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{i}] >> {15 - 5 * j}) & 31)::int + 1, 1)" for i in range(1, 9) for j in range(4))
OP9_SQL = f"""
with h as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
n as (select *, list_transform(range(8), lambda i: ('0x' || substr(x, (1 + 5 * i)::int, 5))::bigint) as v from h),
d as (select page_id, payload_bytes::bigint as payload_bytes, {_DIGITS} as payload_digest from n),
f as (select *, min(page_id) over (partition by payload_digest) as first_page from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_page then 'response' else 'revisit' end as record_type,
 case when page_id <> first_page then first_page end as refers_to from f
"""

def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.verified(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


def _h(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


OP11_SQL = f"""
with recursive t as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
   lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as tab),
d as (select *, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda ch: ord(ch)::bigint)),
   lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) as crc from documents, t),
l as materialized (select doc_id, source, {_h("text")} as leaf,
   case when crc % 5 = 0 then {_h("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed from d),
p as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from l),
nodes as (select source, 0 as lvl, pos, leaf as h, n from p union all
  select source, lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from nodes where n > 1 group by source, lvl, pos // 16, n),
runs as materialized (select source, lvl, pos // 16 as run, list(h order by pos) as hs from nodes where n > 1 group by all),
s as materialized (select source, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (select 0 as lvl, pos, h, n from s union all
  select lvl + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from tops where n > 1 group by lvl, pos // 16, n),
top_runs as materialized (select lvl, pos // 16 as run, list(h order by pos) as hs from tops where n > 1 group by all),
f as (select doc_id, source, leaf, 0 as lvl, pos, n, coalesce(changed, leaf) as acc, '' as sib from p union all
  select doc_id, f.source, leaf, f.lvl + 1, pos // 16, (n + 15) // 16,
   sha256(array_to_string(list_concat(hs[1:pos % 16], [acc], hs[pos % 16 + 2:]), '')),
   sib || array_to_string(list_concat(hs[1:pos % 16], hs[pos % 16 + 2:]), '')
  from f join runs r on r.source is not distinct from f.source and r.lvl = f.lvl and r.run = pos // 16 where n > 1),
g as (select doc_id, leaf, s.h as subroot, 0 as lvl, s.pos, s.n, acc, sib from f join s on s.source is not distinct from f.source where f.n = 1 union all
  select doc_id, leaf, subroot, g.lvl + 1, pos // 16, (n + 15) // 16,
   sha256(array_to_string(list_concat(hs[1:pos % 16], [acc], hs[pos % 16 + 2:]), '')),
   sib || array_to_string(list_concat(hs[1:pos % 16], hs[pos % 16 + 2:]), '')
  from g join top_runs r on r.lvl = g.lvl and r.run = pos // 16 where n > 1)
select doc_id, leaf, subroot, r.h as root, sha256(sib) as proof_sha256, acc as folded_root, acc = r.h as verified
from g, (select h from tops where n = 1) r where g.n = 1
"""


#: A conversation that holds the template's own marks.
ODD = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(ODD, "conv_id long, turn int, role string, text string"))
    read = chat.read_back(chat.format_threads(rows, Scratch(spark)), in_order=True)
    return read.select(F.col("tree").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), '##', '#\#')"
OP12_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, {_ESCAPED.format("text")} as t, replace({_ESCAPED.format("role")}, ':', '\:') as r from c)
select conv_id::bigint as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, md5(role || chr(10) || text))) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, md5(role || chr(10) || text)) filter (role = 'assistant'), '')) as loss_sha256,
 sum(4 + length(r) + 2 + length(t) + 8)::bigint as formatted_chars
from f group by conv_id
"""


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.repeated(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_minhash": op2_minhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_hnsw": op5_hnsw,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_langid": op8_langid,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
    "op11_merkle": op11_merkle,
    "op12_chat": op12_chat,
    "op13_periodic": op13_periodic,
}
ORACLES: dict[str, str] = {"op2_minhash": OP2_SQL, "op5_hnsw": OP5_SQL, "op7_mixing": OP7_SQL, "op9_warc": OP9_SQL, "op11_merkle": OP11_SQL,
    "op12_chat": OP12_SQL,
}

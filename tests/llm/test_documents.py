"""Operators on documents against plain versions, on tables with every odd case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rankloom.llm import license_rules, licenses, minhash, mixing, pieces, quality, shingles, spotsigs, textstats, toxicity, voters
from rankloom.llm.components import components

SMALL = "/root/testdata/sf0.001"


# --- spot signatures

def test_fingerprints_of_whole_and_edited_texts(spark, edge, texts):
    got = spotsigs.fingerprints(edge).collect()
    assert len(got) == edge.count()
    order = sorted(texts(edge), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for i, t in texts(edge):
        by_text.setdefault(t, set()).update(r.fingerprint for r in got if r.doc_id == i and r.n_chars == len(t))
    assert all(len(v) == 1 for k, v in by_text.items() if k in ("", "one two"))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints_of_empty_and_single_tables(spark, empty):
    assert spotsigs.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "the quick fox and the dog")], "doc_id long, text string")
    r = spotsigs.fingerprints(one).first()
    assert r.near_next == 1.0


def test_signature_chains_skip_common_words(spark):
    df = spark.createDataFrame([("The cat sat on the old mat",), ("cat, SAT!",), ("the cat sat on an old mat",)], "t string")
    sets = [r.s for r in spotsigs.with_signatures(df.selectExpr("t as text"), "text", "s").collect()]
    assert len(sets[0]) == 2 and len(set(sets[0]) & set(sets[2])) == 1 and len(sets[1]) == 1


def test_texts_without_anchors_are_covered_to_their_end(spark):
    english = "the cat sat on the old mat and " * 30
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    pairs = [("xx yy " + words("p", 200), "xx yy " + words("q", 200)), ("xx yy zz", "xx yy ww"), (english + words("p", 100), english + words("q", 100)),
             ("xx, yy\nпервый второй третий", "xx, yy\nчетвёртый пятый шестой"), (words("p", 60) + " the end", words("p", 20) + words("q", 40) + " the end")]
    rows = [(k, t) for k, two in enumerate(pairs) for t in two]
    got = spotsigs.with_signatures(spark.createDataFrame(rows, "k int, text string"), "text", "s").collect()
    for k in range(len(pairs)):
        a, b = (set(r.s) for r in got if r.k == k)
        assert len(a & b) < 0.5 * len(a | b) and a and b, pairs[k][0][:40]
    assert len(next(r.s for r in got if r.text == pairs[0][0])) == 201
    # Common text is as before: nothing opens within GAP words of an anchor.
    plain = spark.createDataFrame([("cats sleep on the mat near one two three four five and wake",)], "text string")
    assert len(spotsigs.with_signatures(plain, "text", "s").first().s) == 3


def test_similar_pairs_lose_none(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pairs, members = spotsigs.similar_pairs(docs, 0.6)
    sets = {r.fingerprint: set(r.s) for r in spotsigs.with_signatures(docs.select("text"), "text", "s").select(
        spotsigs.digest(spotsigs.F.col("s")).alias("fingerprint"), "s").collect() if r.s}
    names = sorted(sets)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == want and want
    assert members.count() == docs.count()


# --- near-duplicates

def _brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    label = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return Counter((rows[i][0], len(sets[i]), label[root[i]] if sets[i] else rows[i][0]) for i in range(len(rows)))


def test_near_duplicates_of_odd_rows(edge, texts):
    got = minhash.near_duplicates(edge, k=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(texts(edge), 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_documents_and_of_none(spark, empty, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = minhash.near_duplicates(docs, k=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(texts(docs), 5)
    assert minhash.near_duplicates(empty).count() == 0


def test_groups_of_near_copies_at_the_threshold(spark, texts):
    """Copies that differ from each other about as much as the threshold allows: centres and the exact rest both matter."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 7), replace=False):
            words[at] = f"m{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, k=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _brute(rows, 4)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (None, 3)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    coords = shingles.coordinates(512, 1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    assert abs((shingles.signature(np.sort(a), coords) == shingles.signature(np.sort(b), coords)).mean() - 0.8) < 0.06


# --- pieces

@pytest.fixture(scope="module")
def model():
    return pieces.load()


def _plain_viterbi(model, names, scores, byte_ids, text):
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, None)] + [(-1e300, None)] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if s[i:j] in names:
                c = best[i][0] + scores[names[s[i:j]]]
                if c > best[j][0] + 1e-12:
                    best[j] = (c, (i, [names[s[i:j]]]))
        if s[i] not in names:
            c = best[i][0] + model.unknown
            if c > best[i + 1][0]:
                best[i + 1] = (c, (i, [byte_ids[b] for b in s[i].encode()]))
    out, at = [], len(s)
    while at:
        at, ids = best[at][1]
        out = ids + out
    return out, best[len(s)][0]


def _score(model, scores, ids):
    return sum(scores.get(i, 0.0) for i in ids)


def test_viterbi_against_a_plain_one_and_the_library(model):
    import duckdb
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    normal = np.array([p.type == 1 for p in proto.pieces])
    zipf = pieces.zipf_scores(normal)
    names = {p.piece: i for i, p in enumerate(proto.pieces) if normal[i]}
    scores = {i: zipf[i] for i in names.values()}
    proto.trainer_spec.model_type = 1
    for i in scores:
        proto.pieces[i].score = zipf[i]
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    sample = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()]
    sample = sample[:60] + ["", " ", "  two  spaces ", "你好 世界\n\t", "ß▁x", "a" * 500, "😀😀 x", "\n\n  \n"]
    offsets, ids = model.encode(sample)
    for i, text in enumerate(sample):
        mine = ids[offsets[i]:offsets[i + 1]].tolist()
        plain, _ = _plain_viterbi(model, names, scores, model.byte_ids, text)
        assert abs(_score(model, scores, mine) - _score(model, scores, plain)) < 1e-6
        theirs = library.encode(text)
        assert mine == theirs or abs(_score(model, scores, mine) - _score(model, scores, theirs)) < 1e-3  # ties only
        assert model.decode(np.array(mine, int)) == library.decode(theirs)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="▁"), max_size=60))
def test_pieces_decode_to_the_text(model, text):
    offsets, ids = model.encode([text, text])
    assert model.decode(ids[:offsets[1]]) == text and offsets[2] == 2 * offsets[1]


def test_pieces_of_odd_rows(spark, edge, empty, texts):
    got = pieces.round_trip(edge).collect()
    assert len(got) == edge.count() and all(r.restored for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {0}
    assert pieces.round_trip(empty).count() == 0
    back = pieces.decode(pieces.encode(edge)).select("text", "decoded", "kept").collect()
    assert all((r.text or "") == r.decoded and r.kept for r in back)


def test_texts_are_encoded_in_slices_of_few_bytes(spark, model):
    """A slice was 1,000 texts of any length before."""
    import pyarrow as pa

    texts = [None, "", "é" * 1000, "a word " * (pieces.SLICE_BYTES // 4), None] + ["some words " * 2000] * 100 + [""] * 2500
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(pieces.slices(batch, 1))
    assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    for part in got:
        size = sum(len((t or "").encode()) for t in part.column(1).to_pylist())
        assert 0 < part.num_rows <= 1000 and (size <= pieces.SLICE_BYTES or sum(bool(t) for t in part.column(1).to_pylist()) == 1)
    assert len(got) >= 7 and list(pieces.slices(batch.slice(0, 0), 1)) == []
    rows = [(i, t) for i, t in enumerate(texts[2:130])]
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", "token_ids").collect()
    offsets, ids = model.encode([t for _, t in rows])
    assert {r.doc_id: list(r.token_ids) for r in encoded} == {i: ids[offsets[i]:offsets[i + 1]].tolist() for i, _ in rows}


# --- quality and toxicity



def _ranked(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("score, label, held, least", [
    (lambda d, l: quality.scored(d, l), "quality", lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0, 0.97),
    (lambda d, l: toxicity.scored(d, l), "toxic", lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2, 0.8),
])
def test_held_out_documents_are_ranked(spark, score, label, held, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held(i) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    known = [(r[label], got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    assert _ranked(np.array([k[0] for k in known]), np.array([k[1] for k in known])) >= least


def test_classifiers_on_odd_rows(spark, edge, empty):
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (4, 7, 7)], "doc_id long, quality int, toxic int")
    none = odd.limit(0)
    for labels in (odd, none):
        for scored in (quality.scored, toxicity.scored):
            got = scored(edge, labels).collect()
            assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
            assert scored(empty, labels).count() == 0
        assert set(quality.keep_good(edge, labels).columns) == set(edge.columns)
        assert set(toxicity.drop_toxic(edge, labels).columns) == set(edge.columns)
    assert quality.keep_good(edge, none).count() == edge.count()


def test_discriminant_against_a_plain_density(spark):
    rng = np.random.default_rng(1)
    d = len(textstats.NAMES)
    x = [(rng.normal(size=d).tolist(), 0) for _ in range(300)] + [(rng.normal(1.0, 0.5, size=d).tolist(), 1) for _ in range(500)]
    model = quality.fit(spark.createDataFrame(x, "stats array<double>, label int"), 0.0, 0.0)
    data = {c: np.array([v for v, y in x if y == c]) for c in (0, 1)}
    at = rng.normal(0.5, 1, size=(20, d))
    logs = []
    for c, m in data.items():
        cov, far = np.cov(m.T), at - m.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(m)))
    z = (logs[1] - logs[0]) / d
    assert np.allclose(model.scores(at), 0.5 * (1 + z / (1 + np.abs(z))))


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.2).astype(int)
    good = [(rng.random(4000) < np.where(y == 1, 0.7, 0.05)) for _ in range(4)]
    noisy = rng.random(4000) < np.where(y == 1, 0.5, 0.3)
    said = np.where(rng.random(4000) < 0.05, 1 - y, y)
    once, often = (toxicity.label_model(np.column_stack(good + [noisy] * n).astype(float), said) for n in (1, 6))
    assert min(((p > 0.5) == (y == 1)).mean() for p in (once, often)) > 0.94
    assert np.abs(once - often).mean() < 0.05


def test_voters_see_through_symbols_and_digits():
    v = voters.Voters({"=blarg": 200.0})
    hits, sizes = v.counts(["You are an IDIOT###", "1d10t", "blarg!! blarg", None, ""])
    assert hits[0, 0] == 1 and hits[0, -1] == 1 and hits[1, -2] == 1 and hits[2].sum() == 2 and hits[3:].sum() == 0


def test_entry_counts_hold_few_entries_whatever_a_task_reads(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 500)
    rows = [(" ".join(f"word{(i * 7 + k) % 900}" for k in range(20)), i % 2) for i in range(300)]
    batches = [toxicity.pd.DataFrame(rows[at:at + 100], columns=["text", "label"]) for at in (0, 100, 200)]
    got = list(toxicity.entry_counts(iter(batches)))
    assert len(got) > 3 and max(map(len, got)) < 700
    want = (Counter(), Counter())
    for text, label in rows:
        want[label].update({e for t in set(voters.tokens_of(text)) for e in voters.entries_of(t)})
    sums = toxicity.pd.concat(got).groupby("entry").sum()
    assert {e: (r.bad, r.fine) for e, r in sums.iterrows()} == {e: (want[1][e], want[0][e]) for e in want[0].keys() | want[1].keys()}


# --- mixing

def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], (5, 2, 1)) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 0], (5, 2)) == pytest.approx([15, 0])
    assert mixing.targets([], ()) == []


def test_mix_takes_targets_and_reruns_agree(spark, edge, empty):
    docs = edge.withColumn("size", mixing.words(mixing.F.col("text")))
    plan, mix = mixing.mixture(docs, block_words=64, blocks_per_shard=4)
    got = mixing.taken(plan, mix).collect()
    assert len(got) == edge.count() and all(r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    again = mixing.taken(*mixing.mixture(docs.repartition(3), block_words=64, blocks_per_shard=4)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    blocks = mix.groupBy("source", "block").agg(mixing.F.countDistinct("shard").alias("n")).where("n > 1")
    assert blocks.count() == 0 and mix.select("shard").distinct().count() > 3
    plan, mix = mixing.mixture(empty)
    assert mixing.taken(plan, mix).count() == 0


def test_splitting_tree_keeps_every_block():
    quotas = np.array([37, 5, 0, 120])
    paths = [mixing.split_path(quotas, k, 7, 3) for k in range(7)]
    assert (sum(p[0] for p in paths) == quotas).all()
    for a, b in zip(paths, paths[1:]):
        assert (a[0] + a[1] == b[1]).all()
    totals = [int(p[0].sum()) for p in paths]
    assert max(totals) - min(totals) <= 2


def test_mixed_documents_have_the_words_taken(spark, edge, empty):
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    docs = edge.withColumn("size", mixing.words(mixing.F.col("text")))
    want = sum(r.taken for r in mixing.taken(*mixing.mixture(docs)).collect())
    assert out.select(mixing.F.sum(mixing.words(mixing.F.col("text")))).first()[0] == want
    assert mixing.mixed_documents(empty).count() == 0


# --- licenses

def _plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in license_rules.PHRASES.items():
        p = phrase.split()
        for i in range(len(ws)):
            if ws[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    norm, spans, kept = " " + " ".join(ws) + " ", [], set()
    for i, r in enumerate(license_rules.RULES):
        for m in re.finditer(f" {r.pattern}(?= )", norm):
            a = norm[:m.start()].count(" ")
            spans.append((a, -(a + m.group().count(" ")), -r.priority, i))
    for s in spans:
        if not any(o != s and o < s and o[1] <= s[1] and o[2] <= s[2] for o in spans):
            kept.add(license_rules.RULES[s[3]].label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | kept))


LICENSED = [
    "Licensed under the Apache License, Version 2.0. All rights reserved; ALL RIGHTS RESERVED.", "GNU General Public License v3 or the MIT License",
    "SPDX-License-Identifier: MPL-2.0", "Creative Commons Attribution-ShareAlike 4.0 and CC BY-SA 4.0; cc by cc by", "reserved rights all",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "ACC BY", "cc  by", "Kcc by Kelvin ccé by",
    "(c) Copyright 2020 2021 Someone Inc. All rights reserved. Provided AS IS, without warranty of any kind", "the general public license of general public license",
]


def test_scan_against_a_plain_one(spark, edge, empty, texts):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(LICENSED)], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(extra).union(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(docs).collect())
    assert got == Counter((i, *_plain_scan(t)) for i, t in texts(docs))
    assert licenses.scan(empty).count() == 0 and licenses.scan(edge).count() == edge.count()
    assert len(license_rules.RULES) > 200


def test_every_match_has_its_keyword_and_a_gate():
    """The prefilters lose nothing: matches drawn from each rule hold its keyword and a gate word."""
    import random

    draw = random.Random(5)

    def build(tree):
        out = []
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(arg))
            elif name == "SUBPATTERN":
                out.append(build(arg[-1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out.extend(build(arg[2]) for _ in range(draw.randint(arg[0], min(arg[0] + 2, arg[1]))))
            elif name == "BRANCH":
                out.append(build(draw.choice(arg[1])))
            elif name == "IN":
                picks = [chr(a) for o, a in arg if str(o) == "LITERAL"] or ["7" if "DIGIT" in str(arg) else "z"]
                out.append(draw.choice(picks))
            else:
                raise AssertionError(name)
        return "".join(out)

    for rule in license_rules.RULES:
        tree = re._parser.parse(rule.pattern)
        for _ in range(25):
            match = build(tree)
            assert re.fullmatch(rule.pattern, match)
            assert rule.keyword in match, (rule, match)
            assert any(g in match for g in license_rules.GATES), (rule, match)

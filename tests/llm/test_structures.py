"""Merkle manifests, reply trees and periodic runs against plain versions and on tables with every odd case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat, convolve, merkle, periodic
from rankloom.llm.common import Scratch
from rankloom.session import shared_dir

SMALL = "/root/testdata/sf0.001"


# --- Merkle manifest

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(r, text):
    return _h(_field(r.doc_id), _field(r.source), _field(r.lang), _field(r.n_chars), _field(text))


def _tree(leaves):
    """Levels from the leaves up, and for each leaf its (left, right) siblings."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i - i % 16
            path.append(("".join(level[run:i]), "".join(level[i + 1:run + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def _plain_proofs(rows):
    by = defaultdict(list)
    for r in rows:
        low = None if r.text is None else "".join(c.lower() if c.isascii() else c for c in r.text)
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), _leaf(r, low) if hit else _leaf(r, r.text), r.doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(by[s])]) for s in sources]
    root, tops = _tree([t[0] for t in trees])
    out = Counter()
    for s, (subroot, paths), top in zip(sources, trees, tops):
        for (_, _, leaf, start, doc_id), path in zip(sorted(by[s]), paths):
            acc = start
            for left, right in path + top:
                acc = _h(left, acc, right)
            out[(doc_id, leaf, subroot, root, _h(*[left + right for left, right in path + top]), acc, acc == root)] += 1
    return out


def _proofs(docs, every):
    rows = merkle.verified(docs, every).withColumn("proof", merkle.digest(merkle.siblings(F.col("path"))))
    return Counter(tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect())


@pytest.mark.parametrize("every", [1, 2, 3])
def test_proofs_of_trees_of_many_sizes(spark, every):
    sizes = {None: 1, "": 2, "a": 16, "b": 17, "c": 257, "é": 1, "z": 300} if every > 1 else {None: 1, "a": 17, "b": 33}
    sizes |= {f"s{i}": 1 for i in range(15)}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 1000 if n % 50 else None, f"Text {n % 90}", None if n % 11 == 0 else "en", source, n if n % 13 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = _proofs(docs, every)
    assert got == _plain_proofs(docs.collect())
    assert {k[-1] for k in got} == {True, False}


def test_manifest_of_odd_rows(spark, edge, empty):
    assert _proofs(edge, 2) == _plain_proofs(edge.collect())
    assert merkle.verified(empty).count() == 0
    one = edge.where("doc_id = 6")
    assert _proofs(one, 3) == _plain_proofs(one.collect())


def test_levels_between_are_not_stored(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("source"), F.lit(1).alias("n_chars"))
    found = merkle.manifest(docs, every=2)
    assert [sum(len(r.digests) for r in level.collect()) for level in found.levels] == [5000, 18 + 2]
    assert all(len(r.digests) <= 256 for level in found.levels for r in level.collect())
    assert found.sources.count() == 2


# --- reply trees

def _plain_threads(rows):
    by = defaultdict(list)
    for r in rows:
        role, text = r.role or "", r.text or ""
        by[r.conv_id].append((r.turn is not None, r.turn or 0, role, hashlib.md5(f"{role}\n{text}".encode()).hexdigest(), text))
    out = Counter()
    for conv, turns in by.items():
        turns.sort()
        said = [t for _, _, role, _, t in turns if role == "assistant"]
        out[(None if conv is None else str(conv), len(turns), _h(*[f"{role}\n{t}\n" for _, _, role, _, t in turns]), sum(map(len, said)), _h(*said))] += 1
    return out


TALKS = [
    (1, 0, "user", "### Assistant: </turn> \\"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"),
    (2, 3, "assistant", None), (2, 1, None, "####\n#\\#"), (2, None, "a: b\\:", "x</turn>\n### user: y"), (None, 0, "user", ""), (None, 1, "assistant", "😀 é\n"),
    (3, 0, "assistant", "</turn"), (3, 1, "assistant", "<"), (4, 5, "system", "<\\/turn>\\n"), (4, 5, "assistant", "#"),
]


@pytest.fixture(scope="module")
def talks(spark):
    rows = TALKS + [(9, i, ("user", "assistant")[i % 2], f"turn {i} " + "w " * (i % 7)) for i in range(300)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, tree string, id int, at int")


@pytest.mark.parametrize("part", [chat.PART, 700])
def test_threads_read_back(spark, talks, part):
    cols = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    want = _plain_threads(talks.collect())
    path = f"{shared_dir(spark)}/chat-test-{random.randrange(1 << 40)}"
    chat.format_threads(talks, Scratch(spark), part).write.parquet(path)
    kept = spark.read.parquet(path)
    assert Counter(tuple(r) for r in chat.read_back(kept).select(*cols).collect()) == want
    direct = chat.read_back(chat.format_threads(talks, Scratch(spark), part), in_order=True).select(*cols)
    assert Counter(tuple(r) for r in direct.collect()) == want
    long = kept.where("tree = '9'").count()
    assert long == 1 if part == chat.PART else long > 5
    assert chat.read_back(chat.format_threads(talks.limit(0), Scratch(spark))).count() == 0


def test_escapes_hold_no_marks_and_come_back():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice(["#", "\\", "</turn>", "<", "/turn>", "\n", ": ", ":", "a", "### user: ", "é"]) for _ in range(draw.randint(0, 12)))
        for kept in (chat.escape(text), chat.escape_role(text)):
            assert "##" not in kept and "</turn>" not in kept and chat.unescape(kept) == text
        piece, start, end = chat.one_turn(text, text)
        assert chat.parsed(piece * 2) == [(text, text)] * 2 and chat.unescape(piece[start:end]) == text


def _plain_replies(rows, best):
    """Paths of a reply table: {tree: {tuple of texts}}, trees and parents as the docstring says."""
    own, out = {}, defaultdict(set)
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0)):
        own.setdefault((r[0], r[1]), r)
    up = {k: (k[0], r[2]) if r[2] is not None and r[2] != r[1] and (k[0], r[2]) in own else None for k, r in own.items()}
    answered = set(up.values())
    ranked = defaultdict(list)
    for k in own:
        if k in answered:
            continue
        path, at = [], k
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            ranked[k[0]].append((-sum(own[p][5] or 0 for p in path) / len(path), -len(path), k[1], tuple(own[p][4] for p in reversed(path))))
    for tree, paths in ranked.items():
        out[tree] = {p[3] for p in (sorted(paths) if best is None else sorted(paths)[:best])}
    return dict(out)


@pytest.mark.parametrize("best", [1, 2, None])
def test_branches_of_reply_trees(spark, best):
    draw = random.Random(8)
    rows = []
    for tree in range(6):
        for i in range(60):
            parent = None if i == 0 else draw.randrange(max(0, i - 9), i)
            rows.append((tree, i, parent, ("user", "assistant")[i % 2], f"m{tree}.{i}", float(draw.randint(0, 9)) if i % 5 else None))
    rows += [(50, 1, 2, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0), (51, 1, 1, "user", "self", 1.0), (51, 2, 77, "user", "lost", 3.0),
             (52, 1, None, "user", "twice", 1.0), (52, 1, None, "user", "twice", 1.0), (52, 2, 1, "assistant", "once", 1.0),
             (50, 3, 4, "user", "tail", 1.0), (50, 4, 5, "user", "c", 1.0), (50, 5, 4, "user", "d", 1.0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "tree long, id long, parent long, role string, text string, score double, place int")
    got = defaultdict(set)
    for r in chat.format_replies(df, Scratch(spark), best).collect():
        got[int(r.tree)].add(tuple(t for _, t in chat.parsed(r.formatted)))
        assert [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends)] == [t for role, t in chat.parsed(r.formatted) if role == "assistant"]
    assert got == _plain_replies(rows, best)


# --- periodic runs

def _plain_runs(w):
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def _plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def _some_words(draw):
    n, kind = draw.randint(0, 300), draw.randint(0, 5)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * draw.randint(0, 150) + ["b"] * draw.randint(0, 2) + ["a"] * draw.randint(0, 150)
    if kind == 2:
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        return y[:n]
    if kind == 3:
        root = [draw.choice("abcdefgh") for _ in range(draw.randint(1, 70))]
        w = (root * (n // len(root) + 1))[:n]
        for _ in range(draw.randint(0, 3) if w else 0):
            w[draw.randrange(n)] = draw.choice("xyz")
        return w
    w = [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
    if n > 40 and kind == 4:
        a = draw.randrange(n)
        p = 1 + (n - a) // draw.randint(3, 10)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_transforms_come_back_and_multiply():
    draw = np.random.default_rng(2)
    for n in (16, 32, 128, 2048):
        x, y = (draw.integers(-(convolve.PRIME // 2), convolve.PRIME // 2, (n, 2)) for _ in range(2))
        assert (convolve.restore(convolve.transform(x.astype(float))) == x).all()
        got = convolve.restore(convolve.reduced(convolve.transform(x.astype(float)) * convolve.transform(y.astype(float))))
        want = [sum(int(x[i, 0]) * int(y[(k - i) % n, 0]) for i in range(n)) for k in range(0, n, n // 16)]
        assert [(int(g) - w) % convolve.PRIME for g, w in zip(got[::n // 16, 0], want)] == [0] * 16


def test_runs_against_a_plain_search():
    draw = random.Random(6)
    for _ in range(120):
        docs = [[c.encode() for c in _some_words(draw)] for _ in range(draw.randint(1, 5))]
        for words, (found, kept) in zip(docs, periodic.searched(docs)):
            want = _plain_runs(words)
            assert [tuple(r) for r in found.tolist()] == want and kept == _plain_collapse(words, want)


def test_long_periods_beyond_the_longest_block(monkeypatch):
    monkeypatch.setattr(convolve, "LONGEST", 16)
    draw = random.Random(9)
    root = [str(draw.randrange(300)).encode() for _ in range(500)]
    words = [b"x"] + root * 2 + root[:123] + [b"y"]
    assert [tuple(r) for r in periodic.searched([words])[0][0].tolist()] == [(1, 1123, 500)] == _plain_runs(words)


def test_one_word_over_and_over_is_quick():
    for words in ([b"a"] * 200_000, [b"a"] * 99_999 + [b"b"] + [b"a"] * 100_000):
        found, kept = periodic.searched([words])[0]
        assert len(found) == (1 if words[99_999] == b"a" else 2) and len(kept) <= 5


def _plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _plain_runs(w)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(top or (None,) * 3), None if top is None else 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(_plain_collapse(w, runs)).hexdigest())


def test_periodic_rows_of_documents(spark, edge, empty, texts):
    docs = edge.where("coalesce(doc_id, 0) not in (6, 7)").select("doc_id", "text")
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    docs = docs.union(small)
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(tuple(r) for r in periodic.digests(periodic.periodic_runs(periodic.repeated(docs))).select(*cols).collect())
    assert got == Counter(_plain_row(i, t) for i, t in texts(docs))
    assert periodic.periodic_runs(edge).count() == edge.count() and periodic.periodic_runs(empty).count() == 0

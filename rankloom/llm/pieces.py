"""SentencePiece encoding and decoding with a unigram Viterbi search.

A vocabulary file gives pieces and scores. Spaces become the whitespace marker,
one marker is put before a text, and the path of pieces with the greatest sum
of log scores wins; ties go to the earlier start. A character that no piece
covers costs ten below the least score and is written as its UTF-8 bytes. A
vocabulary that was made by merging holds ranks in place of log scores; they
are read as a Zipf law, log p of rank r being -log(r + 2.7) less the log of the
sum over the vocabulary.

The model (a double-array trie and the scores) is read once on the driver and
sent with the job: its size is that of the vocabulary and does not grow with
the data. Texts never cross a shuffle. Words of a text that no piece can cross
are searched once per task and remembered up to a fixed number.

Null and empty texts have no tokens. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .unigram import Unigram

#: The vocabulary file; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose words are held at a time, and rows of them; a longer text is alone.
SLICE_BYTES = 512 << 10
SLICE_ROWS = 1000


def load(path: str = VOCABULARY) -> Unigram:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = [p.piece for p in proto.pieces]
    kinds = np.array([p.type for p in proto.pieces])
    normal = np.isin(kinds, (pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.USER_DEFINED))
    merged = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
    scores = zipf_scores(normal) if merged else np.array([p.score for p in proto.pieces])
    by_name = {p: i for i, p in enumerate(pieces)}
    byte_ids = np.array([by_name[f"<0x{b:02X}>"] for b in range(256)])
    return Unigram(pieces, scores, normal, byte_ids, proto.normalizer_spec.add_dummy_prefix)


def zipf_scores(normal: np.ndarray) -> np.ndarray:
    """Log scores by rank among the normal pieces."""
    rank = np.cumsum(normal) - 1
    return -np.log(rank + 2.7) - np.log((1 / (np.arange(normal.sum()) + 2.7)).sum())


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that a task holds the words of little text at a time."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if i > start and (held + size > SLICE_BYTES or i - start == SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", ids: str = "token_ids", check: bool = False) -> DataFrame:
    """The rows with the ids of their text's pieces added; with ``check`` also decoded_sha256 and restored, from the text decoded from them."""
    model, at, names = load(path), docs.columns.index(text), [*docs.columns, ids, *(["decoded_sha256", "restored"] if check else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                texts = batch.column(at).to_pylist()
                offsets, got = model.encode(texts)
                cols = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(got, pa.int32()))]
                if check:
                    back = [model.decode(got[offsets[i]:offsets[i + 1]]) for i in range(len(texts))]
                    cols.append(pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], pa.string()))
                    cols.append(pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{ids}` array<int>" + (", decoded_sha256 string, restored boolean" if check else ""))


def decode(rows: DataFrame, path: str = VOCABULARY, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids added; null ids give null."""
    model, at, names = load(path), rows.columns.index(ids), [*rows.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{text}` string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_fallback, ids_sha256, decoded_sha256, restored): digests of the ids (little-endian int32) and of the text decoded from them."""
    model = load(path)
    names = ["doc_id", "n_tokens", "n_fallback", "ids_sha256", "decoded_sha256", "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                offsets, ids = model.encode(texts)
                rows = []
                for i, text in enumerate(texts):
                    mine = ids[offsets[i]:offsets[i + 1]]
                    back = model.decode(mine)
                    rows.append((len(mine), int(model.fallback[mine].sum()), hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest(),
                                 hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
                cols = [pa.array(c) for c in zip(*rows)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_fallback long, ids_sha256 string, decoded_sha256 string, restored boolean")

"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens; a block of documents keeps its positions as indices into the block's distinct
words.  The blocks' words go to buckets by their hash, packed, one row per block and bucket.  In its bucket each
distinct word is encoded once, and decoded once by the table of token bytes; ids and bytes go back to the blocks
that asked, where the documents are put together by position.  A frequent word is one entry per block, so no
bucket is hot, and texts cross the network as packed indices only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, map_batches, narrow, prepare

#: Characters of text in a block: bounds a worker's memory; larger blocks share more words.
BLOCK_CHARS = 32 << 20
#: Characters of text for each bucket of distinct words.
BUCKET_CHARS = 64 << 20
BLOCK = "block bigint, rows binary, seq binary, n bigint, bucket array<int>, words array<binary>"


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _join(parts: list[bytes]) -> bytes:
    """Byte strings as one, with their lengths in front."""
    return b"".join((len(parts).to_bytes(4, "little"), np.fromiter(map(len, parts), "<u4", len(parts)).tobytes(), *parts))


def _split(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


class _Index(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def blocks(docs: DataFrame, pattern: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """A row per block: its documents, their pre-tokens as indices by position, its distinct words by bucket."""
    from pyspark import TaskContext

    def make():
        import regex

        find, pid, press = regex.compile(pattern).findall, TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=6)

        def step(b: pa.RecordBatch):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = find(text) if text else []
                step.ids.append(doc_id)
                step.seqs.append(np.fromiter(map(step.index.__getitem__, found), "<u4", len(found)))
                step.chars += len(text or "")
                if step.chars >= BLOCK_CHARS:
                    yield flush()

        def flush() -> dict:
            # frequent words first, which compresses the indices; then by bucket and word, which compresses the words
            words = [w.encode() for w in step.index]
            seq = np.concatenate(step.seqs) if step.seqs else np.zeros(0, "<u4")
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            often = np.bincount(seq, minlength=len(words))
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.lexsort((bucket[order], -often[order]))]
            place = np.empty(len(words), "<u4")
            place[order] = np.arange(len(words))
            packs, full = [], []
            for k in range(buckets):
                own = order[bucket[order] == k]
                if len(own):
                    full.append(k)
                    packs.append(press.compress(_join([np.diff(place[own].astype("<i8"), prepend=0).astype("<u4").tobytes(), *[words[i] for i in own.tolist()]])))
            planes = place[seq].view("u1").reshape(-1, 4).T  # planes of zeros take next to nothing
            ids, null = np.array([i or 0 for i in step.ids], "<i8"), np.array([i is None for i in step.ids], "u1")
            lens = np.array([len(x) for x in step.seqs], "<u4")
            row = {
                "block": [(pid << 24) + step.no], "n": [len(words)], "seq": [_join([press.compress(p.tobytes()) for p in planes])],
                "rows": [press.compress(_join([ids.tobytes(), null.tobytes(), lens.tobytes()]))], "bucket": [full], "words": [packs],
            }
            step.ids, step.seqs, step.index, step.chars, step.no = [], [], _Index(), 0, step.no + 1
            return row

        step.ids, step.seqs, step.index, step.chars, step.no = [], [], _Index(), 0, 0
        step.end = lambda: [flush()] if step.ids else ()
        return step

    d = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_batches(d, make, BLOCK)


def encode_words(asked: DataFrame, path: str, pattern: str) -> DataFrame:
    """(bucket, block, words) in bucket order to (block, answer): a word is encoded at its bucket's first sight of it."""

    def make():
        enc = _encoder(path, pattern)
        press, unpress = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        width = "<u2" if max(ranks(path).values(), default=0) < 65536 else "<u4"

        def step(b: pa.RecordBatch):
            for bucket, block, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != step.bucket:
                    step.bucket, step.ids = bucket, {}
                place, *words = _split(unpress.decompress(packed))
                for w in set(words).difference(step.ids):
                    step.ids[w] = np.array(enc._encode_single_piece(w.decode()), width).tobytes()
                yield {"block": [block], "answer": [press.compress(_join([place, _join([step.ids[w] for w in words])]))]}

        step.bucket, step.ids = None, {}
        return step

    return map_batches(asked, make, "block bigint, answer binary")


def _assembled(joined: DataFrame, path: str, emit, schema: str) -> DataFrame:
    """(rows, seq, n, answers) per block to documents; ``emit`` makes columns from (doc_id, word indices, ids, table)."""

    def make():
        unpress = zstandard.ZstdDecompressor()
        width = "<u2" if max(ranks(path).values(), default=0) < 65536 else "<u4"
        table = {i: w for w, i in ranks(path).items()}  # token id to bytes: what decoding joins

        def step(b: pa.RecordBatch):
            for rows, seq, n, answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids: list = [()] * n
                for a in answers or []:
                    place, i = _split(unpress.decompress(a))
                    for k, x in zip(np.cumsum(np.frombuffer(place, "<u4"), dtype=np.int64).tolist(), _split(i), strict=True):
                        ids[k] = np.frombuffer(x, width).tolist()
                who, null, lens = _split(unpress.decompress(rows))
                planes = [np.frombuffer(unpress.decompress(p), "u1") for p in _split(seq)]
                at = np.stack(planes, 1).view("<u4")[:, 0] if len(planes[0]) else np.zeros(0, "<u4")
                ends = np.cumsum(np.frombuffer(lens, "<u4"), dtype=np.int64).tolist()
                who = [None if x else i for i, x in zip(np.frombuffer(who, "<i8").tolist(), null, strict=True)]
                put, starts = emit(ids, table), [0, *ends][:-1]
                for s in range(0, len(who), 500):
                    yield put(who[s : s + 500], [at[x:y].tolist() for x, y in zip(starts[s : s + 500], ends[s : s + 500], strict=True)])

        return step

    return map_batches(joined, make, schema)


def _answers(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    chars = narrow(docs, text=text_col).agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))  # a bucket's words stay few
    base = checkpoint(blocks(docs, pattern, buckets, id_col, text_col))
    asked = base.select("block", F.explode(F.arrays_zip("bucket", "words")).alias("x")).select(F.col("x.bucket").alias("bucket"), "block", F.col("x.words").alias("words"))
    answers = encode_words(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket"), path, pattern)
    n = max(1, base.count())  # a task per block: blocks are large, whatever their number
    answers = answers.repartition(n, "block").groupBy("block").agg(F.collect_list("answer").alias("answers"))  # one per bucket at most
    return base.select("block", "rows", "seq", "n").repartition(n, "block").join(answers, "block", "left").select("rows", "seq", "n", "answers")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the byte-level BPE ids of every whole text, as tiktoken's encode_ordinary gives them.

    A null or empty text has no ids.  Repeated rows and null ids are kept as they come; no rows give no rows.
    """

    def emit(ids, table):
        return lambda who, texts: {"doc_id": who, "ids": [[x for i in t for x in ids[i]] for t in texts]}

    return _assembled(_answers(docs, path, pattern, id_col, text_col), path, emit, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): each row's ids joined with the token-byte table by position.

    The table has one row per vocabulary entry, a fixed size, and is shipped to every task.  Null ids give empty
    bytes; an id outside the vocabulary raises KeyError.
    """
    prepare(tokens.sparkSession)

    def make():
        table = {i: w for w, i in ranks(path).items()}

        def step(b: pa.RecordBatch):
            yield {"doc_id": b.column(0).to_pylist(), "bytes": [b"".join([table[i] for i in ids or ()]) for ids in b.column(1).to_pylist()]}

        return step

    return map_batches(narrow(tokens, doc_id=id_col, ids=ids_col), make, "doc_id bigint, bytes binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: its ids, and the bytes they decode to."""

    def emit(ids, table):
        text = [",".join(map(str, x)).encode() for x in ids]  # of each distinct word
        raw = [b"".join([table[i] for i in x]) for x in ids]
        count = [len(x) for x in ids]
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def put(who, texts):
            return {
                "doc_id": who, "n_tokens": [sum(map(count.__getitem__, t)) for t in texts],
                "ids_sha256": [sha(b",".join(map(text.__getitem__, t))) for t in texts], "decoded_sha256": [sha(b"".join(map(raw.__getitem__, t))) for t in texts],
            }

        return put

    return _assembled(_answers(docs, path, pattern, "doc_id", "text"), path, emit, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

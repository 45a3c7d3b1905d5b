import hashlib
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from haulspark.llm import bpe, packing, records  # noqa: E402
from haulspark.llm.wordbpe import WordEncoder  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "Lorem Ipsum, dolor; sit! amet? " * 3000
TEXTS = [
    "Don't stop. It's 12,5% İstanbul ΣΑΣ ﬁne éa á", None, "", "   ", "a", "snake_case x\x1cy　z 日本語。😀😀", "<|endoftext|> plain text", LONG, "same text here", "same text here",
    "ǅ ŉ' ß. ẞ Ünïcode-word", "\n\n  tabs\t and  spaces ", "idiot!!! 'll 's'll",
]
SCHEMA = "doc_id bigint, text string, lang string, ids string, key string, pid int"


def docs(spark, texts=None, ids=None):
    texts = TEXTS if texts is None else texts
    rows = [(ids[i] if ids else i, t, "xx", "clash", "clash", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library(whole):
    enc = WordEncoder(WORDS, keep=20)
    assert enc.direct
    r = random.Random(1)
    alphabet = "abcXYZéÉßñİΣς'’.,!?#$%-_ 019\t\n日本ﬁ́ \x1d"
    texts = [*TEXTS, *("".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400))]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, enc.width).tolist() == whole(text), repr(text[:80])
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "a", "B.", " ", "\n", "É", ",", "<|end", "oftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(30_000)]
    for text, ids in zip(texts, WordEncoder(WORDS).encode(texts), strict=True):
        assert np.frombuffer(ids, enc.width).tolist() == whole(text), repr(text)
    assert whole("a <|endoftext|> b")[1] == 49407


def test_records_round_trip(spark, tmp_path, whole):
    ids = [5, 3, None, 9, 1, 3, 100, 7, 2, 2, 50, 51, 52]
    d = docs(spark, ids=ids)
    folder = f"file://{tmp_path}/rec"
    manifest = records.write_records(d, folder, WORDS, 2)
    got = records.read_records(spark, folder, manifest).orderBy("start").collect()
    want = sorted(zip(ids, TEXTS, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for g, (i, t) in zip(got, want, strict=True):
        own = whole(t) + [2]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (i, at, len(own)) and np.frombuffer(g["ids"], "<u4").tolist() == own
        at += len(own)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(TEXTS)
    assert records.tokens_round_trip(docs(spark, []), WORDS, 2).count() == 0
    fs, base = pafs.FileSystem.from_uri(folder)
    name = next(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".rec"))
    data = bytearray(fs.open_input_file(name).read())
    data[-6] ^= 1
    off, good = 0, 0
    with pytest.raises(ValueError):
        while off < len(data):
            _, off = records.unframe(bytes(data), off)
            good += 1


def test_masking_is_invertible():
    c = zlib.crc32(b"payload")
    m = (records.masked(b"payload") - records.MASK_DELTA) & 0xFFFFFFFF
    assert ((m << 15) | (m >> 17)) & 0xFFFFFFFF == c


def check_packing(rows, texts, whole, window):
    own = [whole(t) + [1] for t in texts]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, ids in enumerate(own):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    fill = []
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        fill.append(at)
    assert sum(f < window for f in fill) <= 1  # only the last sequence is short
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("window", [16, 64, 2048])
def test_packing(spark, whole, window):
    r = random.Random(window)
    texts = [*TEXTS, *(" ".join("word" for _ in range(r.randint(0, 90))) for _ in range(150)), *["copied text of some length"] * 80]
    check_packing(packing.pack(docs(spark, texts), WORDS, 1, window).collect(), texts, whole, window)


def test_packing_edges(spark, whole):
    assert packing.pack(docs(spark, []), WORDS).count() == 0
    rows = packing.pack(docs(spark, ["x", "x", None], ids=[1, 1, None]), WORDS, 1, 8).collect()
    assert len(rows) >= 3 and sum(x["length"] for x in rows) == 5 and {x["doc_id"] for x in rows} == {1, None}


def test_least_squares_uses_no_piece_twice():
    r = np.random.default_rng(3)
    hist = np.bincount(r.integers(1, 64, 5000), minlength=65)
    combos, times, left = packing.plan(hist, 64)
    used = np.zeros(65, int)
    for c, t in zip(combos, times, strict=True):
        assert c.sum() == 64
        for a in c[c > 0]:
            used[a] += t
    assert (left >= 0).all() and (used + left)[1:64].tolist() == hist[1:64].tolist()
    assert times.sum() > 0.5 * (hist * np.arange(65)).sum() / 64
    more, loose = packing.greedy(left[:64], 64)
    assert all(sum(p) == 64 for p, _ in more) and sum(t * len(p) for p, t in more) + loose.sum() == left[:64].sum()


def test_byte_bpe(spark):
    enc = bpe._encoder(BYTES, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bpe.round_trip_digest(docs(spark), BYTES, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.encode(docs(spark), BYTES, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(ids, BYTES).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.round_trip_digest(docs(spark, []), BYTES, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    texts = [f"text {i % 7} of {i}" for i in range(1200)]
    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.round_trip_digest(docs(spark, texts).coalesce(2), BYTES, public_tokenizers.PATTERN).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}

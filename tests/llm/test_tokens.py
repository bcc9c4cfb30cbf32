import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from hirelake.llm import encoders
from hirelake.llm.encoders import Encoder
from hirelake.llm.queries import QUERIES
from hirelake.llm.token_counts import resync_ids, token_counts
from hirelake.llm.token_files import FrameReader, FrameWriter, read_token_files, write_token_files
from tests.llm.util import SF, docs

WORDS = public_tokenizers.path("word_bpe_49k.json")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: sp.encode(t)
    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(5)
    abc = ["the", "Of", "Ünder", "naïve", "é", "ΣΑΣ", "don't", "x" * 90, "12,345", "你好", "🙂🙂", "<|endoftext|>",
           "a<|startoftext|>b", " ", " ", "\x1c", "\x85", "İ", "ﬁ", "!!", "###", "́́", "it'S", "\x00"]
    seps = [" ", " ", " ", "\n", "\t", "  ", "\r\n", "　", " \n "]
    out = ["", " ", "\n\n", "a", " a ", "́x", "a b c"]
    for _ in range(120):
        out.append("".join(rng.choice(abc) + rng.choice(seps) for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("name", FILES)
def test_encoder_gives_what_the_library_gives(name):
    texts, lib = odd_texts(), library(name)
    enc = Encoder(public_tokenizers.path(name))
    assert enc.drops_blanks == (name == "word_bpe_49k.json")
    assert [x.tolist() for x in enc.ids(texts)] == [lib(t) for t in texts]
    assert enc.counts(texts) == [len(lib(t)) for t in texts]


@pytest.mark.parametrize("drop", ["Lowercase", "NFC", "both"])
def test_cased_and_uncomposed_files(tmp_path, drop):
    """The same file without a normaliser: words keep their case, as the library has it."""
    with open(WORDS) as f:
        spec = json.load(f)
    left = [n for n in spec["normalizer"]["normalizers"] if n["type"] != drop and drop != "both"]
    assert len(left) < len(spec["normalizer"]["normalizers"])
    spec["normalizer"] = {"type": "Sequence", "normalizers": left}
    path = str(tmp_path / "cased.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    texts = [*odd_texts(), "Hello World, NASA Launch", "ÀÉ Àé aB Ab! AB? ab"]
    enc, tok = Encoder(path), Tokenizer.from_file(path)
    assert [x.tolist() for x in enc.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(encoders, "MEMO", 5)
    enc, lib = Encoder(WORDS), library("word_bpe_49k.json")
    for t in odd_texts():
        assert enc.ids([t, t])[1].tolist() == lib(t)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk,overlap", [(200, 16), (97, 40), (1000, 8)])
def test_resynchronised_ids_equal_whole_ids(name, chunk, overlap):
    enc, lib = Encoder(public_tokenizers.path(name)), library(name)
    widened = 0
    texts = odd_texts() + [" ".join(odd_texts()), "y" * 700, "the " * 300 + "z" * 400 + " the" * 300, " " * 900 + "a"]
    for t in texts:
        if len(t) > chunk:
            ids, chunks, w = resync_ids(enc, t, chunk, overlap)
            assert ids.tolist() == lib(t)
            widened += w
    assert widened > 0  # long words force wider overlaps


def test_counts_query_against_the_library(spark):
    got = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    lib = library("word_bpe_49k.json")
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(lib(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (
            n, len((r.text or "").encode()), n > 2048)


def test_counts_of_odd_rows(spark):
    df = docs(spark, [None, "", "a b", "a b", "w " * 3000], [1, 2, 3, 3, None]).selectExpr("*", "7 as n_tokens", "8 as n_bytes")
    got = sorted(tuple(r)[:4] for r in token_counts(df, WORDS, chunk=500, overlap=20).na.fill(-1).collect())
    assert got == [(-1, 6000, 3000, True), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False)]
    assert token_counts(docs(spark, []), WORDS).count() == 0


def packed(parts, frame_ids):
    out = io.BytesIO()
    w = FrameWriter(out, frame_ids)
    for i, p in parts:
        w.add(i, np.array(p, np.uint32))
    w.close()
    return out.getvalue()


@pytest.mark.parametrize("frame_ids", [1, 3, 64, 10_000])
def test_file_round_trip(frame_ids):
    rng = random.Random(6)
    parts = [(i if i else None, [rng.getrandbits(32) for _ in range(rng.choice([0, 1, 5, 200]))]) for i in range(40)]
    data = packed(parts, frame_ids)
    r = FrameReader(io.BytesIO(data))
    assert [r.document(i).tolist() for i in range(40)] == [p for _, p in parts]
    assert r.nulls.tolist() == [True] + [False] * 39 and r.doc_ids.tolist()[1:] == list(range(1, 40))
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(np.array(p, "<u4").tobytes() for _, p in parts)  # any zstd tool can read it


def test_one_document_needs_few_bytes():
    parts = [(i, np.random.default_rng(i).integers(0, 2**32, 500).tolist()) for i in range(400)]
    data = packed(parts, 1000)
    r = FrameReader(io.BytesIO(data))
    before = r.bytes_read
    assert r.document(333).tolist() == parts[333][1]
    assert r.bytes_read - before < len(data) / 100


def test_damage_is_found():
    data = bytearray(packed([(1, list(range(5000)))], 1000))
    data[100] ^= 1
    with pytest.raises(Exception):
        FrameReader(io.BytesIO(bytes(data))).document(0)


def test_files_query_against_the_library(spark):
    got = [tuple(r) for r in QUERIES["op9_token_files"](spark, SF).orderBy("doc_id").collect()]
    lib, start, want = library("word_bpe_49k.json"), 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*lib(r.text or ""), 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_odd_rows(spark):
    df = docs(spark, [None, "", "b", "a", "a", "c c"], [4, 3, 9, 9, 9, None]).selectExpr("*", "1 as start", "2 as path", "3 as file")
    made = write_token_files(df, WORDS, end_id=1, files=3, frame_ids=2)
    rows = [tuple(r)[:3] for r in read_token_files(made).orderBy("start").collect()]
    assert rows == [(None, 0, 3), (3, 3, 1), (4, 4, 1), (9, 5, 2), (9, 7, 2), (9, 9, 2)]
    assert read_token_files(write_token_files(docs(spark, []), WORDS)).count() == 0


def test_letters_with_marks_equal_the_library():
    rng = random.Random(13)
    letters = "abcxyzABCÀÉÎÖØßàéîöøÿñÑ"
    tails = ["", ",", ".", "!!", "###", "'", "'s", "<|", "_", "-", "×", "÷", "'S'", "’", "1", "́", "́,"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(tails) for _ in range(4000)]
    enc, lib = Encoder(WORDS), library("word_bpe_49k.json")
    texts = [" ".join(words[a:a + 40]) for a in range(0, 4000, 40)]
    assert enc.plain is not None
    assert [x.tolist() for x in enc.ids(texts)] == [lib(t) for t in texts]
    assert [x.tolist() for x in enc.ids(words)] == [lib(t) for t in words]


def test_paths_of_other_stores():
    from hirelake.llm.token_files import python_uri
    assert python_uri("s3a://b/k/x") == "s3://b/k/x"
    assert python_uri("dbfs:/tmp/x") == "/dbfs/tmp/x"
    assert python_uri("file:/tmp/x") == python_uri("file:///tmp/x") == "file:///tmp/x"
    assert python_uri("hdfs://n:8020/x") == "hdfs://n:8020/x" and python_uri("/tmp/a:b") == "/tmp/a:b"
    with pytest.raises(ValueError, match="no Python reader"):
        python_uri("odd://x/y")


def test_a_folder_that_only_spark_opens(spark, tmp_path):
    """Tasks write and read behind a mount of Spark's file systems."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./in", f"file://{tmp_path}")
    df = docs(spark, ["a b c", "", "d e"])
    made = write_token_files(df, WORDS, folder="viewfs://tokens/in/new/files")
    assert sorted(x.n_tokens for x in read_token_files(made).collect()) == [1, 3, 4]
    assert list((tmp_path / "new/files").glob("*.zst"))


def test_look_ups_by_block(spark):
    from hirelake.llm.blocks import by_block, of_block
    df = spark.range(5000).selectExpr("(id % 700) * 7919 - 100000 as block", "id as v", "repeat('x', 50) as w")
    for n in (3, 40):
        folder = by_block(df, "look", n)
        import glob
        files = glob.glob(folder.removeprefix("file://") + "/*/*.parquet")
        assert 0 < len(files) <= n  # whatever the number of blocks
        for k in (0, 1, 350, 699):
            t = of_block(folder, k * 7919 - 100000, ["v"])
            assert t.column_names == ["v"] and sorted(t.column("v").to_pylist()) == [i for i in range(5000) if i % 700 == k]
        assert of_block(folder, 12345, ["v"]) is None

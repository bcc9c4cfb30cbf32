import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from hirelake.llm import pieces as P
from hirelake.llm.queries import QUERIES
from tests.llm.util import SF, docs
from tests.llm.test_tokens import odd_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(14)
    bits = [" ", "  ", "\n", "\t", "▁", "the", "ing", "tion", "é", "ß", "你", "🙂", "a" * 70, "ab" * 40, "=" * 33, " " * 35,
            "0x0A", "<s>", "</s>", "<0x0A>", "\x00", "​", "\r\n", "()", ");", "don't", "Über", "123", "\xa0", "﻿", "́"]
    out = [None, "", " ", "  ", "▁", "x", " x", "x ", "\n", "y" * 5000, "▁" * 40 + "z", "(" * 300]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return out + odd_texts()


def test_queue_gives_what_the_library_gives(sp):
    table = P.piece_table(MODEL)
    for t in texts():
        if t:
            ids = []
            for w in P.marked(P.words_of(t)):
                text, _, cuts = table.cuts([w])
                for a, b in zip(cuts, cuts[1:]):
                    for x in P.merge_queue(text[a:b], table.pieces)[0]:
                        ids += [table.pieces[x][0]] if x in table.pieces else table.bytes_of(x)
            assert ids == sp.encode(t), t
            assert table.decode(ids) == sp.decode(ids)


def test_encode_and_decode_equal_the_library(spark, sp):
    all_ = texts()
    df = docs(spark, all_).repartition(3).selectExpr("*", "1 as ids", "2 as block", "3 as part")
    out = P.encode(df, MODEL, block_rows=64)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(all_):
        want = sp.encode(t or "")
        assert got[i]["ids"] == want and got[i].n_tokens == len(want), t
        assert got[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert got[i].round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in P.decode(out, MODEL).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(all_)}


def test_query_against_the_library(spark, sp):
    got = {r.doc_id: r for r in QUERIES["op1_pieces"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = sp.encode(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[r.doc_id].round_trip


def test_viterbi_fold_against_all_segmentations(spark):
    rng = random.Random(15)
    pieces = {c: (i, -4.0 - i) for i, c in enumerate("abc")}
    for i in range(12):
        pieces.setdefault("".join(rng.choice("abc") for _ in range(rng.randint(2, 4))), (i + 3, -rng.uniform(1, 9)))
    table = P.PieceTable(pieces, {}, True, -1, 0, [], {})
    parts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(60)})
    got = {r.part: [i for i in range(len(r.part) + 1) if r.borders >> i & 1] for r in P.lattice(spark.createDataFrame([(p,) for p in parts], "part string"), table).collect()}
    for p in parts:
        best = None
        for cuts in itertools.product((0, 1), repeat=len(p) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(p)]
            seg = [p[a:b] for a, b in zip(at, at[1:])]
            if all(s in pieces for s in seg):
                total = sum(pieces[s][1] for s in seg)
                if best is None or total > best[0] + 1e-9:
                    best = (total, seg)
        seg = [p[a:b] for a, b in zip(got[p], got[p][1:])]
        assert "".join(seg) == p and sum(pieces[x][1] for x in seg) == pytest.approx(best[0])


def test_odd_rows(spark, sp):
    df = docs(spark, ["a b", "a b", None, ""], [1, 1, None, 2])
    got = sorted((str(r.doc_id), r["ids"]) for r in P.encode(df, MODEL).collect())
    assert got == [("1", sp.encode("a b")), ("1", sp.encode("a b")), ("2", []), ("None", [])]
    assert P.encode(docs(spark, []), MODEL).count() == 0

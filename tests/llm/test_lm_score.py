import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hirelake.llm import lm_score as L
from hirelake.llm.queries import QUERIES
from tests.llm.util import SF, docs

MEDIUM = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i, modulus=10):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == 0


class Slow:
    """The model by its recursive formula, without states or blocks."""

    def __init__(self, rows, order, strength):
        self.c, self.order, self.m = Counter(), order, strength
        self.n, words = 0, set()
        for i, text in rows:
            if held(i):
                continue
            toks = tokens(text)
            self.n += len(toks)
            words |= set(toks)
            run = ("<s>", *toks)
            for k in range(1, order + 1):
                self.c.update(run[a:a + k] for a in range(len(run) - k + 1))
        self.v = len(words)
        self.z = self.n + .1 * (self.v + 1)

    def p(self, history, w):
        if not history:
            return (self.c[(w,)] + .1) / self.z
        return (self.c[(*history, w)] + self.m * self.p(history[1:], w)) / (self.c[history] + self.m)

    def row(self, i, text):
        toks = tokens(text)
        run = ("<s>", *toks)
        full = sum(log10(self.p(run[max(0, t - self.order + 1):t], run[t])) for t in range(1, len(run)))
        base = sum(log10(self.p((), w)) for w in toks)
        return (i, held(i), len(toks), sum(self.c[(w,)] > 0 for w in toks), self.n, base, full)


def agrees(got, rows, order, strength):
    model = Slow(rows, order, strength)
    want = [model.row(i, t) for i, t in rows]

    def by(r):
        return (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted([tuple(r) for r in got], key=by)
    want = sorted(want, key=by)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    for a in ([0], [1, 255, 256], [2 ** 64 - 1, 0], rng.integers(0, 2 ** 63, 100)):
        a = np.array(a, np.uint64)
        assert (L.unpack(L.pack(a)) == a).all()
    keys = np.unique(rng.integers(0, 2 ** 63, 1000).astype(np.uint64) * np.uint64(2))
    part = L.ranges(keys, 7)
    assert (np.diff(part) >= 0).all() and [int(k) * 7 >> 64 for k in keys] == part.tolist()


def test_tokens_are_the_plain_rule_s():
    texts = ["", None, " ", "a", " A\x0bb\x0c\r\nC ", "\x1c x\x85y \u00a0 Ä É", "\t", "z" * 5000, "a a  b"]
    got = L.token_hashes(pa.chunked_array([texts[:3], texts[3:]], pa.string()))
    want = [[xxhash.xxh64_intdigest(w.encode()) for w in tokens(t)[:-1]] + [int(L.END)] for t in texts]
    assert [g.tolist() for g in got] == want
    assert L.token_hashes(pa.array([], pa.string())) == []


def test_query_against_the_formula(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    agrees(QUERIES["op13_lm_score"](spark, SF).collect(), rows, 3, L.STRENGTH)


@pytest.mark.parametrize("order,block", [(1, 8 << 20), (2, 3000), (3, 8 << 20), (3, 2500), (4, 3000)])
def test_blocks_and_orders(spark, order, block):
    rng = random.Random(order)
    words = ["a", "B", "b", "c", "ä", "\x85d", "\x1ce"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, "a b c"), (None, "a b c"), (7, texts[7]), (1000, None), (1001, " \n")]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).selectExpr("*", "1 as block", "2 as trained", "3 as score")
    agrees(L.lm_scores(df.repartition(3), order=order, block=block, strength=2.0).collect(), rows, order, 2.0)


def test_states_sum_to_one():
    """Arcs and failure of a state share out all of its probability."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c a b", "", "a"])]
    model = Slow(rows, 3, 2.0)
    words = {w for k in model.c for w in k if len(k) == 1} - {"<s>"}
    for h in [(), ("a",), ("<s>",), ("a", "b"), ("q", "b"), ("<s>", "a")]:
        unseen = .1 / model.z  # one more word
        lack = unseen
        for k in range(len(h)):
            lack *= model.m / (model.c[h[k:]] + model.m)
        assert abs(sum(model.p(h, w) for w in words) + lack - 1) < 1e-12


def test_context_helps_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op13_lm_score"](spark, MEDIUM).collect() if r.held_out]
    assert len(rows) > 50
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.02, gain


def test_nothing_trained_and_empty(spark):
    only_held = [i for i in range(200) if held(i)][:3]
    got = L.lm_scores(docs(spark, ["a b", "", None], only_held)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 3]
    assert all(abs(r.base_score) < 1e-12 and abs(r.score) < 1e-12 for r in got)
    assert L.lm_scores(docs(spark, [])).count() == 0

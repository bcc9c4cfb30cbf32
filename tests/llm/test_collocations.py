import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hirelake.llm import collocations as C
from hirelake.llm.queries import QUERIES
from tests.llm.util import docs

MEDIUM = "/root/testdata/sf0.01"


def slow(rows, least=30, longest=4, top=2000):
    """rows: (lang, text). The contract read word by word."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        c = f[lang]
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        outer = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    outer[p[i:i + k]] = max(outer[p[i:i + k]], a)
        rows = []
        for p, a in cand.items():
            if outer[p] and 100 * outer[p] >= 80 * a:
                continue
            s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_chunks_cover_every_phrase_once():
    rng = random.Random(1)
    for size in (0, 1, 2, 5, 400):
        toks = [rng.choice([b"a", b"b", b"c", b".", b"long"]) for _ in range(size)]
        grams = Counter()
        for begin, new, end in C.parse(toks, 3):
            for k in range(1, 5):
                grams.update(tuple(toks[i - k:i]) for i in range(new + 1, end + 1) if i - k >= begin)
        assert grams == Counter(tuple(toks[i:i + k]) for k in range(1, 5) for i in range(len(toks) - k + 1))


def test_equal_passages_parse_alike():
    rng = random.Random(2)
    passage = [b"%d" % rng.randrange(1000) for _ in range(500)]
    sets = []
    for lead in (3, 40):
        toks = [b"x%d" % rng.randrange(1000) for _ in range(lead)] + passage
        sets.append({tuple(toks[b:e]) for b, _, e in C.parse(toks, 3)})
    assert len(sets[0] & sets[1]) >= min(map(len, sets)) - 4


def test_query_against_brute_force(spark):
    src = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    want = slow([(r.lang, r.text) for r in src])
    assert len(want) > 100 and got(QUERIES["op12_collocations"](spark, MEDIUM)) == want


@pytest.mark.parametrize("bits,slab", [(1 << 26, 1_000_000), (64, 50)])
def test_random_texts(spark, bits, slab):
    """A filter of 64 bits lets nearly everything through; the counts stay."""
    rng = random.Random(3)
    words = ["a", "A", "b", "the", "é", "Ä", "\x1cx", "c.d", "e!", " ", "-"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 80)))
             for _ in range(60)]
    texts += ["the the the the the the"] * 20 + [None, "", " . , ", texts[0], texts[0]]
    langs = [rng.choice(["en", "de", None, "und", ""]) for _ in texts]
    df = docs(spark, texts).drop("lang").join(
        spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id").selectExpr(
        "*", "1 as a", "2 as phrase", "3 as chunk", "4 as n")
    want = slow(zip(langs, texts), least=4, top=40)
    assert len(want) > 40 and got(C.collocations(df, least=4, top=40, bits=bits, slab=slab)) == want


def test_shorter_phrases_only(spark):
    texts = ["x y z x y z x y w"] * 4
    df = docs(spark, texts)
    for longest in (2, 3, 5):
        assert got(C.collocations(df, least=2, longest=longest)) == slow([("en", t) for t in texts], 2, longest)


def test_products_past_64_bits(spark):
    """Counts that one million million copies would give, through the same expressions."""
    row = spark.createDataFrame([(9_000_000_000_000, 9_100_000_000_000, 9_000_000_000_001)], "a long, l long, r long")
    assert row.selectExpr(C.SCORE).first()[0] == 2000000 * 9_000_000_000_000 // 18_100_000_000_001


def test_empty(spark):
    assert C.collocations(docs(spark, [])).count() == 0
    assert C.collocations(docs(spark, [None, "", "one two three"])).count() == 0
    assert np.count_nonzero(C.frequent_filter(spark.createDataFrame([], "lang string, phrase string, a long"))) == 0

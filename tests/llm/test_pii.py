import hashlib
import random
import re

import pytest

from hirelake.llm import pii as P
from hirelake.llm.queries import QUERIES
from tests.llm.util import docs, folder

MEDIUM = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + (2 * int(c)) // 10 for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_of(rows):
    return [(r.doc_id, [tuple(s) for s in r.base]) for r in sorted(rows, key=lambda r: str(r.doc_id))]


def odd_texts():
    rng = random.Random(11)
    bits = ["a@b.c", "a@b..c", "a@b.c.@d.e", "x_y%z+1@q-r.s-t.u", "@", ".", "..", "-", " ", "  ", "+", "(", ")", "_",
            "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "4111  1111", "5500005555555559", "378282246310005", "+1 (555) 555-0100", "+49 30 1234567", "+1", "é", "🙂",
            "9", "12", "\n", "12345678901234567890", "0000000000000000", "b", "@c.d", "%", "1-", " 2"]
    return [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def test_base_spans_against_plain_regular_expressions(spark):
    texts = odd_texts()
    rows = P.find_pii(docs(spark, texts).repartition(4)).collect()
    assert base_of(rows) == sorted(((i, slow(t)) for i, t in enumerate(texts)), key=lambda x: str(x[0]))


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_pii"](spark, MEDIUM).collect()}
    n = [0] * 4
    for d in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect():
        want, r = slow(d.text), rows[d.doc_id]
        joined = [f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        own = [sum(k == i for _, k, _ in want) for i in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == own
        assert set(joined) <= set(r.spans.split(","))
        n = [x + y for x, y in zip(n, own)]
    assert all(n)


def test_very_long_runs_stay_linear(spark):
    texts = ["1" * 200_000, "1 " * 100_000, "a@" + "b." * 50_000, "x" * 300_000, "+" * 100_000 + "1" * 12, "1." * 20_000,
             "a@" * 50_000, "-" * 200_000, "1" + " " * 200_000 + "2", "q@r.st " * 5_000]
    rows = P.find_pii(docs(spark, texts)).collect()
    got = dict(base_of(rows))
    for i in (1, 2, 5, 8, 9):  # the plain expressions need quadratic time on the others
        assert got[i] == slow(texts[i]), i
    assert [got[i] for i in (0, 3, 4, 6, 7)] == [[], [], [(99_999, 3, 100_012)], [], []]


def test_em_finds_the_reliable_labelers():
    rng = random.Random(12)
    rates = {"regex": (0.95, 0.1), "check": (0.9, 0.05), "gazetteer": (0.6, 0.5), "context": (0.7, 0.1), "border": (0.9, 0.4)}
    counts: dict = {}
    truth: dict = {}
    for _ in range(8000):
        y = rng.random() < 0.4
        votes = tuple(1 if rng.random() < (a if y else b) else -1 for a, b in rates.values())
        key = (0, *votes, 1)
        counts[key] = counts.get(key, 0) + 1
        truth[key] = truth.get(key, 0) + y
    rows = [(*k, n) for k, n in sorted(counts.items())]
    q, table = P.reliabilities(rows)
    for name, (a, b) in rates.items():
        assert table[name, 1, 1] == pytest.approx(a, abs=0.06) and table[name, 0, 1] == pytest.approx(b, abs=0.06)
    w = P.span_classifier(rows)
    right = 0
    for r in rows:
        yes = sum(w[x] for x in [("bias", 0), *P._inputs(r)]) > 0
        right += truth[r[:-1]] if yes else r[-1] - truth[r[:-1]]
    assert right / 8000 > 0.93


def test_the_method_adds_spans(spark):
    texts = [f"mail jane{i}@corp{i}.com or call +1 (415) 555-01{i:02d} now. card 4111 1111 1111 1111" for i in range(60)]
    texts += [f"please call 415-555-01{i:02d} today" for i in range(20)] + ["ratio 123 456 78901 of", "ok ok ok"] * 20
    rows = {r.doc_id: r for r in P.find_pii(docs(spark, texts)).collect()}
    added = [i for i, r in rows.items() if len(r.spans) > len(r.base)]
    assert set(range(60, 80)) <= set(added) and not set(range(80, 120)) & set(added)


def test_secrets_are_found_and_long_words_left(spark):
    rng = random.Random(21)

    def run(n, abc):
        return "".join(rng.choice(abc) for _ in range(n))

    hexa, any_ = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    cues = ["token", "API_KEY", "password", "secret key"]
    keys = [run(40, hexa) for _ in range(30)] + [run(64, hexa) for _ in range(10)] + ["ghp_" + run(36, any_) + "7" for _ in range(20)]
    texts = [f'the way {rng.choice(cues)} = "{k}" went on' for k in keys]
    plain = ["a chapter-by-chapter-index-of-volume-12 here", "Donaudampfschifffahrtsgesellschaftskapitaen 1", "_" * 60 + "3",
             "number 123456789012345678901234567890 of", "see 2024-01-02-03-04-05-06-07 for", "words only aaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = {r.doc_id: r for r in P.find_pii(docs(spark, texts + plain * 5)).collect()}
    kind = P.KINDS.index("secret")
    found = [i for i, r in rows.items() if any(s.kind == kind for s in r.spans)]
    assert sorted(found) == list(range(len(keys)))
    for i, k in enumerate(keys):
        (s,) = [s for s in rows[i].spans if s.kind == kind]
        assert texts[i][s.start:s.end] == k
    assert P.redact(docs(spark, texts[:3] + plain)).where("text like '%[SECRET]%'").count() == 3


def test_added_spans_on_the_given_documents(spark):
    """Every planted token is a secret span, and nothing but planted tokens is added."""
    src = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    added = 0
    for r in P.find_pii(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        more = [s for s in r.spans if s not in r.base]
        want = [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', src[r.doc_id])]
        assert [(s.start, s.end) for s in more] == want
        added += len(more)
    assert added > 5


def test_redaction(spark):
    texts = ["a b@c.de, +1 (415) 555-0100!", None, "", "clean é", "4111111111111111"]
    df = docs(spark, texts).selectExpr("*", "1 as _base", "2 as kind", "3 as _row")
    out = P.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "a [EMAIL], [PHONE]!", 1: None, 2: "", 3: "clean é", 4: "[CARD]"}


def test_odd_rows(spark, tmp_path):
    df = docs(spark, [None, "", "x@y.zz", "x@y.zz"], [None, 1, 2, 2]).selectExpr("*", "1 as spans", "2 as base", "3 as _more")
    rows = sorted((str(r.doc_id), r.n_email, r.spans) for r in QUERIES["op5_pii"](
        spark, folder(tmp_path, spark, documents=df)).collect())
    assert rows == [("1", 0, ""), ("2", 1, "email:0:6"), ("2", 1, "email:0:6"), ("None", 0, "")]
    assert P.find_pii(docs(spark, [])).count() == 0 and P.redact(docs(spark, [])).count() == 0
    assert P.find_pii(docs(spark, ["nothing here"])).collect()[0].spans == []

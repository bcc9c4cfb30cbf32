"""Personal data by weak supervision, in DataFrame expressions only.

Candidates come from regular expressions, strict ones (the base kinds) and
wider ones (phone numbers without a plus, spelled-out addresses, social
security numbers, titled names, and keys or tokens: long runs of letters and
digits). Labelers vote +1, -1 or 0 on each candidate:

    regex      the strict pattern with its length rule matches; a secret is hexadecimal
    check      digits are plausible (Luhn, parts at most 255, area code, a mix with letters)
    gazetteer  the top-level domain, given name, cue, key prefix or key length is in a fixed list
    context    a cue word of the kind stands in the words just before
    border     no letter or digit touches the candidate

Expectation-maximisation over the counts of the vote patterns estimates each
labeler's reliabilities and the share of true spans; the posteriors train a
logistic span classifier over votes, kind and length. It decides on every
candidate that is not a base span; base spans always stay.

Plan: one scan groups the vote patterns (their number is bounded by the
labelers, not by the data) with partial aggregates; the driver fits on those
counts; a second scan applies the classifier as a sum of CASE expressions. No
text is shuffled, and no row meets another.

The expressions are written so that the regular expressions are linear and
free of repeated groups, which Java matches by recursion: where a rule needs
one ("a dot followed by a label"), offending characters are first replaced by
others of the same width, and the rest is a plain character class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "name", "secret"]
LABELERS = ["regex", "check", "gazetteer", "context", "border"]
ACCEPT = 0.9
ROUNDS = 50
BEFORE = 40  # characters of the gap before a candidate that the context labeler sees

# FIXED VALUES: gazetteers of the labelers
DOMAINS = "com org net edu gov mil int info biz io co us uk de fr es it nl be ch at eu ca au in jp cn br mx ru se no dk fi pl pt ie nz za".split()
GIVEN = """james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph
jessica thomas sarah charles karen anna peter hans klaus maria jean pierre marie carlos jose juan ana""".split()
CUES = {
    "email": "mail email e-mail contact write reach correo courriel",
    "ip": "ip host server address addr login client from",
    "card": "card visa mastercard amex credit debit pay karte carte tarjeta",
    "phone": "phone tel telephone call fax mobile cell telefon whatsapp",
    "ssn": "ssn social security",
    "name": "dear signed regards name from by author",
    "secret": "token secret key apikey api_key access_key password passwd pwd auth bearer credential",
}
# FIXED VALUES: how issued keys begin, and the lengths of hexadecimal digests and keys
KEY_PREFIX = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xoxb-|xoxp-|AIza|eyJ|npm_|hf_"
KEY_LENGTHS = [32, 40, 48, 56, 64, 96, 128]

_STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]{12,}[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: a cheap test that any text with a match passes
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{12}", "phone": r"\+[0-9]"}

_WIDE = [  # kind, pattern
    ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,24}"),
    ("phone", r"(?<![0-9+(.-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"),
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,200}[0-9])[A-Za-z0-9_-]{20,512}(?![A-Za-z0-9_-])"),
]
_WIDE_HINT = r"[(\[]at[)\]]|[0-9]{3}[) .-]|(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]"
_KEY_HINT = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}"

SPAN = "struct<start:int,kind:int,end:int>"


def _ready(text: Column, kind: str) -> Column:
    """The text with characters replaced, one for one, so that the strict
    pattern needs no repeated group."""
    if kind == "email":  # a dot that no label follows cannot be in a domain
        return F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "%")
    if kind == "card":  # separators in a row end a number
        return F.regexp_replace(text, r"[ -](?=[ -])|(?<=[ -])[ -]", "_")
    return text


#: matches that the fold below holds before it puts them aside; copying an
#: array for each of its entries would make many matches quadratic
_PAGE = 128
_MATCH = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches as ``array<struct<start, end,
    match, before, after>>``: code points, end exclusive, the last characters
    of the gap before the match and the first one of the gap after it. The
    gaps between the matches and the matches themselves take turns."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(
        F.length(g).alias("n"), F.substring(g, 1, 1).alias("first"), F.substring(g, -BEFORE, BEFORE).alias("last")))
    turns = F.zip_with(gaps, found, lambda g, m: F.struct(g["n"].alias("n"), g["first"].alias("first"), g["last"].alias("last"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"{_MATCH[6:-1]}").alias("open"),
                     F.array().cast(_MATCH).alias("page"), F.array().cast(f"array<{_MATCH}>").alias("out"))

    def step(acc, x):
        # the match before this gap now gets its right neighbour
        closed = F.when(acc["open"].isNull(), acc["page"]).otherwise(
            F.concat(acc["page"], F.array(acc["open"].withField("after", x["first"]))))
        full = F.size(acc["page"]) >= _PAGE
        here = F.struct((acc["at"] + x["n"]).alias("start"), (acc["at"] + x["n"] + F.length(x["m"])).alias("end"),
                        x["m"].alias("match"), x["last"].alias("before"), F.lit("").alias("after"))
        return F.struct(
            (acc["at"] + x["n"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNotNull(), here).alias("open"),
            F.when(full, F.array().cast(_MATCH)).otherwise(closed).alias("page"),
            F.when(full, F.concat(acc["out"], F.array(closed))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: F.flatten(F.concat(acc["out"], F.array(acc["page"]))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _strict_ok(kind: str, m: Column) -> Column:
    """The rule that a match of the strict pattern must pass."""
    n = F.length(_digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _strict(text: Column, kind: str) -> Column:
    """Candidates of the strict pattern: ``start, end, match, ok``."""
    none = F.array().cast(f"{_MATCH[:-2]},ok:boolean>>")
    hint = text.contains("@") if kind == "email" else text.rlike(_HINT[kind])
    found = F.transform(matches(_ready(text, kind), _STRICT[kind]), lambda x: x.withField("ok", _strict_ok(kind, x["match"])))
    return F.when(hint, found).otherwise(none)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column, strict: Column) -> Column:
    """The labelers' votes on one candidate, the length class at the end."""
    m, low = x["match"], F.lower(x["match"])
    digits = _digits(m)
    before = F.lower(x["before"])
    around = F.concat(F.substring(x["before"], -1, 1), F.lit(" "), x["after"])
    cues = "|".join(CUES[kind].split())
    if kind == "email":
        top = F.regexp_extract(low, "([a-z]+)$", 1)
        check = _vote(F.length(m) <= 254, F.length(m) > 254)
        gazetteer = _vote(top.isin(DOMAINS), ~top.isin(DOMAINS))
    elif kind == "ip":
        check, gazetteer = _vote(strict, ~strict), _vote(m.rlike(r"^(?:10|127|192\.168)\."), F.lit(False))
    elif kind == "card":
        check = _vote(F.length(digits).between(14, 19) & strict, F.lit(True))
        gazetteer = _vote(digits.rlike("^(?:4|5[1-5]|3[47]|6011)"), ~digits.rlike("^[2-6]"))
    elif kind == "phone":
        check = _vote(F.length(digits).between(10, 15), F.lit(True))
        gazetteer = _vote(digits.rlike("^1?[2-9][0-9]{2}"), F.lit(False))
    elif kind == "ssn":
        check = _vote(~digits.rlike("^(?:000|666|9)|^...00|0000$"), F.lit(True))
        gazetteer = F.lit(0)
    elif kind == "secret":
        part = F.length(digits) / F.length(m)
        check = _vote(part.between(0.15, 0.85), F.lit(True))
        hexadecimal = m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        gazetteer = _vote(m.rlike(f"^(?:{KEY_PREFIX})") | hexadecimal & F.length(m).isin(KEY_LENGTHS), F.lit(False))
    else:
        check = F.lit(0)
        given = F.exists(F.split(low, "[^a-z]+"), lambda w: w.isin(GIVEN))
        gazetteer = _vote(given, F.lit(False))
    form = _vote(hexadecimal & (F.length(m) >= 32), F.lit(False)) if kind == "secret" else _vote(strict, F.lit(kind in BASE))
    size = F.when(F.length(m) < 10, 0).when(F.length(m) < 20, 1).otherwise(2)
    return F.struct(
        form.alias("regex"), check.alias("check"), gazetteer.alias("gazetteer"),
        _vote(before.rlike(rf"(?:^|[^a-z])(?:{cues})[^a-z]"), F.lit(False)).alias("context"),
        _vote(~around.rlike("[A-Za-z0-9_]"), F.lit(True)).alias("border"), size.alias("size"))


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(
        x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_base`` (spans) and ``_more`` (candidates with votes,
    ``base`` telling whether the candidate is a base span)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({f"_{k}": _strict(text, k) for k in BASE})
    none = F.array().cast(_MATCH)
    out = out.withColumns({"_hint": text.rlike(_WIDE_HINT), "_key": text.rlike(_KEY_HINT)})
    out = out.withColumns({f"_wide{i}": F.when(F.col("_key" if k == "secret" else "_hint"), matches(text, p)).otherwise(none)
                           for i, (k, p) in enumerate(_WIDE)})
    out = out.withColumn("_base", F.array_sort(F.concat(*[_as_spans(F.col(f"_{k}"), i) for i, k in enumerate(BASE)])))

    def seen(kind, column, strict):
        return F.transform(F.col(column), lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"),
            strict(x).alias("base"), _votes(kind, x, strict(x)).alias("v")))

    more = [seen(k, f"_{k}", lambda x: x["ok"]) for k in BASE]
    more += [seen(k, f"_wide{i}", lambda x: F.lit(False)) for i, (k, _) in enumerate(_WIDE)]
    out = out.withColumn("_more", F.concat(*more))
    return out.drop("_hint", "_key", *[f"_{k}" for k in BASE], *[f"_wide{i}" for i in range(len(_WIDE))])


def vote_counts(docs: DataFrame, text_col: str = "text") -> list[tuple]:
    """``(kind, votes..., size, count)`` of all vote patterns of the table."""
    votes = [F.col(f"c.v.{x}").alias(x) for x in [*LABELERS, "size"]]
    src = with_candidates(docs.select(F.col(text_col).alias("text"))).select(F.explode("_more").alias("c"))
    rows = src.select(F.col("c.kind").alias("kind"), *votes).groupBy("kind", *LABELERS, "size").agg(F.count("*").alias("n"))
    return sorted(tuple(r) for r in rows.collect())  # at most kinds x 3^labelers x sizes rows


def reliabilities(counts: list[tuple], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """EM over the vote patterns. Returns the posterior of each pattern and
    ``{(labeler, true, vote): probability}``; a vote of 0 is an abstention
    with a probability of its own."""
    q = {r: 1 / (1 + math.exp(-sum(r[1:1 + len(LABELERS)]))) for r in counts}  # start at the majority
    table: dict = {}
    for _ in range(rounds if counts else 0):
        total = sum(r[-1] for r in counts)
        share = (sum(q[r] * r[-1] for r in counts) + 1) / (total + 2)
        for k, name in enumerate(LABELERS):
            for true in (1, 0):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                weight[1 if true else -1] += 1.0  # labelers are better than chance a priori
                for r in counts:
                    weight[r[1 + k]] += (q[r] if true else 1 - q[r]) * r[-1]
                s = sum(weight.values())
                table.update({(name, true, v): w / s for v, w in weight.items()})
        for r in counts:
            odds = math.log(share / (1 - share)) + sum(
                math.log(table[n, 1, r[1 + k]] / table[n, 0, r[1 + k]]) for k, n in enumerate(LABELERS))
            q[r] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return q, table


def _inputs(r: tuple) -> list[tuple]:
    return [("kind", r[0]), *[(n, r[1 + k]) for k, n in enumerate(LABELERS)], ("size", r[1 + len(LABELERS)])]


def span_classifier(counts: list[tuple], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Weights of a logistic classifier trained on the EM posteriors."""
    q, _ = reliabilities(counts)
    total = sum(r[-1] for r in counts) or 1
    w: dict = {("bias", 0): 0.0}
    for r in counts:
        w.update({x: 0.0 for x in _inputs(r)})
    for _ in range(rounds):
        grad = {x: -decay * v for x, v in w.items()}
        for r in counts:
            xs = [("bias", 0), *_inputs(r)]
            miss = (q[r] - 1 / (1 + math.exp(-sum(w[x] for x in xs)))) * math.sqrt(r[-1] / total)
            for x in xs:
                grad[x] += miss
        for x in w:
            w[x] += rate * grad[x]
    return w


def _accepted(c: Column, w: dict, accept: float) -> Column:
    total = F.lit(w.get(("bias", 0), 0.0))
    for name in ["kind", *LABELERS, "size"]:
        value = c["kind"] if name == "kind" else c["v"][name]
        term = F.lit(-100.0) if name == "kind" else F.lit(0.0)  # a kind never seen has no spans
        for (n, v), x in sorted(w.items()):
            if n == name:
                term = F.when(value == v, F.lit(x)).otherwise(term)
        total = total + term
    return total >= math.log(accept / (1 - accept))


def with_spans(docs: DataFrame, weights: dict, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` plus ``_base`` and ``_all``, arrays of ``struct<start, kind,
    end>`` (kind numbered as in ``KINDS``), sorted. A span that the classifier
    adds never overlaps a base span."""
    out = with_candidates(docs, text_col)
    added = F.transform(
        F.filter(F.col("_more"), lambda c: ~c["base"] & _accepted(c, weights, accept) & ~F.exists(
            F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))),
        lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return out.withColumn("_all", F.array_sort(F.array_distinct(F.concat(F.col("_base"), added)))).drop("_more")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, base, spans)`` per row: the base spans and all spans.

    Cases: null and empty texts have no spans; rows that repeat come back as
    they are; a table without candidates has base spans only (none); an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weights = span_classifier(vote_counts(src))
    out = with_spans(src, weights, accept=accept)
    return out.select("doc_id", F.col("_base").alias("base"), F.col("_all").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping
    spans become one mark. Null texts stay null."""
    weights = span_classifier(vote_counts(docs, text_col))
    src = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("text"))
    out = with_spans(src, weights, accept=accept)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    parts = F.aggregate(
        F.col("_all"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.array(
                F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
    out = out.withColumn("_parts", F.when(F.size("_all") > 0, parts))
    clean = F.when(F.col("_parts").isNull(), text).otherwise(F.concat(
        F.array_join(F.col("_parts")["out"], ""), F.substring(text, F.col("_parts")["at"] + 1, F.length(text))))
    return out.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])

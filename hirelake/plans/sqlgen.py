"""Builders of DuckDB expressions for the oracle twins, fed by the same fixed
lists as the Spark predicates so both sides test the same rules."""

from __future__ import annotations

from hirelake.functions import rules


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(expr: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(n)})" for n in needles) + ")"


def count_present(expr: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {lit(n)}) AS INTEGER)" for n in dict.fromkeys(needles)) + ")"


def ats_case(url: str, content: str | None = None, domain_first: bool = False) -> tuple[str, str, str]:
    """(is_ats, platform, confidence) CASE expressions."""
    u = f"lower({url})"
    arms = []
    if domain_first:
        arms += [(contains_any(u, d), p, rules.ATS_CONF_DOMAIN) for p, d, _, _ in rules.ATS_RULES]
        arms += [(contains_any(u, pt), p, rules.ATS_CONF_PATH) for p, _, pt, _ in rules.ATS_RULES]
    else:
        for p, d, pt, _ in rules.ATS_RULES:
            arms.append((contains_any(u, d), p, rules.ATS_CONF_DOMAIN))
            arms.append((contains_any(u, pt), p, rules.ATS_CONF_PATH))
    if content is not None:
        c = f"lower({content})"
        arms += [(contains_any(c, ind), p, rules.ATS_CONF_CONTENT) for p, _, _, ind in rules.ATS_RULES]
    plat = "CASE " + " ".join(f"WHEN {cond} THEN {lit(p)}" for cond, p, _ in arms) + " ELSE NULL END"
    conf = ("CASE " + " ".join(f"WHEN {cond} THEN CAST({v} AS DOUBLE)" for cond, _, v in arms)
            + f" ELSE CAST({rules.ATS_CONF_NONE} AS DOUBLE) END")
    is_ats = "CASE " + " ".join(f"WHEN {cond} THEN true" for cond, _, _ in arms) + " ELSE false END"
    return is_ats, plat, conf


def valid_title(t: str) -> str:
    return (f"(coalesce({t}, '') <> '' AND length({t}) BETWEEN 3 AND 150 "
            f"AND NOT {contains_any(f'lower({t})', rules.BAD_TITLE_PHRASES)} "
            f"AND regexp_matches({t}, '[a-zA-Z]{{3,}}'))")


def unescape(t: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    return t


def char_refs(t: str) -> str:
    """Character references as HTML reads them, also without the semicolon."""
    for ent, ch in (("&amp;", "\x01"), ("&amp", "\x01"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&quot", '"'),
                    ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("\x01", "&")):
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    return t


def capitalize(x: str) -> str:
    return f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"

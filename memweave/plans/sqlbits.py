"""SQL fragments for the DuckDB oracle, generated from the same rule data.

These mirror ``memweave.functions.text`` in SQL so the driver can check each
Spark query against an independent engine (RE2 instead of Java regex).
"""

from __future__ import annotations

import re

from .. import rules
from ..functions.regex import WORD, WS, to_re2
from ..sources.memories import SEED_KEYWORDS, SEED_ORIGINS, SEED_RULES, SEED_TECH


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case_pick(idx: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE {idx} {whens} ELSE '' END)"


def confidence(src: str) -> str:
    parts = []
    for keywords, score in rules.CONFIDENCE_GROUPS:
        cond = " OR ".join(f"contains(lower({src}), {q(k)})" for k in keywords)
        parts.append(f"WHEN {cond} THEN {score}")
    return f"CAST(CASE {' '.join(parts)} ELSE {rules.DEFAULT_CONFIDENCE} END AS DOUBLE)"


def redact(expr: str) -> str:
    out = expr
    for p, r in rules.REDACTIONS:
        out = f"regexp_replace({out}, {q(to_re2(p))}, {q(r)}, 'g')"
    return out


def findings(expr: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({expr}, {q(to_re2(p))}) THEN {q(label)} END"
                      for label, p in rules.SECRET_PATTERNS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _tech_literals():
    out = []
    for t in rules.TECH_TERMS:
        if "\\.?" in t:
            a, b = t.split("\\.?")
            out += [(a + "." + b, re.escape(a) + r"\." + b), (a + b, a + b)]
        else:
            out.append((t, t))
    return out


def tech(expr: str) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches({expr}, {q(f'(?i)(?:^|[^{WORD}]){pat}(?:$|[^{WORD}])')}) "
        f"THEN {q(lit)} END" for lit, pat in _tech_literals())
    return f"list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL)))"


def rule_flags(expr: str, prefix: str = "") -> str:
    cols = []
    for i, (a, b, _l) in enumerate(rules.OPPOSITE_RULES, start=1):
        cols.append(f"regexp_matches({expr}, {q(to_re2(a))}) AS {prefix}a{i}")
        cols.append(f"regexp_matches({expr}, {q(to_re2(b))}) AS {prefix}b{i}")
    return ", ".join(cols)


def first_rule(n: str, e: str) -> str:
    """CASE giving the first rule (1..11, 12 = tech) on which n conflicts with e."""
    whens = []
    for i, (_a, _b, _l) in enumerate(rules.OPPOSITE_RULES, start=1):
        whens.append(f"WHEN ({n}.a{i} AND {e}.b{i}) OR ({n}.b{i} AND {e}.a{i}) THEN {i}")
    tech_types = ", ".join(q(t) for t in rules.TECH_CONFLICT_TYPES)
    whens.append(f"WHEN {n}.type IN ({tech_types}) AND len({n}.tech) > 0 AND len({e}.tech) > 0 "
                 f"AND NOT list_has_any({n}.tech, {e}.tech) THEN {len(rules.OPPOSITE_RULES) + 1}")
    return "CASE " + " ".join(whens) + " END"


def rule_label(rule: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(l)}" for i, (_a, _b, l) in enumerate(rules.OPPOSITE_RULES, 1))
    return f"(CASE {rule} {whens} END)"


def valid_type(t: str) -> str:
    return f"({t} IS NOT NULL AND {t} IN ({', '.join(q(x) for x in rules.MEMORY_TYPES)}))"


#: references that occur in the oracle's tables (the operator knows all; tests cover the others)
ENTITIES_SEEN = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
                 ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"))


def strip_html(expr: str) -> str:
    t = f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"
    for ent, ch in ENTITIES_SEEN:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    t = f"replace({t}, '&amp;', '&')"
    t = f"regexp_replace({t}, {q(f'[{WS}]+')}, ' ', 'g')"
    return f"regexp_replace({t}, '^ | $', '', 'g')"


def preview(expr: str, n: int = rules.PREVIEW_CHARS) -> str:
    return f"(CASE WHEN length({expr}) > {n} THEN substr({expr}, 1, {n}) || '…' ELSE {expr} END)"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def date(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def secret_seed(d: str) -> str:
    nl = "chr(10)"
    cases = [
        f"'key sk-' || repeat('a', 40) || ' '",
        f"'PASSWORD=' || repeat('x', 10) || {nl}",
        f"'token ghp_' || repeat('b', 36) || ' '",
        f"'id AKIA' || repeat('Q', 16) || ' '",
        f"'aws secret \"' || repeat('z', 40) || '\" '",
        f"'Authorization: Basic ' || repeat('Q', 12) || ' '",
        f"'Bearer ' || repeat('t', 24) || ' '",
        f"'https://user:' || repeat('p', 8) || '@db.local '",
        f"'-----BEGIN PRIVATE ' || 'KEY-----' || {nl}",
        f"'xoxb-' || repeat('1', 12) || ' '",
        f"'sk-' || 'ant-' || repeat('c', 40) || ' '",
        f"'github_' || 'pat_' || repeat('d', 82) || ' '",
        f"'hf_' || repeat('e', 34) || ' '",
        f"'sk_' || 'live_' || repeat('f', 24) || ' '",
        f"'AI' || 'za' || repeat('g', 35) || ' '",
    ]
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    return f"(CASE {d} % 19 {whens} ELSE '' END)"


MEM = f"""mem AS (
  SELECT doc_id AS id, source AS project,
    {lst(rules.MEMORY_TYPES)}[doc_id % 11 + 1] AS type,
    (CASE WHEN doc_id % 17 < 11 THEN 'We use ' || {lst(SEED_TECH)}[doc_id % 17 + 1] || ' for the service. ' ELSE '' END)
      || {case_pick('doc_id % 41', SEED_RULES)} || {case_pick('doc_id % 23', SEED_KEYWORDS)} || text AS summary,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {lst(SEED_ORIGINS)}[(doc_id % 13) % 6 + 1] END AS source,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
    ['t' || CAST(doc_id % 37 AS VARCHAR)] || (CASE WHEN doc_id % 5 = 0 THEN ['lang:' || lang] ELSE []::VARCHAR[] END) AS tags,
    ['src/mod' || CAST(doc_id % 5 AS VARCHAR) || '.py'] AS related_files,
    false AS conflict_flag,
    doc_id % 7 <> 0 AS approved,
    CAST(NULL AS VARCHAR) AS raw_text,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'c' || lpad(CAST(doc_id // 10 AS VARCHAR), 11, '0') END AS commit_sha,
    CASE WHEN doc_id % 11 = 7 THEN 'https://stackoverflow.com/a/' || CAST(doc_id AS VARCHAR) END AS so_url,
    (CASE WHEN doc_id % 9 = 0 THEN [doc_id + 20] ELSE []::BIGINT[] END)
      || (CASE WHEN doc_id % 27 = 0 THEN [doc_id + 3] ELSE []::BIGINT[] END) AS related_to
  FROM documents
), memc AS (
  SELECT *, {confidence('source')} AS confidence FROM mem
)"""

INCOMING = f"""inc AS (
  SELECT id, project,
    CASE WHEN id % 31 = 0 THEN 'unknown_type' WHEN id % 31 = 1 THEN 'Decision' ELSE type END AS type,
    source, {secret_seed('id')} || summary AS text
  FROM memc
)"""


def with_mem(body: str, *ctes: str) -> str:
    extra = "".join(", " + c for c in ctes)
    return f"WITH {MEM}{extra}\n{body}"


def summary(text: str, max_sentences: int = rules.SUMMARY_MAX_SENTENCES) -> str:
    """T4 in DuckDB: marker split instead of look-behind (RE2 has none)."""
    st = f"regexp_replace({text}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"
    parts = f"string_split(regexp_replace({st}, {q(f'([.!?])[{WS}]+')}, '\\1' || chr(1), 'g'), chr(1))"
    kw = " + ".join(f"(CASE WHEN contains(lower(s), {q(k)}) THEN 1 ELSE 0 END)"
                    for k in rules.SUMMARY_KEYWORDS)
    words = f"len(list_filter(regexp_split_to_array(s, {q(f'[{WS}]+')}), lambda w: w <> ''))"
    scored = (f"list_transform({parts}, lambda s, i: {{'neg': -(({kw}) + greatest(0, 5 - (i - 1) // 10)), "
              f"'i': i, 's': s, 'words': {words}}})")
    top = f"list_slice(list_sort(list_filter({scored}, lambda x: x.words >= 5)), 1, {max_sentences})"
    return (f"(CASE WHEN len({top}) > 0 THEN array_to_string(list_transform({top}, lambda x: x.s), ' ') "
            f"ELSE substr({text}, 1, {rules.SUMMARY_FALLBACK_CHARS}) END)")

"""Scalar column expressions (F1-F15).  All built-in Spark functions but for F7's
entity table: they stay in the JVM and inside whole-stage code generation."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import rules
from .regex import WORD, WS, to_java, to_java_replacement


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 ---------------------------------------------------------------------------
def confidence_from_source(source) -> Column:
    """First substring group that hits wins; NULL source -> default (0.5)."""
    s = F.lower(_c(source))
    expr = None
    for keywords, score in rules.CONFIDENCE_GROUPS:
        hit = reduce(lambda a, b: a | b, [s.contains(k) for k in keywords])
        expr = F.when(hit, F.lit(score)) if expr is None else expr.when(hit, F.lit(score))
    return expr.otherwise(F.lit(rules.DEFAULT_CONFIDENCE))


# F2 ---------------------------------------------------------------------------
def is_valid_type(type_col) -> Column:
    return _c(type_col).isin(*rules.MEMORY_TYPES) & _c(type_col).isNotNull()


def invalid_type_reason(type_col) -> Column:
    return F.concat(F.lit("Invalid memory type '"), F.coalesce(_c(type_col), F.lit("None")),
                    F.lit("'. Valid types: " + rules.invalid_type_reason_suffix()))


# Literal pre-guards: a pattern can only match text containing these strings (of each group one).  Scanning a text for
# a literal is far cheaper than running the regex at every position, and most texts contain none of them.
def _needles(p: str) -> tuple[tuple[str, ...], ...]:
    table = (("sk-ant-", (("sk-ant-",),)), ("sk_live_", (("sk_live_",),)), ("sk-", (("sk-",),)),
             ("gh[ps]_", (("ghp_", "ghs_"),)), ("github_pat_", (("github_pat_",),)), ("AKIA", (("AKIA",),)),
             ("-----BEGIN", (("-----BEGIN",),)), ("hf_", (("hf_",),)), ("xox", (("xox",),)), ("AIza", (("AIza",),)),
             ("://", (("://",), ("@",))), ("API_KEY|SECRET", (("=",),)))
    for key, needles in table:
        if key in p:
            return needles
    return ()


# What a text is searched for once, for all patterns of redaction and scan: signs as they are, words in either case.  No
# replacement inserts one that was not there (``aws`` it would), so that a text's marks hold for its redacted form as well.
SIGNS = ("_", "sk-", "AKIA", "-----BEGIN", "xox", "AIza", "=", "://")
WORDS = ("bearer", "secret", "authorization")


def _mark(p: str) -> int:
    """The number of the sign or word that a pattern's matches hold."""
    for key, mark in (("github_pat_", "_"), ("gh[ps]_", "_"), ("hf_", "_"), ("sk_live_", "_"), ("API_KEY|SECRET", "="),
                      *((w, w) for w in WORDS), *((x, x) for x in SIGNS[1:])):
        if key in p:
            return (SIGNS + WORDS).index(mark)
    raise ValueError(f"no mark for pattern {p!r}")


def _marks(t: Column) -> Column:
    return _given(F.lower(t), lambda low: F.array(*[t.contains(x) for x in SIGNS], *[low.contains(x) for x in WORDS]))


def _guard(t: Column, p: str) -> Column | None:
    groups = [reduce(lambda a, b: a | b, [t.contains(n) for n in group]) for group in _needles(p)]
    return reduce(lambda a, b: a & b, groups) if groups else None


def _given(value: Column, f) -> Column:
    """f(value), where the value is computed once a row, however often f names it and under whatever condition."""
    return F.element_at(F.transform(F.array(value), f), 1)


# F3 ---------------------------------------------------------------------------
REDACT_JAVA = tuple((p, to_java(p), to_java_replacement(r)) for p, r in rules.REDACTIONS)


def _redacted(t: Column, marks: Column) -> Column:
    def step(raw: str, p: str, r: str):
        def of(x):
            guard = _guard(x, raw)
            held = marks[_mark(raw)] if guard is None else marks[_mark(raw)] & guard
            return F.when(held, F.regexp_replace(x, F.lit(p), F.lit(r))).otherwise(x)
        return of
    return reduce(lambda x, rule: _given(x, step(*rule)), REDACT_JAVA, t)


def redact(text) -> Column:
    """All substitutions in order (a later rule may re-mask an earlier placeholder); a rule runs on texts
    only that hold its literals at its turn."""
    t = _c(text)
    return _given(_marks(t), lambda marks: _redacted(t, marks))


# F4 ---------------------------------------------------------------------------
SCAN_JAVA = tuple((label, p, to_java(p)) for label, p in rules.SECRET_PATTERNS)


def _found(t: Column, marks: Column) -> Column:
    items = []
    for label, raw, p in SCAN_JAVA:
        guard = _guard(t, raw)
        held = marks[_mark(raw)] if guard is None else marks[_mark(raw)] & guard
        items.append(F.when(held & t.rlike(p), F.lit(label)))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def scan_findings(text) -> Column:
    return _given(_c(text), lambda t: _given(_marks(t), lambda marks: _found(t, marks)))


def redact_and_scan(text) -> Column:
    """struct<clean_text, findings>: the redacted text and what is found in it; the text is searched for marks once."""
    t = _c(text)
    return _given(_marks(t), lambda marks: _given(_redacted(t, marks), lambda clean: F.struct(
        clean.alias("clean_text"), _found(clean, marks).alias("findings"))))


# F5 ---------------------------------------------------------------------------
def _from_word_start(words, n: int, rest: str) -> str:
    """A pattern of words (beginning with n letters or more) from a word's start: these letters are read as n classes first, as
    nearly all places of a text fail there, and only then what stands before them and which word it is.  ``rest``: a format for
    what follows the n letters, which gets the words' rests as one alternation."""
    classes = "".join(f"[{''.join(sorted({w[k] for w in words}))}]" for k in range(n))
    by = {start: [w[n:] for w in words if w[:n] == start] for start in sorted({w[:n] for w in words})}
    rests = "|".join(f"(?<={start})(?:{'|'.join(to_java(r).removeprefix('(?d)') for r in ends)})" for start, ends in by.items())
    return f"(?d)(?i){classes}(?<![{WORD}]{'.' * n}){rest.format(rests=f'(?:{rests})(?![{WORD}])')}"


TECH_JAVA = _from_word_start(rules.TECH_TERMS, 3, "{rests}")


def tech_set(text) -> Column:
    """Distinct, sorted lower-case technology terms (whole-word hits)."""
    hits = F.regexp_extract_all(_c(text), F.lit(TECH_JAVA), 0)
    return F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.lower(x))))


# F6 ---------------------------------------------------------------------------
RULES_JAVA = tuple((to_java("(?i)" + a), to_java("(?i)" + b), label)
                   for a, b, label in rules.OPPOSITE_RULES)


def _rule_form(p: str) -> tuple[str, str, int, str]:
    """A rule side as (kind, first word, most signs between, second word): ``gap`` for two words of one line, ``lead`` for a
    word or phrase alone (whatever may follow it), ``whole`` for any other pattern."""
    gap = re.fullmatch(r"\\b(\w+)\\b\.\{0,(\d+)\}\\b(\w+)\\b", p)
    if gap:
        return "gap", gap.group(1), int(gap.group(2)), gap.group(3)
    lead = re.fullmatch(r"\\b(\w.*?)\\b\.\{0,\d+\}", p)
    return ("lead", lead.group(1), 0, "") if lead else ("whole", p, 0, "")


def _rule_words():
    """The rules' sides as (rule, side, whole pattern, form), and the pattern that finds their first words: at each the word without
    its two first letters, and what follows it on its line, as far as any rule looks."""
    forms = [(i, side, p, _rule_form(raw)) for i, ((ra, rb, _l), (pa, pb, _label)) in
             enumerate(zip(rules.OPPOSITE_RULES, RULES_JAVA), start=1) for raw, p, side in ((ra, pa, "a"), (rb, pb, "b"))]
    firsts = sorted({first for *_, (kind, first, _n, _second) in forms if kind != "whole"})
    if len({w[2:] for w in firsts}) < len(firsts):
        raise ValueError("first words of rules that differ in two letters only")
    reach = max((n + len(second) + 1 for *_, (kind, _first, n, second) in forms if kind == "gap"), default=0)   # and the sign after it
    return forms, _from_word_start(firsts, 2, f"(?=({{rests}}.{{{{0,{reach}}}}}))")


def rule_sides(text) -> Column:
    """array<struct<rule int, side string>>: which side of each rule a text names.

    A text is read once: the rules' first words (``use``, ``always``) are cut out with what follows them, one a line, and the rules
    are looked for in these short pieces."""
    t = _c(text)
    forms, found = _rule_words()
    pieces = F.array_join(F.regexp_extract_all(t, F.lit(found), 1), "\n")

    def named(part):
        items = []
        for i, side, whole, (kind, first, n, second) in forms:
            if kind == "whole":
                hit = t.rlike(whole)
            else:
                rest = f".{{0,{n}}}(?<![{WORD}]){second}(?![{WORD}])" if kind == "gap" else ""
                hit = (part != "") & part.rlike(f"(?d)(?i)(?m)^{to_java(first[2:]).removeprefix('(?d)')}(?![{WORD}]){rest}")
            items.append(F.when(hit, F.struct(F.lit(i).alias("rule"), F.lit(side).alias("side"))))
        return F.filter(F.array(*items), lambda x: x.isNotNull())
    return _given(pieces, named)


def rule_label(rule_no) -> Column:
    m = F.create_map(*[x for i, (_a, _b, label) in enumerate(rules.OPPOSITE_RULES, start=1)
                       for x in (F.lit(i), F.lit(label))])
    return m[_c(rule_no)]


# F7 ---------------------------------------------------------------------------
@F.pandas_udf(StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """Every named and numeric character reference (Arrow batches; the table is the HTML standard's)."""
    return texts.map(html.unescape, na_action="ignore")


def strip_html(markup) -> Column:
    """Tags -> space, entities decoded, whitespace collapsed, trimmed."""
    t = unescape_html(F.regexp_replace(_c(markup), F.lit("<[^>]+>"), F.lit(" ")))
    t = F.regexp_replace(t, F.lit(f"[{WS}]+"), F.lit(" "))
    return F.regexp_replace(t, F.lit("^ | $"), F.lit(""))


# F8 / F9 ----------------------------------------------------------------------
def so_url_kind_id(url) -> Column:
    """struct<kind string, id string>; NULL when the URL does not parse.

    The id stays text (without leading zeros), so that no number is too long."""
    u = _c(url)
    found = [(kind, F.regexp_extract(u, p, 1)) for kind, p in rules.SO_URL_PATTERNS]
    kind = num = None
    for k, got in found:
        kind = F.when(got != "", F.lit(k)) if kind is None else kind.when(got != "", F.lit(k))
        num = F.when(got != "", got) if num is None else num.when(got != "", got)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"),
                                              F.regexp_replace(num, "^0+([0-9])", "$1").alias("id")))


def so_canonical_url(url) -> Column:
    """https://<host>/a/<id> or /questions/<id>; NULL for another host or an URL that does not parse."""
    host = F.lower(F.regexp_extract(_c(url), rules.URL_HOST_PATTERN, 1))
    parsed = so_url_kind_id(url)
    path = F.when(parsed["kind"] == "answer", F.lit("a/")).otherwise(F.lit("questions/"))
    return F.when(host.isin(*rules.SO_HOSTS) & parsed.isNotNull(),
                  F.concat(F.lit("https://stackoverflow.com/"), path, parsed["id"]))


# F10 --------------------------------------------------------------------------
def parse_json_list(v) -> Column:
    """Bad, NULL or non-list JSON -> empty array."""
    parsed = F.from_json(_c(v), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


# F14 --------------------------------------------------------------------------
def preview(text, n: int = rules.PREVIEW_CHARS, ellipsis: bool = True) -> Column:
    t = _c(text)
    cut = F.substring(t, 1, n)
    if not ellipsis:
        return cut
    return F.when(F.length(t) > n, F.concat(cut, F.lit("…"))).otherwise(t)


def iso_ts(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")

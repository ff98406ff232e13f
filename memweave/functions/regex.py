"""Render rule patterns (Python ``re`` syntax) for Java (Spark) and RE2 (DuckDB).

Three dialect gaps matter for exact parity with Python's ``re`` on ``str``:

* ``.``  - Java also stops at ``\\r``, U+0085, U+2028/9; ``(?d)`` restricts it to ``\\n``.
* ``\\s`` - Python matches every ``str.isspace()`` character; we spell that class
  out (``WS``) so Java and RE2 agree with it, NBSP included.
* ``\\b`` - Python is Unicode-aware.  Java gets explicit look-arounds over
  ``[\\p{L}\\p{N}_]``; RE2 has no look-around, so the oracle form consumes the
  boundary character (only used for boolean matches).
"""

from __future__ import annotations

import re

# characters for which Python's str.isspace() is true
WS = r"\x09-\x0D\x1C-\x1F\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def _replace_ws(p: str) -> str:
    out = []
    i = 0
    in_class = False
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if nxt == "s":
                out.append(WS if in_class else f"[{WS}]")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def _boundaries(p: str, start: str, end: str) -> str:
    out = []
    i = 0
    while i < len(p):
        if p.startswith(r"\b", i):
            nxt = p[i + 2] if i + 2 < len(p) else ""
            out.append(start if (nxt.isalnum() or nxt == "(") else end)
            i += 2
            continue
        if p[i] == "\\" and i + 1 < len(p):
            out.append(p[i:i + 2])
            i += 2
            continue
        out.append(p[i])
        i += 1
    return "".join(out)


def to_java(p: str) -> str:
    """Java regex with Python semantics for ``.``, ``\\s`` and ``\\b``."""
    p = _boundaries(p, f"(?<![{WORD}])", f"(?![{WORD}])")
    return "(?d)" + _replace_ws(p)


def to_java_replacement(r: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", r)


def to_re2(p: str) -> str:
    """RE2 regex with the same boolean/replace behaviour (no ``\\b`` gaps)."""
    gap = re.fullmatch(r"\\b(\w+)\\b\.\{0,(\d+)\}\\b(\w+)\\b", p)
    if gap:
        a, n, b = gap.group(1), int(gap.group(2)), gap.group(3)
        nw = f"[^{WORD}\\n]"
        return (f"(?i)(?:^|[^{WORD}]){a}{nw}(?:.{{0,{n - 2}}}{nw})?{b}(?:$|[^{WORD}])")
    lead = re.fullmatch(r"\\b(.+?)\\b\.\{0,\d+\}", p)
    if lead:
        return f"(?i)(?:^|[^{WORD}]){_replace_ws(lead.group(1))}(?:$|[^{WORD}])"
    if r"\b" in p:
        raise ValueError(f"no RE2 form for pattern {p!r}")
    return _replace_ws(p)

"""Python-``re`` → Java-regex dialect for the rule patterns.

Spark evaluates regexes with ``java.util.regex``.  The rules are written for
Python's ``re`` on ``str``, whose ``\\s``, ``\\d``, ``\\w``, ``\\b`` and ``.``
are Unicode-aware and differ from Java's defaults.  We spell each class out
so both engines accept exactly the same characters:

* ``\\s``  → every code point for which ``str.isspace()`` is true
* ``\\d``  → ``\\p{Nd}``
* ``\\w``  → ``[\\p{L}\\p{N}_]``;  ``\\b`` → explicit look-around on that class
* ``.``    → ``[^\\n]`` (Python's dot only stops at newline)
* IGNORECASE → ``(?iu)`` (Unicode case folding)

The structured rules run on digit-normalised text in the reference.  Instead of
normalising the text we add the Arabic-Indic digits to every class that names
ASCII digits, which is equivalent and keeps the working copy identical to the
original, so hit text and byte offsets come straight out of the split.
"""
from __future__ import annotations

import re
from functools import lru_cache

from .. import rules as R


def _python_whitespace_ranges(exclude_newline: bool) -> str:
    cps = [c for c in range(0x110000) if chr(c).isspace()]
    if exclude_newline:
        cps = [c for c in cps if c != 0x0A]
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
        i = j + 1
    return "".join(parts)


WS_INNER = _python_whitespace_ranges(exclude_newline=False)    # class body
HWS_INNER = _python_whitespace_ranges(exclude_newline=True)    # [^\S\n] body
WS = f"[{WS_INNER}]"
HWS = f"[{HWS_INNER}]"
WORD = r"[\p{L}\p{N}_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
DIGIT = r"\p{Nd}"
AR_DIGIT_RANGE = r"\x{660}-\x{669}"


def _translate(py: str, fold_digits: bool) -> str:
    """Token-level rewrite of one rule pattern (only the constructs the rule
    table uses are handled; anything else is left verbatim)."""
    out = py
    out = out.replace(r"[^\S\n]", HWS)
    out = out.replace(r"[\d\s\-()]", f"[{DIGIT}{WS_INNER}\\-()]")
    out = out.replace(r"[\dA-Za-z]", f"[{DIGIT}A-Za-z]")
    out = out.replace(r"\s", WS)
    out = out.replace(r"\d", DIGIT)
    out = out.replace(r"\b", BOUNDARY)
    out = out.replace("(.+)", "([^\\n]+)")
    if fold_digits:
        out = out.replace("A-Za-z0-9", f"A-Za-z0-9{AR_DIGIT_RANGE}")
        out = out.replace("[A-Z0-9]", f"[A-Z0-9{AR_DIGIT_RANGE}]")
        out = out.replace("[12]", r"[12\x{661}\x{662}]")
    return out


@lru_cache(maxsize=None)
def java_pattern(rule: R.Rule) -> str:
    """Java pattern whose *value* is wrapped for sentinel marking.

    Structured rules: the whole match is the value.  Label rules: the trailing
    group is the value and everything before it becomes group 1.
    """
    if rule.family == "structured":
        py = rule.python_pattern
        # A ``\b`` next to a token that can only match a word character is
        # one-sided: before it, "previous char is not a word char"; after it,
        # "next char is not a word char".  Same matches, one look-around
        # instead of two look-around pairs at every text position.
        if py.startswith(r"\b") and py[2:].startswith(("[A-Z]", r"(?:\d")):
            py = "\0LEAD" + py[2:]
        if py.endswith(r"\b") and py[:-2].endswith(("[A-Z0-9]){11,30}", r"\d{1,3}")):
            py = py[:-2] + "\0TRAIL"
        out = _translate(py, fold_digits=True)
        return out.replace("\0LEAD", f"(?<!{WORD})").replace("\0TRAIL", f"(?!{WORD})")
    py = rule.python_pattern
    idx = py.rfind("(")
    assert py[idx:idx + 3] != "(?:", "label value group must be last"
    prefix, value = py[:idx], py[idx:]
    # under IGNORECASE Python's A-Z also takes the Kelvin sign and dotted capital I
    value = value.replace("[A-Z0-9", r"[A-Z\x{212A}\x{130}0-9")
    return "(?iu)(" + _translate(prefix, False) + ")" + _translate(value, False)


def marker_replacement(rule: R.Rule) -> str:
    if rule.family == "structured":
        return R.SENTINEL_OPEN + "$0" + R.SENTINEL_CLOSE
    return "$1" + R.SENTINEL_OPEN + "$2" + R.SENTINEL_CLOSE


def either_order(phrase: str, quote=lambda w: "\\Q" + w + "\\E", gap: str = WS + "+") -> str:
    """Regex group for the words of a phrase as written or last to first."""
    words = tuple(map(quote, phrase.split()))
    orders = dict.fromkeys([words, words[::-1]])             # a single word has one order
    return "(?:" + "|".join(gap.join(o) for o in orders) + ")"


def line_label_pattern(phrases: list[str], quote=None) -> str:
    return "|".join(either_order(p, quote) if quote else either_order(p) for p in phrases)


def line_label_union() -> str:
    return "|".join(line_label_pattern(ph) for _, ph in R.LINE_LABEL_SPECS)


def label_gate(rule: R.Rule) -> str:
    """Cheap test implied by a label rule: its label alternation occurs."""
    py = rule.python_pattern
    depth, i = 0, 0
    while True:                              # end of the leading (?:...) group
        ch = py[i]
        if ch == "\\":
            i += 2
            continue
        depth += ch == "("
        depth -= ch == ")"
        i += 1
        if depth == 0:
            break
    return "(?iu)" + _translate(py[:i], False)


def label_words(rules) -> list[str]:
    """Lower-case literal heads of the rules' label alternatives: a text without
    any of them matches none of the rules."""
    heads = []
    for rule in rules:
        py = rule.python_pattern
        inner = py[py.index("(?:") + 3:]
        for alternative in inner.replace("(?:no\\.?|number)", "").replace("(?:", "").split(")")[0].split("|"):
            head = re.match("[a-z ]+", alternative)
            if head is not None:
                heads.append(head[0].rstrip())
    return sorted(h for h in set(heads) if not any(o != h and o in h for o in heads))

"""License scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

Texts become sequences of words (runs of digits, letters a-z after lower-casing A-Z, and bytes from
128); one automaton finds notice phrases and identifier tags in the words joined by single spaces, so
a match always covers whole words. After an identifier tag the expression on the rest of its line is
parsed: ``with`` binds tighter than ``and``, ``and`` tighter than ``or``. The parse gives the expression in
reverse Polish order, its identifiers, and whether a set of permitted licences satisfies it.

Cases: null and empty texts have no words and no places (first and last are null, labels empty,
score 0); overlapping places all count; malformed expressions and words that are no licence give no identifiers;
texts of any length are scanned whole; equal rows give equal rows; null doc_ids pass through; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rangeframe.llm.common import map_text

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notice phrases of well-known licences, and the labels that this scan adds.
NOTICES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
#: Licences that satisfy an expression by default.
PERMITTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0"})

# Identifiers of common licences in the SPDX list, in lower case; an expression's operands are these,
# these with a "+", and LicenseRef-... names. ``Scanner`` takes further ones.
IDENTIFIERS = frozenset(
    """0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0
    artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear
    bsd-3-clause-lbnl bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0
    cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0
    cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 etalab-2.0 eupl-1.1
    eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only
    gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc json lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later
    lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libpng-2.0 libtiff lppl-1.3c mit mit-0
    mit-cmu mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd nposl-3.0 odbl-1.0 odc-by-1.0 ofl-1.0
    ofl-1.1 openssl osl-2.1 osl-3.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat sspl-1.0 tcl
    unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xfree86-1.1 zend-2.0 zlib zpl-2.0 zpl-2.1""".split()
)

_TAG_LINE = re.compile(r"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[ \t]*:?[ \t]*([^\n]*)")
_TOKEN = re.compile(r"\(|\)|/|[0-9a-z][0-9a-z.+:-]*")
_REFERENCE = re.compile(r"(?:documentref-[0-9a-z.-]+:)?licenseref-[0-9a-z.-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}

#: What words are made of, as a translation of UTF-8 bytes: A-Z to a-z, other bytes below 128 to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def to_postfix(expression: str, identifiers: frozenset[str] = IDENTIFIERS) -> list[str] | None:
    """Reverse Polish order of a licence expression (lower case); None if there is none or it is malformed.

    The expression ends where what follows is no part of one: a word that is no licence, also behind an operator
    ("MIT and this file": mit). A slash between two licences is an "or". After "with" any name is an exception.
    """
    out: list[str] = []
    stack: list[str] = []
    whole: list[str] | None = None  # what was complete last, outside of parentheses
    operand_next, exception_next = True, False
    for t in _TOKEN.findall(expression.lower()):
        t = "or" if t == "/" else t
        if t in _BINDS:
            if operand_next:
                if whole is None:
                    return None
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand_next, exception_next = True, t == "with"
            continue
        if t == "(":
            if not operand_next or exception_next:
                break
            stack.append(t)
            continue
        if t == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif operand_next and (exception_next or t in identifiers or t.removesuffix("+") in identifiers or _REFERENCE.fullmatch(t)):
            out.append(t)
            operand_next = exception_next = False
        else:
            break
        if "(" not in stack:
            whole = out + stack[::-1]
    else:
        if operand_next or "(" in stack:
            return None
    return whole


@dataclass(frozen=True)
class Value:
    ids: tuple[str, ...]
    permitted: bool


def evaluate(postfix: list[str], permitted: frozenset[str] = PERMITTED) -> Value | None:
    """Identifiers of an expression and whether the permitted licences satisfy it; None if malformed.

    ``a with e`` stands for licence a under exception e: an exception only adds permissions.
    """
    stack: list[Value] = []
    for t in postfix:
        if t not in _BINDS:
            stack.append(Value((t,), t in permitted))
            continue
        if len(stack) < 2:
            return None
        b, a = stack.pop(), stack.pop()
        if t == "with":
            if len(a.ids) != 1 or len(b.ids) != 1:
                return None
            stack.append(Value((f"{a.ids[0]} with {b.ids[0]}",), a.permitted))
        else:
            stack.append(Value(a.ids + b.ids, (a.permitted and b.permitted) if t == "and" else (a.permitted or b.permitted)))
    return stack[0] if len(stack) == 1 else None


class Scanner:
    """The automaton over phrases of whole words."""

    def __init__(self, permitted: frozenset[str] = PERMITTED, identifiers: frozenset[str] = IDENTIFIERS):
        import ahocorasick

        self.permitted, self.identifiers = permitted, identifiers
        self.automaton = ahocorasick.Automaton()
        for phrase in {**NOTICES, **BASE, TAG: ""}:
            self.automaton.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> dict:
        words = text.translate(_FOLD).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        base: dict[str, list[int]] = {}
        own: set[str] = set()
        tagged = False
        last_char, last_word = 0, 0
        for end, (phrase, size) in sorted(self.automaton.iter(line), key=lambda x: x[0] - x[1][1]):
            start = end - size + 1
            last_word += line.count(" ", last_char, start)
            last_char = start
            if phrase in BASE:
                base.setdefault(BASE[phrase], []).append(last_word)
            if phrase in NOTICES:
                own.add(NOTICES[phrase])
            tagged |= phrase == TAG
        expressions: list[str] = []
        allowed: list[bool] = []
        if tagged:
            for m in _TAG_LINE.finditer(text.lower().decode("latin-1")):
                value = evaluate(p, self.permitted) if (p := to_postfix(m[1], self.identifiers)) else None
                if value:
                    expressions.append(" ".join(p))
                    allowed.append(value.permitted)
                    own.update(x.split(" with ")[0] for x in value.ids)
        places = [k for v in base.values() for k in v]
        evidence = len(places) + len(own) + 2 * len(expressions)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted({*base, *own})),
            "score": evidence / (evidence + 1.0),
            "expressions": expressions,
            "permitted": all(allowed) if allowed else None,
        }


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<string>, permitted boolean"
)


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", permitted: frozenset[str] = PERMITTED, identifiers: frozenset[str] = IDENTIFIERS
) -> DataFrame:
    """One row per document: places of base phrases, labels, parsed expressions and a score from 0 to 1."""

    def make():
        scanner = Scanner(permitted, identifiers)

        def work(texts: list[bytes]) -> dict:
            rows = [scanner.scan(t) for t in texts]
            return {k: [r[k] for r in rows] for k in rows[0]}

        return work

    return map_text(docs, [doc_id], text, FIELDS, make)


__all__ = ["BASE", "IDENTIFIERS", "Scanner", "evaluate", "license_scan", "to_postfix"]

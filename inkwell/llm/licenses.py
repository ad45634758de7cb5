"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser the expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import columns, map_rows

#: The contract's phrases and labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, as public license texts and notices word them.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
    "isc license": "isc",
    "boost software license": "bsl",
}
TAG = "spdx license identifier"
_TAG_TEXT = re.compile(r"(?i:spdx-license-identifier)[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: Binding strength: WITH before AND before OR.
_STRENGTH = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: SPDX ids that count as licenses and exceptions, in lower case; LicenseRef-... and DocumentRef-... count too.
KNOWN_IDS = frozenset(
    """
0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 bzip2-1.0.6
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0
cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later
gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0+ gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0+ gpl-3.0-only gpl-3.0-or-later hpnd icu ijg isc
lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1+ lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0+ lgpl-3.0-only lgpl-3.0-or-later libpng libpng-2.0 lppl-1.3c
mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby
sgi-b-2.0 sleepycat tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception openssl-exception
""".split()
)


def is_known(license_id: str) -> bool:
    return license_id in KNOWN_IDS or license_id.startswith(("licenseref-", "documentref-"))


@dataclass(frozen=True)
class Expression:
    """An expression in postfix order, as the shunting-yard gives it: ids, and operators behind their two parts.

    Whatever is asked of it is one walk with a stack, so no expression is too deep.
    """

    tokens: tuple[str, ...]

    def ids(self) -> set[str]:
        """The ids, those joined by WITH as one."""
        held: list[str] = []  # WITH joins two ids, so only ids wait for it
        out: set[str] = set()
        for token in self.tokens:
            if token == "with":
                right = held.pop()
                held.append(f"{held.pop()} with {right}")
            elif token not in _STRENGTH:
                held.append(token)
            else:
                out.update(held)
                held.clear()
        return out | set(held)

    def allows(self, accepted: set[str]) -> bool:
        """Whether a user who accepts these ids may use the work: OR any part, AND all; WITH needs its license or the pair."""
        held: list[bool] = []
        for k, token in enumerate(self.tokens):
            if token not in _STRENGTH:
                held.append(token in accepted)
                continue
            right, left = held.pop(), held.pop()
            if token == "with":
                held.append(left or f"{self.tokens[k - 2]} with {self.tokens[k - 1]}" in accepted)
            else:
                held.append(left and right if token == "and" else left or right)
        return held[0]

    def unknown(self) -> bool:
        return not all(token in _STRENGTH or is_known(token) for token in self.tokens)


def show(expression: Expression) -> str:
    """Infix, with parentheses around every operator. Ids stand in the same order as in postfix."""
    begins: list[int] = []  # of each part on the stack, its first id
    opened, closed, before, ids = [], [], [], []
    for token in expression.tokens:
        if token not in _STRENGTH:
            begins.append(len(ids))
            ids.append(token)
            opened.append(0)
            closed.append(0)
            before.append("")
        else:
            before[begins.pop()] = f" {token} "  # the operator stands before its right part
            opened[begins[-1]] += 1
            closed[-1] += 1
    return "".join(f"{b}{'(' * o}{x}{')' * c}" for b, o, x, c in zip(before, opened, ids, closed, strict=True))


def parse_expression(text: str) -> tuple[Expression | None, bool]:
    """The longest well-formed expression at the start of text, by shunting-yard, and whether anything was malformed.

    Ids become lower case. A second operand in a row ends the expression ("MIT for details" is MIT); so does a
    closing parenthesis that nothing opened. Unclosed parentheses and operators without an operand spoil it. An unknown
    id is malformed; an expression without any known one is none ("banana phone").
    """
    output: list[str] = []
    stack: list[str] = []
    plain: list[bool] = []  # of each part whether it is a single id, as WITH needs on both sides
    opened = 0

    def reduce() -> bool:
        op = stack.pop()
        right, left = plain.pop(), plain.pop()
        output.append(op)
        plain.append(False)
        return op != "with" or (left and right)

    at, operand_next = 0, True
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
            opened += 1
        elif token == ")":
            if not opened:
                break
            if operand_next:
                return None, True
            while stack[-1] != "(":
                if not reduce():
                    return None, True
            stack.pop()
            opened -= 1
        elif token in _STRENGTH:
            if operand_next:
                return None, True
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[token]:
                if not reduce():
                    return None, True
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                break
            output.append(token.rstrip(".:") or token)
            plain.append(True)
            operand_next = False
        at = m.end()
    if operand_next or opened:
        return None, True
    while stack:
        if not reduce():
            return None, True
    found = Expression(tuple(output))
    if not any(is_known(t) for t in found.tokens if t not in _STRENGTH):
        return None, True
    return found, found.unknown()


def normal_words(text: str) -> list[str]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Bytes of other characters stay."""
    return text.encode().translate(_FOLD).decode().split(" ")


class Scanner:
    """An Aho-Corasick automaton over normalised words; built once for each worker."""

    def __init__(self, phrases: dict[str, str] | None = None) -> None:
        import ahocorasick

        extra = NOTICE_PHRASES if phrases is None else phrases
        self.automaton = ahocorasick.Automaton()
        for phrase, label in {**extra, **BASE_PHRASES, TAG: ""}.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label))
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        words = [w for w in normal_words(text) if w]
        joined = f" {' '.join(words)} "
        base: list[tuple[int, str]] = []
        notices: list[tuple[int, str]] = []
        tagged, spaces, counted = False, 0, 0
        for end, (phrase, label) in self.automaton.iter(joined):  # by rising end, so that each space counts once
            if phrase == TAG:
                tagged = True
                continue
            spaces, counted = spaces + joined.count(" ", counted, end), end
            place = spaces - phrase.count(" ") - 1
            (base if phrase in BASE_PHRASES else notices).append((place, label))
        expressions, malformed = [], False
        if tagged:
            for m in _TAG_TEXT.finditer(text):
                node, bad = parse_expression(m[1])
                malformed |= bad
                if node is not None:
                    expressions.append(node)
        return {"n_words": len(words), "base": sorted(base), "notices": sorted(notices), "expressions": expressions, "malformed": malformed}


#: Ids under which text may be reused freely, for the operator's verdict.
PERMISSIVE = frozenset({"mit", "apache-2", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd", "isc", "cc0", "cc0-1.0", "cc-by", "cc-by-4.0", "public-domain", "unlicense", "0bsd", "bsl", "bsl-1.0", "zlib"})

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<string>, permissive boolean, malformed boolean"
)


def confidence(found: dict) -> float:
    """How sure it is that the text states a license: 1 for a valid tag, else 1 - 2^-(2 a base place and 1 another notice)."""
    if found["expressions"]:
        return 1.0
    return 1.0 - 0.5 ** (2 * len(found["base"]) + len(found["notices"]))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: words, phrase places, labels, parsed expressions, verdict and score.

    permissive: null without any label; else all expressions can be satisfied from PERMISSIVE and all notices are in
    it. expressions: every operator with its parentheses. labels name known ids (KNOWN_IDS, LicenseRef-...) only; malformed
    tells of others. Expressions may be of any length and depth. Null texts count as empty; rows are independent, so repeated ids and rows stay; an empty table gives no rows.
    Narrow: no shuffle.
    """
    scanner: list[Scanner] = []

    def batch(rows: dict) -> dict:
        if not scanner:
            scanner.append(Scanner())
        out: dict[str, list] = {n.split()[0]: [] for n in SCHEMA.split(", ")}
        for key, text in zip(rows["doc_id"], rows["text"], strict=True):
            found = scanner[0].scan(text or "")
            places = [p for p, _ in found["base"]]
            base = sorted({x for _, x in found["base"]})
            notices = {x for _, x in found["notices"]}
            stated = {x for n in found["expressions"] for x in n.ids() if is_known(x.partition(" with ")[0])}
            labels = sorted(set(base) | notices | stated)
            free = None
            if labels:
                free = all(n.allows(set(PERMISSIVE)) for n in found["expressions"]) and all(x in PERMISSIVE for x in notices | set(base))
            for name, value in zip(
                out,
                (key, found["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), confidence(found), [show(n) for n in found["expressions"]], free, found["malformed"]),
                strict=True,
            ):
                out[name].append(value)
        return out

    return map_rows(columns(df, doc_id=id_col, text=text_col), batch, SCHEMA)

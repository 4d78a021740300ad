"""Operator 3: licence scans.

One Aho-Corasick automaton over the plain words of a text finds notice phrases, a second one over the lower-cased bytes
finds identifier tags; the expression after a tag is parsed by shunting-yard and evaluated.

Cases: a null or empty text has no words, no labels and score 0; a phrase counts wherever its words stand one after
another, whatever stands between them, overlaps included; a malformed expression gives the identifiers that it names
and is scored as if all applied; an expression ends at its line's end or before the first word that cannot continue it; texts of any length are scanned whole; repeated rows give repeated results; labels that several phrases give
count once; an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import LOWER, PLAIN, slices

#: The contract's phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of well-known licences.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "eclipse public license": "epl",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "isc license": "isc",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
#: How freely a text under each licence may be used, from 0 to 1; others have OTHER.
FREE = {"gpl": 0.4, "agpl": 0.3, "lgpl": 0.5, "mpl": 0.6, "epl": 0.6, "apache": 0.9, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc-by": 0.8, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "proprietary": 0.1}
OTHER = 0.2
#: What an exception adds to the licence it is attached to.
EXCEPTION = 0.1
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: What may stand around an expression or end it.
AROUND = " \t\r*/#-<>!\"';,."
LEAD = re.compile(f"[{re.escape(AROUND)}]*")
#: First parts of the other licence identifiers in public use.
OTHERS = frozenset("""
0bsd aal afl apsl artistic beerware blueoak boost bsl bzip2 caldera cc cddl cdla cecill cern copyleft cpal cpl curl ecl efl entessa
epl eupl fair fdl frameworx fsfap ftl gfdl giftware hpnd ijg imagemagick intel ipl json latex lppl libpng libtiff lpl mirros
motosoto ms mulanpsl multics mysql nasa naist naumen ncsa netcdf ngpl nokia nosl npl ntp oclc odbl odc ofl ogl oldap openssl
osl pddl php postgresql psf python qpl rpl rpsl ruby saxpath sgi simpl sissl sleepycat sspl sun tcl torque ucl unicode upl vim vsl
w3c watcom wtfpl x11 xnet xpp zend zimbra zlib zpl
""".split())
#: An identifier of a document's own, or of another document.
OWN = re.compile(r"(?:documentref-[0-9a-z.-]+:)?licenseref-[0-9a-z.-]+")
#: What an identifier is made of; a colon stands only in the form above.
NAME = re.compile(rf"{OWN.pattern}|[0-9a-z][0-9a-z.+-]*")
TOKEN = re.compile(r"[^\S\n]*([()]|[^\s()]+)")


def family(identifier: str) -> str:
    """The label of an identifier: GPL-3.0-only, gpl-2.0+ and gplv2 are gpl."""
    name = identifier.rstrip("+")
    for one in (name, re.sub(r"-?v?[0-9][0-9.]*$", "", name)):
        for label in sorted(FREE, key=len, reverse=True):
            if one == label or one.startswith(label + "-"):
                return label
    return name


def known(name: str) -> bool:
    """Whether a name is a licence: of a family in FREE or in OTHERS, or of the form LicenseRef-..."""
    return family(name) in FREE or re.split(r"[-+]", name)[0] in OTHERS or OWN.fullmatch(name) is not None


def exception(name: str) -> bool:
    return "exception" in name or name.startswith("additionref-") or name == "linux-syscall-note"


def postfix(expression: str) -> tuple[list[str], bool]:
    """Shunting-yard: operands and operators in postfix order, and whether the expression is well formed."""
    out, stack, good, operand = [], [], True, False
    for t in expression.replace("(", " ( ").replace(")", " ) ").split():
        if t in OPERATORS:
            good &= operand
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            good &= not operand
            stack.append(t)
        elif t == ")":
            good &= operand and "(" in stack
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            good &= not operand
            out.append(t)
            operand = True
    good &= operand and "(" not in stack
    out += [t for t in reversed(stack) if t != "("]
    return out, good


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and freedom of an expression: `or` lets the reader choose the freest, `and` binds to the least free, `with` loosens."""
    terms, good = postfix(expression)
    names = [t for t in terms if t not in OPERATORS]
    if not names:
        return set(), 0.0
    if good:
        stack: list[tuple[set[str], float]] = []
        for t in terms:
            if t not in OPERATORS:
                stack.append(({family(t)}, FREE.get(family(t), OTHER)))
                continue
            (right, b), (left, a) = stack.pop(), stack.pop()
            if t != "with" and len(left) < len(right):
                left, right = right, left
            if t == "with":
                stack.append((left, min(1.0, a + EXCEPTION)))
            else:
                left |= right  # the smaller into the larger, so that long expressions take no copies
                stack.append((left, max(a, b) if t == "or" else min(a, b)))
        return stack[0]
    labels = {family(t) for t in names}
    return labels, min(FREE.get(x, OTHER) for x in labels)


def expression(text: str, at: int) -> str:
    """The tokens from `at` on for as long as they form an expression of licences on one line, however long that is; a word that is no licence ends it."""
    at = LEAD.match(text, at).end()
    out, depth, operand = [], 0, False
    while m := TOKEN.match(text, at):
        t, at = m[1], m.end()
        if t == ")":
            if not (operand and depth):
                break
            depth -= 1
        elif t == "(":
            if operand:
                break
            depth += 1
        elif (t in OPERATORS) != operand:
            break
        else:
            bare = own[0].rstrip(AROUND) if (own := NAME.match(t)) else ""
            if t not in OPERATORS and not (exception(bare) if out and out[-1] == "with" else known(bare)):
                break
            out.append(bare)
            if bare != t:
                break
            operand = not operand
            continue
        out.append(t)
    return " ".join(out)


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None):
        self.base = dict(BASE if phrases is None else phrases)
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for p, label in (MORE | self.base).items():
            self.phrases.add_word(f" {p} ", (len(p) + 2, label, p in self.base))
        for t in TAGS:
            self.tags.add_word(t, len(t))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def __call__(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(PLAIN).split()
        line = " " + b" ".join(words).decode("latin-1") + " "  # a byte a letter
        starts: list[int] = []
        base, labels, free = set(), set(), []
        at, seen = 0, 0
        for end, (size, label, is_base) in self.phrases.iter(line):
            labels.add(label)
            if is_base:
                base.add(label)
                place = end - size + 1
                if place >= at:
                    seen, at = seen + line.count(" ", at, place), place
                    starts.append(seen)
                else:
                    starts.append(line.count(" ", 0, place))
        free = [FREE.get(x, OTHER) for x in labels]
        low = text.translate(LOWER).decode("latin-1") if b":" in text else ""
        for end, _ in self.tags.iter(low):
            own, score = evaluate(expression(low, end + 1))
            labels |= own
            free += [score] * bool(own)
        # Every notice binds, so a text is as free as the least free of them.
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(free, default=0.0)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places, labels and freedom of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases)
        for batch in batches:
            for b in slices(batch, text_col):
                rows = [scanner(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
                long, text = pa.int64(), pa.string()
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (long, long, long, long, text, text, pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")

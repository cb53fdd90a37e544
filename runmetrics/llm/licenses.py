"""License scans: notice phrases and identifier tags by Aho-Corasick, license expressions by a shunting yard.

Words are the runs of a-z, 0-9 and characters beyond ASCII in the text with A-Z lower-cased. Phrases are found where
their words stand consecutively, at all places, overlapping ones too. ``BASE`` phrases give the base labels and places;
``NOTICES`` add labels. Behind an identifier tag the longest begin of the line that is an expression of known licences,
and, or, with and brackets counts, whatever prose follows; its licences add labels, and ``permissive`` says whether it
allows a choice of permissive licences alone (null without an expression). ``score`` is the share of words inside found
phrases.

Null texts count as empty: no words, no labels (empty strings), score 0. Texts are scanned whole. Tags without an
expression behind them are counted in ``malformed``. Repeated rows give repeated results, an empty table none; other
columns take no part.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import per_text

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "bsd license": "bsd",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "spdx-license-expression:", "license-expression:")
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "0bsd")
# Families of the public licence list, without versions and variants behind a hyphen.
FAMILIES = (
    "0bsd", "aal", "afl", "agpl", "apache", "apl", "apsl", "artistic", "bittorrent", "blueoak", "bsd", "bsl", "bzip2", "cal", "catosl", "cc-by", "cc0",
    "cddl", "cdla", "cecill", "cern-ohl", "cpal", "cpl", "curl", "ecl", "efl", "elastic", "entessa", "epl", "eudatagrid", "eupl", "fair", "frameworx",
    "ftl", "gfdl", "gpl", "hpnd", "ibm-pibs", "icu", "ijg", "imagemagick", "intel", "ipa", "ipl", "isc", "json", "lgpl", "libpng", "libtiff", "lppl",
    "miros", "mit", "motosoto", "mpl", "ms-pl", "ms-rl", "mulanpsl", "multics", "nasa", "naumen", "ncsa", "ngpl", "nokia", "npl", "ntp", "oclc", "odbl",
    "odc-by", "ofl", "ogl", "ogtsl", "oldap", "openssl", "oset-pl", "osl", "pddl", "php", "postgresql", "psf", "python", "qpl", "rpl", "rpsl", "rscpl",
    "ruby", "simpl", "sissl", "sleepycat", "spl", "sspl", "tcl", "ucl", "unicode", "unlicense", "upl", "vim", "vsl", "w3c", "watcom", "wtfpl", "x11", "xnet", "zend",
    "zlib", "zpl",
)
# License ids whose label differs from the id in lower case.
SAME = {"apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3"}

_KEEP = b"abcdefghijklmnopqrstuvwxyz0123456789"
_FOLD = bytes(b if b >= 0x80 or b in _KEEP else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_LICENCE = re.compile(rf"(?:{'|'.join(FAMILIES)})(?:-[a-z0-9.-]+)?\+?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", re.IGNORECASE)
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|(?:documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+", re.IGNORECASE)
_LINE = re.compile("[^\r\n]*")
_BINDING = {"or": 1, "and": 2, "with": 3}


def tokens(expression: str) -> list[str]:
    found, at = [], 0
    expression = expression.rstrip()
    while at < len(expression):
        match = _TOKEN.match(expression, at)
        if not match:
            raise ValueError(f"unexpected {expression[at]!r}")
        found.append(match[1])
        at = match.end()
    return found


def postfix(expression: str) -> list[str]:
    """The expression in postfix order; ValueError where it isn't one."""
    out, stack, operand = [], [], True  # operand: one is due
    for token in tokens(expression):
        name = token.lower()
        if name in _BINDING:
            if operand:
                raise ValueError("an operator without a licence before it")
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[name]:
                out.append(stack.pop())
            stack.append(name)
            operand = True
        elif token == ")":
            if operand:
                raise ValueError("a bracket closes too early")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("a bracket too many")
            stack.pop()
        else:
            if not operand:
                raise ValueError("two licences side by side")
            if token == "(":
                stack.append(token)
            else:
                out.append(token)
                operand = False
    if operand or "(" in stack:
        raise ValueError("the expression ends too early")
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """The labels of an expression, and whether permissive licences alone can be chosen."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token in _BINDING:
            (labels, right), (more, left) = stack.pop(), stack.pop()
            # an exception is no licence of its own: it neither adds a label nor changes what its licence allows
            stack.append((more, left) if token == "with" else (labels | more, left and right if token == "and" else left or right))
        else:
            name = token.lower().rstrip("+")
            name = name.removesuffix("-only").removesuffix("-or-later")
            stack.append(({SAME.get(name, name)}, name.startswith(PERMISSIVE)))
    return stack.pop()


def leading(line: str) -> str | None:
    """The longest begin of ``line`` that is an expression of known licences; a full stop or colon behind a name ends it."""
    found, best, depth, at = [], 0, 0, 0
    before = ""  # the last token: a bracket, an operator, or a name
    while match := _TOKEN.match(line, at):
        token, at = match[1].rstrip(".:"), match.end()
        name = token.lower()
        due = before in ("", "(", *_BINDING)  # a licence, or after "with" an exception, or a bracket
        if name == "(":
            if not due or before == "with":
                break
            depth += 1
        elif name == ")":
            if due or not depth:
                break
            depth -= 1
        elif name in _BINDING:
            # an exception belongs to one licence
            if due or name == "with" and (before == ")" or len(found) > 1 and found[-2].lower() == "with"):
                break
        elif not due or not (_EXCEPTION if before == "with" else _LICENCE).fullmatch(token):
            break
        found.append(token)
        before = name if name in _BINDING or name in ("(", ")") else "name"
        if not depth and before in (")", "name"):
            best = len(found)
        if token != match[1]:
            break
    return " ".join(found[:best]) or None


class Scanner:
    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in NOTICES.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, label, False))
        for phrase, label in BASE.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, label, True))
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def expressions(self, text: str) -> list[str | None]:
        """What each identifier tag says, None where nothing can be read."""
        if "license-" not in (lower := text.lower() if text.isascii() else text.encode().lower().decode()):
            return []
        ends = [end + 1 for end, _ in self.tags.iter(lower)]
        return [leading(_LINE.match(text, end)[0]) for end in ends]

    def scan(self, text: str) -> tuple:
        words = text.encode().translate(_FOLD).split()
        line = b" ".join([b"", *words, b""]).decode("latin-1")
        found = sorted((end + 1 - chars, count, label, base) for end, (chars, count, label, base) in self.phrases.iter(line))
        at = place = covered = upto = 0
        places, base_labels, labels = [], set(), set()
        for begin, count, label, base in found:
            place += line.count(" ", at, begin)
            at = begin
            covered += max(0, place + count - max(upto, place))
            upto = max(upto, place + count)
            labels.add(label)
            if base:
                places.append(place)
                base_labels.add(label)
        permissive, malformed = None, 0
        for expression in self.expressions(text):
            if expression is None:
                malformed += 1
                continue
            more, allowed = evaluate(expression)
            labels |= more
            permissive = allowed if permissive is None else permissive and allowed
        return (len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base_labels)),
                ",".join(sorted(labels)), covered / len(words) if words else 0.0, permissive, malformed)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive, malformed."""
    def make():
        scanner = Scanner()
        return lambda texts: map(scanner.scan, texts)

    whole, text = pa.int64(), pa.string()
    fields = [("n_words", whole), ("n_base", whole), ("first_word", whole), ("last_word", whole), ("base_labels", text), ("labels", text),
              ("score", pa.float64()), ("permissive", pa.bool_()), ("malformed", whole)]
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_text(make, fields), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                             "base_labels string, labels string, score double, permissive boolean, malformed long")

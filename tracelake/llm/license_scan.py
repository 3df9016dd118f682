"""Licence notices and SPDX expressions.

One Aho-Corasick automaton over word-normalised text finds notice phrases and
identifier tags in a single pass. Where a colon follows a tag, the rest of its line is
parsed as a licence expression: a shunting-yard pass turns it into postfix order
(WITH binds closer than AND, AND closer than OR) and a stack evaluates its
restriction, from 0 (none found) to 1. A choice (OR) takes its lesser side, a
conjunction (AND) its greater, an exception (WITH) lowers its licence. Only
known licence ids and references (LicenseRef-) are operands, so prose after a
tag is no licence.

Defined results: a null or empty text has no words and no labels; places and
expressions are empty lists; score is 0. Equal rows give equal results, an empty
table none; a text of any length is scanned whole. A tag with no readable
expression adds nothing. A broken expression counts up to its last sound
operand; open brackets close at its end. Phrases that overlap all count; labels are
distinct and sorted. Only doc_id and text are read: extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm.words import WORD_IN_TEXT, normal_words, raw_texts

#: Phrases that always count, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: Licence ids as families: label, name, versions ("" for none), endings of an id.
GNU = ("", "+", "-only", "-or-later")
FAMILIES = (
    ("mit", "MIT", ("",), ("", "-0", "-CMU", "-Modern-Variant", "-feh", "-enna", "-advertising")),
    ("apache-2", "Apache", ("2.0",), ("",)),
    ("apache-1", "Apache", ("1.0", "1.1"), ("",)),
    ("bsd-2", "BSD-2-Clause", ("",), ("", "-Patent", "-Views", "-FreeBSD")),
    ("bsd-3", "BSD-3-Clause", ("",), ("", "-Clear", "-LBNL", "-Attribution", "-Modification")),
    ("bsd-1", "BSD-1-Clause", ("",), ("",)),
    ("bsd-4", "BSD-4-Clause", ("",), ("", "-UC")),
    ("0bsd", "0BSD", ("",), ("",)),
    ("isc", "ISC", ("",), ("",)),
    ("zlib", "Zlib", ("",), ("", "-acknowledgement")),
    ("boost", "BSL", ("1.0",), ("",)),
    ("busl", "BUSL", ("1.1",), ("",)),
    ("python", "PSF", ("2.0",), ("",)),
    ("python", "Python", ("2.0", "2.0.1"), ("",)),
    ("postgresql", "PostgreSQL", ("",), ("",)),
    ("ncsa", "NCSA", ("",), ("",)),
    ("x11", "X11", ("",), ("",)),
    ("curl", "curl", ("",), ("",)),
    ("openssl", "OpenSSL", ("",), ("",)),
    ("unicode", "Unicode", ("3.0", "DFS-2015", "DFS-2016", "TOU"), ("",)),
    ("w3c", "W3C", ("",), ("", "-19980720", "-20150513")),
    ("artistic", "Artistic", ("1.0", "2.0"), ("", "-Perl", "-cl8")),
    ("afl", "AFL", ("1.1", "1.2", "2.0", "2.1", "3.0"), ("",)),
    ("ecl", "ECL", ("1.0", "2.0"), ("",)),
    ("ms-pl", "MS-PL", ("",), ("",)),
    ("wtfpl", "WTFPL", ("",), ("",)),
    ("public-domain", "Unlicense", ("",), ("",)),
    ("public-domain", "PDDL", ("1.0",), ("",)),
    ("cc0", "CC0", ("1.0",), ("",)),
    ("cc-by", "CC-BY", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-sa", "CC-BY-SA", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nd", "CC-BY-ND", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nc", "CC-BY-NC", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nc-sa", "CC-BY-NC-SA", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nc-nd", "CC-BY-NC-ND", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("odbl", "ODbL", ("1.0",), ("",)),
    ("odc-by", "ODC-By", ("1.0",), ("",)),
    ("ofl", "OFL", ("1.0", "1.1"), ("", "-RFN", "-no-RFN")),
    ("mpl", "MPL", ("1.0", "1.1", "2.0"), ("", "-no-copyleft-exception")),
    ("epl", "EPL", ("1.0", "2.0"), ("",)),
    ("eupl", "EUPL", ("1.0", "1.1", "1.2"), ("",)),
    ("cddl", "CDDL", ("1.0", "1.1"), ("",)),
    ("cpl", "CPL", ("1.0",), ("",)),
    ("ms-rl", "MS-RL", ("",), ("",)),
    ("osl", "OSL", ("1.0", "1.1", "2.0", "2.1", "3.0"), ("",)),
    ("lgpl", "LGPL", ("2.0", "2.1", "3.0"), GNU),
    ("gpl-1", "GPL", ("1.0",), GNU),
    ("gpl-2", "GPL", ("2.0",), GNU),
    ("gpl-3", "GPL", ("3.0",), GNU),
    ("agpl", "AGPL", ("1.0", "3.0"), GNU),
    ("gfdl", "GFDL", ("1.1", "1.2", "1.3"), GNU),
    ("sspl", "SSPL", ("1.0",), ("",)),
    ("elastic", "Elastic", ("2.0",), ("",)),
)
#: Id in lower case to label; callers may pass a longer table.
SPDX = {f"{name}{'-' * bool(version)}{version}{ending}".lower(): label for label, name, versions, endings in FAMILIES for version in versions for ending in endings}
#: Any id of this form is a licence that its own document defines; its label is the id.
REFERENCE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: What may stand after WITH.
EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|[a-z0-9.-]*-linking")
#: How much a label restricts use; others 0.6.
RESTRICTION = {
    "public-domain": 0.05, "cc0": 0.05, "wtfpl": 0.05, "0bsd": 0.05,
    "mit": 0.1, "isc": 0.1, "bsd-1": 0.1, "bsd-2": 0.1, "bsd-3": 0.1, "bsd-4": 0.1, "zlib": 0.1, "boost": 0.1, "python": 0.1, "postgresql": 0.1,
    "ncsa": 0.1, "x11": 0.1, "curl": 0.1, "openssl": 0.15, "unicode": 0.1, "w3c": 0.1, "artistic": 0.15, "afl": 0.15, "ecl": 0.15, "ms-pl": 0.15,
    "apache-1": 0.15, "apache-2": 0.15, "cc-by": 0.2, "odc-by": 0.2, "ofl": 0.2,
    "mpl": 0.4, "epl": 0.4, "eupl": 0.4, "cddl": 0.4, "cpl": 0.4, "ms-rl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "odbl": 0.5, "gfdl": 0.5, "osl": 0.7,
    "gpl": 0.7, "gpl-1": 0.7, "gpl-2": 0.7, "gpl-3": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95,
    "busl": 0.9, "sspl": 0.9, "elastic": 0.9, "all-rights-reserved": 1.0,
}
UNKNOWN = 0.6
BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[A-Za-z0-9.+:-]+|[()]|[^\s()]")
#: Between a tag and its expression.
COLON = re.compile(r"[ \t]*:[ \t]*")

SCHEMA = pa.schema([
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))),
    ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("restriction", pa.float64())]))),
    ("labels", pa.list_(pa.string())),
    ("score", pa.float64()),
])
DDL = (
    "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string,base:boolean>>,"
    " expressions array<struct<expression:string,labels:array<string>,restriction:double>>, labels array<string>, score double"
)


def label_of(operand: str, spdx: dict[str, str] = SPDX) -> str | None:
    """The label of a licence id in lower case, None of anything else."""
    if operand in spdx or operand.rstrip("+") in spdx:
        return spdx.get(operand) or spdx[operand.rstrip("+")]
    return operand if REFERENCE.fullmatch(operand) else None


def postfix(tokens: list[str], known: Callable[[str, bool], object] = lambda _, after_with: True) -> list[str]:
    """Shunting-yard: operands and operators in postfix order, up to the first token out of place or operand not known."""
    out: list[str] = []
    held: list[str] = []
    want_operand = True
    for token in tokens:
        low = token.lower().rstrip(".:")
        if want_operand:
            if low == "(":
                held.append("(")
            elif low in BINDING or low == ")" or not known(low, bool(held) and held[-1] == "with"):
                break
            else:
                out.append(low)
                want_operand = False
        elif low == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
        elif low in BINDING:
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[low]:
                out.append(held.pop())
            held.append(low)
            want_operand = True
        else:
            break
    if want_operand:  # the last operator lacks its right side; brackets after it are empty
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    return out + [x for x in reversed(held) if x != "("]


def evaluate(order: list[str], spdx: dict[str, str] = SPDX) -> tuple[list[str], float] | None:
    """Labels and restriction of an expression in postfix order; None of an empty one."""
    stack: list[tuple[list[str], float]] = []
    for x in order:
        if x not in BINDING:
            label = label_of(x, spdx) or x
            stack.append(([label], RESTRICTION.get(label, UNKNOWN)))
            continue
        (right, r), (left, s) = stack.pop(), stack.pop()
        stack.append((left, s / 2) if x == "with" else (left + right, min(r, s) if x == "or" else max(r, s)))
    return stack[0] if stack else None


@cache
def _automaton():
    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | PHRASES).items():
        found.add_word(f" {phrase} ", (len(phrase.split()), label, phrase in BASE_PHRASES))
    for tag in TAGS:
        found.add_word(f" {tag} ", (len(tag.split()), None, False))
    found.make_automaton()
    return found


def scan(raw: bytes, spdx: dict[str, str] = SPDX) -> tuple[int, list, list, list, float]:
    words = normal_words(raw)
    normal = f" {b' '.join(words).decode()} "
    places, expressions, seen, at = [], [], 0, 0
    text = ends = None
    for end, (length, label, base) in _automaton().iter(normal):
        seen, at = seen + normal.count(" ", at, end), end
        if label:
            places.append({"word": seen - length, "label": label, "base": base})
            continue
        if text is None:
            text = raw.decode()
            ends = [m.end() for m in WORD_IN_TEXT.finditer(text)]
        colon = COLON.match(text, ends[seen - 1])
        if not colon:
            continue
        stop = text.find("\n", colon.end())
        line = text[colon.end() : stop if stop >= 0 else len(text)]
        order = postfix(TOKEN.findall(line), lambda x, after_with: EXCEPTION.fullmatch(x) if after_with else label_of(x, spdx))
        if value := evaluate(order, spdx):
            expressions.append({"expression": line.strip(), "labels": value[0], "restriction": value[1]})
    labels = sorted({x["label"] for x in places} | {y for x in expressions for y in x["labels"]})
    score = max([RESTRICTION.get(x["label"], UNKNOWN) for x in places] + [x["restriction"] for x in expressions], default=0.0)
    return len(words), places, expressions, labels, score


def license_scan(docs: DataFrame, spdx: dict[str, str] | None = None) -> DataFrame:
    """Per document: n_words, places of phrases, licence expressions, labels and score. spdx: ids in lower case with their labels, beside those known here."""
    ids = SPDX | (spdx or {})

    def run(batches):
        for batch in batches:
            found = [scan(x, ids) for x in raw_texts(batch)]
            columns = [batch.column(0), *(list(x) for x in zip(*found, strict=True))] if found else [[] for _ in SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, DDL)

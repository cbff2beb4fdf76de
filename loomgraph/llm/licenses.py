"""License scans: notices by an Aho-Corasick automaton, licence expressions by a shunting-yard parser.

Method: a text's bytes are lower-cased (A-Z only). One pass of an automaton over them finds identifier tags, and what follows a tag up to the end of its line is read as a licence expression of
identifiers, and, or, with and parentheses. A second pass runs over the text's words, joined by single spaces, and finds the places where the words of a notice phrase stand consecutively, whatever
punctuation is between them. Both passes are linear in the text, whatever the number of patterns.

An expression has a score between 0 (nothing is allowed) and 1 (everything is): ``and`` takes the smaller, ``or`` the larger of its sides, ``with`` lifts its left side to the exception's score. The score of a text is the least of its
expressions' and notices', since all of them hold; a text that says nothing has NOTHING.

Scale and skew: one map over the rows, without a shuffle; a text is held as bytes, as words and as one string of them.

Defined results: a null text is empty; it has no words, no places and the score NOTHING. Repeated rows and rows without an id are rows of their own; columns besides the id and the text are ignored; an empty table gives an empty
result. An expression ends where its grammar does (at a second operand, at the line's end, at a sign that no identifier has); one that ends within an operator or with parentheses open is evaluated as far as it goes and marked as not valid.
The tags in WEAK count only if their expression begins with a known identifier, as prose uses the same words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Notices that every scan looks for, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "boost software license": "bsl", "public domain": "public-domain", "cc0 1 0": "cc0-1.0", "cc by 4 0": "cc-by-4.0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nc 4 0": "cc-by-nc-4.0", "cc by sa 4 0": "cc-by-sa-4.0", "all rights reserved": "all-rights-reserved",
}
#: How much a label's licence allows, by the longest beginning of the label.
SCORES = {
    "0bsd": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "apache": 0.9, "artistic": 0.8, "bsd": 0.9, "bsl": 0.9, "cc-by": 0.9, "isc": 0.9, "mit": 0.9, "psf": 0.9, "python": 0.9, "zlib": 0.9,
    "cddl": 0.6, "epl": 0.6, "lgpl": 0.6, "mpl": 0.6, "cc-by-sa": 0.5, "odbl": 0.5, "gpl": 0.4, "agpl": 0.3, "sspl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.1, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.25
NOTHING = 0.5
#: What an exception lifts its licence to, by its ending; others lift nothing.
EXCEPTIONS = {"-exception": 0.6, "-exception-2.0": 0.6, "-exception-2.2": 0.6, "-exception-3.1": 0.6}
#: Tags before an expression; the weak ones are words of prose as well.
TAGS = ("spdx-license-identifier:", "license-expression:")
WEAK = ('"license":', "license:")

_WORD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in common.LOWER)
_TOKEN = re.compile(r"""[ \t"']*([()]|[a-z0-9][a-z0-9.+:-]*)""")
_RANK = {"or": 1, "and": 2, "with": 3}


def known(label: str) -> float | None:
    """The score of a label, None if no beginning of it is known."""
    for n in range(len(label), 1, -1):
        if label[:n] in SCORES and (n == len(label) or not label[n].isalpha()):
            return SCORES[label[:n]]
    return None


def _joined(op: str, left: float, right: tuple[str, float]) -> float:
    name, score = right
    if op == "and":
        return min(left, score)
    if op == "or":
        return max(left, score)
    return max([left, *(s for end, s in EXCEPTIONS.items() if name.endswith(end))])


def expression(text: str, at: int = 0) -> tuple[int, list[str], float, bool]:
    """(end, identifiers, score, valid) of the licence expression that begins at a place of a lower-case text.

    Operands and operators are stacked and joined as precedence allows: with binds before and, and before or. An expression without an identifier ends at its beginning with the score UNKNOWN.
    """
    begin, names, operands, operators, operand_next, valid = at, [], [], [], True, True

    def reduce_one() -> None:
        op, right, left = operators.pop(), operands.pop(), operands.pop()
        operands.append(("", _joined(op, left[1], right)))

    while m := _TOKEN.match(text, at):
        t = m[1].rstrip(":.") or m[1]
        if m[1].endswith(":"):  # the next tag
            break
        if t == "(":
            if not operand_next:
                break
            operators.append(t)
        elif t == ")":
            if operand_next or "(" not in operators:
                break
            while operators[-1] != "(":
                reduce_one()
            operators.pop()
        elif t in _RANK:
            if operand_next:
                break
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[t]:
                reduce_one()
            operators.append(t)
            operand_next = True
        else:
            if not operand_next:
                break
            names.append(t)
            score = known(t)
            operands.append((t, UNKNOWN if score is None else score))
            operand_next = False
        at = m.start(1) + len(t)
    if operand_next:  # it ends within an operator or before any operand
        valid = False
        while operators and len(operands) < 1 + sum(o != "(" for o in operators):
            operators.pop()
    while operators:
        if operators[-1] == "(":
            operators.pop()
            valid = False
        else:
            reduce_one()
    return (at, names, operands[0][1], valid) if operands else (begin, [], UNKNOWN, False)


@lru_cache(maxsize=2)
def _automata(extra: tuple[tuple[str, str], ...]):
    """The automaton over words, each phrase between spaces, and the one over tags."""
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *extra]:
        words.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for tag in TAGS + WEAK:
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scanned(text: bytes, notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items())) -> tuple[int, list[tuple[str, bool, int]], list[tuple[str, list[str], float, bool]], float]:
    """(number of words, places (label, base, first word) in the text's order, expressions (text, identifiers, score, valid), score) of a text."""
    by_words, by_tags = _automata(notices)
    words = text.translate(_WORD).split()
    joined = b" " + b" ".join(words) + b" "
    found = [(end - size + 1, label, base) for end, (size, label, base) in by_words.iter(joined.decode("latin-1"))] if words else []
    places = []
    if found:
        spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        at = np.searchsorted(spaces, [begin for begin, _, _ in found]).tolist()
        places = sorted((w, label, base) for w, (_, label, base) in zip(at, found, strict=True))
    low, expressions = text.translate(common.LOWER).decode("latin-1"), []
    for end, tag in by_tags.iter(low):
        stop, names, score, valid = expression(low, end + 1)
        if names and (tag in TAGS or known(names[0]) is not None):
            expressions.append((low[end + 1 : stop].strip(" \t\"'"), names, score, valid))
    scores = [score for _, _, score, _ in expressions] + [s for _, label, _ in places if (s := known(label)) is not None]
    return len(words), [(label, base, w) for w, label, base in places], expressions, min(scores, default=NOTHING)


PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())]))
EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("identifiers", pa.list_(pa.string())), ("score", pa.float64()), ("valid", pa.bool_())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """(id, n_words, places, expressions, score) of every row: where notices stand, what the tags' expressions say, and what the text allows."""
    common.ship(docs.sparkSession)
    extra, names = tuple(notices.items()), [id_col, "n_words", "places", "expressions", "score"]
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = "n_words long, places array<struct<label:string,base:boolean,word:bigint>>, expressions array<struct<text:string,identifiers:array<string>,score:double,valid:boolean>>, score double"

    def run(batches):
        for b in batches:
            made = [scanned(common.as_bytes(t.as_py()), extra) for t in b.column(1)]
            places = [[dict(zip(("label", "base", "word"), p, strict=True)) for p in m[1]] for m in made]
            expressions = [[dict(zip(("text", "identifiers", "score", "valid"), e, strict=True)) for e in m[2]] for m in made]
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.array(places, PLACES), pa.array(expressions, EXPRESSIONS), pa.array([m[3] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {out}")


def digests(scans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): the places of BASE notices counted, and the labels joined by commas."""
    base = F.filter("places", lambda p: p["base"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    of: Column = F.transform(base, lambda p: p["word"])
    every = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["identifiers"])))
    return scans.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(of).alias("first_word"), F.array_max(of).alias("last_word"), joined(F.transform(base, lambda p: p["label"])).alias("base_labels"),
        joined(every).alias("labels"), "score",
    )

"""License scans against plain searches, expressions against a recursive reading, and odd texts."""

import random
import re

import pyarrow.parquet as pq
import pytest

from loomgraph.llm import licenses, queries
from tests.llm.test_operators import docs_of, empty, odd, odd_texts  # noqa: F401


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def places(text, phrases):
    w = words(text)
    return len(w), sorted((i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def check(row, text):
    n, base = places(text, licenses.BASE)
    _, more = places(text, licenses.NOTICES)
    assert (row["n_words"], row["n_base"]) == (n, len(base))
    assert (row["first_word"], row["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
    assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
    assert {label for _, label in base + more} <= set(row["labels"].split(",")) | {""}
    assert row["labels"] == ",".join(sorted(set(row["labels"].split(",")))) and 0 <= row["score"] <= 1
    if not base and not more and "license" not in (text or "").lower():
        assert (row["labels"], row["score"]) == ("", licenses.NOTHING)


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    got = queries.op12_license_scan(spark, small).collect()
    assert len(got) == len(docs) and sum(r["n_base"] for r in got) > 0
    for r in got:
        check(r, docs[r["doc_id"]])


TEXTS = [
    "MIT License MIT License", "mit-license; Apache\n* License, GNU general   public license", "cc by cc by nc 4.0", "gnu general public licenses", "xmit license", "MIT\x00License", "CC BY", "mit license" * 3,
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nmore", "the GNU Affero General Public License", "All rights reserved. MIT License",
]


def test_odd_texts(spark, odd, empty):  # noqa: F811
    texts = [*odd_texts(), "same text here", "no id"]
    got = licenses.digests(licenses.scan(odd)).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(words(t)) for t in texts)
    assert licenses.digests(licenses.scan(empty)).collect() == []
    for r in licenses.digests(licenses.scan(docs_of(spark, [(i, "s", t) for i, t in enumerate(TEXTS)]))).collect():
        check(r, TEXTS[r["doc_id"]])


def test_long_text(spark):
    text = "filler " * 200_000 + "Apache License" + " filler" * 100_000 + " MIT License"
    (r,) = licenses.digests(licenses.scan(docs_of(spark, [(1, "s", text)]))).collect()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) == (300_004, 2, 200_000, 300_002, "apache,mit", 0.9)


@pytest.mark.parametrize(
    ("text", "end", "names", "score", "valid"),
    [
        ("mit", 3, ["mit"], 0.9, True),
        ("mit or gpl-3.0-only and all-rights-reserved", 43, ["mit", "gpl-3.0-only", "all-rights-reserved"], 0.9, True),
        ("(mit or gpl-3.0-only) and cc-by-nc-4.0", 38, ["mit", "gpl-3.0-only", "cc-by-nc-4.0"], 0.2, True),
        ("gpl-2.0-only with classpath-exception-2.0 or sspl-1.0", 53, ["gpl-2.0-only", "classpath-exception-2.0", "sspl-1.0"], 0.6, True),
        ("gpl-2.0-only with nothing-known", 31, ["gpl-2.0-only", "nothing-known"], 0.4, True),
        ("mit and", 7, ["mit"], 0.9, False),
        ("mit and (", 9, ["mit"], 0.9, False),
        ("(mit or (gpl-2.0", 16, ["mit", "gpl-2.0"], 0.9, False),
        ("mit\nand gpl-2.0", 3, ["mit"], 0.9, True),
        ("mit apache-2.0", 3, ["mit"], 0.9, True),
        ("mit) or gpl", 3, ["mit"], 0.9, True),
        ("mit. and so on", 3, ["mit"], 0.9, True),
        ("mitre", 5, ["mitre"], 0.25, True),
        ("and mit", 0, [], 0.25, False),
        ("", 0, [], 0.25, False),
        ("mit and license: mit", 7, ["mit"], 0.9, False),
    ],
)
def test_expressions(text, end, names, score, valid):
    assert licenses.expression(text) == (end, names, score, valid)


def test_expressions_against_recursion():
    """Random trees, written out with as many parentheses as precedence needs or more."""
    r, ids = random.Random(5), ["mit", "gpl-3.0", "cc-by-nc", "cc0-1.0", "mpl-2.0", "unheard-of"]

    def tree(depth):
        """(text, rank, score)"""
        if depth == 0 or r.random() < 0.2:
            name = r.choice(ids)
            score = licenses.UNKNOWN if licenses.known(name) is None else licenses.known(name)
            return (f"{name} with gcc-exception-3.1", 3, max(score, 0.6)) if r.random() < 0.2 else (name, 4, score)
        op, rank, f = r.choice([("and", 2, min), ("or", 1, max)])
        sides = [tree(depth - 1) for _ in range(2)]
        text = f" {op} ".join(f"({t})" if k < rank or r.random() < 0.2 else t for t, k, _ in sides)
        return text, rank, f(s for *_, s in sides)

    for _ in range(500):
        text, _, score = tree(5)
        end, _, got, valid = licenses.expression(text)
        assert (end, got, valid) == (len(text), score, True), text


def test_tags():
    read = lambda t: licenses.scanned(t.encode())[2:]
    assert read('{"license": "MIT", "x": 1}') == ([("mit", ["mit"], 0.9, True)], 0.9)
    assert read("license: see the file") == ([], licenses.NOTHING)
    assert read("// SPDX-License-Identifier: Foo-1.0 */") == ([("foo-1.0", ["foo-1.0"], 0.25, True)], 0.25)
    assert read("License: GPL-2.0 OR MIT. Apache License") == ([("gpl-2.0 or mit", ["gpl-2.0", "mit"], 0.9, True)], 0.9)
    many = licenses.scanned(b"license: mit and " * 20_000)
    assert len(many[2]) == 20_000 and not many[2][0][3]

"""Token files of rows that share an id, and tokenizers beyond 16-bit ids."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from loomgraph.llm import common, token_codec
from tests.llm.test_operators import PATH, docs_of


def test_hot_id(spark):
    """Rows of one id, and of none, fill several tasks, in the order of their texts."""
    rows = [(7, "s", f"{i:04d} text of a hot id") for i in range(400)] + [(None, "s", f"{i:04d} no id") for i in range(200)] + [(i, "s", "other") for i in range(20, 30)] + [(None, "s", None)]
    folder = common.scratch(spark, "hot-ids")
    manifest = token_codec.write_tokens(docs_of(spark, rows), folder, PATH)
    assert manifest.count() >= 3
    got = token_codec.read_tokens(manifest, folder).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    t, at = Tokenizer.from_file(PATH), 0
    for r, (_, _, text) in zip(got, want, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_wide_vocabulary(tmp_path):
    Tokenizer(models.WordLevel({f"w{i}": i for i in range((1 << 16) + 1)}, unk_token="w0")).save(str(tmp_path / "wide.json"))
    with pytest.raises(token_codec.FormatError, match="16 bits"):
        token_codec.LibraryWords(str(tmp_path / "wide.json"))

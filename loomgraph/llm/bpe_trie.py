"""BPE encoding by prefix-sharing trie traversal, and decoding.

Method: texts are split into words by the tokenizer's own pattern; the distinct words not met before are inserted into a
trie. Its depth-first traversal carries one state for each node, the last token of the encoding of the node's prefix:
the encoding of a prefix p is the encoding of p without its last token t, followed by t, and t is the only suffix token
of p that is compatible with the last token before it. A shared prefix is therefore encoded once for all words below it.
The trie is held as its sorted leaves: neighbours in byte order share exactly the path of their common prefix, and a
stack holds the states of the current path, so memory is the words' own and not one object for each node.

Defined results: a null text is an empty text (no ids, empty decoded text); repeated rows give repeated rows; an empty
table gives an empty result; columns besides the id and the text are ignored, whatever they are called.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose encodings a worker keeps in each of two generations; when the younger is full it becomes the older, whose unused words go. Forgetting costs time and changes no result.
KEPT_WORDS = 200_000
#: Characters of the longest word that is kept beyond its batch: bounds the bytes as well.
KEPT_LENGTH = 64
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Fixed by the vocabularies: the words of byte-level BPE.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?DIGIT+| ?OTHER+|\s+(?!\S)|\s+"


def _newer(path: str, kind: str, seed: str) -> str:
    """A character class body of what regex counts as that kind and the tokenizer's own splitter does not, since its Unicode tables are older."""
    from tokenizers import Tokenizer

    chars = regex.findall(rf"\p{{{kind}}}", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))
    pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str("".join(f" {seed}{c}" for c in chars))
    begins = {start for _, (start, _) in pieces}
    spans: list[list[int]] = []
    for i, c in enumerate(chars):
        if 3 * i + 2 in begins:
            if spans and spans[-1][1] == ord(c) - 1:
                spans[-1][1] += 1
            else:
                spans.append([ord(c), ord(c)])
    return "".join(f"\\U{lo:08X}-\\U{hi:08X}" for lo, hi in spans)


def _word_patterns(path: str):
    """(pattern for usual texts, pattern for texts with such newer characters, pattern that finds these or None)."""
    letters, digits = _newer(path, "L", "a"), _newer(path, "N", "0")
    usual = regex.compile(_WORDS.replace("LETTER", r"\p{L}").replace("DIGIT", r"\p{N}").replace("OTHER", r"[^\s\p{L}\p{N}]"))
    if not letters + digits:
        return usual, usual, None
    letter = rf"[\p{{L}}--[{letters}]]" if letters else r"\p{L}"
    digit = rf"[\p{{N}}--[{digits}]]" if digits else r"\p{N}"
    other = rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{letters}{digits}]]"
    return usual, regex.compile("(?V1)" + _WORDS.replace("LETTER", letter).replace("DIGIT", digit).replace("OTHER", other)), regex.compile(f"[{letters}{digits}]")


class Splitter:
    """Splits texts into the words that a byte-level BPE tokenizer merges within, and its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level files without prefix space and normaliser can be used")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._word, self._odd_word, self._odd = _word_patterns(path)

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if self._odd is None or text.isascii() or not self._odd.search(text):
            return self._word.findall(text)
        return self._odd_word.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if not any(m in text for m in self.special):
            return self.words(text)
        return [w for i, p in enumerate(self._cut.split(text)) for w in ([p] if i % 2 else self.words(p))]


class TrieBpe:
    """Encoder and decoder for a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("only BPE files can be used")
        self.split = Splitter(path)
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = self.split.special
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        # Tokens are numbered by the order in which merging makes them; a byte comes before any merge.
        vocab = model["vocab"]
        made: dict[str, int] = {c: b for c, b in letters.items() if c in vocab}
        parts: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self._pair: dict[int, int] = {}
        self._id = [vocab.get(c, -1) for c in sorted(letters, key=letters.get)]
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            a, b, whole = made[left], made[right], left + right
            if whole not in made:
                made[whole] = len(parts)
                parts.append((a, b))
                self._id.append(vocab[whole])
            self._pair.setdefault(a << 32 | b, made[whole])
        self._parts = parts
        self._token = {bytes(letters[c] for c in t): n for t, n in made.items()}
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        # Tokens read backwards, as nested maps from bytes; -1 holds the token that ends there.
        self._backwards: dict = {}
        for t, n in self._token.items():
            node = self._backwards
            for x in reversed(t):
                node = node.setdefault(x, {})
            node[-1] = n

    def _apart(self, a: int, b: int, bound: int) -> bool:
        """Whether no merge numbered below bound crosses the seam of two tokens: undo their merges in turn, latest first, and see that no earlier one would have joined the parts at the seam."""
        pair, parts = self._pair, self._parts
        while True:
            joined = pair.get(a << 32 | b)
            if joined is not None and joined < bound:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:  # the left token was finished after the right one
                bound, a = a, parts[a][1]
            else:  # of equal merges the left one is made first
                bound, b = b + 1, parts[b][0]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens side by side."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._apart(left, right, 1 << 60)
        return known

    def _whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self._alone.get(token)
        if known is None:
            a, b = self._parts[token]
            known = self._alone[token] = token < 256 or self._whole(a) and self._whole(b) and self._apart(a, b, token)
        return known

    def learn(self, words: set[str]) -> None:
        """Encode words that are not kept yet."""
        for special in words & self.special.keys():
            self.kept[special] = (self.special[special],)
        words = words - self.special.keys()
        backwards, ids, fits, compatible, whole = self._backwards, self._id, self._fits.get, self._compatible, self._whole
        path: list[int] = [-1]  # last token of each prefix of the current word
        length: list[int] = [0]
        before = b""
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            n, shared = len(data), 0
            for x, y in zip(data, before, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], length[shared + 1 :]
            for end in range(shared + 1, n + 1):
                # Of the tokens that end here one alone is compatible with what comes before it.
                node, start = backwards, end
                while True:
                    start -= 1
                    node = node[data[start]]
                    t = node.get(-1)
                    if t is not None:
                        if start:
                            key = path[start] << 32 | t
                            ok = fits(key)
                            if compatible(path[start], t) if ok is None else ok:
                                break
                        elif whole(t):
                            break
                path.append(t)
                length.append(end - start)
            before = data
            out, at = [], n
            while at:
                out.append(ids[path[at]])
                at -= length[at]
            self.kept[word] = tuple(reversed(out))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; special strings in a text become their special ids."""
        at = 0
        while at < len(texts):  # about two million characters at a time: their words are learnt together
            end, size = at, 0
            while end < len(texts) and (size < 2_000_000 or end == at):
                size += len(texts[end])
                end += 1
            cut = [self.split.pieces(text) for text in texts[at:end]]
            kept, older = self.kept, self._older
            wanted = {w for words in cut for w in words if w not in kept}
            if len(kept) + len(wanted) > KEPT_WORDS and kept:
                self._older = older = kept
                self.kept = kept = {}
                wanted = {w for words in cut for w in words}
            new = set()
            for w in wanted:
                if (known := older.get(w)) is None:
                    new.add(w)
                else:
                    kept[w] = known
            if new:
                self.learn(new)
            for words in cut:
                yield list(chain.from_iterable(map(kept.__getitem__, words)))
            for w in new:
                if len(w) > KEPT_LENGTH:
                    del kept[w]
            at = end

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """One encoder for each worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TrieBpe(path)
        # What is kept are plain maps and tuples without cycles: the collector need not walk them again and again.
        gc.freeze()
        gc.set_threshold(200_000, 20, 20)
    return _encoders[path]


def encoding_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, and with_ids its ids as array<int>.

    One narrow pass: texts go to a worker and encodings come back, nothing is shuffled.
    """
    common.ship(docs.sparkSession)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        bpe = encoder(tokenizer)
        decimal = {i: str(i) for i in bpe.bytes_of}.__getitem__
        sha = hashlib.sha256
        for b in batches:
            n, left, right, whole = [], [], [], []
            for ids in bpe.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                left.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                right.append(sha(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    whole.append(np.array(ids, dtype=np.int32))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())]
            if with_ids:
                flat = pa.array(np.concatenate(whole) if whole else np.zeros(0, dtype=np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

"""Token ids by the tokenizers library, each different word encoded once.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, and
those never reach from a word into the white space after it.  So a text can be
cut before each run of white space and the cuts encoded on their own.  Arrow
finds the different cuts of a few megabytes; those seen before come from a
cache in sorted arrays, keyed by a 128-bit hash, and the others go through the
library's BPE model many at a time.  The cache has a bound; what was not asked
for again leaves first.  Texts for which the cut might not be exact (unusual
white space, text that is not NFC, special tokens spelled out) go through the
whole tokenizer instead.  Long texts are cut like others, so memory follows
``CHUNK`` and the size of the longest text.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.textops import _SPACE, hash_spans, raw

#: Bytes of text whose different cuts are looked up at a time.
CHUNK = 2 << 20
_ODD = "[\\x00\\x1c-\\x1f\\x{85}\\x{a0}\\x{130}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Only texts with such characters can be out of NFC.
_HIGH = "[\\x{300}-\\x{10ffff}]"
# The patterns of the two public pre-tokenizers.
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(texts) gives (ids of all texts in a row, number of each)."""

    def __init__(self, path: str, cache: int = 700_000, pieces: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.vocab_size = self.whole.get_vocab_size(with_added_tokens=True)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.style = self._style(spec)
        self.cache = cache
        if self.style:
            suffix = spec["model"].get("end_of_word_suffix") or ""
            self.piece = regex.compile(_WORD_PIECES if self.style == "word" else _BYTE_PIECES).findall
            core = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
            self.core = Tokenizer.from_str(json.dumps(core))
            with contextlib.suppress(AttributeError):
                self.core.model._resize_cache(pieces)
            self.size = np.zeros(self.vocab_size, np.int64)
            for token, i in self.core.get_vocab().items():
                self.size[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
            self.chars = _byte_chars() | {0: " "}
        self._reset()

    @staticmethod
    def _style(spec: dict) -> str:
        """Which of the two known pipelines this is; '' for any other."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"].get("type", "BPE") != "BPE" or spec["model"].get("dropout") or spec.get("post_processor"):
            return ""
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        if norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence":
            first = pre["pretokenizers"][0]
            if first.get("pattern", {}).get("Regex") == _WORD_PIECES and first.get("invert"):
                return "word"
        return ""

    def _reset(self) -> None:
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.n, self.hit = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)
        self.flat = np.empty(0, np.uint32)

    def _odd(self, col: pa.Array) -> np.ndarray:
        """Rows for which cutting might not be exact."""
        if not self.style:
            return np.arange(len(col))
        odd = pc.match_substring_regex(col, _ODD)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(col, s))
        odd = odd.to_numpy(zero_copy_only=False)
        if self.style == "word":
            for i in np.flatnonzero(pc.match_substring_regex(col, _HIGH).to_numpy(zero_copy_only=False) & ~odd):
                odd[i] = not unicodedata.is_normalized("NFC", col[i].as_py())
        return np.flatnonzero(odd)

    def _pieces(self, cuts: list[str]) -> list[str]:
        if self.style == "word":
            return self.piece(" ".join(cuts))
        # Cuts that begin with one space make up a text that falls into them again.
        out: list[str] = []
        plain = 0
        for i, c in enumerate(cuts):
            if len(c) < 2 or c[0] != " " or c[1] in " \t\n\r\x0b\x0c":
                out += self.piece("".join(cuts[plain:i]))
                out += self.piece(c)
                plain = i + 1
        return out + self.piece("".join(cuts[plain:]))

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all new cuts in a row, number of each).  Their pieces hold all
        their bytes, and a byte is one character of the vocabulary, so lengths
        tell which ids are whose."""
        cuts = [c.decode() for c in new]
        pieces = self._pieces(cuts)
        lines = ["\0".join(pieces[i : i + 500]).encode().decode("latin1").translate(self.chars) for i in range(0, len(pieces), 500)]
        ids = np.array([x for e in self.core.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], np.int64)
        solid = [len(c.translate(None, b" \t\n\r\x0b\x0c")) for c in new] if self.style == "word" else [len(c) for c in new]
        ends = np.cumsum(solid)
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        upper = np.searchsorted(upto, ends)
        if not np.array_equal(upto[np.minimum(upper, len(ids))], ends):
            each = [e.ids for e in self.whole.encode_batch_fast(cuts, add_special_tokens=False)]
            ids, upper = np.array([x for e in each for x in e], np.int64), np.cumsum([len(e) for e in each])
        return ids.astype(np.uint32), np.diff(upper, prepend=0)

    def _keep(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Puts new cuts, whose ids begin at ``at``, into the cache; beyond its bound
        those not asked for since the last time leave."""
        if len(self.key) + len(key) > self.cache:
            stay = np.flatnonzero(self.hit)
            stay = stay[: max(0, self.cache // 2)]
            n_, upto = self.n[stay], np.cumsum(self.n[stay], dtype=np.int32)
            self.flat = self.flat[np.repeat(self.at[stay] - (upto - n_), n_) + np.arange(upto[-1] if len(upto) else 0)]
            self.key, self.check, self.n, self.at, self.hit = self.key[stay], self.check[stay], n_, upto - n_, np.zeros(len(stay), bool)
        at = len(self.flat) + at
        self.flat = np.concatenate([self.flat, ids])
        order = np.argsort(key)
        where = np.searchsorted(self.key, key[order])
        add = lambda old, new: np.insert(old, where, new[order])
        self.check, self.at, self.n, self.hit = add(self.check, check), add(self.at, at), add(self.n, n), add(self.hit, np.zeros(len(key), bool))
        self.key = add(self.key, key)

    def _chunk(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each cut) of cuts that follow each other; the last of
        start is the end."""
        off = (start - start[0]).astype(np.int64)
        cuts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data[start[0] : start[-1]])])
        d = cuts.dictionary_encode()
        which, one = d.indices.to_numpy(), d.dictionary
        text, o = raw(one)
        a, b = o[:-1], o[1:]
        key, check = hash_spans(text, a, b), hash_spans(text[::-1], len(text) - b, len(text) - a)
        at, order = np.empty(len(key), np.int64), np.argsort(key)
        at[order] = np.searchsorted(self.key, key[order])  # in order, so the search stays in cache
        at[at == len(self.key)] = 0
        held = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        self.hit[at[held]] = True
        new = np.flatnonzero(~held)
        n, place = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)
        n[held], place[held] = self.n[at[held]], self.at[at[held]]
        parts, flat = [], self.flat
        for i in range(0, len(new), 4000):
            ids, m = self._learn(one.take(pa.array(new[i : i + 4000])).to_pylist())
            n[new[i : i + 4000]] = m
            parts.append(ids)
        if parts:
            ids = np.concatenate(parts)
            place[new] = len(flat) + np.cumsum(n[new]) - n[new]
            flat = np.concatenate([flat, ids])
        many = n[which]
        upto = np.cumsum(many, dtype=np.int32)
        at_ = np.repeat(place[which] - (upto - many), many)
        at_ += np.arange(len(at_), dtype=np.int32)
        out = flat[at_]
        if parts:
            alone = new[self.key[at[new]] != key[new]] if len(self.key) else new
            self._keep(key[alone], check[alone], ids, place[alone] - (len(flat) - len(ids)), n[alone])
        return out, many

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of an array (or list) of strings without nulls."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        col = col.cast(pa.large_string())
        plain = {int(i): np.array(self.whole.encode(col[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in self._odd(col)}
        if plain:
            mask = np.zeros(len(col), bool)
            mask[list(plain)] = True
            col = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), col)
        if self.style == "word":
            col = pc.utf8_lower(col)
        data, off = raw(col)
        # A cut begins where white space follows a word, and with each text.
        space = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = space[1:] & ~space[:-1]
        first[off] = True
        start = np.flatnonzero(first)
        parts, counts, a = [], [], 0
        while a < len(start) - 1:
            b = max(a + 1, int(np.searchsorted(start, start[a] + CHUNK, "right")) - 1)
            ids, n = self._chunk(data, start[a : b + 1])
            parts.append(ids)
            counts.append(n)
            a = b
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        ends = upto[np.searchsorted(start, off)]
        fast = np.diff(ends)
        if not plain:
            return ids, fast
        rows = [plain[i] if i in plain else ids[ends[i] : ends[i + 1]] for i in range(len(col))]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in each worker process."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to every text's ids."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1

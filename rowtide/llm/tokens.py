"""Exact tokenizer ids, with each distinct word of a task encoded once.

A text is cut where no token can cross: at a single space or line feed between two characters that are not white
space (the byte-level pattern starts a piece there; the word vocabulary drops white space). What lies between is
encoded once and remembered: words of plain Latin letters, digits and signs by tiktoken's merge loop over the same
file's vocabulary, all others by the tokenizers library. Texts with any other white space are cut at the clean places
only, or not at all, so that ids always equal those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex
import tiktoken
import xxhash

_CLEAN = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: Characters whose case, composition and class are the same in every Unicode version; others go to the library.
_PLAIN = re.compile(r"[\x21-\x7e\n \u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of distinct words as arrays: word hash, second hash, offsets and ids. Built from (word, ids) once."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys, kind="stable")
        sizes = np.diff(ends, prepend=0)
        self.keys, self.checks = keys[order], checks[order]
        self.starts, self.sizes, self.ids = (ends - sizes)[order], sizes[order], ids

    def find(self, words: list[str]) -> dict[str, bytes]:
        if not len(self.keys) or not words:
            return {}
        hashes = [xxhash.xxh3_128_intdigest(w.encode()) for w in words]
        low = np.array([h & 0xFFFFFFFFFFFFFFFF for h in hashes], np.uint64)
        high = np.array([h >> 96 for h in hashes], np.uint32)
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        hit = (self.keys[at] == low) & (self.checks[at] == high)
        return {words[i]: self.ids[self.starts[k] : self.starts[k] + self.sizes[k]].astype("<u4").tobytes() for i, k in zip(np.flatnonzero(hit).tolist(), at[hit].tolist())}


class _ByteLevelMerges:
    """ids of a plain chunk for a byte-level vocabulary."""

    #: Fixed value: the byte-level pre-tokenizer's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocab: dict[str, int], special: set[str]):
        to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
        self.ids = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class _WordEndMerges:
    """ids of a plain word for a vocabulary whose last symbol carries an end mark.

    Each byte becomes two, the byte and FE, or FF for the last: neither occurs in UTF-8, so the marked symbols merge
    first and the merge loop then sees the vocabulary's own symbols.
    """

    END = "</w>"

    def __init__(self, vocab: dict[str, int], special: set[str], pattern: str):
        to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {}
        for piece, i in vocab.items():
            if piece not in special:
                stem, last = (piece[: -len(self.END)], 255) if piece.endswith(self.END) and piece != self.END else (piece, 254)
                marked = bytearray(b for c in stem for b in (to_byte[c], 254))
                marked[-1] = last
                ranks[bytes(marked)] = i
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(pattern).findall

    def ids(self, word: str) -> list[int]:
        word = word.lower()
        out = []
        for piece in (word,) if word.isalpha() else self.pieces(word):
            letters = piece if piece.isascii() else piece.encode().decode("latin-1")
            out += self.merge(("\xfe".join(letters) + "\xff").encode("latin-1"))
        return out


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    return letters | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}


def _merges(path: str, drops_blanks: bool):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    if not drops_blanks:
        return _ByteLevelMerges(vocab, special)
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return _WordEndMerges(vocab, special, pattern)


class WordEncoder:
    """texts -> ids as little-endian 32-bit integers, exactly as tokenizers' encode(text, add_special_tokens=False).

    path: a tokenizer file, byte-level (keeps white space) or with word ends (drops it). keep: words remembered
    before the memory is cleared; it bounds memory only.
    """

    def __init__(self, path: str, table: WordTable | None = None, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.drops_blanks = self.model.encode("a b", add_special_tokens=False).ids == self.model.encode("a \n b", add_special_tokens=False).ids
        self.plain_ids = _merges(path, self.drops_blanks).ids
        self.memo: dict[str, bytes] = {}
        self.table, self.keep = table, keep

    def words(self, text: str) -> list[str]:
        """Parts of text whose ids, joined, are the ids of text."""
        parts = text.split()
        blanks = text.count(" ") + text.count("\n")
        if self.drops_blanks:
            if sum(map(len, parts)) + blanks + text.count("\t") + text.count("\r") == len(text):
                return parts
            return [text] if any(c in text for c in _ODD) else _CLEAN.split(text)
        if parts and blanks == len(parts) - 1 and sum(map(len, parts)) + blanks == len(text) and "\0" not in text:
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return _CLEAN.split(text) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.keep:
            memo.clear()
        split = [self.words(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in memo})
        if new and self.table is not None:
            memo.update(self.table.find(new))
            new = [w for w in new if w not in memo]
        if new:
            memo.update(zip(new, self.fresh(new)))
        return [b"".join(map(memo.__getitem__, ws)) for ws in split]

    def fresh(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if _PLAIN.fullmatch(w) and "<|" not in w:
                out[k] = array("I", self.plain_ids(w)).tobytes()
            else:
                rest.append(k)
        for k, e in zip(rest, self.model.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that later tasks find the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

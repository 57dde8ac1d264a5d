"""Splitting and encoding with the public tokenizers, one distinct word at a time.

A byte-pair tokenizer cuts its input into words before it merges, so the ids of a text are the ids
of its words one after another, and a word need be encoded only once. Text of common Latin
characters is cut by a compiled pattern; any other text by the tokenizer's own normalizer and
pre-tokenizer. Both give the same words.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_ENDINGS = "'(?:[stmd]|re|ve|ll)"
# no combining marks, no letters beyond Latin-1, and only blanks on which all engines agree
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff‐-‧]")
_COMMON_BYTES = bytes([9, 10, 13, *range(0x20, 0x7f), *range(0xa1, 0x100)])
# letters first: no other branch begins with one, and they are the commonest case
_BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]+|{_ENDINGS}| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"[{_LETTER}]+|{_ENDINGS}|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LONG_TEXT = 4_000_000


def _is_common(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _COMMON_BYTES)
    except UnicodeEncodeError:
        return not _UNCOMMON.search(text)


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text, read on the driver and sent to the tasks (a few MB whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level pieces: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def splitter(spec: str) -> "Splitter":
    """One per tokenizer and Python worker, so remembered words live as long as the worker."""
    return Splitter(spec)


class Splitter:
    REMEMBERED = 350_000

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(spec)
        special = [t["content"] for t in told.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told.get("added_tokens", [])):
            raise ValueError("added tokens with special matching rules are not supported")
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = frozenset(special)
        self.pattern, self.lower = None, False
        pre, norm = told["pre_tokenizer"], told["normalizer"]
        if norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.pattern = _BYTE_LEVEL
        elif (norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence"
              and pre["pretokenizers"][0].get("pattern", {}).get("Regex") == _WORD_PATTERN):
            self.pattern, self.lower = _WORD_LEVEL, True
        else:
            raise ValueError("only byte-level tokenizers with the two known word patterns are supported")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        self.letters = {b: c for c, b in byte_letters().items()}
        self.blank = self.letters[32]
        self.kind = "H" if self.width == 2 else "I"
        self.merge = self.tokenizer.model.tokenize
        self.known = _Known(self)

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of the words of a text, in order; long texts come in several lists."""
        for part in self.special.split(text) if any(m in text for m in self.marks) else [text]:
            if part in self.marks:
                yield [part]
            elif _is_common(part):
                part = part.lower() if self.lower else part
                if len(part) < LONG_TEXT:
                    yield self.pattern.findall(part)
                else:
                    found = self.pattern.finditer(part)
                    while some := [m.group() for m in islice(found, 100_000)]:
                        yield some
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                yield [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]

    def encode_word(self, word: str) -> array:
        """Ids of a word, by the merges of the tokenizers library.

        A word is what its pre-tokenizer hands to the model, once written in byte letters; going to the
        model at once leaves out the work on offsets that a whole encoding does.
        """
        if word in self.marks:
            return array(self.kind, [self.tokenizer.token_to_id(word)])
        plain = word.isascii() and word.isprintable()
        spelt = word.replace(" ", self.blank) if plain else word.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.merge(spelt)])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word."""
        return [self.little_endian(self.encode_word(w)) for w in words]

    @staticmethod
    def little_endian(ids: array) -> bytes:
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text; words met before are not encoded again."""
        out, ids_of = [], self.known.__getitem__
        for t in texts:
            out.append(b"".join([b"".join(map(ids_of, w)) for w in self.words(t)]))
            self.known.forget(self.REMEMBERED)
        return out


class _Known(dict):
    """Word -> its ids in little-endian bytes, encoded when it is first asked for.

    Two generations: words still in use move on from the older one, others are forgotten.
    """

    def __init__(self, words: Splitter):
        super().__init__()
        self.encode, self.older = words.encode_word, {}
        self.packed = words.little_endian

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.packed(self.encode(word))
        self[word] = ids
        return ids

    def forget(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()

"""Tokenizing pre-tokens with a public tokenizer, and remembering the results in the worker.

The pre-tokens of texts in plain letters, digits and signs (ASCII and precomposed Latin-1) are cut here by the tokenizer's own pattern. Of
other texts only the stretches between single spaces are cut here; a stretch that isn't plain is given to the tokenizer, and so is any
that may hold a special token. Tests hold all ways against the tokenizer over whole texts.

Memory: a cache forgets all but its lasting entries when it has ``most``, and what is longer than ``LONGEST`` characters is never remembered,
so a worker's caches are bounded in bytes, whatever the texts hold.
"""

from __future__ import annotations

import os
import re
from array import array

#: Longer pre-tokens and stretches are tokenized each time, and not remembered.
LONGEST = 64

#: Text of these characters alone has no composition, no special case mapping and no numbers but digits.
_PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_SPECIAL = "<|"
_SINGLE = re.compile(r"(?<=\S)(?= \S)")
_BETWEEN = re.compile("[^ \t-\r]+").findall
# The pre-token patterns of the two vocabularies, for plain text (of the first: in lower case).
_WORDS = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\\[-`{-~]+").findall
_BYTES = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[!-/:-@\\[-`{-~]+|\\s+(?!\\S)|\\s+").findall


def _letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _letters()


def byte_level(part: str) -> str:
    return part.encode().decode("latin-1").translate(_LETTERS)


def public_path(name: str) -> str:
    """Where a vocabulary file lies on this machine; executors look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path(name))


def is_plain(text: str) -> bool:
    return _PLAIN_TEXT(text) is not None and _SPECIAL not in text


class Cache(dict):
    """Results of ``make``, remembered up to ``most`` beside the ``lasting`` ones."""

    def __init__(self, make, most: int, lasting: dict | None = None):
        super().__init__(lasting or {})
        self.make, self.lasting, self.most = make, lasting or {}, most + len(lasting or {})

    def __missing__(self, part):
        found = self.make(part)
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.lasting)
            self[part] = found
        return found


class Ids:
    """Ids (little-endian bytes) of texts by a vocabulary of lower-case words, between whose pre-tokens white space goes."""

    def __init__(self, name: str, most: int = 300_000):
        self.tokenizer = load(name)
        model = self.tokenizer.model
        self.parts = Cache(lambda part: array("I", [t.id for t in model.tokenize(byte_level(part))]).tobytes(), most)
        self.stretches = Cache(self._stretch, most // 4)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _WORDS(text.lower())))

    def _stretch(self, text: str) -> bytes:
        return self._plain(text) if is_plain(text) else array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        return self._plain(text) if is_plain(text) else b"".join(map(self.stretches.__getitem__, _BETWEEN(text)))


class Lengths:
    """Numbers of tokens of texts by a vocabulary of byte-level pre-tokens. lasting: numbers of pre-tokens that are known from the start."""

    def __init__(self, name: str, lasting: dict[str, int] | None = None, most: int = 300_000):
        self.tokenizer = load(name)
        model = self.tokenizer.model
        self.parts = Cache(lambda part: len(model.tokenize(byte_level(part))), most, lasting)
        self.stretches = Cache(self._stretch, most // 4)

    def _cut(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special token."""
        if is_plain(text):
            return _BYTES(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _stretch(self, text: str) -> int:
        if _SPECIAL in text:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.parts.__getitem__, self._cut(text)))

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, but for those of stretches that may hold a special token."""
        if is_plain(text):
            return _BYTES(text)
        return [p for s in _SINGLE.split(text) if _SPECIAL not in s for p in self._cut(s)]

    def of(self, text: str) -> int:
        if is_plain(text):
            return sum(map(self.parts.__getitem__, _BYTES(text)))
        return sum(map(self.stretches.__getitem__, _SINGLE.split(text)))

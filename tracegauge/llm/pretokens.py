"""Byte-level BPE of whole texts through a cache of space-separated units.

The pre-tokeniser of this vocabulary never joins characters across a single space that stands between
two characters that are not white space. So the part after such a space, with the space, has the same
tokens wherever it stands, and each worker asks the tokenizers library for a unit once. Texts that have
other white space beside a space are cut only where the rule holds.

A new unit is cut into pre-tokens by the library too, unless it has only characters whose classes have never
changed; then Python's own expressions give the same pre-tokens at a fraction of the time.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

#: Pre-tokens whose ids a worker keeps.
PRE_TOKENS = 150_000
#: A space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that Python and the tokeniser's expressions may class differently as white space.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: A word of letters, digits, signs and line breaks of old and fixed classes (ASCII and Latin letters), with
#: no white space at its ends.
_SETTLED = re.compile("[!-~À-ÖØ-öø-ƺ](?:[ -~\nÀ-ÖØ-öø-ƺ]*[!-~À-ÖØ-öø-ƺ])?")
#: The vocabulary's pre-token expression, for settled characters.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next one from 256."""
    visible, spare = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def tokenizer(path: str):
    """The tokenizers library's object for a file, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts of characters whose classes have never changed: here all libraries cut the same pre-tokens.
_SETTLED_TEXT = re.compile("[ -~\n\t\rÀ-ÖØ-öø-ƺ]*")


class WholeTexts:
    """The ids of whole texts. Settled texts go through the tiktoken library's merge loop, with the ranks of the
    same vocabulary; all others, and files whose ids are not in the order of their merges, through the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.names = [x["content"] for x in file["added_tokens"]]
        self.library = tokenizer(path)
        self.by_rank = self._by_rank(file)

    @staticmethod
    def _by_rank(file: dict):
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab, merges = file["model"]["vocab"], file["model"].get("merges", [])
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(c not in vocab or vocab[c] > 255 for c in byte):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids, without begin, end or added tokens; special strings inside are found as by default."""
        if self.by_rank is not None and _SETTLED_TEXT.fullmatch(text) and not any(x in text for x in self.names):
            return array("I", self.by_rank.encode_ordinary(text)).tobytes()
        return _packed(self.library.encode(text, add_special_tokens=False).ids)


class Units:
    """Splits texts into units whose tokens do not depend on their neighbours, and encodes units."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.names = [x["content"] for x in json.load(f)["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, self.names)) + ")")
        self.library = tokenizer(path)
        self.letters = dict(enumerate(byte_letters()))
        self.known: dict[str, bytes] = {}

    def special_in(self, text: str) -> bool:
        return any(x in text for x in self.names)

    def of(self, text: str) -> list[str]:
        """The units of any ``text``, in order; all of them joined give ``text``."""
        if self.special_in(text):
            return [u for part in self.special.split(text) if part for u in ([part] if part in self.names else self._cut(part))]
        return self._cut(text)

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _OTHER_SPACE.search(text):
            return [text]
        first, *rest = _CUT.split(text)
        return [first, *[" " + p for p in rest]]

    @staticmethod
    def sound(word: str) -> bool:
        """Whether a space before ``word`` may be cut at, and one after it."""
        if word.isascii() and word.isprintable():
            return bool(word)
        return bool(word) and not word[0].isspace() and not word[-1].isspace() and not _OTHER_SPACE.search(word)

    def ids(self, units: Iterable[str]) -> Iterator[bytes]:
        """The library's ids of each unit, as little-endian 32-bit numbers."""
        for u in units:
            if _SETTLED.fullmatch(u) and not self.special_in(u):
                yield b"".join([self.known.get(p) or self._pre_token(p) for p in _PRE_TOKEN.findall(u)])
            else:
                yield _packed(self.library.encode(u, add_special_tokens=False).ids)

    def word_ids(self, word: str) -> bytes:
        """The library's ids of a word with a space before it; no special string is in it."""
        if word.isascii() or _SETTLED.fullmatch(word):
            return b"".join([self.known.get(p) or self._pre_token(p) for p in _PRE_TOKEN.findall(" " + word)])
        return _packed(self.library.encode(" " + word, add_special_tokens=False).ids)

    def _pre_token(self, pre_token: str) -> bytes:
        if len(self.known) >= PRE_TOKENS:
            self.known.clear()
        shown = pre_token.encode().decode("latin-1").translate(self.letters)
        ids = self.known[pre_token] = _packed([t.id for t in self.library.model.tokenize(shown)])
        return ids


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def n_ids(packed: bytes) -> int:
    return len(packed) // 4


class Memo(dict):
    """A bounded dictionary that makes the values it lacks. It is emptied when full, down to ``start``; that
    costs time, never results."""

    def __init__(self, make: Callable[[str], object], room: int, start: dict | None = None) -> None:
        super().__init__(start or {})
        self.make, self.room, self.start = make, room, start or {}

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) >= self.room:
            self.clear()
            self.update(self.start)
        self[key] = value
        return value


class Unsound(Exception):
    """A word that cannot be cut off at its spaces."""


class Encoder:
    """Values of the units of texts. ``value`` makes a unit's packed ids into what is kept. ``start`` holds values
    of words, each with a space before it."""

    def __init__(self, path: str, value: Callable[[bytes], object], room: int, start: dict | None = None) -> None:
        self.units, self.value = Units(path), value
        self.words = Memo(self._word, room, start)

    def _word(self, word: str) -> object:
        if not Units.sound(word):
            raise Unsound
        return self.value(self.units.word_ids(word))

    def values(self, text: str) -> list:
        """The values of all units of ``text``, in order."""
        first, *words = text.split(" ")
        if not self.units.special_in(text) and (not words or Units.sound(first)):
            try:
                rest = [*map(self.words.__getitem__, words)]
            except Unsound:
                pass
            else:
                return [*map(self.value, self.units.ids([first] if first else [])), *rest]
        return [self.value(ids) for ids in self.units.ids(self.units.of(text))]

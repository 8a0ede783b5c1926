"""Token ids of the public tokenizer files, exactly as the tokenizers library gives them, at the speed of a lookup.

A text is cut at white space into units; each distinct unit is cut into pre-tokens and encoded once in a worker by the
library's own model, and then looked up. Where white space counts, a lone space goes with what follows it and a lone
line feed starts anew, so units don't depend on each other; a text with other white space is cut into pre-tokens as a
whole. Units whose characters all lie in the vetted range (below U+0180, without control characters that the two regex
engines class differently) are cut by Python's ``re`` with the letter and number classes of that range spelled out;
every other unit by the library's normalizer and pre-tokenizer, which work on it alone. The vocabulary's added tokens
divide a text before anything else. So every pre-token of every text meets ``of_word``, and results are the library's.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import cache

VETTED = 0x180  # code points below are cut by Python's re
UNIT_BYTES, WORD_BYTES = 32 << 20, 20 << 20  # memory for units and pre-tokens that a worker remembers unless told otherwise
_ENTRY = 140  # bytes that an entry of a memo takes besides its characters and ids: two objects and its place in the table


def _class(kind: str) -> str:
    return re.escape("".join(chr(c) for c in range(VETTED) if unicodedata.category(chr(c))[0] == kind))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    let, num = _class("L"), _class("N")
    short = "'(?:[stmd]|re|ve|ll)"
    words = re.compile(rf"[{let}]+|{short}|[{num}]|[^\s{let}{num}]+")
    spaced = re.compile(rf" ?[{let}]+|{short}| ?[{num}]+| ?[^\s{let}{num}]+|\s+(?!\S)|\s+")
    odd = re.compile(rf"[^\t-\r -~\x85\xa0-{chr(VETTED - 1)}]")
    return words, spaced, odd


@cache
def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free letter from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def byte_level(word: str) -> str:
    """A pre-token in the alphabet of byte-level vocabularies."""
    if word.isascii() and word[1:].isalpha():
        return "\u0120" + word[1:] if word[0] == " " else word if word[0] > " " else "\u010a" + word[1:]
    return "".join(map(_byte_letters().__getitem__, word.encode()))


@cache
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(_byte_letters())}


@cache
def _blank() -> re.Pattern:
    """White space at which any text may be cut where white space is dropped."""
    return re.compile(r"[\t-\r ]+")


_SIGNS = frozenset("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")  # ASCII signs but for the apostrophe and the backslash


class Mixed(Exception):
    """A text's white space is more than lone spaces and line feeds, so it can't be cut there."""


class Memo(dict):
    """word -> what ``make`` gives, remembered until the entries take ``room`` bytes; long words aren't."""

    def __init__(self, make: Callable[[str], bytes], room: int) -> None:
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if self.room > 0 and (n := len(word)) < 64:
            self[word] = out
            self.room -= _ENTRY + n + len(out)
        return out


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, unit_bytes: int = UNIT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        words, spaced, self.odd = _patterns()
        self.lower = t.normalizer is not None
        self.find = (words if self.lower else spaced).findall
        self.added = {x.content: array("I", [i]).tobytes() for i, x in t.get_added_tokens_decoder().items()}
        self.divide = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.tokenize = t.model.tokenize
        t.model._resize_cache(0)  # words are remembered here
        self.memo, self.words = Memo(self.of_unit, unit_bytes), Memo(self.of_word, WORD_BYTES)

    def of_word(self, word: str) -> bytes:
        """Of a pre-token."""
        return array("I", [x.id for x in self.tokenize(byte_level(word))]).tobytes()

    def of_unit(self, unit: str) -> bytes:
        """Of a part of a text between spaces; where white space counts, a space goes before it unless it starts with a line feed."""
        if unit.isalpha() and (unit.isascii() or not self.odd.search(unit)):
            return self.of_word(unit if self.lower else " " + unit)
        if unit.isascii() and unit[-1:] in _SIGNS and (letters := unit[:-1]).isalpha():  # a word and a sign, as most others are
            return self.memo[letters] + self.words[unit[-1]]
        if not self.lower:
            if not unit or unit[1:].split() != [unit[1:]] and unit[1:] or unit == "\n" or unit[0].isspace() and unit[0] != "\n":
                raise Mixed
            if unit[0] != "\n":
                unit = " " + unit
        if self.odd.search(unit):
            return self.of_strange(unit)
        return b"".join(map(self.of_part, self.find(unit)))

    def of_part(self, word: str) -> bytes:
        """Of a pre-token; one that is a unit of letters is remembered as such."""
        if self.lower:
            return self.memo[word] if word.isalpha() else self.words[word]
        return self.memo[word[1:]] if word[0] == " " and word[1:].isalpha() else self.words[word]

    def of_strange(self, part: str) -> bytes:
        """Of a part that has characters beyond the vetted range."""
        return b"".join(map(self.words.__getitem__, self.cut(part)))

    def cut(self, part: str) -> list[str]:
        """The pre-tokens of a part of a text as the library cuts it; it must not hold an added token."""
        if self.tokenizer.normalizer is not None:
            part = self.tokenizer.normalizer.normalize_str(part)
        return [bytes(map(_byte_of().__getitem__, x)).decode() for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.divide is not None and any(x in text for x in self.added):
            return b"".join(self.added[x] if x in self.added else self.of_text(x) for x in self.divide(text) if x)
        return self.of_text(text)

    def of_text(self, text: str) -> bytes:
        """Of a text without added tokens."""
        if self.lower:
            return b"".join(map(self.memo.__getitem__, self.units(text)))
        odd = self.odd.search(text) is not None
        try:
            first, *rest = text.replace("\n", " \n").split(" ")
            head = self.of_strange(first) if odd else b"".join(map(self.words.__getitem__, self.find(first)))
            return b"".join((head, *map(self.memo.__getitem__, rest)))
        except Mixed:
            return self.of_strange(text) if odd else b"".join(map(self.words.__getitem__, self.find(text)))

    def units(self, text: str) -> list[str]:
        """The units of a text, for vocabularies that drop white space and case; those beyond the vetted range as they are."""
        if self.odd.search(text) is None:
            return text.lower().split()
        return [u for x in _blank().split(text) if x for u in ([x] if self.odd.search(x) else x.lower().split())]

    def pre_tokens(self, unit: str) -> list[str]:
        return self.cut(unit) if self.odd.search(unit) else self.find(unit)

    def without_added(self, text: str) -> list[str]:
        """What the added tokens of a text leave."""
        return [x for x in self.divide(text) if x not in self.added] if self.divide is not None else [text]

    def decode(self, ids: Iterable[int]) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


@cache
def encoder(path: str, unit_bytes: int = UNIT_BYTES) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path, unit_bytes)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file on this machine; the files are installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Pre-tokens of the two public BPE vocabularies, exactly as the tokenizers library splits texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import attrgetter

from tokenizers import Tokenizer

#: Letters up to U+024F. Texts without the characters of RARE have no other letters, numbers, spaces or combining marks.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
RARE = re.compile("[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]")
_byte = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall
_word = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{LETTERS}0-9]+").findall


def _by_library(tokenizer: Tokenizer, text: str) -> list[str]:
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def byte_pieces(tokenizer: Tokenizer, text: str) -> list[str]:
    """Pre-tokens of a byte-level vocabulary: one expression for Latin texts, the library's own split for all others."""
    return _by_library(tokenizer, text) if RARE.search(text) else _byte(text)


def word_pieces(tokenizer: Tokenizer, text: str) -> list[str]:
    """Pre-tokens of the lower-casing word vocabulary, in the same two ways."""
    if not RARE.search(text):
        lower = text.lower()
        if not RARE.search(lower):
            return _word(lower)
    return _by_library(tokenizer, tokenizer.normalizer.normalize_str(text))


@lru_cache(maxsize=4)
def library_tokenizer(config: str) -> Tokenizer:
    return Tokenizer.from_str(config)


@lru_cache(maxsize=4)
def special_splitter(config: str) -> Callable[[str], Iterator[tuple[str, int | None]]]:
    """Parts of a text around the vocabulary's added strings: (part, None) or (string, its id)."""
    ids = {t["content"]: t["id"] for t in json.loads(config)["added_tokens"]}
    find = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None

    def split(text: str) -> Iterator[tuple[str, int | None]]:
        if find is None or not find.search(text):
            yield text, None
            return
        for part in find.split(text):
            if part:
                yield part, ids.get(part)

    return split


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if visible, else the next free one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(spare)) for b in range(256)}


class Cache(dict):
    """Values of keys made on demand, none of them None. Once `limit` / 2 keys are in use they become the older half, of which
    keys that are asked for again come back and the others go with the next half, so memory stays bounded."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.half, self.older = make, max(limit // 2, 1), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=4)
def piece_ids(config: str) -> Callable[[str], list[int]]:
    """Ids of one pre-token of a byte-level vocabulary, by the library's own merges."""
    tokenize, letters, number = library_tokenizer(config).model.tokenize, byte_letters(), attrgetter("id")

    def ids(piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            return list(map(number, tokenize(piece.replace(" ", letters[32]))))
        return list(map(number, tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))))

    return ids

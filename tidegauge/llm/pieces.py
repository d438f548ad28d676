"""Byte-level BPE text cut into chunks that encode alone.

No pre-token of the byte-level pattern holds a space behind its first character, except
runs of white space. Where a space stands between two other non-white characters, the
text before it and the text from it on therefore encode independently, and a chunk seen
before need not be encoded again. Texts in which a space touches other white space are
cut at pre-tokens instead, by the library's own pre-tokenizer where they hold characters
whose class may differ between Unicode versions.
"""

from __future__ import annotations

import json
import re

import regex

SPECIAL = "<|endoftext|>"
#: A space beside other white space; looked at from the space, which the engine finds fast.
RUNS = re.compile(r" (?:[\s\u180e]|(?<=[\s\u180e] ))")

#: The published pre-token pattern of this vocabulary family (a fixed value).
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: All but characters whose class no Unicode version disputes.
DISPUTED = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1-\u024f\u0400-\u044f\u2010-\u2027\u20ac]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str | None = None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or default_path())


def bare(library):
    """The library with the same model alone: all that it is given is one pre-token."""
    from tokenizers import Tokenizer

    return Tokenizer(library.model)


def specials(path: str) -> dict[str, int]:
    """Texts that the library maps to one id wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the code points from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Chunks(dict):
    """Memo of ``make(chunk)`` that forgets everything when it holds ``bound`` chunks."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, chunk: str):
        if len(self) >= self.bound:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


def has_runs(text: str) -> bool:
    return RUNS.search(text) is not None


def segments(text: str, pattern: re.Pattern | None) -> list[str]:
    """Text and special strings by turns: ordinary, special, ordinary, ..."""
    return pattern.split(text) if pattern else [text]


def special_pattern(contents) -> re.Pattern | None:
    names = sorted(contents, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

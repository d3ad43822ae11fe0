"""Texts to the words on which a BPE model works, exactly as the tokenizers library cuts them.

Only for characters on which both regular-expression engines are known to agree does a text take
the short way; any other goes through the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import re
import unicodedata

from tokenizers import Tokenizer

#: ASCII without the separators 0x1c to 0x1f, and Latin letters from U+00C0 to U+017F.
_PLAIN = re.compile("[\t-\r -~À-ſ]*")
_L = "A-Za-zÀ-ÖØ-öø-ſ"

#: The words of the byte-level scheme and of the lower-case vocabulary, over the characters above.
BYTE_LEVEL_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
LOWER_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[0-9]|[^\s{_L}0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTER = byte_letters()
BYTE = {c: b for b, c in LETTER.items()}


def plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def lower_words(tokenizer: Tokenizer, text: str) -> list[str]:
    """The normalised words of a text without special tokens."""
    if plain(text):
        return LOWER_WORD.findall(unicodedata.normalize("NFC", text).lower())
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
    return [bytes(map(BYTE.__getitem__, piece)).decode("utf-8", "surrogateescape") for piece, _ in pieces]


def special_pattern(tokenizer: Tokenizer) -> re.Pattern:
    return re.compile("(" + "|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) + ")")

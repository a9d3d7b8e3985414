"""Splitting texts into units that a byte-level pre-tokenizer treats independently of each other."""

from __future__ import annotations

import re

#: White space other than a plain space or line end.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: A plain space between two characters that aren't white space.
JOINT = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """Parts of a text, split at each single space between two non-space characters.

    The pattern of the byte-level tokenizers gives such a space to the word that follows and never matches across it, so
    the text's pre-tokens are those of the first part and of each later part with its space before it.
    """
    plain = not ("  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or OTHER_SPACE.search(text))
    return text.split(" ") if plain else JOINT.split(text)


class Numbers(dict):
    """Numbers each new key by its order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n

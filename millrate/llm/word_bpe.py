"""Reading of a word-level BPE tokenizer file: how texts fall into words.

Both operators on such a file need what the library does before merging: NFC,
lower case, white space dropped, words of letters, single digits, runs of other
characters and the contractions.  :func:`check` compares the file with that
description and refuses any other.
"""

from __future__ import annotations

import json
import re
import unicodedata

# The description of the tokenizer file that is understood.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WORD_END = "</w>"


def check(path: str) -> dict:
    """The parsed file, if it has the described steps."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["pre_tokenizer"]["pretokenizers"]
    if (tuple(x["type"] for x in spec["normalizer"]["normalizers"]) != NORMALIZERS
            or [x["type"] for x in steps] != ["Split", "ByteLevel"]
            or steps[0]["pattern"] != {"Regex": SPLIT} or steps[1]["use_regex"] or steps[1]["add_prefix_space"]
            or spec["model"]["type"] != "BPE" or spec["model"]["end_of_word_suffix"] != WORD_END):
        raise ValueError(f"{path} isn't a tokenizer of the kind that is understood")
    return spec


def specials(spec: dict) -> re.Pattern:
    """Matches the special strings, which the library finds before anything else."""
    names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names)))


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no final sigma rule)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


#: Characters that str.split() drops though the tokenizer does not.
KEPT_CONTROLS = re.compile("[\x1c-\x1f]")


#: Characters that Python's Unicode tables know, as far as met: one entry a code point at most.
_ASSIGNED: set[str] = set(map(chr, range(0x80)))


def has_unassigned(text: str) -> bool:
    """Holds a character without a category in Python's Unicode tables, where
    those of other libraries may be newer.  A text's different characters are
    looked up, which costs less than a pattern of all such ranges."""
    new = set(text) - _ASSIGNED
    free = {c for c in new if unicodedata.category(c) == "Cn"}
    _ASSIGNED.update(new - free)
    return bool(free)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the rest for U+0100 upwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in own)}
    return [chr(rest.get(b, b)) for b in range(256)]

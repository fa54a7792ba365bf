"""Byte-level BPE ids from a vocabulary file, by the fast encoder that gives the same ids.

`path` is a tokenizers JSON file. Its vocabulary is turned into merge ranks, and texts are encoded whole. The strings of
the file's added tokens become their ids, as the tokenizers library has it by default.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import Any

import numpy as np

#: White space as the vocabulary's pattern means it (fixed values: Unicode's White_Space).
_BLANK = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Runs of so many blanks are encoded apart, for the pattern's look-ahead steps back through a run blank by blank.
_RUN = 4096
_RUNS = re.compile(f"([{_BLANK}]{{{_RUN},}})")
#: Other texts are encoded in pieces of about so many characters, cut only between a letter and the space before
#: another, where the pattern always ends a word, so the ids are those of the whole text.
_STRIDE = 200_000
_CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Any, re.Pattern | None, dict[str, int]]:
    """The encoder of a JSON vocabulary, a pattern of its added tokens and their ids. A worker makes it once."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, added = byte_letters(), {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in added}
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), split, added


def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    made, _, added = encoder(path)
    return max([made.n_vocab, *(i + 1 for i in added.values())])


@lru_cache(maxsize=2)
def byte_lengths(path: str) -> np.ndarray:
    """How many bytes each id stands for."""
    made, _, added = encoder(path)
    out = np.zeros(vocabulary_size(path), dtype=np.int64)
    for i in range(made.n_vocab):
        try:
            out[i] = len(made.decode_single_token_bytes(i))
        except KeyError:
            pass
    for piece, i in added.items():
        out[i] = len(piece.encode())
    return out


def _plain(text: str, made: Any, out: list) -> None:
    """Ids of a text without added tokens and without runs of _RUN blanks."""
    at = 0
    while len(text) - at > _STRIDE:
        cut = _CUT.search(text, at + _STRIDE)
        if cut is None:
            break
        out.append(made.encode_to_numpy(text[at : cut.start()], disallowed_special=()))
        at = cut.start()
    out.append(made.encode_to_numpy(text[at:], disallowed_special=()))


def ids_of(text: str, path: str) -> np.ndarray:
    made, split, added = encoder(path)
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) < _RUN and not (split and split.search(text)):
        return made.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
    out: list = []
    for i, part in enumerate(split.split(text) if split else [text]):
        if i % 2:
            out.append(np.array([added[part]]))
            continue
        held = ""
        runs = _RUNS.split(part)
        for j, piece in enumerate(runs):
            if j % 2:  # the last blank belongs to what follows, if anything does
                follows = bool(runs[j + 1])
                out.append(np.array(made._encode_single_piece(piece[:-1] if follows else piece), dtype=np.int64))
                held = piece[-1] if follows else ""
            elif piece:
                _plain(held + piece, made, out)
                held = ""
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

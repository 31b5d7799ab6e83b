"""Byte-level byte-pair vocabularies: the split into words, and whole-text encoding for other operators."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Unicode white space, as the split rule of the vocabulary means it. Fixed values.
WHITE = r"\t-\r \x85\xa0  -     　"
#: The public split rule of byte-level vocabularies. Fixed value.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


#: Beyond these characters the library's tables of letters and digits may be older than others'; such
#: texts are given to the library itself.
UNUSUAL = re.compile(r"[^\u0000-\u052f\u2000-\u206f]").search


def vocabulary(path: str) -> dict:
    """The parsed tokenizer file, after a check that it is a plain byte-level one."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t["pre_tokenizer"]
    plain = t["normalizer"] is None and t["model"]["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
    if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in t["added_tokens"]):
        raise ValueError("only byte-level vocabularies without normalisation or stripping added tokens")
    return t


@lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or 256 on for the others."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[bytes, ...]:
    """Bytes of each id: the id-to-piece table. Its size is the vocabulary's."""
    t = vocabulary(path)
    of = byte_of_char()
    out = {i: bytes(of[c] for c in p) for p, i in t["model"]["vocab"].items()} | {a["id"]: a["content"].encode() for a in t["added_tokens"]}
    return tuple(out.get(i, b"") for i in range(max(out) + 1))


@lru_cache(maxsize=4)
def special(path: str) -> dict[str, int]:
    return {a["content"]: a["id"] for a in vocabulary(path)["added_tokens"]}


@lru_cache(maxsize=4)
def whole_text_encoder(path: str):
    """``f(text) -> ids`` equal to the tokenizer file's, by the same ranks in a faster library.

    Ranks are ids there: base bytes first, then merges in order, which is checked.
    """
    import tiktoken

    t = vocabulary(path)
    n_base = len(t["model"]["vocab"]) - len(t["model"]["merges"]) - len([a for a in t["added_tokens"] if a["content"] in t["model"]["vocab"]])
    if n_base != 256:
        raise ValueError("the vocabulary is not 256 bytes and its merges")
    own = pieces(path)
    marks = special(path)
    ranks = {p: i for i, p in enumerate(own) if i not in marks.values()}
    enc = tiktoken.Encoding("own", pat_str=SPLIT.replace(WHITE, r"\s"), mergeable_ranks=ranks, special_tokens=marks)
    allowed = set(marks)
    lib = library(path)

    def encode(text: str) -> list[int]:
        if UNUSUAL(text):
            return lib.encode(text, add_special_tokens=False).ids
        return enc.encode(text, allowed_special=allowed, disallowed_special=())

    return encode


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer file as the library reads it, one thread, unused truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_bytes(ids) -> bytes:
    """Little-endian unsigned 32-bit."""
    return np.asarray(ids, dtype="<u4").tobytes()

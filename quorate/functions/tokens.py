"""Ids of a public tokenizer's file, by tiktoken where that gives the same ones."""

from __future__ import annotations

import json
from functools import lru_cache

#: How the byte-level pre-tokenizer of the format parts a text into words where it uses its own pattern: fixed value.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Both encoders must agree on these, or the quick one is not used.
PROBES = ("", " ", "It's  we'll\n\n\tX1 22 333 - a.b,c?! 'tis", "É été naïf ÀÉÎ straße ŁódŹ ¿qué? «x» 50 €\u00a0z", "a\r\n b\x0b\x0c  c   ", "x" * 50 + " " * 9 + "0" * 30, "don't DON'T I'M you're\x00\x01")


@lru_cache(maxsize=2)
def encoders(path: str):
    """(exact, quick, special): the tokenizer file, its vocabulary as byte ranks for tiktoken, and its special strings.

    quick is None where the file asks for anything but byte-level pairs without normalisation, or fails a probe.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    spec = json.load(open(path, encoding="utf-8"))
    special, model, pre = {t["content"] for t in spec.get("added_tokens", [])}, spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return exact, None, special
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    quick = tiktoken.Encoding("same", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    agree = all(quick.encode_ordinary(t) == exact.encode(t, add_special_tokens=False).ids for t in PROBES)
    return exact, quick if agree else None, special


@lru_cache(maxsize=2)
def decodes(path: str) -> bool:
    """Whether the quick encoder also gives the text of ids as the file does, with U+FFFD for what is no character."""
    exact, quick, _ = encoders(path)
    if not quick or (json.load(open(path, encoding="utf-8")).get("decoder") or {}).get("type") != "ByteLevel":
        return False
    ids = [quick.encode_ordinary(t) for t in (*PROBES, "\U0001f9ea\u00e9\u4e2d" * 3)]
    return all(quick.decode(x[a:b]) == exact.decode(x[a:b]) for x in ids for a in range(len(x)) for b in (a + 1, a + 5, len(x)))


def latin(text: str, special: set[str]) -> bool:
    """Whether a text is of Latin letters and without the string of a special token, so that the quick encoder may do it."""
    return (text.isascii() or max(text) < "ɐ") and not any(s in text for s in special)


def token_ids(texts: list[str], path: str) -> list[list[int]]:
    """Ids by the tokenizer file, without special tokens.

    Texts of Latin letters are encoded by tiktoken from the same vocabulary, which gives the same ids about six times
    as fast; any text with other characters or with the string of a special token goes to tokenizers itself, as the two
    libraries may class a rare character differently.
    """
    exact, quick, special = encoders(path)
    out: list = [None] * len(texts)
    slow = []
    for i, t in enumerate(texts):
        if quick and latin(t, special):
            out[i] = quick.encode_ordinary(t)
        else:
            slow.append(i)
    for i, e in zip(slow, exact.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
        out[i] = e.ids
    return out

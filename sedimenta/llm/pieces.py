"""Byte-level BPE vocabularies as the tokenizers library stores them, and their pre-tokenisation."""

from __future__ import annotations

import json
import re

import regex

#: The split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Texts without characters from here on are split by the standard library's faster engine, with the classes spelt out.
LATIN = 0x250


def latin_split() -> re.Pattern:
    """SPLIT for texts of characters below LATIN, commonest pieces first: letters and digits begin no other alternative."""
    some = lambda kind: "".join(re.escape(chr(c)) for c in range(LATIN) if regex.match(kind, chr(c)))
    letters, digits, spaces = some(r"\p{L}"), some(r"\p{N}"), some(r"\s")
    ends, letter, digit, other, *gaps = SPLIT.split("|")[:7], *SPLIT.split("|")[7:]
    two = [letter.replace(" ?", " ").replace("+", "++"), letter.replace(" ?", "").replace("+", "++")]
    classes = "|".join([*two, digit, *ends, other, *gaps]).replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
    return re.compile(classes.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]"))


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Tokens as bytes, merges by rank, and the special tokens that are cut out of a text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, pre = spec["model"]["type"], spec["pre_tokenizer"]
        if kind != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} is not plain byte-level BPE")
        back = byte_chars()
        raw = {t: bytes(back[c] for c in t) for t in spec["model"]["vocab"] if all(c in back for c in t)}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for t, i in spec["model"]["vocab"].items():
            self.bytes[i] = raw.get(t, t.encode())
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.longest = max(map(len, self.ids))
        #: Merge of a pair of ids: (rank, merged id). The merge that makes a token: (rank, left, right).
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        vocab = spec["model"]["vocab"]
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b] = rank, whole
            self.made.setdefault(whole, (rank, a, b))
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._any, self._latin = regex.compile(SPLIT).findall, latin_split().findall
        self._beyond = re.compile(f"[^\0-{chr(LATIN - 1)}]").search

    def _split(self, text: str) -> list[str]:
        return (self._any if self._beyond(text) else self._latin)(text)

    def pieces(self, text: str) -> list[str]:
        """The pieces that merges stay within, in order. A special token is a piece of its own."""
        if self._cut is None or not self._cut.search(text):
            return self._split(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._split(text[at:])

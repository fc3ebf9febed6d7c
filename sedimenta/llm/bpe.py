"""BPE encoding and decoding by prefix-sharing trie traversal."""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .pieces import Vocabulary, default_vocabulary

#: Bounds of what a worker keeps: encoded words, edges of the automaton beyond which no jumps are added to it, and the
#: longest word (bytes) put in the trie.
WORDS, NODES, LONG = 250_000, 250_000, 256


class TrieEncoder:
    """Encodes distinct words over a trie.

    The encoding of a string ends in exactly one token, and what stands before that token is the encoding of a
    shorter prefix. So a trie node needs one state, the last token of its prefix, found from the states of its
    ancestors: the token must end the prefix, and together with the last token of the prefix before it be a pair
    that no merge would join across. Following last tokens towards the root gives the whole encoding. Words are
    taken in byte order, which visits the trie depth first, so only the path to the root is held; each shared prefix is
    worked out once. The tokens that end a prefix, longest first, come from an Aho-Corasick automaton of the vocabulary.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._link()
        self.words: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    def _link(self) -> None:
        """The automaton: step by state and byte, back to the longest proper suffix that is a state too; the longest token
        that ends a state, and the next shorter one that ends a token, -1 for none."""
        self.step, self.back, self.ends = {}, [0], [-1]
        step, back, ends, levels = self.step, self.back, self.ends, [[] for _ in range(self.v.longest)]
        for raw, token in self.v.ids.items():
            at = 0
            for depth, byte in enumerate(raw):
                to = step.get(at << 8 | byte)
                if to is None:
                    to = step[at << 8 | byte] = len(back)
                    back.append(0)
                    ends.append(-1)
                    levels[depth].append((at, byte, to))
                at = to
            ends[at] = token
        self.shorter, self.size = [-1] * self.v.size, list(map(len, self.v.bytes))
        self.single = [array("I", [i]).tobytes() for i in range(self.v.size)]
        for depth, states in enumerate(levels):
            for at, byte, to in states:
                back[to] = self._next(back[at], byte) if depth else 0
                rest = ends[back[to]]
                if ends[to] < 0:
                    ends[to] = rest
                else:
                    self.shorter[ends[to]] = rest

    def _next(self, at: int, byte: int) -> int:
        """The state after one more byte."""
        step, edge = self.step, at << 8 | byte
        to = step.get(edge)
        while to is None and at:
            at = self.back[at]
            to = step.get(at << 8 | byte)
        if len(step) < NODES:
            step[edge] = to or 0
        return to or 0

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives just these two.

        Walks back through the merges on both sides of the border. A token lives from the rank that made it up to
        the rank that merges it on; a merge across the border happens if its rank comes up while both its sides
        live. Of equal ranks, the merge further left goes first.
        """
        key = left << 32 | right
        known = self.apart.get(key)
        if known is not None:
            return known
        made, merge = self.v.made, self.v.merge
        end_left = end_right = sys.maxsize
        a, b, free = left, right, True
        while True:
            across = merge.get((a, b))
            if across is not None and across[0] < end_left and across[0] <= end_right:
                free = False
                break
            of_a, of_b = made.get(a), made.get(b)
            if of_a is None and of_b is None:
                break
            if of_a is None or (of_b is not None and of_b[0] >= of_a[0]):
                end_right, b = of_b[0], of_b[1]
            else:
                end_left, a = of_a[0], of_a[2]
        if len(self.apart) > 4 * WORDS:
            self.apart.clear()
        self.apart[key] = free
        return free

    def _grow(self, words: list[bytes]) -> list[bytes]:
        """Encodings of sorted distinct words: a depth-first walk of their trie."""
        step, ends, shorter, size, single, apart = self.step, self.ends, self.shorter, self.size, self.single, self.apart
        # of the node at each depth of the path
        state, last, whole = [0] * (LONG + 1), [-1] * (LONG + 1), [b""] * (LONG + 1)
        previous, out = b"", []
        for word in words:
            end, most = 0, min(len(previous), len(word))
            while end < most and previous[end] == word[end]:
                end += 1
            at = state[end]
            for byte in word[end:]:
                end += 1
                to = step.get(at << 8 | byte)
                at = state[end] = self._next(at, byte) if to is None else to
                token = ends[at]
                while token >= 0:
                    start = end - size[token]
                    if not start:
                        break
                    fits = apart.get(last[start] << 32 | token)
                    if fits or (fits is None and self.stays_apart(last[start], token)):
                        break
                    token = shorter[token]
                else:
                    raise ValueError("a byte has no token")
                last[end], whole[end] = token, whole[start] + single[token]
            out.append(whole[end])
            previous = word
        return out

    def _line(self, word: bytes) -> array:
        """A long word: its trie is one path, so two arrays do."""
        last, at = array("i", [-1]), 0
        for end, byte in enumerate(word, 1):
            at = self._next(at, byte)
            token = self.ends[at]
            while token >= 0 and end > self.size[token] and not self.stays_apart(last[end - self.size[token]], token):
                token = self.shorter[token]
            if token < 0:
                raise ValueError("a byte has no token")
            last.append(token)
        found, end = array("I"), len(word)
        while end:
            found.append(last[end])
            end -= len(self.v.bytes[last[end]])
        found.reverse()
        return found

    def learn(self, words: set[str]) -> None:
        """Adds the encodings of new distinct words."""
        plain = sorted(words)  # as their bytes would be
        raw = [w.encode() for w in plain]
        special, lined = words & self.v.special.keys(), [w for w, x in zip(plain, raw, strict=True) if len(x) > LONG]
        if special or lined:
            odd = special.union(lined)
            self.words.update((w, self.single[self.v.special[w]] if w in special else self._line(w.encode()).tobytes()) for w in odd)
            plain = [w for w in plain if w not in odd]
            raw = [w.encode() for w in plain]
        self.words.update(zip(plain, self._grow(raw), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as native unsigned 32-bit integers."""
        split = [self.v.pieces(t) for t in texts]
        distinct = set().union(*split) if split else set()
        new = distinct.difference(self.words)
        if len(self.words) + len(new) > WORDS:  # those in use stay
            self.words = {w: self.words[w] for w in distinct if w in self.words}
        if new:
            self.learn(new)
        words = self.words
        return [b"".join(map(words.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> str:
        tokens = self.v.bytes
        return b"".join([tokens[i] for i in array("I", ids)]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def worker_coder(path: str) -> TrieEncoder:
    """One for all tasks of a worker: what one task has encoded, the next knows."""
    return TrieEncoder(Vocabulary(path))


def _little(ids: bytes) -> bytes:
    if sys.byteorder == "little":
        return ids
    swapped = array("I", ids)
    swapped.byteswap()
    return swapped.tobytes()


def bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and decodes every text: (id_col, n_tokens, ids, decoded), ids as little-endian unsigned 32-bit integers.

    A null text counts as empty: no ids, and an empty decoded text. A null id stays null. Repeated rows each give
    a row. Other columns of docs are not read, whatever their names. An empty table gives an empty one. No text is
    cut; a worker holds one slice of rows, bounded in bytes unless a single text is longer.
    """
    path = path or default_vocabulary()

    def make():
        coder = worker_coder(path)

        def step(columns):
            ids = coder.encode([t or "" for t in columns[1]])
            return [columns[0], [len(x) // 4 for x in ids], [_little(x) for x in ids], [coder.decode(x) for x in ids]]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def op9(spark, sf_dir: str) -> DataFrame:
    out = bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))

"""BPE encoding and decoding by a trie of distinct words.

For a byte-pair vocabulary each prefix of a word has one last token: the last one
of the prefix's own encoding. It is the token `t` that ends the prefix, such that
the prefix without `t` ends in a token `s` and (`s`, `t`) encodes to itself. So a
depth-first walk over a trie of the distinct words (they are inserted in order)
finds the last token of each prefix once, however many words share it, from those of
the nodes above; a word's encoding is read back along its last tokens. The final
symbol of a word carries the end-of-word mark.

The trie stays in a process from one batch to the next, and words are encoded once
and looked up after that; the trie and the table of known words are bounded and begun
anew when full. Decoding goes from ids to the tokens' texts. One pass over the texts
in Arrow batches, no shuffle; memory is bounded by both tables, a fixed number of
bytes and the longest text.

Defined results: a null text counts as empty and an empty one has no tokens;
special tokens' strings in a text become those tokens; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from struct import pack

from pyspark.sql import DataFrame, SparkSession

from .batches import kept_until_left, map_texts
from .common import table

#: Known words a process keeps, nodes of its trie, and pairs of tokens whose validity it keeps.
WORDS_KEPT, NODES_KEPT, PAIRS_KEPT = 300_000, 450_000, 150_000
NEVER = 1 << 60
#: Below this code point, lower case and composed, Python and the library agree on letters and numbers.
PLAIN_BELOW = "ɐ"


class Codec:
    """A vocabulary of the tokenizers library's BPE model with an end-of-word mark."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.made = {a + b: (k, a, b) for (a, b), k in self.ranks.items()}
        #: Tokens that are the encodings of their own characters: all that an encoding can hold.
        self.whole = {t for t in self.ids if t not in self.made}
        for t, (k, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]):
            if a in self.whole and b in self.whole and self.meets(a, b, k):
                self.whole.add(t)
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Fixed value: the vocabulary's pattern, its white space written out.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+").findall
        self.symbol = byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbol)}
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: The trie: the node below a node by a character, and the last token of each node's prefix. The root is 0.
        self.nodes: dict[int, int] = {}
        self.last = [""]

    def meets(self, a: str, b: str, until: int) -> bool:
        """Whether no merge across the boundary of `a` and `b` comes before `until`.

        Merges inside are undone from the last one back. At each step the parts
        that then met at the boundary must not have a merge that comes earlier,
        or, of equal merges, further left.
        """
        while self.ranks.get((a, b), NEVER) >= until:
            in_a, in_b = self.made.get(a), self.made.get(b)
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and in_a[0] > in_b[0]:
                until, a = in_a[0], in_a[2]
            else:
                until, b = in_b[0] + 1, in_b[1]
        return False

    def follows(self, before: str, token: str) -> bool:
        """Whether the encoding of the two tokens' characters is just them."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        got = self.pairs[before, token] = not before or self.meets(before, token, NEVER)
        return got

    def ending(self, symbols: str, way: list[int], upto: int, end: str) -> tuple[int, str]:
        """Start and text of the last token of symbols[:upto]; way: the nodes of the shorter prefixes."""
        last, whole, pairs = self.last, self.whole, self.pairs
        for k in range(max(0, upto - self.longest), upto):
            token = symbols[k:upto] + end
            if token in whole and ((ok := pairs.get((last[way[k]], token))) or ok is None and self.follows(last[way[k]], token)):
                return k, token
        raise ValueError(f"no token of the vocabulary ends {symbols[:upto]!r}")

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet, in their order, which walks the trie depth first."""
        if len(self.last) > NODES_KEPT:
            self.nodes.clear()
            del self.last[1:]
        nodes, last, symbol, ending = self.nodes, self.last, self.symbol, self.ending
        for w in sorted(words):
            symbols = w if w.isascii() and w.isprintable() else "".join([symbol[b] for b in w.encode()])
            node, way = 0, [0]
            for c in symbols[:-1]:
                below = nodes.get(key := node << 21 | ord(c))
                if below is None:
                    token = ending(symbols, way, len(way), "")[1]
                    below = nodes[key] = len(last)
                    last.append(token)
                node = below
                way.append(node)
            at, token = ending(symbols, way, len(symbols), self.end)
            out = [token]
            while at:
                out.append(t := last[way[at]])
                at -= len(t)
            out.reverse()
            self.known[w] = pack(f"<{len(out)}I", *map(self.ids.__getitem__, out))

    def split(self, text: str) -> list[str]:
        """The text's words, in lower case and composed form."""
        if text.isascii() or max(text) < PLAIN_BELOW and unicodedata.is_normalized("NFC", text):
            return self.words(text.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in found]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, 4 bytes each."""
        cut = []
        for t in texts:
            if self.split_special and "<|" in t and len(parts := self.split_special.split(t)) > 1:
                cut.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.split(p) if p else [])])
            else:
                cut.append(self.split(t) if t else [])
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for s, i in self.special.items():
            self.known[s] = pack("<I", i)
        if new := set().union(*cut).difference(self.known):
            self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, 4 bytes each, and what they decode to."""
        return [(ids, self.decode(ids)) for ids in self.ids_of(texts)]

    def decode(self, ids: bytes) -> str:
        """As the library decodes without a decoder: tokens joined with a space."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def codec(path: str) -> Codec:
    kept_until_left(__name__, codec.cache_clear)
    return Codec(path)


def _digests(path: str) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    def make() -> Callable[[list[str]], list[tuple]]:
        c = codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return lambda texts: [(len(ids) // 4, sha(ids), sha(text.encode())) for ids, text in c.encode(texts)]

    return make


def _ids(path: str) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    def make() -> Callable[[list[str]], list[tuple]]:
        import numpy as np

        c = codec(path)
        return lambda texts: [(np.frombuffer(ids, "<u4").astype("i4"),) for ids in c.ids_of(texts)]

    return make


def encode(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all) of the documents with their token ids in `ids`."""
    return map_texts(docs, _ids(vocabulary or default_vocabulary()), "ids array<int>", keep=keep)


def digests(docs: DataFrame, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` with n_tokens, ids_sha256 and decoded_sha256."""
    return map_texts(docs, _digests(vocabulary or default_vocabulary()), "n_tokens long, ids_sha256 string, decoded_sha256 string", keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are the leaves of a trie of bytes. In sorted order they are its depth-first walk: what a word shares
with the one before it is the path that the walk stays on. The walk carries, for every prefix, the last token of that prefix's
encoding: the one token that ends there and follows the shorter prefix's last token as BPE itself would place it. The tokens that
end at a prefix follow from its longest ending that begins a token, which one byte moves on. A prefix shared by many words is so
encoded once, and a word's ids are read back along the last tokens.

Null texts count as empty; an empty text has no ids. Memory is bounded by the caches' limits and the longest text; the caches
only save time. Repeated rows give repeated results.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from itertools import chain

from pyspark.sql import DataFrame

from synteny_spark.llm.common import per_text, texts

#: Entries at which a cache starts anew.
CACHE = 400_000


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class TrieBpe:
    """A byte-level BPE vocabulary of a tokenizers JSON file."""

    #: Characters on which this pattern and the library's own splitting agree; other texts are split by the library.
    SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ]*\Z")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+| ?[\d\xb2\xb3\xb9\xbc-\xbe]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    #: A space beside other white space: then the pieces between spaces are not split independently.
    CROWDED = ("  ", *(x + " " for x in "\t\n\r\xa0"), *(" " + x for x in "\t\n\r\xa0"))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        as_bytes = {s: bytes(symbols[c] for c in s) for s in vocab if s not in self.specials}
        self.ids = {b: vocab[s] for s, b in as_bytes.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        #: States: the beginnings of tokens. Of each, the tokens that end it with their lengths, longest first; moves are found as needed.
        self.beginnings = {p: i for i, p in enumerate(dict.fromkeys([b"", *(b[:k] for b in self.ids for k in range(1, len(b) + 1))]))}
        self.spelt = list(self.beginnings)
        self.fits: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.spelt)
        self.moves: dict[int, int] = {}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        #: What each token is merged from. In order, if a token has one merge, after those of its parts: then merges can be undone.
        self.made = {token: (rank, *pair) for pair, (rank, token) in self.merges.items()}
        self.ordered = len(self.made) == len(self.merges) and all(rank > self.made.get(x, (-1,))[0] for rank, *pair in self.made.values() for x in pair)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.cut_at = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.many = max(self.bytes_of) + 1
        #: By a * many + b, whether b may follow a.
        self.follows: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        #: By what follows a space up to the next one.
        self.pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Plain BPE: again and again the leftmost pair of the lowest rank."""
        merges = self.merges
        while found := [(*m, i) for i, p in enumerate(zip(parts, parts[1:])) if (m := merges.get(p))]:
            _, token, at = min(found, key=lambda m: (m[0], m[2]))
            parts[at : at + 2] = [token]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two tokens."""
        found = self.follows.get(a * self.many + b)
        if found is None:
            if len(self.follows) > 4 * CACHE:
                self.follows.clear()
            found = self.follows[a * self.many + b] = self.stay_apart(a, b) if self.ordered else self.merge([self.ids[bytes((x,))] for x in self.bytes_of[a] + self.bytes_of[b]]) == [a, b]
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b: the merges that made them are undone, the last one first, and what meets is looked at."""
        merges, made, byte, limit = self.merges, self.made, (-1,), len(self.merges)
        while True:
            across = merges.get((a, b))
            if across and across[0] < limit:
                return False
            left, right = made.get(a, byte), made.get(b, byte)
            if left[0] > right[0]:
                limit, a = left[0], left[2]
            elif right[0] >= 0:
                limit, b = right[0] + 1, right[1]  # of equal ranks the leftmost pair goes first
            else:
                return True

    def move(self, state: int, byte: int) -> int:
        """The longest ending of the state's bytes and one more that begins a token."""
        ending = self.spelt[state] + bytes((byte,))
        while ending not in self.beginnings:
            ending = ending[1:]
        found = self.beginnings[ending]
        if self.fits[found] is None:
            self.fits[found] = tuple((len(ending) - k, self.ids[ending[k:]]) for k in range(len(ending)) if ending[k:] in self.ids)
        if len(self.moves) > 4 * CACHE:
            self.moves.clear()
        self.moves[state << 8 | byte] = found
        return found

    def encode_words(self, words: list[str]) -> None:
        """Adds the words to the cache. At depth d of the walk, the arrays tell of the d bytes above it: state, last token, where that begins."""
        moves, fits, follows, many = self.moves, self.fits, self.follows, self.many
        # last holds the vocabulary's own ints, which all cached words share; out of an array each would be a new one
        states, last, start, before = array("i", [0]), [0], array("i", [0]), b""
        for w in sorted(words):
            raw = w.encode("utf-8")
            d = 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                d += 1
            before = raw
            del states[d + 1 :], last[d + 1 :], start[d + 1 :]
            state = states[d]
            for x in raw[d:]:
                known = moves.get(state << 8 | x)
                state = self.move(state, x) if known is None else known
                d += 1
                for size, token in fits[state]:
                    k = d - size
                    if not k:
                        break
                    known = follows.get(last[k] * many + token)
                    if known or known is None and self.may_follow(last[k], token):
                        break
                else:
                    raise ValueError("a byte has no token")
                states.append(state), last.append(token), start.append(k)
            ids = []
            while d:
                ids.append(last[d])
                d = start[d]
            ids.reverse()
            self.words[w] = tuple(ids)

    def split(self, text: str) -> list[str]:
        if self.SIMPLE.match(text):
            return self.WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def split_piece(self, piece: str) -> list[str]:
        """As split; the common shapes, a word and a word with one mark after it, are told without a pattern."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return [piece]
        if body[:-1].isalpha() and body[-1] in ".,;:!?":
            return [piece[:-1], piece[-1]]
        return self.split(piece)

    def encode_batch(self, batch: list[str]) -> list[list[int]]:
        """The ids of each text. Much is allocated here and nothing in cycles, so the collector rests meanwhile."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(batch)
        finally:
            if on:
                gc.enable()

    def _encode_batch(self, batch: list[str]) -> list[list[int]]:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        words, known = self.words, self.pieces
        plans, met, pieces = [], set(), set()
        for text in batch:
            plan: list[str | tuple[dict, list[str]]] = []
            for part in self.cut_at.split(text) if self.cut_at and "<" in text else (text,):
                if part in self.specials:
                    plan.append(part)
                elif part and (any(x in part for x in self.CROWDED) or not self.SIMPLE.match(part)):
                    plan.append((words, self.split(part)))
                    met.update(plan[-1][1])
                elif part:
                    first, *rest = part.split(" ")
                    plan += [(words, self.split_piece(first)), (known, rest)]
                    met.update(plan[-2][1])
                    pieces.update(rest)
            plans.append(plan)
        fresh = {p: self.split_piece(" " + p) for p in pieces if p not in known}
        met.update(chain.from_iterable(fresh.values()))
        self.encode_words([w for w in met if w not in words])
        for p, parts in fresh.items():
            known[p] = words[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable([words[w] for w in parts]))
        out = []
        for plan in plans:
            ids: list[int] = []
            for part in plan:
                if isinstance(part, str):
                    ids.append(self.specials[part])
                else:
                    ids.extend(chain.from_iterable(map(part[0].__getitem__, part[1])))
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, TrieBpe] = {}


def loaded(path: str) -> TrieBpe:
    """One vocabulary and its caches for all tasks of a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text."""
    path = path or vocabulary_path()
    return per_text(texts(docs, id_col, text_col), lambda: lambda batch: [(ids,) for ids in loaded(path).encode_batch(batch)], "ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null ids give an empty text."""
    from pyspark.sql import functions as F

    path = path or vocabulary_path()
    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("text"))
    return per_text(rows, lambda: lambda batch: [(loaded(path).decode(ids),) for ids in batch], "text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text is encoded, and decoded again from those ids."""
    path = path or vocabulary_path()

    def make():
        bpe, sha = loaded(path), hashlib.sha256

        def run(batch: list[str]) -> list[tuple]:
            return [(len(ids), sha(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(), sha(bpe.decode(ids).encode("utf-8")).hexdigest()) for ids in bpe.encode_batch(batch)]

        return run

    return per_text(texts(docs, id_col, text_col), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Byte-level BPE by forced-boundary splitting.

A merge can only make a token of the vocabulary, so two neighbouring bytes that stand next
to each other inside no token are never merged over: there a cut is certain, and what lies
between two cuts can be encoded by itself. Texts are first split as the vocabulary's file
says (special tokens, then its pattern); each piece is cut at the forced boundaries, the
fragments are encoded on their own, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import map_rows

#: The pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids, in each task; longer pieces than LONG bytes are not kept.
CACHED, LONG = 200_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself if printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder over one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        spelt = lambda s: bytes(to_byte[c] for c in s)
        vocab = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes = {i: spelt(s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.single = [vocab[c] for c in byte_letters()]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.inside = {pair for s in map(spelt, vocab) for pair in zip(s, s[1:])}
        self._native = _native({spelt(s): i for s, i in vocab.items()}, [x[1] for x in self.merge.values()])
        self.split, self.narrow = regex.compile(PATTERN), _narrow()
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.kept, self._newer = path, _Kept(self.piece), None

    def fragments(self, piece: bytes) -> list[bytes]:
        """piece, cut at each pair of bytes that no token has inside."""
        if self.inside.issuperset(zip(piece, piece[1:])):
            return [piece]
        cuts = [0, *(i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in self.inside), len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:])]

    def fragment(self, b: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank first, the leftmost of them."""
        if self._native and len(b) <= 200:
            return self._native(b)
        ids, merge = [self.single[x] for x in b], self.merge
        if len(ids) > 24:
            return self._by_heap(ids)
        while len(ids) > 1:
            rank, at = min((merge.get(p, _NONE)[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == _NONE[0]:
                break
            ids[at : at + 2] = [merge[ids[at], ids[at + 1]][1]]
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """As fragment(), in n log n steps over a linked list, for long fragments."""
        n, merge = len(ids), self.merge
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if (m := merge.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = merge[pair][1], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := merge.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, (ids[a], ids[b])))
        return [x for x in ids if x is not None]

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece of the pattern."""
        return [*chain.from_iterable(map(self.fragment, self.fragments(piece.encode())))]

    def pieces(self, text: str) -> list[str]:
        """text as the library's pattern splits it."""
        if text.isascii() or not _WIDE.search(text):
            return self.narrow.findall(text)
        if not (there := self.newer.intersection(text)):
            return self.split.findall(text)
        # U+0378 is assigned in no version: it is neither letter nor number, as those were.
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(dict.fromkeys(map(ord, there), 0x378)))]

    @property
    def newer(self) -> set[str]:
        """Letters and numbers of the pattern's library that the vocabulary's library doesn't know yet."""
        if self._newer is None:
            import regex
            from tokenizers import Tokenizer

            split, out = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str, set()
            every = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))
            for kind, sign in ((r"\p{L}", "a"), (r"\p{N}", "1")):
                own = regex.findall(kind, every)
                for at in range(0, len(own), 1000):
                    part = own[at : at + 1000]
                    # A block of letters stays one piece; only a block that falls apart is looked at.
                    if len(split(sign + "".join(part))) > 1:
                        out.update(c for c in part if len(split(sign + c)) > 1)
            self._newer = out
        return self._newer

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        out: list[int] = []
        parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(self.kept.__getitem__, self.pieces(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_WIDE = re.compile("[^\0-\u024f]")


def _narrow() -> re.Pattern:
    """PATTERN for texts below U+0250, its classes spelt out, which Python's own engine runs much faster."""
    import regex

    chars = [chr(c) for c in range(0x250)]
    pattern = PATTERN
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = "".join(re.escape(c) for c in chars if regex.match(name, c))
        pattern = re.sub(rf"(\[\^[^]]*){re.escape(name)}", lambda m, x=inside: m[1] + x, pattern)
        pattern = pattern.replace(name, f"[{inside}]")
    outside = "".join(re.escape(c) for c in chars if regex.match(r"\S", c))
    return re.compile(pattern.replace(r"\S", f"[{outside}]"))


def _native(ranks: dict[bytes, int], made: list[int]):
    """A compiled function for short fragments, if the vocabulary numbers its tokens by rank as that needs."""
    try:
        import tiktoken
    except ImportError:
        return None
    if any(a >= b for a, b in zip(made, made[1:])) or min(made, default=256) < 256 or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Kept(dict):
    """Ids by piece, for a bounded number of short pieces."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> list[int]:
        ids = self.make(piece)
        if len(piece) <= LONG:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


_NONE = (1 << 60, -1)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of docs, by the vocabulary file at path.

    One narrow pass, nothing is shuffled; a task holds the vocabulary (a few dozen MB) and a
    bounded cache of pieces. path must be readable on every worker. A null or empty text has no
    ids and decodes to the empty text; a null id stays null; repeated rows are each encoded;
    an empty table gives an empty result; other columns of docs are not looked at.
    """

    def start():
        bpe = ForcedBoundaryBpe(path)

        def run(cols):
            ids = [bpe.encode(t or "") for t in cols[1]]
            return [cols[0], ids, [bpe.decode(x) for x in ids]]

        return run

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(kept, start, "doc_id long, ids array<int>, decoded string", rows=64)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; see encode() for nulls and ties.

    The digests are taken where the ids are made, so ids and texts don't travel back.
    """

    def start():
        bpe = ForcedBoundaryBpe(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def run(cols):
            n, of_ids, of_text = [], [], []
            for t in cols[1]:
                ids = bpe.encode(t or "")
                n.append(len(ids))
                of_ids.append(sha(",".join(map(bpe.text.__getitem__, ids)).encode()))
                of_text.append(sha(bpe.decode(ids).encode()))
            return [cols[0], n, of_ids, of_text]

        return run

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_rows(kept, start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Byte-level BPE encoding and decoding by speculation and verification.

Every piece of a text (the pre-tokenizer's "word") is first cut greedily into
the longest known tokens. A cut is the true encoding exactly when each pair of
neighbouring tokens is compatible: encoding the two together gives the two back.
That test runs over all pairs of a block at once, as array operations; only
pieces with an incompatible pair are merged step by step.

Rows are independent: nothing is shuffled, a lost executor repeats its own
partitions. The vocabulary is a file of fixed size, broadcast once.

Defined results: a null text counts as an empty one and gives no ids; rows are
answered one by one, so repeated rows and null or repeated ``doc_id`` stay as
they are; other columns of the input are not read; an empty table gives none.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Fixed value of the byte-level scheme: the cut of a text into pieces, with classes
#: for letters (L), numbers (N) and white space (S).
PIECES = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
BLOCK_CHARS = 2_000_000
REMEMBERED_PIECES = 1_000_000
SHORT_PIECE = 40  # bytes; longer ones are merged one by one with a heap
SIMPLE_SIGNS = 0x0530  # the quick pattern spells out the letters and numbers below this code point
SCHEMA = "doc_id bigint, n_tokens bigint, ids_le32 binary, decoded string"
NEVER = np.iinfo(np.int64).max


def pieces_pattern(classes: dict[str, str]) -> str:
    return re.sub("[LNS]", lambda m: classes[m[0]], PIECES)


def quick_classes() -> dict[str, str]:
    """The classes below SIMPLE_SIGNS spelled out, for the standard library's faster engine."""
    signs = [chr(c) for c in range(SIMPLE_SIGNS)]
    return {k: "".join(map(re.escape, filter(regex.compile(c).match, signs))) for k, c in CLASSES.items()}


def byte_of_symbol() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and merge parts as arrays over token ids."""

    def __init__(self, document: dict):
        symbols = byte_of_symbol()
        spell = lambda token: bytes(symbols[c] for c in token)
        model = document["model"]
        self.added = {a["content"]: a["id"] for a in document["added_tokens"]}
        self.id_of = {spell(t): i for t, i in model["vocab"].items()}
        size = 1 + max([*self.id_of.values(), *self.added.values()])
        self.bytes_of = [b""] * size
        for spelled, i in self.id_of.items():
            self.bytes_of[i] = spelled
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (spell(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole, one, two = self.id_of[a + b], self.id_of[a], self.id_of[b]
            self.merge[one, two] = rank, whole
            self.rank[whole], self.left[whole], self.right[whole] = rank, one, two
        keys = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_wholes = np.array(list(self.merge.values()), np.int64)[order].T
        self.id_of_byte = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        # a token that its own bytes do not encode to may not be proposed
        self.proposed = {s: i for s, i in self.id_of.items() if len(s) == 1 or self.exact(s) == [i]}
        self.reach: dict[bytes, int] = {}
        for s in self.proposed:
            self.reach[s[:3]] = max(self.reach.get(s[:3], 1), len(s))

    def ranks(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (NEVER without one) and the token it makes."""
        key = x << 32 | y
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k], NEVER), self.pair_wholes[k]

    def exact(self, piece: bytes) -> list[int]:
        """Merge the lowest rank first, leftmost on ties, with a heap over a linked list."""
        ids = [self.id_of[piece[i:i + 1]] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False))
                if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one side is gone by now
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < len(ids) and (p := (ids[x], ids[y])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], x, *p))
        return [i for i in ids if i >= 0]

    def greedy(self, piece: bytes) -> list[int]:
        out, i, known, reach = [], 0, self.proposed, self.reach
        while i < len(piece):
            for j in range(min(len(piece), i + reach.get(piece[i:i + 3], 2)), i, -1):
                if (token := known.get(piece[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether their bytes together encode to just the pair.

        Walks back in time along the border: of the two pieces that touch there,
        the one made last is split. While they touched, a merge across the border
        must not have come before the merges that took one of them away; among
        equal ranks the one on the left comes first.
        """
        good = np.ones(len(x), bool)
        at = np.arange(len(x))
        gone_x, gone_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(at):
            rank, _ = self.ranks(x, y)
            clash = (rank < gone_x) & (rank <= gone_y) & (rank < NEVER)
            good[at[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry, gone_x, gone_y = (v[go] for v in (at, x, y, rx, ry, gone_x, gone_y))
            split_x = rx > ry
            gone_x, gone_y = np.where(split_x, rx, gone_x), np.where(split_x, gone_y, ry)
            x, y = np.where(split_x, self.right[x], x), np.where(split_x, y, self.left[y])
        return good

    def exact_many(self, pieces: list[bytes]) -> list[list[int]]:
        """exact() of many short pieces in step: one merge in each of them at a time."""
        out: list[list[int]] = [[]] * len(pieces)
        ids = self.id_of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank, whole = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)
        fresh = np.arange(len(ids))  # whose pair with the next token is not looked up yet
        while len(ids):
            fresh = fresh[fresh + 1 < len(ids)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh], whole[fresh] = self.ranks(ids[fresh], ids[fresh + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NEVER
            for i, lo, n in zip(owner[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                out[i] = ids[lo:lo + n].tolist()
            best = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < NEVER))
            if not len(best):
                break
            best = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
            ids[best] = whole[best]
            rank[best] = NEVER
            touched = np.zeros(len(ids), bool)
            touched[best] = True
            before = best[best > 0] - 1
            before = before[owner[before] == owner[before + 1]]
            touched[before], rank[before] = True, NEVER
            keep = ~np.repeat(done, sizes)
            keep[best + 1] = False
            ids, owner, rank, whole, touched = (v[keep] for v in (ids, owner, rank, whole, touched))
            fresh = np.flatnonzero(touched)
        return out

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of each piece: proposals, one check of all pairs, exact merging of the rest."""
        spelled = [p.encode("utf-8", "surrogatepass") for p in pieces]
        proposals = [self.greedy(s) for s in spelled]
        flat = np.array([t for p in proposals for t in p], np.int64)
        owner = np.repeat(np.arange(len(proposals)), [len(p) for p in proposals])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.unique(owner[inner[~good[which]]]).tolist()
        short = [i for i in failed if len(spelled[i]) <= SHORT_PIECE]
        for i, ids in zip(short, self.exact_many([spelled[i] for i in short]), strict=True):
            proposals[i] = ids
        for i in failed:
            if len(spelled[i]) > SHORT_PIECE:
                proposals[i] = self.exact(spelled[i])
        ends = np.cumsum([4 * len(p) for p in proposals]).tolist()
        packed = np.array([t for p in proposals for t in p], "<u4").tobytes()
        return {p: packed[lo:hi] for p, lo, hi in zip(pieces, [0, *ends], ends, strict=False)}


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        document = json.load(file)
    used = {k: document.get(k) for k in ("normalizer", "post_processor")}
    kinds = [document[k]["type"] for k in ("pre_tokenizer", "decoder", "model")]
    if kinds != ["ByteLevel", "ByteLevel", "BPE"] or used["normalizer"] \
            or document["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    return Vocabulary(document)


class Encoder:
    """A vocabulary with the pieces met so far; the memory is emptied when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.find_any = regex.compile(pieces_pattern(CLASSES)).findall
        self.find_simple = re.compile(pieces_pattern(quick_classes())).findall
        self.unusual = re.compile(f"[^\0-{chr(SIMPLE_SIGNS - 1)}]").search
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.packed_mark = {m: np.array([i], "<u4").tobytes() for m, i in vocabulary.added.items()}

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if self.unusual(text) else self.find_simple(text)

    def parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """Added tokens stand for themselves wherever they occur; the rest is cut into pieces."""
        if self.marks is None or not self.marks.search(text):
            return [(False, self.find(text))]
        return [(i % 2 == 1, [p] if i % 2 else self.find(p))
                for i, p in enumerate(self.marks.split(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        if len(self.known) > REMEMBERED_PIECES:
            self.known.clear()
        new: set[str] = set()
        for parts in cut:
            for marked, pieces in parts:
                if not marked:
                    new.update(pieces)
        new.difference_update(self.known)
        if new:
            self.known.update(self.vocabulary.encode_pieces(list(new)))
        return [b"".join(b"".join(map((self.packed_mark if m else self.known).__getitem__, pieces))
                         for m, pieces in parts) for parts in cut]

    def decode(self, packed: bytes) -> str:
        of = self.vocabulary.bytes_of
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")


ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(key: tuple[str, str], held: Broadcast) -> Encoder:
    """One encoder for all tasks of a query in a worker process, so that its memory pays."""
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(held.value)
    return ENCODERS[key]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BLOCK_CHARS characters, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as packed little-endian 32-bit integers, and the text decoded from them."""
    held, key = docs.sparkSession.sparkContext.broadcast(load(path)), (path, uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, held)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in blocks(texts):
                packed = encoder.encode([t or "" for t in texts[lo:hi]])
                yield pa.record_batch([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array(packed, pa.binary()), pa.array([encoder.decode(p) for p in packed], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_le32", "decoded"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)

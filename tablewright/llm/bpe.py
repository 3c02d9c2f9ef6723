"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a batch stand in one row of symbols. An index maps each rank (a pair that
the vocabulary merges) to all positions where it stands; the lowest active rank is applied at
all its positions, the lists of the pairs that this makes are extended, and so on until no rank
is active. Every word gets its merges in the order of their ranks, as encoding it alone would.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tablewright.llm.chunks import ChunkIds
from tablewright.llm.common import HashIndex, list_array, mixed, texts

# Bytes of text whose distinct words are merged together.
UNIT_BYTES = 1 << 22
# Words that a worker keeps the ids of, and ids that are decoded at once.
KEPT_WORDS = 500_000
DECODED_IDS = 1 << 19
# Ranks below this are applied to all their positions in one step.
COMMON_RANKS = 1_000
# --- Fixed values: how the vocabulary's file splits words of ASCII characters ------------------
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file: its text for the workers, and the tables of its merges."""

    source: str

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())


class Encoder:
    """Ids of words by a vocabulary; built once per task."""

    def __init__(self, vocabulary: Vocabulary, common: int = COMMON_RANKS) -> None:
        spec = json.loads(vocabulary.source)
        model = spec["model"]
        self.library = Tokenizer.from_str(vocabulary.source)  # its normalizer and splitter, not its merges
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges: dict[int, int] = {}
        self.result: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            first, second = self.vocab[a], self.vocab[b]
            self.result.append((first, second, self.vocab[a + b]))
            self.merges[first << 32 | second] = rank
        keys = np.array(list(self.merges), np.uint64)
        self.pairs = HashIndex(mixed(keys))
        # Ids of the byte alphabet's characters, inside a word and at its end.
        single = {c: i for c, i in self.vocab.items() if len(c) == 1}
        self.inner = np.full(max(map(ord, single)) + 1, -1, np.int64)
        self.final = self.inner.copy()
        for c, i in single.items():
            self.inner[ord(c)], self.final[ord(c)] = i, self.vocab[c + self.suffix]
        self.common = common
        # The vocabulary's characters for bytes; the bytes of letters and punctuation stand for themselves.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self.alphabet |= {b: level.pre_tokenize_str(chr(b))[0][0][-1] for b in range(128, 192)}
        self.alphabet |= {b: level.pre_tokenize_str(chr((b & 31) << 6 | 0x20))[0][0][0] for b in range(194, 196)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _parts(self, word: bytes) -> list[str]:
        """A word's parts in the vocabulary's byte alphabet."""
        own = word.decode()
        if word.isascii():
            return [own.lower()] if own.isalpha() else ASCII_PARTS.findall(own.lower().translate(self.alphabet))
        if own.isalpha() and max(own) < "\u0100":  # Latin letters, composed already
            return [own.lower().encode().decode("latin-1").translate(self.alphabet)]
        normal = self.library.normalizer.normalize_str(own)
        return [part for part, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def merge(self, parts: list[str]) -> list[list[int]]:
        """The ids of each part, all parts together.

        The first ``common`` ranks stand at very many positions and are applied to all of them
        at once; the later ones have few positions each and are walked.
        """
        if not parts:
            return []
        text = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        symbols = self.inner[text]
        symbols[ends - 1] = self.final[text[ends - 1]]
        following = np.arange(1, len(symbols) + 1)
        following[ends - 1] = -1
        before = np.arange(-1, len(symbols) - 1)
        before[ends[:-1]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def found_at(at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions."""
            after = following[at]
            at, after = at[after >= 0], after[after >= 0]
            rank = self._ranks(symbols[at], symbols[after])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            for own, a, b in zip(rank[first].tolist(), first.tolist(), [*first.tolist()[1:], len(rank)], strict=False):
                if own in places:
                    places[own].append(at[a:b])
                else:
                    places[own] = [at[a:b]]
                    heapq.heappush(active, own)

        found_at(np.arange(len(symbols)))
        while active and active[0] < self.common:
            rank = heapq.heappop(active)
            first, second, merged = self.result[rank]
            lists = places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if first == second or len(lists) > 1:
                at = np.unique(at)
            after = following[at]
            good = (symbols[at] == first) & (after >= 0)
            good[good] = symbols[after[good]] == second
            at, after = at[good], after[good]
            if first == second and len(at):  # "aaa" merges its first two
                run = np.flatnonzero(np.concatenate([[True], at[1:] != after[:-1]]))
                nth = np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))
                at, after = at[nth % 2 == 0], after[nth % 2 == 0]
            symbols[at], symbols[after] = merged, -1
            beyond = following[after]
            following[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            back = before[at]
            found_at(np.concatenate([at, back[back >= 0]]))
        walked = self._walk(
            symbols.tolist(), following.tolist(), before.tolist(),
            {rank: np.concatenate(lists).tolist() for rank, lists in places.items()}, active,
        )
        starts = [0, *ends.tolist()]
        return [[s for s in walked[a:b] if s >= 0] for a, b in zip(starts, starts[1:])]

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.pairs.find(mixed(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)))

    def _walk(self, symbols: list[int], following: list[int], before: list[int], places: dict[int, list[int]], active: list[int]) -> list[int]:
        merges = self.merges
        while active:
            rank = heapq.heappop(active)
            first, second, merged = self.result[rank]
            found = places.pop(rank)
            if first == second:
                found.sort()  # "aaa" merges its first two
            for at in found:
                after = following[at]
                if symbols[at] != first or after < 0 or symbols[after] != second:
                    continue  # another merge took one of the two
                symbols[at], symbols[after] = merged, -1
                beyond = following[at] = following[after]
                if beyond >= 0:
                    before[beyond] = at
                    new = merges.get(merged << 32 | symbols[beyond])
                    if new is not None:
                        if new in places:
                            places[new].append(at)
                        else:
                            places[new] = [at]
                            heapq.heappush(active, new)
                back = before[at]
                if back >= 0:
                    new = merges.get(symbols[back] << 32 | merged)
                    if new is not None:
                        if new in places:
                            places[new].append(back)
                        else:
                            places[new] = [back]
                            heapq.heappush(active, new)
        return symbols

    def words(self, chunk: bytes) -> list[bytes]:
        """What stands between ASCII white space; special tokens stand alone."""
        text = chunk.decode()
        if not any(s in text for s in self.special):
            return chunk.split()
        out: list[bytes] = []
        for piece in self.special_split.split(text):
            out += [piece.encode()] if piece in self.special else piece.encode().split()
        return out

    def encode_new(self, chunks: list[bytes], among: np.ndarray) -> list[np.ndarray]:
        """Ids of each chunk; their words, few of them more than one to a chunk, are merged together."""
        split = [c.split() if m else self.words(c) for c, m in zip(chunks, among.tolist(), strict=True)]
        own = list({w for words in split for w in words})
        by_word = [[w.decode()] if w.decode() in self.special else self._parts(w) for w in own]
        parts = list({p for each in by_word for p in each if p not in self.special})
        ids = dict(zip(parts, self.merge(parts), strict=True)) | {s: [i] for s, i in self.special.items()}
        of_word = {w: [i for p in each for i in ids[p]] for w, each in zip(own, by_word, strict=True)}
        return [np.array([i for w in words for i in of_word[w]], np.uint32) for words in split]


def encode(docs: DataFrame, vocabulary: Vocabulary, kept: int = KEPT_WORDS) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int): every whole text's tokens.

    One row per row of ``docs``, whatever its id; a null or empty text has no ids. A worker
    encodes a word once, until it has met very many. No shuffle; other columns are ignored.
    """
    # A Python worker keeps its broadcast values, and with them the ids it knows, over many tasks.
    shared = docs.sparkSession.sparkContext.broadcast({"source": vocabulary.source})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "ids" not in held:
            encoder = Encoder(Vocabulary(held["source"]))
            held["ids"] = ChunkIds(list(encoder.special), encoder.encode_new, UNIT_BYTES, kept)
        for batch in batches:
            for low, ids, bounds in held["ids"].encode(batch.column("text")):
                lists = list_array(ids.astype(np.int32), bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low : low + len(lists)], lists], ["doc_id", "ids"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return texts(docs, "doc_id").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``decoded``: the ids' tokens joined by one space.

    That is what a file without a decoder asks for. Null or no ids give an empty text; an id
    outside the vocabulary is left out.
    """
    spec = json.loads(vocabulary.source)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    shared = encoded.sparkSession.sparkContext.broadcast([names.get(i) for i in range(max(names) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(shared.value, object)
        for batch in batches:
            column = batch.column("ids")
            ends = np.cumsum([0, *[x or 0 for x in column.value_lengths().to_pylist()]])
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + DECODED_IDS, side="right")) - 1)
                part = column[low:high]
                flat = part.flatten().to_numpy(zero_copy_only=False)
                decoded = []
                for a, b in pairwise((ends[low : high + 1] - ends[low]).tolist()):
                    ids = flat[a:b]
                    if b > a and (ids.min() < 0 or ids.max() >= len(table)):
                        ids = ids[(ids >= 0) & (ids < len(table))]
                    decoded.append(" ".join(filter(None, table[ids].tolist())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], part, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                low = high

    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string"
    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, schema)

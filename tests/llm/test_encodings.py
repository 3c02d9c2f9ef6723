import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tablewright.llm.bpe import Encoder, Vocabulary, decode, encode
from tablewright.llm.chunks import ChunkIds
from tablewright.llm.packing import LibraryIds, configurations, pack, packed, plan

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "Hello  wörld's 12 <|endoftext|> É Σας İ \x1c  x y", "a <|startoftext|>b<|endoftext|>", "", "   ", " a  b  \x1c \x1d  c\n",
    "don't I'LL 1²½ ﬁ 日本語 😀👨‍👩‍👧 \t\t x  ", "a b  c 　 d\u0085", "aaaaaaaaa aaa 'sss''s", "é \x00 !!\x1f?", "x" * 5000,
]


@pytest.fixture(scope="module")
def samples(docs):
    return ODD + [r.text for r in docs.collect()] + ["", "tail <|endoftext|>"]


def make(kind):
    if kind == "word":
        encoder = Encoder(Vocabulary.from_file(WORD), common=300)
        return ChunkIds(list(encoder.special), encoder.encode_new, 1 << 18, 20_000), Tokenizer.from_file(WORD)
    library = LibraryIds(open(BYTE, encoding="utf-8").read())
    return ChunkIds(library.special, library.encode_new, 1 << 18, 20_000), Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_ids_are_the_librarys(kind, samples):
    ids, library = make(kind)
    want = [e.ids for e in library.encode_batch(samples, add_special_tokens=False)]
    for _ in range(2):  # the second time from kept chunks
        got = []
        for low, flat, bounds in ids.encode(pa.array(samples)):
            assert low == len(got)
            got += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == want


def test_random_strings():
    rng = random.Random(2)
    ids, library = make("word")
    texts = ["".join(rng.choice("aab'sé \n\x1c1!ſΣ́") for _ in range(rng.randrange(0, 25))) for _ in range(2000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [flat[a:b].tolist() for _, flat, bounds in ids.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == want


def test_query(spark, data, docs):
    library = Tokenizer.from_file(WORD)
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        whole = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in entry.queries()["op10_bpe"](spark, data).collect()} == want


def test_odd_rows(odd, clashing):
    vocabulary = Vocabulary.from_file(WORD)
    rows = decode(encode(odd, vocabulary), vocabulary).collect()
    assert len(rows) == 11 and encode(clashing, vocabulary).count() == 11
    assert all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (2, 3, 4))
    assert encode(odd.limit(0), vocabulary).count() == 0


def check(histogram, capacity, done):
    ranks, places = defaultdict(list), defaultdict(list)
    for length, rank, count, first, per, offset in done.runs:
        for j in range(count):
            ranks[length].append(rank + j)
            places[first + j // per].append((offset + j % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == done.sequences


def test_plans_place_every_piece_once():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 2, 7, 30, 100])
        histogram = {k: n for k in range(1, capacity + 1) if (n := rng.choice([0, 1, 3, 50]))}
        check(histogram, capacity, plan(histogram, capacity, rng.choice([1, 3, 8]), rng.choice([0.1, 0.2, 0.5])))
    check({}, 8, plan({}, 8))


def test_configurations_reach_the_optimum():
    # Three thirds, or a half and two quarters: the program's optimum is the volume.
    found = configurations([50, 25], [100, 200], 100)
    assert sum(n for _, n in found) == 100


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    histogram = {k: int(n) for k, n in zip(range(1, 201), rng.integers(5, 60, 200))}
    least = -(-sum(k * n for k, n in histogram.items()) // 200)
    assert min(plan(histogram, 200, 16, share).sequences for share in (0.2, 0.35, 0.5)) <= 1.03 * least


def test_pieces(spark, data, docs):
    library = Tokenizer.from_file(BYTE)
    rows = entry.queries()["op8_best_fit_packing"](spark, data).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        own = [pieces[r.doc_id][k] for k in range(len(pieces[r.doc_id]))]
        at = 0
        for k, piece in enumerate(own):
            assert piece.start == at and piece.length <= 2048 and (k == 0 or piece.length == 2048)
            assert zlib.crc32(np.array(ids[at : at + piece.length], "<u4").tobytes()) == piece.ids_crc32
            at += piece.length
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 2048)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_packing_odd_rows(odd, clashing, spark):
    source = open(BYTE, encoding="utf-8").read()
    rows = pack(clashing, source, with_ids=True).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and all(len(r.ids) == r.length for r in rows)
    assert {(r.doc_id, r.length) for r in rows if r.doc_id in (2, 3)} == {(2, 1), (3, 1)}
    assert pack(odd.limit(0), source).count() == 0
    same = spark.range(500).selectExpr("id", "CAST(7 AS BIGINT) AS length")  # one length holds all rows
    assert packed(same, 70).groupBy("sequence_id").count().where("count <> 10").count() == 0

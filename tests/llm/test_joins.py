import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewright.llm import ngram_join
from tablewright.llm.line_dedup import SegmentKeys, deduped, line_dedup, within
from tablewright.llm.links import components
from tablewright.llm.ngram_join import dealt, may_share, one_of_each, parities, similarity_classes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Classes:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def shingle_sets(rows):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def classes_by_hand(rows, percent=80):
    sets = shingle_sets(rows)
    own, under, both = Classes(), defaultdict(list), Counter()
    for i, found in sets.items():
        for shingle in found:
            under[shingle].append(i)
    for ids in under.values():
        both.update((a, b) for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            own.link(a, b)
    return {i: (len(s), own.find(i)) for i, s in sets.items()}


def got_classes(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(docs).collect()}


def test_components(spark):
    rng = random.Random(8)
    for n, m in ((40, 25), (200, 190), (60, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(300, 340)]
        own = Classes()
        for a, b in pairs:
            own.link(a, b)
        edges = spark.createDataFrame([*pairs, (None, 3), (5, 5)], "a long, b long")
        want = {x: own.find(x) for a, b in pairs if a != b for x in (a, b)}
        assert {r.node: r.root for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0


def test_classes_of_the_table(spark, data, docs):
    want = classes_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    rows = entry.queries()["op2_ngram_jaccard_join"](spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_classes_of_chains_hubs_and_copies(frame):
    """Copies, near copies of one text and of each other, chains, texts just under and over the limit."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] * 4 + [" ".join(edited(rng, base, k % 4)) for k in range(40)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[k * 7 : k * 7 + 90]) for k in range(14)]
    for k in range(60):
        own = [f"x{k}y{i}" for i in range(rng.randrange(1, 60))]
        texts += [" ".join(own), " ".join(edited(rng, own, rng.randrange(0, 3))), " ".join(own + [f"z{j}" for j in range(rng.randrange(0, 12))])]
    texts += ["a b", "A  B", "b a", "a b c d e", "a b c d e f", "", None, " "]
    passage = " ".join(f"p{i}" for i in range(70))  # shared by many, most of none
    texts += [passage + " " + " ".join(f"q{k}r{i}" for i in range(k)) for k in range(0, 60, 3)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got_classes(frame(rows)) == classes_by_hand(rows)


def test_sketches_tell_long_sets_apart(spark):
    """Of the longest sets too, those far below the limit are left out before texts are sent; no similar pair is."""
    rng, rows = np.random.default_rng(4), []
    for n in (1, 40, 700, 5000, 9000):
        own = rng.integers(0, 1 << 63, n, np.uint64)
        for share in (0.5, 0.95):
            for size in (n, n - n // 20):  # of one length of sketch, and of two
                other = np.concatenate([own[: int(size * share)], rng.integers(0, 1 << 63, size - int(size * share), np.uint64)])
                both = len(set(own.tolist()) & set(other.tolist()))
                close = 100 * both >= 80 * (len(own) + len(other) - both)
                rows.append((n, close, len(own), len(other), parities(own).view(np.int64).tolist(), parities(other).view(np.int64).tolist()))
    table = spark.createDataFrame(rows, "n long, close boolean, n_a long, n_b long, sketch_a array<long>, sketch_b array<long>")
    for r in table.withColumn("may", may_share(80)).collect():
        assert r.may or not r.close
        assert r.n < 700 or r.may == r.close


def test_texts_are_sent_once_for_many_pairs(spark, monkeypatch):
    """A text that is compared with many is sent to each part of them, not to each pair."""
    monkeypatch.setattr(ngram_join, "HUB_ROWS", 64)
    key = lambda i: i.to_bytes(2, "big")
    pairs = [(key(500), key(i)) for i in range(400)] + [(key(7), key(8))]
    rows = dealt(spark.createDataFrame(pairs, "a binary, b binary")).collect()
    under = defaultdict(list)
    for r in rows:
        under[bytes(r.hub), r.part].append((r.lead, bytes(r.digest)))
    assert sorted(sorted((h, d)) for (h, _), found in under.items() for lead, d in found if not lead) == sorted(map(sorted, pairs))
    assert all([d for lead, d in found if lead] == [h] for (h, _), found in under.items())
    assert len(rows) <= len(pairs) + 7 + 1 and max(map(len, under.values())) < 120


@pytest.mark.parametrize("few", [0, 16])
def test_links_of_members_that_are_not_first(frame, monkeypatch, few):
    """Groups of equal prefix and size whose members are not similar, linked through other members than the first."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(17)
    passages = [["and", "so", "it", "goes", "on"] + [f"t{p}w{i}" for i in range(60)] for p in range(6)]
    texts = [" ".join(p) for p in passages for _ in range(6)]  # frequent, so last in the order
    for g in range(6):
        rare = [f"g{g}r{i}" for i in range(17)]
        texts += [" ".join(rare + p) for p in passages]  # one prefix, one size, other passages
        texts += [" ".join([f"x{g}"] + rare + p) for p in passages]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got_classes(frame(rows).coalesce(1)) == classes_by_hand(rows)


def test_texts_of_repeated_ids(frame):
    """A set's text is found if its id stands on rows of other sets, and on many rows."""
    rng = random.Random(23)
    base = [f"w{i}" for i in range(80)]
    near = [" ".join(edited(rng, base, 1)) for _ in range(6)]
    rows = [(5, t) for t in near for _ in range(4)] + [(5, " ".join(f"o{k}v{i}" for i in range(50))) for k in range(5)] + [(None, near[0]), (9, " ".join(base))]
    got = [(r.n_shingles, r.component_id) for r in similarity_classes(frame(rows)).collect()]
    assert Counter(got) == Counter([(76, 5)] * 26 + [(46, 5)] * 5)


def test_classes_of_odd_rows(odd, clashing, frame):
    rows = similarity_classes(clashing).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows if r.doc_id not in (5, 6)) == [
        (0, 0, 0), (0, 2, 0), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 1, 7), (8, 1, 8)
    ]
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert similarity_classes(odd.limit(0)).count() == 0
    kept = one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def changed(rng, text, n, letters="abc"):
    text = list(text)
    for _ in range(n):
        kind, at = rng.random(), rng.randrange(len(text) + 1)
        if kind < 0.34 or not text:
            text.insert(at, rng.choice(letters))
        elif kind < 0.67:
            text.pop(min(at, len(text) - 1))
        else:
            text[min(at, len(text) - 1)] = rng.choice(letters)
    return "".join(text)


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 14)))
        b = changed(rng, a, rng.randrange(0, 5))
        for edits in range(4):
            assert within(a, b, edits) == (distance(a, b) <= edits)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_segments_meet(edits):
    rng = random.Random(edits)
    keys = SegmentKeys(edits)
    for _ in range(600):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(edits + 3, 20)))
        a, b = sorted((a, changed(rng, a, rng.randrange(0, edits + 1))), key=len)
        if len(a) >= edits + 3 and distance(a, b) <= edits:
            (own, _), (others, asked) = keys.keys([a]), keys.keys([b])
            assert set(own[0].tolist()) & ({*others[0].tolist(), *asked[0].tolist()} - {0})


def deduped_by_hand(rows, edits=2, least=30):
    places = defaultdict(list)
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if len(line) >= least:
                places[line].append((i, k))
    own, lines = Classes(), list(places)
    for k, a in enumerate(lines):
        own.find(a)
        for b in lines[k + 1 :]:
            if abs(len(a) - len(b)) <= edits and within(a, b, edits):
                own.link(a, b)
    members = defaultdict(list)
    for line in lines:
        members[own.find(line)] += places[line]
    gone = {p for found in members.values() for p in sorted(found)[1:]}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines_by_hand(frame):
    rng = random.Random(12)
    bases = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(25, 60))) for _ in range(25)]
    hub = "the same long boilerplate line that stands everywhere in this corpus"
    chain = ["x" * 40 + "abcdefghijklmnop"[:k] + "y" * 10 for k in range(0, 16, 2)]
    texts = []
    for _ in range(150):
        lines = [changed(rng, rng.choice(bases), rng.randrange(0, 4)) for _ in range(rng.randrange(0, 5))]
        lines += [changed(rng, hub, rng.randrange(0, 4), "QRS")] * (rng.random() < 0.5) + [rng.choice(chain), "short", ""]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    got = line_dedup(frame(rows)).collect()
    assert {r.doc_id: r.text for r in got} == deduped_by_hand(rows)
    assert all(r.n_lines == texts[r.doc_id].count("\n") + 1 for r in got)


def short_deduped_by_hand(rows, least=30, short=12):
    places = defaultdict(list)
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                places[line].append((i, k))
    own, lines = Classes(), list(places)
    for k, a in enumerate(lines):
        own.find(a)
        for b in lines[k + 1 :]:
            n = min(len(a), len(b))
            if within(a, b, 2 if n >= least else 1 if n >= short else 0):
                own.link(a, b)
    members = defaultdict(list)
    for line in lines:
        members[own.find(line)] += places[line]
    gone = {p for found in members.values() for p in sorted(found)[1:]}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_short_lines_by_hand(frame):
    rng = random.Random(13)
    bases = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in range(1, 34) for _ in range(2)]
    texts = []
    for _ in range(120):
        lines = [changed(rng, rng.choice(bases), rng.randrange(0, 3)) for _ in range(rng.randrange(0, 5))]
        lines += ["All rights reserved."] * (rng.random() < 0.5) + ["", " \t"]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in line_dedup(frame(rows), short=12).collect()}
    assert got == short_deduped_by_hand(rows)
    assert sum("All rights reserved." in t for t in got.values()) == 1


def test_query_leaves_no_line_twice(spark, data):
    rows = entry.queries()["op7_line_dedup"](spark, data).collect()
    left = Counter(line for r in rows for line in (r.text or "").split("\n") if line.strip())
    assert max(left.values()) == 1


def test_lines_of_odd_rows(odd, clashing, frame):
    done = deduped(clashing)
    rows = done.collect()
    assert done.columns == clashing.columns and len(rows) == 11
    assert [r.text for r in rows if r.doc_id == 2] == [None] and [r.n_chars for r in rows if r.doc_id == 3] == [0]
    assert [r.text for r in rows if r.doc_id == 1] == ["one two three four five six seven"] * 2  # one document, twice
    assert {r.n_lines for r in line_dedup(odd).where("doc_id = 8").collect()} == {2}
    assert line_dedup(odd.limit(0)).count() == 0
    copies = line_dedup(frame(["a line that is repeated in many texts\nown " + str(k) for k in range(50)])).collect()
    assert sum(r.n_dropped for r in copies) == 49 and {r.doc_id for r in copies if not r.n_dropped} == {0}


def test_long_lines(frame):
    long_ = "".join(chr(97 + i * i % 23) for i in range(40000))
    rows = line_dedup(frame([long_, long_[:20000] + "!" + long_[20000:], long_[::-1]])).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {0: 0, 1: 1, 2: 0}


def test_sides_that_are_too_large_to_send(frame, monkeypatch):
    """Every join by shuffle gives what joins with small sides give."""
    from tablewright.llm import common, links

    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(links, "BROADCAST_ROWS", -1)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(" ".join(edited(rng, base, k % 5)) + "\n" + "a line of its own that many texts share" for k in range(12)))
    assert got_classes(frame(rows)) == classes_by_hand(rows)
    assert {r.doc_id: r.text for r in line_dedup(frame(rows)).collect()} == deduped_by_hand(rows)


def test_no_pairs_of_everything(spark, data, capsys):
    similarity_classes(spark.read.parquet(f"{data}/documents.parquet").where(F.col("doc_id") < 20)).explain()
    assert "CartesianProduct" not in capsys.readouterr().out

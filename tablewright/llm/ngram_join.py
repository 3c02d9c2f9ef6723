"""N-gram Jaccard join by groups of equal prefixes.

A document is the set of its word shingles. All sets are ordered alike, shingles that many
documents share last, and two sets can only be similar enough if their prefixes meet. Documents
with the same prefix and size form one group; groups, not documents, are entered under their
prefix shingles. Group pairs pass a size and a position filter, are expanded to their members,
and every pair of members that is not yet known to belong together is verified on whole texts.

Under a shingle with few groups all of them meet at once. Where it has many, all are first paired
with a few of them, a number of pairs that grows with the groups. Only groups that are then still in
different classes are paired with each other, so that a large group of near copies costs links in
proportion to its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import HashIndex, WordHasher, hashed_words, heaviest, list_array, mixed, release, staged, texts
from tablewright.llm.links import components, leaders, matched, possible, shuffled, unordered, untried

WIDTH = 5
PERCENT = 80
# Shingles that stand last in the order, being frequent: a bound on what is sent to the tasks.
# It changes the order, and with it the work, not the links.
FREQUENT = 1 << 16
# Bits of a set's sketch, which tells most sets apart before their texts are sent: as many as the set
# has shingles, rounded up to a power of two, within these bounds.
SKETCH_BITS = (64, 1 << 17)
# Groups under a shingle up to which each meets each other.
FEW = 16
# Sets that are compared with one text of another set before that text is sent again.
HUB_ROWS = 64
# Bytes of text that one step inside a task works on; a worker holds some hundred times that.
STEP_BYTES = 1 << 18


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the distinct hashes of its runs of ``width`` words, or of all its words if fewer."""
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(hashes)
    sums = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        sums += hashes[k : k + len(sums)] * factors[k]
    sums = mixed(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(sums[a : b - width + 1]))
        elif b > a:
            whole = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which a similar set has at least one in its own prefix."""
    return n - -(-percent * n // 100) + 1


def parities(own: np.ndarray) -> np.ndarray:
    """Which of as many kinds of shingles as the sketch has bits a set holds an odd number of, in words of 64 bits."""
    least, most = SKETCH_BITS
    bits = min(max(1 << (len(own) - 1).bit_length() if len(own) else 0, least), most)
    kind = (own >> np.uint64(40)).astype(np.int64) & (bits - 1)
    odd = (np.bincount(kind, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def frequent_shingles(docs: DataFrame, width: int, most: int, least: int = 4) -> np.ndarray:
    """The shingles most documents share, rarest first.

    Each batch of documents passes on what at least ``least`` of its documents hold, so little
    is shuffled; the counts only order the shingles.
    """
    hasher = WordHasher(block=STEP_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s for _, _, h, b in hashed_words(batch.column(0), hasher, STEP_BYTES) for s in shingles(h, b, width)]
            found, n = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64))], ["token", "n"]
            )

    seen = texts(docs).mapInArrow(run, "token long, n long")
    counts = staged(seen.groupBy("token").agg(F.sum("n").alias("n")))
    tokens, n = heaviest(counts, "token", "n", most)
    return tokens[np.lexsort((tokens, n))].view(np.uint64)


def signatures(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, digest and sketch of the set, gid of the group, tokens of its prefix).

    A batch gives the prefix of a group once; its other members have an empty one.
    """
    hasher = WordHasher(block=STEP_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(shared.value)
        for batch in batches:
            given: set[int] = set()
            for low, high, hashes, bounds in hashed_words(batch.column("text"), hasher, STEP_BYTES):
                sizes, digests, gids, prefixes, sketches = [], [], [], [], []
                for own in shingles(hashes, bounds, width):
                    at = index.find(own)
                    rare, common = own[at < 0], own[at >= 0][np.argsort(at[at >= 0])]
                    prefix = np.concatenate([rare, common])[: prefix_size(len(own), percent)] if len(own) else own
                    gid = hashlib.blake2b(prefix.tobytes() + len(own).to_bytes(8, "little"), digest_size=8).digest()
                    gid = int.from_bytes(gid, "little", signed=True)
                    sizes.append(len(own))
                    sketches.append(parities(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    gids.append(gid)
                    prefixes.append(prefix[:0] if gid in given else prefix)
                    given.add(gid)
                ends = np.cumsum([0, *map(len, prefixes)])
                flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[low:high], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                        pa.array(gids, pa.int64()), list_array(flat, ends, pa.int64()),
                        list_array(np.concatenate(sketches).view(np.int64), np.cumsum([0, *map(len, sketches)]), pa.int64()),
                    ],
                    ["doc_id", "n", "digest", "gid", "tokens", "sketch"],
                )
            release()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, digest binary, gid long, tokens array<long>, sketch array<long>"
    return texts(docs, "doc_id").mapInArrow(run, schema)


def may_be_similar(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether sizes, and what can follow the positions where two sets meet first, allow a link."""
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    rest = (100 + percent) * F.least(n_a - pos_a, n_b - pos_b) >= percent * (n_a + n_b)
    return sizes & rest


def posted(sigs: DataFrame) -> DataFrame:
    """(token, gid, n, pos): each group under the shingles of its prefix."""
    return sigs.where("n > 0").select("gid", "n", F.posexplode("tokens").alias("pos", "token"))


def meetings(rows: DataFrame) -> DataFrame:
    """(token, few, met): the groups under each token that two or more share, each once, staged.

    Under a token of at most ``FEW`` rows they are one list; others have a list for each group,
    so a token with very many groups is never brought together. Only the smallest and largest
    group and the number of rows of each token are gathered before, folded before the shuffle.
    """
    shared = rows.groupBy("token").agg(F.min("gid").alias("_low"), F.max("gid").alias("_high"), F.count("*").alias("_rows"))
    keys = staged(shared.where("_low != _high").select("token", (F.col("_rows") <= FEW).alias("few")))
    found = shuffled(possible(rows, keys, "token"), keys, "token")
    apart = F.when(~F.col("few"), F.col("gid")).alias("_apart")
    lists = found.groupBy("token", "few", apart).agg(F.collect_set(F.struct("gid", "n", "pos")).alias("met"))
    return staged(lists.select("token", "few", "met"))


def met_in_lists(lists: DataFrame, percent: int) -> DataFrame:
    """(gid, other): the pairs of groups of one list that may be similar."""
    x, y = F.col("x"), F.col("y")
    pairs = lists.select("met", F.explode("met").alias("x"))
    pairs = pairs.select("x", F.explode(F.filter("met", lambda other: other["gid"] > F.col("x.gid"))).alias("y"))
    pairs = pairs.where(may_be_similar(x["n"], x["pos"], y["n"], y["pos"], percent))
    return pairs.select(x["gid"].alias("gid"), y["gid"].alias("other"))


def may_share(percent: int) -> Column:
    """Whether two sketches allow the similarity: each bit they differ in is a shingle of one set only,
    and of those similar sets have at most a share of their sizes' sum.

    Of two lengths the longer one, twice as long, is folded; sketches of other lengths tell nothing.
    """

    def halved(side: str) -> Column:
        half = F.size(side) / 2
        return F.zip_with(F.slice(side, F.lit(1), half.cast("int")), F.slice(side, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))

    n_a, n_b = F.size("sketch_a"), F.size("sketch_b")
    one = F.when(n_a == 2 * n_b, halved("sketch_a")).otherwise(F.col("sketch_a"))
    other = F.when(n_b == 2 * n_a, halved("sketch_b")).otherwise(F.col("sketch_b"))
    total = F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    comparable = (n_a == n_b) | (n_a == 2 * n_b) | (n_b == 2 * n_a)
    return ~comparable | ((100 + percent) * total <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def packed(text: pa.Scalar, codec: pa.Codec) -> bytes:
    """A text's bytes, compressed, behind their number."""
    raw = text.as_buffer()
    return raw.size.to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def unpacked(column: pa.Array, codec: pa.Codec, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes, each with the number of its first row."""
    low, size, found = 0, 0, []
    for k, value in enumerate(column):
        data = value.as_buffer()
        length = int.from_bytes(data[:8].to_pybytes(), "little")
        if found and size + length > most:
            yield low, pa.array(found, pa.large_binary())
            low, size, found = k, 0, []
        found.append(codec.decompress(data[8:], length, asbytes=True) if length else b"")
        size += length
    if found:
        yield low, pa.array(found, pa.large_binary())


def dealt(pairs: DataFrame) -> DataFrame:
    """(hub, part, digest, lead): each pair as a row of the set that is in fewer pairs, under the other, its
    hub; and a row of the hub itself, the lead, for each of its parts, which have some ``HUB_ROWS`` rows.
    """
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest")))
    times = staged(ends.groupBy("digest").agg(F.count("*").alias("times")))
    for side in ("a", "b"):
        pairs = shuffled(pairs, times.select(F.col("digest").alias(side), F.col("times").alias(f"times_{side}")), side)
    first = (F.col("times_a") > F.col("times_b")) | ((F.col("times_a") == F.col("times_b")) & (F.col("a") < F.col("b")))
    pairs = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("digest"),
        F.ceil(F.greatest("times_a", "times_b") / HUB_ROWS).alias("parts"),
    )
    rows = staged(pairs.select("hub", F.pmod(F.xxhash64("digest"), "parts").alias("part"), "digest"))
    leads = rows.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("digest"), F.lit(True).alias("lead"))
    return rows.withColumn("lead", F.lit(False)).unionByName(leads)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set digests whose sets are similar, from the whole texts; ``pairs`` should be staged.

    Sketches leave most others out. A set's text is that of one document; it is brought to its digest,
    and from there under each hub that it is compared with, where a task holds the hub's set alone.
    """
    kept = pairs
    for side in ("a", "b"):
        own = nodes.select(F.col("digest").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        kept = shuffled(kept, possible(own, pairs, side), side)
    rows = staged(dealt(staged(kept.where(may_share(percent)).select("a", "b"))))
    wanted = staged(rows.select("digest").distinct())
    reps = staged(shuffled(possible(nodes.select("digest", "rep"), wanted, "digest"), wanted, "digest", "left_semi").select(F.col("rep").alias("doc_id")))
    hasher = WordHasher(block=STEP_BYTES)

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            found = [
                hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                for _, _, h, b in hashed_words(batch.column(0), hasher, STEP_BYTES) for s in shingles(h, b, width)
            ]
            content = [packed(t, codec) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(content, pa.binary())], ["digest", "content"])
            release()

    # What the maps let pass besides the rows asked for, their digests leave out. An id may stand on
    # several rows, of one set or of others: a text for each set that is asked for.
    content = possible(texts(docs, "doc_id"), reps, "doc_id").select("text").mapInArrow(with_digest, "digest binary, content binary")
    content = possible(content, wanted, "digest").groupBy("digest").agg(F.min("content").alias("content"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, leads = batch.column("hub").to_pylist(), batch.column("lead").to_pylist()
            good = [False] * len(batch)
            for low, column in unpacked(batch.column("content"), codec, STEP_BYTES):
                for at, _, h, b in hashed_words(column, hasher, STEP_BYTES):
                    for k, other in enumerate(shingles(h, b, width), low + at):
                        if leads[k]:
                            hub, own = hubs[k], other
                            continue
                        if hubs[k] != hub:
                            raise ValueError("a set's text is gone: the documents have changed meanwhile")
                        small, large = (own, other) if len(own) < len(other) else (other, own)
                        at_ = np.searchsorted(large, small)
                        both = int((large[np.minimum(at_, len(large) - 1)] == small).sum()) if len(large) else 0
                        good[k] = 100 * both >= percent * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("digest")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
            release()

    full = shuffled(rows, content, "digest").repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("lead"))
    return full.select("hub", "digest", "lead", "content").mapInArrow(similar, "a binary, b binary")


def similarity_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``same_set``.

    Words stand between blanks and tab to carriage return, A-Z taken as a-z. Two documents are
    linked when 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    shingles; ``component_id`` is the smallest id reachable by links, itself included, and
    ``same_set`` the number of documents with the same set.

    Rows without words are linked with nothing. Null ids take part and have their class's
    smallest id, null if it has none; repeated ids keep their rows. Shingles are compared by
    64-bit hashes. Other columns are ignored; no documents, no rows.
    """
    sigs = staged(signatures(docs, width, percent, frequent_shingles(docs, width, frequent)))
    full = sigs.where("n > 0")
    nodes = staged(full.groupBy("gid", "digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("same_set"), F.first("sketch").alias("sketch")))
    centers = staged(nodes.groupBy("gid").agg(F.min("digest").alias("center"), F.count("*").alias("sets")))
    lists = meetings(posted(sigs))
    runs = lists.where("NOT few").select("token", F.explode("met").alias("m")).select("token", "m.*")

    # Each group with all or a few under each of its shingles, each member with the group's first.
    leads = leaders(runs, "token", "gid", "n", "pos")
    ahead = shuffled(runs, leads, "token").where(F.col("gid") != F.col("lead.gid"))
    ahead = ahead.where(may_be_similar(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), percent))
    ahead = ahead.select("gid", F.col("lead.gid").alias("other"))
    ahead = staged(ahead.union(met_in_lists(lists.where("few"), percent)).distinct())
    members = nodes.select("gid", "digest")
    first = centers.select(F.col("gid").alias("other"), "center")
    star = shuffled(shuffled(members, ahead, "gid"), first, "other").select(*unordered("digest", "center"))
    inside = shuffled(members, centers.where("sets > 1"), "gid").where("digest != center").select(*unordered("digest", "center"))
    tried = staged(star.union(inside).distinct())
    edges = staged(verified(tried, nodes, docs, width, percent))
    roots = staged(components(edges))

    # What is left: groups that meet and have members in different classes, also if one was met as its first member alone.
    labelled = staged(
        shuffled(members, roots.withColumnRenamed("node", "digest"), "digest", "left").select("gid", "digest", F.coalesce("root", "digest").alias("root"))
    )
    spans = staged(labelled.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")))
    open_runs = shuffled(untried(runs, leads, "token"), spans, "gid")
    mixed_tokens = open_runs.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l != h").select("token")
    open_runs = staged(shuffled(open_runs, staged(mixed_tokens), "token", "left_semi"))
    if open_runs.limit(1).count():
        x, y = open_runs.alias("x"), open_runs.alias("y")
        apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high"))
        close = may_be_similar(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
        met = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & apart & close)
        met = met.select(F.col("x.gid").alias("gid"), F.col("y.gid").alias("other"))
    else:
        met = None
    more_than_first = staged(centers.where("sets > 1").select(F.col("gid").alias("other")))
    halves = staged(shuffled(possible(ahead, more_than_first, "other"), more_than_first, "other", "left_semi"))
    of_other = spans.select(F.col("gid").alias("other"), F.col("low").alias("low_o"), F.col("high").alias("high_o"))
    halves = shuffled(shuffled(halves, spans, "gid"), of_other, "other").where("low != high OR low_o != high_o OR low != low_o")
    within = spans.where("low != high").select("gid", F.col("gid").alias("other")).union(halves.select("gid", "other"))
    met = staged((within if met is None else met.union(within)).distinct())
    if met.limit(1).count():
        others = labelled.select(F.col("gid").alias("other"), F.col("digest").alias("b"), F.col("root").alias("root_b"))
        rest = shuffled(shuffled(labelled.withColumnRenamed("digest", "a"), met, "gid"), others, "other").where("root != root_b")
        rest = rest.select(*unordered("a", "b")).distinct().join(tried, ["a", "b"], "left_anti")
        more = staged(verified(staged(rest), nodes, docs, width, percent))
        if more.limit(1).count():
            roots = staged(components(edges.union(more)))

    # A class has its smallest id; a set without links is a class of its own.
    known = shuffled(
        nodes.select("digest", "rep", "same_set"), roots.withColumnRenamed("node", "digest"), "digest", "left"
    ).withColumn("root", F.coalesce("root", "digest"))
    known = staged(known)
    lowest = staged(known.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = staged(shuffled(known, lowest, "root").select("digest", "component_id", "same_set"))
    ids = sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = shuffled(ids, named, "digest", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("same_set", F.lit(1)).cast("long").alias("same_set"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, columns unchanged, with one of each class: that with the smallest id.

    Rows that share an id are one document, of which one row stays, the same on every run; rows
    without an id are kept.
    """
    classes = staged(similarity_classes(docs, width, percent))
    gone = classes.where("doc_id != component_id").select("doc_id")
    kept = matched(docs, staged(gone), "doc_id", "left_anti")
    repeated = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = staged(repeated)
    if not repeated.limit(1).count():
        return kept
    twice = matched(kept, repeated, "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Of an id's rows that with the smallest digest of its text, then of its source, stays: the same on every run.
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("text", "doc_id")])
    twice = twice.groupBy("doc_id").agg(F.min_by(row, order).alias("_row")).select("_row.*")
    return matched(kept, repeated, "doc_id", "left_anti").unionByName(twice)

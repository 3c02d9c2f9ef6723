from datetime import datetime

import pytest

from tablewright.operators import index as ix
import tablewright.sources.store as store
from tablewright.session import SharedFolder
from tablewright.sources.store import (
    LostRace, change_index, compact_index, delete_from_index, edit_index, import_vectors, index_version, loaded_batch,
    read_index, read_table, search_index, upsert_index, vacuum, write_index, write_search_tables, write_table,
)

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)


@pytest.fixture
def index(spark):
    empty = spark.createDataFrame([], ix.INDEX_SCHEMA)
    rows = spark.createDataFrame(
        [("a", "qa", "looker", [1.0, 0.0]), ("b", "qb", "manual", [0.0, 1.0])],
        "id string, question string, source string, embedding array<double>",
    )
    return ix.upsert(empty, rows, T1)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_insert_defaults(spark, index):
    more = spark.createDataFrame([("c", "qc")], "id string, question string")
    got = by_id(ix.upsert(index, more, T2))
    assert set(got) == {"a", "b", "c"}
    c = got["c"]
    assert (c["sql"], c["source"], c["dashboard"], c["embedding"], c["created_at"]) == ("", "manual", "", [], T2)


def test_replace_keeps_created(spark, index):
    rows = spark.createDataFrame(
        [("a", "first", 1), ("a", "second", 2), ("a", "earlier", 0)], "id string, question string, seq int"
    )
    got = by_id(ix.upsert(index, rows, T2, "seq"))
    a = got["a"]
    assert (a["question"], a["source"], a["embedding"], a["created_at"], a["updated_at"]) == ("second", "manual", [], T1, T2)
    assert (got["b"]["updated_at"], len(got)) == (T1, 2)


def test_changes_are_what_upsert_writes(spark, index):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("n", "z", 1)], "id string, question string, seq int")
    changed, whole = by_id(ix.changes(index, rows, T2, "seq")), by_id(ix.upsert(index, rows, T2, "seq"))
    assert set(changed) == {"a", "n"}
    assert all(whole[i] == row for i, row in changed.items())


def test_edit_keeps_vector(spark, index):
    rows = spark.createDataFrame([("a", "new"), ("z", "unknown")], "id string, question string")
    got = by_id(ix.edit(index, rows, T2))
    assert (got["a"]["question"], got["a"]["embedding"], got["a"]["created_at"]) == ("new", [1.0, 0.0], T1)
    assert (got["z"]["embedding"], got["z"]["created_at"]) == ([], T2)


def test_delete_get_list_stats(spark, index):
    ids = spark.createDataFrame([("a",), ("none",)], "id string")
    assert [r["id"] for r in ix.delete(index, ids).collect()] == ["b"]
    assert [r["id"] for r in ix.existing(index, ids).collect()] == ["a"]
    assert ix.get(index, "a").columns == [c for c in index.columns if c != "embedding"]
    assert ix.get(index, "none").count() == 0
    newer = ix.upsert(index, spark.createDataFrame([("b", "x")], "id string, question string"), T3)
    assert [r["id"] for r in ix.list_all(newer).collect()] == ["b", "a"]
    stats = {r["source"]: r for r in ix.index_stats(newer).collect()}
    assert (stats["looker"]["vectors"], stats["manual"]["vectors"], stats[None]["vectors"]) == (1, 1, 2)
    assert stats[None]["is_total"] and stats[None]["last_updated"] == T3
    assert ix.index_stats(index.limit(0)).count() <= 1


def test_dictionary(spark):
    base = spark.createDataFrame([("mrr", "m"), ("arr", "a")], "keyword string, content string")
    rows = spark.createDataFrame([("arr", "b", 1), ("arr", "c", 2), ("cac", "d", 1)], "keyword string, content string, n int")
    put = ix.put(base, rows, "n")
    assert [tuple(r) for r in ix.listed(put).collect()] == [("arr", "c"), ("cac", "d"), ("mrr", "m")]
    gone = spark.createDataFrame([("mrr",), ("nope",)], "keyword string")
    assert [r["keyword"] for r in ix.listed(ix.remove(put, gone)).collect()] == ["arr", "cac"]


def test_versions(spark, index, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        read_table(spark, root)
    assert read_table(spark, root, ix.INDEX_SCHEMA).count() == 0
    assert write_table(index, root) == 1
    ids = spark.createDataFrame([("a",)], "id string")
    assert write_table(ix.delete(read_table(spark, root), ids), root) == 2
    assert [r["id"] for r in read_table(spark, root).collect()] == ["b"]


def test_stored_index(spark, index, tmp_path):
    root = str(tmp_path / "index")
    schema = "id string, question string, embedding array<double>"
    assert read_index(spark, root).columns == index.columns and read_index(spark, root).count() == 0
    many = spark.createDataFrame([(f"r{n}", f"q{n}", [float(n)]) for n in range(300)], schema)
    assert write_index(ix.upsert(index, many, T1), root, parts=8) == 1
    assert read_index(spark, root).count() == 302
    before = index_version(spark, root)
    assert [(p.depth, p.prefix) for p in before.parts] == [(3, n) for n in range(8)] and not before.log

    rows = spark.createDataFrame([("r7", "changed", [9.0]), ("r7", "last", [8.0])], schema).selectExpr(
        "*", "IF(question = 'last', 2, 1) AS n")
    assert upsert_index(rows, root, T2, "n") == 2
    after = index_version(spark, root)
    assert after.parts == before.parts and len(after.log) == 1
    assert spark.read.parquet(f"{root}/{after.log[0].folder}").count() == 1
    got = by_id(read_index(spark, root))
    assert len(got) == 302
    assert (got["r7"]["question"], got["r7"]["embedding"], got["r7"]["created_at"], got["r7"]["updated_at"]) == ("last", [8.0], T1, T2)
    assert got["r8"]["updated_at"] == T1

    edit_index(spark.createDataFrame([("r7", "edited")], "id string, question string"), root, T3)
    got = by_id(read_index(spark, root))
    assert (got["r7"]["question"], got["r7"]["embedding"], got["r7"]["updated_at"]) == ("edited", [8.0], T3)

    delete_from_index(spark.createDataFrame([("r1",), ("none",), ("a",)], "id string"), root)
    assert set(by_id(read_index(spark, root))) == set(got) - {"r1", "a"}
    delete_from_index(read_index(spark, root).select("id"), root)
    assert read_index(spark, root).count() == 0
    upsert_index(many, root, T2)
    assert read_index(spark, root).count() == 300
    write_index(index, root)
    assert set(by_id(read_index(spark, root))) == {"a", "b"}


def some(spark, ids, text="q", start=0.0):
    rows = [(f"r{n}", f"{text}{n}", [start + n, 1.0]) for n in ids]
    return spark.createDataFrame(rows, "id string, question string, embedding array<double>")


def test_log_is_folded_and_parts_are_split(spark, tmp_path, monkeypatch):
    """The same rows whatever is folded when, against a dictionary of rows."""
    root, want = str(tmp_path / "index"), {}
    monkeypatch.setattr(store, "MOST_BATCHES", 3)
    write_index(ix.upsert(spark.createDataFrame([], ix.INDEX_SCHEMA), some(spark, range(50)), T1), root, parts=4)
    want = {f"r{n}": f"q{n}" for n in range(50)}
    logged = []
    for step in range(5):
        ids = range(step * 7, step * 7 + 20)
        if step % 2:
            delete_from_index(some(spark, ids), root, T2)
            want = {i: t for i, t in want.items() if i not in {f"r{n}" for n in ids}}
        else:
            upsert_index(some(spark, ids, f"step {step} "), root, T2)
            want |= {f"r{n}": f"step {step} {n}" for n in ids}
        logged.append(len(index_version(spark, root).log))
        assert {i: r["question"] for i, r in by_id(read_index(spark, root)).items()} == want
    assert logged == [1, 2, 0, 1, 2]
    before = index_version(spark, root)
    compact_index(spark, root, part_bytes=500)
    after = index_version(spark, root)
    assert not after.log and max(p.depth for p in after.parts) > 2
    assert sum(2.0 ** -p.depth for p in after.parts) == 1.0
    assert {i: r["question"] for i, r in by_id(read_index(spark, root)).items()} == want
    edit_index(some(spark, [3], "edited ").drop("embedding"), root, T3)
    assert by_id(read_index(spark, root))["r3"]["question"] == "edited 3"
    assert len(before.parts) == 4


def test_only_touched_parts_are_folded(spark, tmp_path):
    root = str(tmp_path / "index")
    write_index(ix.upsert(spark.createDataFrame([], ix.INDEX_SCHEMA), some(spark, range(200)), T1), root, parts=16)
    before = {p.name: p.folder for p in index_version(spark, root).parts}
    upsert_index(some(spark, [5], "new "), root, T2)
    compact_index(spark, root)
    after = {p.name: p.folder for p in index_version(spark, root).parts}
    assert sum(before[n] != after[n] for n in before) == 1
    assert by_id(read_index(spark, root))["r5"]["question"] == "new 5" and read_index(spark, root).count() == 200


def test_a_lost_writer_stops_nobody_for_long(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    upsert_index(some(spark, [1]), root, T1)

    def dies(held):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        change_index(spark, root, some(spark, [2]), dies)
    upsert_index(some(spark, [2]), root, T1)
    # Lost after it claimed the next number: others wait for its lease, then pass it over.
    SharedFolder(spark, root).create("claims/00000003")
    with pytest.raises(LostRace):
        upsert_index(some(spark, [3]), root, T1)
    monkeypatch.setattr(store, "LEASE", -1)
    assert upsert_index(some(spark, [3]), root, T1) == 4
    assert set(by_id(read_index(spark, root))) == {"r1", "r2", "r3"}
    # Should it come back, its version is not the latest any more.
    with pytest.raises(LostRace):
        store._publish(SharedFolder(spark, root), 3, store.Version(version=3).row(T1), store.INDEX_VERSION_SCHEMA)
    assert set(by_id(read_index(spark, root))) == {"r1", "r2", "r3"}


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    root = str(tmp_path / "index")
    for n in range(4):
        upsert_index(some(spark, [n]), root, T1)
    compact_index(spark, root)
    orphan = f"{root}/log-lost"
    some(spark, [9]).write.parquet(orphan)
    folder = SharedFolder(spark, root)
    assert vacuum(spark, root, keep=1) == []
    assert len([n for n in folder.names() if n.startswith("log-")]) == 5
    gone = vacuum(spark, root, keep=1, grace=-1.0)
    assert "log-lost" in gone and sum(n.startswith("log-") for n in gone) == 5
    assert set(by_id(read_index(spark, root))) == {f"r{n}" for n in range(4)}
    upsert_index(some(spark, [7]), root, T1)
    assert read_index(spark, root).count() == 5
    table = str(tmp_path / "table")
    for n in range(3):
        write_table(spark.range(n + 1), table)
    assert sum(n.startswith("table-") for n in vacuum(spark, table, keep=1, grace=-1.0)) == 2
    assert read_table(spark, table).count() == 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    first = upsert_index(some(spark, [1]), root, T1, batch=("charts", 0))
    second = upsert_index(some(spark, [1], "again "), root, T2, batch=("charts", 1))
    for _ in range(2):
        assert upsert_index(some(spark, [1]), root, T3, batch=("charts", 0)) == second > first
    assert upsert_index(some(spark, [2]), root, T3, batch=("other", 0)) == second + 1
    row = by_id(read_index(spark, root))["r1"]
    assert (row["question"], row["updated_at"]) == ("again 1", T2)
    compact_index(spark, root)
    version = index_version(spark, root)
    assert (loaded_batch(version, "charts"), loaded_batch(version, "other"), loaded_batch(version, "none")) == (1, 0, -1)


def test_search_tables_know_later_changes(spark, tmp_path):
    root = str(tmp_path / "index")
    base = ix.upsert(spark.createDataFrame([], ix.INDEX_SCHEMA), some(spark, range(300), start=-150.0), T1)
    write_index(base, root, parts=4)
    asked = spark.createDataFrame([(1, [1.0, 0.01]), (2, [-1.0, 0.02]), (3, [0.0, 1.0])], "query_id int, embedding array<double>")

    def both():
        found = [sorted(map(tuple, search_index(asked, root, 6, 0.2, exact=e).collect())) for e in (False, True)]
        assert found[0] == found[1]

    both()
    plan = write_search_tables(spark, root, bucket_rows=20, k=6, threshold=0.2, aim=1.0)
    assert plan.bits == 4 and plan.recall == 1.0 and index_version(spark, root).search is not None
    both()
    delete_from_index(some(spark, [160, 299]), root)
    upsert_index(some(spark, [155, 400], start=0.0), root, T2)
    both()
    assert index_version(spark, root).search is not None
    compact_index(spark, root)
    assert index_version(spark, root).search is None
    both()


def test_import_vectors(spark):
    rows = spark.createDataFrame(
        [("a", "[0.5, 1]", "2024-01-01T00:00:00+00:00"), ("b", "[]", "2024-01-01T00:00:00+00:00"),
         ("c", "broken", "2024-01-01T00:00:00+00:00")],
        "id string, embedding string, created_at string",
    ).selectExpr("*", "created_at AS updated_at")
    got = by_id(import_vectors(rows))
    assert (got["a"]["embedding"], got["b"]["embedding"], got["c"]["embedding"]) == ([0.5, 1.0], [], [])
    assert got["a"]["created_at"] == T1

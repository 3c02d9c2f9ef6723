"""One place for interactive use: a session, a shared folder, and what is kept in it.

Every method is a few calls of the operators, which take whole tables; use those directly for bulk
work. Tables are versioned, so what was read stays readable while a change is written.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.ingest.load import Load, chart_rows, load, rebuild, schema_rows, select_sources
from tablewright.operators import catalog, snapshots
from tablewright.operators import index as ix
from tablewright.operators.catalog import table_docs, union_all
from tablewright.operators.embed import Embedder, Rewriter, embed
from tablewright.operators.guard import DEFAULT_LIMIT, QueryRun, run_sql
from tablewright.operators.search import SEARCH_K, search
from tablewright.operators.slots import evaluate_slots
from tablewright.operators.substring import glossary_hits
from tablewright.operators.topk import DEFAULT_THRESHOLD
from tablewright.sources.patterns import PATTERN_SCHEMA, delete_patterns, find_pattern, write_patterns
from tablewright.sources.query_log import read_query_log
from tablewright.sources.store import (
    delete_from_index,
    edit_index,
    read_index,
    read_table,
    upsert_index,
    write_table,
)

KEYWORD_SCHEMA = "keyword string, content string"
TERM_SCHEMA = "term string, definition string"


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Workbench:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: Embedder | None = None,
        rewrite: Rewriter | None = None,
    ) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.rewrite = embedder, rewrite

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _one(self, schema: str, *values: object) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    def _table(self, name: str, schema: str | None) -> DataFrame:
        return self.spark.table(f"`{schema}`.`{name}`" if schema else name)

    # --- SQL and catalog ---------------------------------------------------------------
    def sql(self, query: str, limit: int | None = DEFAULT_LIMIT) -> QueryRun:
        """Runs a read query, capped and logged."""
        return run_sql(self.spark, query, limit, self._path("log"))

    def log(self) -> DataFrame:
        return read_query_log(self.spark, self._path("log"))

    def tables(self, schema: str | None = None) -> DataFrame:
        return catalog.list_tables(self.spark, schema)

    def all_tables(self) -> DataFrame:
        return catalog.list_all_tables(self.spark)

    def describe(self, table: str, schema: str | None = None, order_by: list[str] | None = None) -> DataFrame:
        return catalog.describe(self._table(table, schema), order_by)

    def profile(self, table: str, schema: str | None = None) -> DataFrame:
        return catalog.profile(self._table(table, schema))

    def slots(self, slots: Iterable[Mapping[str, str]]) -> DataFrame:
        return evaluate_slots(self.spark, slots)

    # --- Keywords and glossary -----------------------------------------------------------
    def keywords(self) -> DataFrame:
        return ix.listed(read_table(self.spark, self._path("keywords"), KEYWORD_SCHEMA))

    def add_keyword(self, keyword: str, content: str) -> None:
        self._put("keywords", KEYWORD_SCHEMA, keyword, content)

    def remove_keyword(self, keyword: str) -> bool:
        return self._remove("keywords", KEYWORD_SCHEMA, keyword)

    def terms(self) -> DataFrame:
        return ix.listed(read_table(self.spark, self._path("terms"), TERM_SCHEMA))

    def define(self, term: str, definition: str) -> None:
        self._put("terms", TERM_SCHEMA, term, definition)

    def undefine(self, term: str) -> bool:
        return self._remove("terms", TERM_SCHEMA, term)

    def _put(self, name: str, schema: str, key: str, value: str) -> None:
        stored = read_table(self.spark, self._path(name), schema)
        write_table(ix.put(stored, self._one(schema, key, value)), self._path(name))

    def _remove(self, name: str, schema: str, key: str) -> bool:
        stored = read_table(self.spark, self._path(name), schema)
        if stored.where(F.col(stored.columns[0]) == key).isEmpty():
            return False
        write_table(ix.remove(stored, self._one(schema, key, None)), self._path(name))
        return True

    # --- Patterns ------------------------------------------------------------------------
    def patterns(self) -> DataFrame:
        return read_table(self.spark, self._path("patterns"), PATTERN_SCHEMA).orderBy("filename")

    def save_pattern(
        self, question: str, sql: str, tables: list[str] | None = None, description: str = "", source: str = "manual"
    ) -> DataFrame:
        """Saves a pattern, embeds it when there is an embedder, and returns its row."""
        schema = "question string, sql string, tables array<string>, description string, source string"
        row = self._one(schema, question, sql, tables or [], description, source)
        write_patterns(row, self._path("patterns"), _now().date())
        saved = self.find_pattern(question)
        if self.embedder:
            self._load(lambda index: rebuild(saved, index, self.embedder, _now()))
        return saved

    def find_pattern(self, question: str) -> DataFrame:
        return find_pattern(self.patterns(), self._one("question string", question))

    def delete_pattern(self, filename: str) -> bool:
        """Removes a pattern and its vector; whether there was one."""
        stored = self.patterns()
        if stored.where(F.col("filename") == filename).isEmpty():
            return False
        kept, _ = delete_patterns(stored, self.index(), self._one("filename string", filename))
        write_table(kept, self._path("patterns"))
        delete_from_index(self._one("id string", filename), self._path("index"))
        return True

    # --- Index ---------------------------------------------------------------------------
    def index(self) -> DataFrame:
        return read_index(self.spark, self._path("index"))

    def delete_vector(self, id_: str) -> bool:
        ids = self._one("id string", id_)
        if ix.existing(self.index(), ids).isEmpty():
            return False
        delete_from_index(ids, self._path("index"))
        return True

    def edit_vector(self, id_: str, question: str, **fields: str) -> None:
        """Changes the texts of an index row and carries its vector over."""
        names = ["id", "question", *fields]
        row = self.spark.createDataFrame([(id_, question, *fields.values())], ", ".join(f"{n} string" for n in names))
        edit_index(row, self._path("index"), _now())

    def stats(self) -> DataFrame:
        return ix.knowledge_stats(self.patterns(), self.keywords(), self.terms(), self.index())

    def rebuild(self) -> Load:
        """Embeds all saved patterns again."""
        return self._load(lambda index: rebuild(self.patterns(), index, self._model(), _now()))

    def _model(self) -> Embedder:
        if self.embedder is None:
            raise ValueError("this workbench has no embedder")
        return self.embedder

    def _load(self, step) -> Load:
        done = step(self.index())
        upsert_index(done.rows, self._path("index"), _now())
        return done

    def search(
        self, questions: str | list[str], k: int = SEARCH_K, threshold: float = DEFAULT_THRESHOLD
    ) -> DataFrame:
        """Ranked knowledge for one or many questions; ``query_id`` is a question's place in the list."""
        asked = self._asked(questions)
        model = (lambda df: embed(df, "text", self.embedder)) if self.embedder else None
        found = search(asked, self.keywords(), self.index() if model else None, model, k, threshold)
        return found.orderBy("query_id", "rank")

    def search_terms(self, questions: str | list[str]) -> DataFrame:
        """Glossary entries that contain the question's text."""
        return glossary_hits(self._asked(questions), self.terms()).orderBy("query_id", "term")

    def _asked(self, questions: str | list[str]) -> DataFrame:
        texts = [questions] if isinstance(questions, str) else questions
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")

    # --- Dashboards ----------------------------------------------------------------------
    def ingest(
        self,
        charts: Mapping[str, DataFrame],
        sources: Iterable[str] = ("all",),
        skip_existing: bool = False,
        dry_run: bool = False,
        tables: Mapping[str, DataFrame] | None = None,
    ) -> Load:
        """Loads extracted charts by source, and ``tables`` as source ``warehouse``, into the index."""
        readers = {name: (lambda df=df, name=name: self._chart_rows(df, name)) for name, df in charts.items()}
        if tables:
            readers["warehouse"] = lambda: schema_rows(table_docs(self.spark, tables))
        chosen = select_sources(sources, readers)
        if not chosen:
            raise ValueError("none of these sources has landed data")
        rows = union_all(chosen.values())
        model = self.embedder if dry_run else self._model()
        done = load(rows, self.index(), model, _now(), skip_existing, dry_run)
        if not dry_run:
            upsert_index(done.rows, self._path("index"), _now())
        return done

    def _chart_rows(self, charts: DataFrame, source: str) -> DataFrame:
        return chart_rows(charts.withColumn("source", F.lit(source)), self.rewrite)

    # --- Snapshots -----------------------------------------------------------------------
    def checkpoint(self, name: str, tables: Mapping[str, DataFrame]) -> str:
        return snapshots.checkpoint(self.spark, self._path("snapshots"), name, tables)

    def checkpoints(self) -> DataFrame:
        return snapshots.list_checkpoints(self.spark, self._path("snapshots"))

    def rollback(self, name: str = "") -> dict[str, DataFrame]:
        return snapshots.rollback(self.spark, self._path("snapshots"), name)

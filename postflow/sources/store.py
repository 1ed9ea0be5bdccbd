"""The posting store: typed Parquet tables under one root folder.

Tables are append-only. Each write goes to a folder of its own,
`<table>/writer=<who>/batch_id=<n>/` (postings further split by `source`): a
command, a stream (by its checkpoint) or a seed is a writer, so equal batch
numbers of two writers never meet. A batch that is committed is never written
again: running it once more returns what it did. Status edits, dead marks and
generated texts are separate tables folded in by `view()`. A missing table reads
as an empty typed table.

Compaction, a move to id keys and pruning write a new version: a root of its own
that holds every table, the marks of the batches committed so far (so that none of
them is done again there) and, last of all, a manifest. A version's number is
claimed by exclusive creation of a file, so it exists once.

A snapshot holds the change tables folded so far, one row a key, and names the batches
it covers; `view()` folds it with the batches after it alone.

A version can be bucketed by posting key (Spark's own buckets): postings and snapshots
then lie by key, and the insert lookup and the view shuffle only what came later.

Ids come in blocks, reserved by exclusive creation of a file for each: writers that
ingest at once get different ones, and a batch that is done again gets its own.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import schema
from postflow.operators import board, ingest, keys
from postflow.session import checkpoint_dir, scratch_path
from postflow.sources.adapters import AdapterResult
from postflow.sources.files import Files

TABLES: dict[str, T.StructType] = {
    "postings": schema.STORED_POSTINGS,
    "status_changes": schema.STATUS_CHANGES,
    "dead_marks": schema.DEAD_MARKS,
    "materials": schema.MATERIALS,
    "rejects": schema.REJECTS,
    "summaries": schema.SUMMARIES,
    "aliases": schema.ALIASES,
}

PARTITIONS = {"postings": ["source"]}
CHANGES = ("status_changes", "materials", "dead_marks")
BATCH_COLUMNS = ["writer", "batch_id"]

# Writers of the store itself; streams are named by their checkpoint.
SEED, COMPACT, INGEST, LINKS, GENERATE, STATUS, APPEND, REKEY = (
    "seed", "compact", "ingest", "links", "generate", "status", "append", "rekey")


def writer_of_stream(checkpoint_location: str) -> str:
    """A stream keeps its name for as long as it keeps its checkpoint."""
    return "stream-" + hashlib.sha1(checkpoint_location.rstrip("/").encode()).hexdigest()[:12]


def _with_batch(st: T.StructType) -> T.StructType:
    return T.StructType([*st.fields, T.StructField("writer", T.StringType(), True),
                         T.StructField("batch_id", T.LongType(), True)])


def _table_of(path: str) -> str:
    """The catalog's name of a bucketed folder (Spark reads buckets only through a table)."""
    return "postflow_" + hashlib.sha1(path.encode()).hexdigest()[:20]


def _is_batch(writer: str, batch_id: int) -> Column:
    return (F.col("writer") == F.lit(writer)) & (F.col("batch_id") == F.lit(int(batch_id)))


class PostingStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(spark)
        checkpoint_dir(spark)
        self.id_sources: list[str] = []  # sources on id keys
        self._has_marks = False
        self.buckets, self._base = 0, ""  # of a version bucketed by key: how many, and its first batch
        if self.files.exists(self._manifest):
            manifest = json.loads(self.files.read(self._manifest))
            self.id_sources, self._has_marks = manifest["id_sources"], True
            self.buckets, self._base = manifest["buckets"], manifest["base"]
        elif self.files.exists(self._claim):
            raise ValueError(f"{self.root} is a version that was not written to its end")

    @property
    def _claim(self) -> str:
        return f"{self.root}/_claim"

    @property
    def _manifest(self) -> str:
        return f"{self.root}/_manifest.json"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _batch_path(self, name: str, writer: str, batch_id: int) -> str:
        return f"{self.path(name)}/writer={writer}/batch_id={int(batch_id)}"

    def _marks(self) -> DataFrame:
        return self.spark.read.schema(schema.MARKS).parquet(self.path("_marks"))

    def committed(self, name: str, writer: str, batch_id: int) -> bool:
        """Whether the batch was written to its end (its job left the success mark, here
        or in the version before)."""
        if self.files.exists(self._batch_path(name, writer, batch_id) + "/_SUCCESS"):
            return True
        return self._has_marks and not self._marks().filter(
            (F.col("name") == name) & _is_batch(writer, batch_id)).isEmpty()

    # -- read ---------------------------------------------------------------
    def read(self, name: str, with_batch: bool = False) -> DataFrame:
        """The table with its declared schema; empty when nothing was written yet."""
        st = _with_batch(TABLES[name])
        try:
            df = self.spark.read.schema(st).parquet(self.path(name))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "Path does not exist" not in str(exc):
                raise
            df = self.spark.createDataFrame([], st)
        cols = [f.name for f in TABLES[name].fields] + (BATCH_COLUMNS if with_batch else [])
        return df.select(*cols)

    def read_batch(self, name: str, writer: str, batch_id: int) -> DataFrame:
        return self.read(name, with_batch=True).filter(_is_batch(writer, batch_id)).drop(*BATCH_COLUMNS)

    def read_others(self, name: str, writer: str, batch_id: int) -> DataFrame:
        """The table without one batch: what an attempt at that batch may look at."""
        return self.read(name, with_batch=True).filter(~_is_batch(writer, batch_id)).drop(*BATCH_COLUMNS)

    def postings(self) -> DataFrame:
        return self.read("postings").select(*schema.POSTING_COLUMNS)

    def key_of(self, job_board_id: str) -> str:
        """The key a posting has now, by one it has or had."""
        found = self.read("aliases").filter(F.col("old_key") == F.lit(job_board_id)).first()
        return job_board_id if found is None else found["new_key"]

    def view(self, exclude: tuple[str, str, int] | None = None) -> DataFrame:
        """Current postings: latest status, latest successful texts, first dead mark.
        `exclude=(table, writer, batch)` leaves out what that batch wrote to the table."""
        if self.buckets:
            return self._view_by_key(exclude)

        def side(name: str) -> DataFrame:
            if exclude is not None and exclude[0] == name:
                return self.read_others(*exclude)
            return self._changes(name) if name in CHANGES else self.read(name)

        return board.current_view(side("postings"), side("status_changes"), side("materials"), side("dead_marks"))

    # -- buckets -----------------------------------------------------------------
    def _write_by_key(self, df: DataFrame, path: str, buckets: int, partition: list[str]) -> None:
        """df as Parquet below path, bucketed and sorted by key, one file a bucket (and source)."""
        w = df.repartition(buckets, "job_board_id").write.format("parquet").option("path", path)
        if partition:
            w = w.partitionBy(*partition)
        w.bucketBy(buckets, "job_board_id").sortBy("job_board_id").saveAsTable(_table_of(path))

    def _by_key(self, name: str, path: str, partition: list[str]) -> DataFrame:
        """What `_write_by_key` wrote, as the bucketed table that it is (in a session
        that does not know it yet, by its folder)."""
        own = _table_of(path)
        if not self.spark.catalog.tableExists(own):
            fields = [f for f in TABLES[name].fields if f.name not in partition] + [TABLES[name][c] for c in partition]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            layout = f"PARTITIONED BY ({', '.join(partition)})" if partition else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {own} ({columns}) USING parquet {layout} CLUSTERED BY (job_board_id) "
                           f"SORTED BY (job_board_id) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            if partition:
                self.spark.catalog.recoverPartitions(own)
        return self.spark.table(own).select(*[f.name for f in TABLES[name].fields])

    def _later(self, name: str, covered: set[str]) -> DataFrame:
        """A table without some of its batches (`writer=.../batch_id=...`)."""
        here = {"/".join(p.split("/")[-2:]) for p in self.files.matching(f"{self.path(name)}/writer=*/batch_id=*")}
        later = [f"{self.path(name)}/{b}" for b in sorted(here - covered)]
        if not later:
            return self.spark.createDataFrame([], _with_batch(TABLES[name]))
        return self.spark.read.schema(_with_batch(TABLES[name])).option("basePath", self.path(name)).parquet(*later)

    def _postings_by_key(self) -> DataFrame:
        return self._by_key("postings", f"{self.path('postings')}/{self._base}", PARTITIONS["postings"])

    def _view_by_key(self, exclude: tuple[str, str, int] | None) -> DataFrame:
        last = self._last_snapshot()

        def parts(name: str) -> list[DataFrame]:
            if exclude is not None and exclude[0] == name:
                return [self.read_others(*exclude)]
            if last is None:
                return [self.read(name)]
            return [self._by_key(name, f"{last['root']}/{name}", []), self._later(name, set(last["covered"][name]))]

        sides = [parts(name) for name in CHANGES]
        later = self._later("postings", {self._base})
        if exclude is not None and exclude[0] == "postings":
            later = later.filter(~_is_batch(*exclude[1:]))
        return board.view_of_parts(self._postings_by_key(), *sides).unionByName(board.view_of_parts(later, *sides))

    # -- snapshots -------------------------------------------------------------
    def _last_snapshot(self) -> dict | None:
        found = self.files.matching(f"{self.path('_snapshots')}/[0-9]*.json")
        return json.loads(self.files.read(found[-1])) if found else None

    def _batches(self, name: str) -> list[str]:
        """The batches of a table that were written to their end, as `writer=.../batch_id=...`."""
        done = {"/".join(p.split("/")[-3:-1]) for p in self.files.matching(f"{self.path(name)}/writer=*/batch_id=*/_SUCCESS")}
        if self._has_marks:
            done |= {f"writer={r.writer}/batch_id={r.batch_id}" for r in self._marks().filter(F.col("name") == name).collect()}
        here = {"/".join(p.split("/")[-2:]) for p in self.files.matching(f"{self.path(name)}/writer=*/batch_id=*")}
        return sorted(done & here)

    def _changes(self, name: str) -> DataFrame:
        """What `view()` folds of a change table: all of it, or the last snapshot and the
        batches that it does not cover."""
        last = self._last_snapshot()
        if last is None:
            return self.read(name)
        rows = self.spark.read.schema(TABLES[name]).parquet(f"{last['root']}/{name}")
        return rows.unionByName(self._later(name, set(last["covered"][name])).drop(*BATCH_COLUMNS))

    def snapshot(self) -> int:
        """Fold the change tables up to now (the snapshot before and the batches after it);
        returns the snapshot's number. It counts once its manifest is there, which is
        written last; a writer that comes second to a number takes the next."""
        numbers = [int(p.rsplit("/", 1)[1].split(".")[0]) for p in self.files.matching(f"{self.path('_snapshots')}/[0-9]*")]
        number = 1 + max(numbers, default=-1)
        while not self.files.create(f"{self.path('_snapshots')}/{number:08d}.claim", "{}"):
            number += 1
        covered = {name: self._batches(name) for name in CHANGES}
        last = self._last_snapshot()
        root = f"{self.path('_snapshots')}/{number:08d}"
        for name in CHANGES:
            new = [f"{self.path(name)}/{b}" for b in covered[name] if last is None or b not in set(last["covered"][name])]
            parts = [f"{last['root']}/{name}"] if last else []
            frames = [self.spark.read.schema(TABLES[name]).parquet(*x) for x in (parts, new) if x]
            rows = self.spark.createDataFrame([], TABLES[name])
            for f in frames:
                rows = rows.unionByName(f)
            if self.buckets:
                self._write_by_key(board.folded(name, rows), f"{root}/{name}", self.buckets, [])
            else:
                board.folded(name, rows).write.parquet(f"{root}/{name}")
        self.files.create(f"{root}.json", json.dumps({"root": root, "covered": covered}))
        return number

    # -- write --------------------------------------------------------------
    def write(self, name: str, df: DataFrame, writer: str, batch_id: int) -> None:
        """Write one batch of a writer; a committed batch is left as it is.
        (Overwriting clears the rest of an attempt that did not get to its end.)"""
        if self.committed(name, writer, batch_id):
            return
        w = self._typed(name, df).write.mode("overwrite")
        if name in PARTITIONS:
            w = w.partitionBy(*PARTITIONS[name])
        w.parquet(self._batch_path(name, writer, batch_id))

    @staticmethod
    def _typed(name: str, df: DataFrame) -> DataFrame:
        """df with the table's columns; those that an older caller does not know are null."""
        return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in TABLES[name].fields])

    def _append(self, name: str, df: DataFrame, batch_id: int) -> None:
        """Add rows to a batch of the caller's own. They are written under a digest of
        all of them, so appending the same rows to the same batch once more (a replay)
        adds nothing, and other rows have a place of their own."""
        staging = scratch_path(self.spark, "append")
        self._typed(name, df).write.parquet(staging)
        rows = self.spark.read.schema(TABLES[name]).parquet(staging)
        row = F.xxhash64(*rows.columns)
        n, a, b = rows.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
        if n:
            digest = hashlib.sha1(f"{n} {a} {b}".encode()).hexdigest()[:16]
            self.write(name, rows, f"{APPEND}-{digest}", batch_id)
        self.files.delete(staging)

    def reserve_ids(self, n: int, writer: str, batch_id: int) -> int:
        """The first of n ids of this batch's own, after all that are stored or reserved.

        Blocks are numbered files `_ids/<k>`, created exclusively: of writers that try
        the same number, one gets it and the others go on behind its block."""
        own = {"writer": writer, "batch_id": int(batch_id), "n": int(n)}
        blocks = [json.loads(self.files.read(p)) for p in self.files.matching(f"{self.path('_ids')}/[0-9]*")]
        mine = [b for b in blocks if {k: b[k] for k in own} == own]
        if mine:
            return mine[-1]["first"]
        stored = self.read_others("postings", writer, batch_id).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        while True:
            first = 1 + max([int(stored), *(b["first"] + b["n"] - 1 for b in blocks)])
            path = f"{self.path('_ids')}/{len(blocks):012d}"
            if self.files.create(path, json.dumps({**own, "first": first})):
                return first
            blocks.append(json.loads(self.files.read(path)))

    def ingest(self, inc: DataFrame, as_of: dt.datetime, batch_id: int, rejects: DataFrame | None = None,
               writer: str = INGEST) -> DataFrame:
        """Insert-if-absent one batch of incoming postings; returns the run summary."""
        none = self.spark.createDataFrame([], schema.REJECTS) if rejects is None else rejects
        return self._ingest(AdapterResult(inc, none), as_of, batch_id, writer)

    def ingest_payloads(self, payloads: DataFrame, sources: DataFrame | None, as_of: dt.datetime,
                        batch_id: int, writer: str = INGEST) -> DataFrame:
        """Scan one batch of landed payloads with every adapter and ingest the postings."""
        if self.committed("summaries", writer, batch_id):
            return self.read_batch("summaries", writer, batch_id)
        return self._ingest(ingest.scan(payloads, sources), as_of, batch_id, writer)

    def _ingest(self, res: AdapterResult, as_of: dt.datetime, batch_id: int, writer: str) -> DataFrame:
        """One pass: the parsed entries (rows and rejects) are written once; what
        becomes of each row is decided on narrow rows; new rows get dense ids after
        the largest stored one. The summary is written last and marks the batch as
        committed, so a batch that broke off is done again from the start."""
        if self.committed("summaries", writer, batch_id):
            return self.read_batch("summaries", writer, batch_id)
        if self.buckets:
            keyed = self._postings_by_key()
            stored = self._later("postings", {self._base}).filter(~_is_batch(writer, batch_id)).drop(*BATCH_COLUMNS)
        else:
            keyed, stored = None, self.read_others("postings", writer, batch_id)
        entries = res.both()
        staging = self._staging(writer, batch_id)
        entries.write.mode("overwrite").parquet(staging)
        entries = self.spark.read.schema(entries.schema).parquet(staging)
        rows = entries.filter(F.col("reason").isNull()).select(*schema.INCOMING_COLUMNS, "provider_id")
        tags = ingest.tag(rows, stored, by_source=True, aliases=self.read("aliases"),
                          id_sources=self.id_sources, keyed=keyed).checkpoint(eager=True)
        won = tags.filter("is_new").select(*ingest.RUN_ORDER, "job_board_id")
        new = rows.drop("job_board_id").join(won, ingest.RUN_ORDER)
        n = won.count()
        base = self.reserve_ids(n, writer, batch_id) - 1 if n else 0
        self.write("postings", ingest.with_defaults(ingest.assign_ids(new, base), as_of), writer, batch_id)
        bad = entries.filter(F.col("reason").isNotNull()).select(*[f.name for f in schema.REJECTS.fields])
        bad = bad.unionByName(ingest.split_required(rows)[1]).unionByName(ingest.collisions(rows, tags))
        self.write("rejects", bad, writer, batch_id)
        self.write("summaries", ingest.summary_of(tags), writer, batch_id)
        self.files.delete(staging)
        return self.read_batch("summaries", writer, batch_id)

    def _staging(self, writer: str, batch_id: int) -> str:
        """Where a batch's parsed entries lie while it is at work: one folder of its own,
        which a new attempt clears of what a broken one left."""
        own = hashlib.sha1(f"{self.root} {writer} {int(batch_id)}".encode()).hexdigest()[:16]
        return f"{checkpoint_dir(self.spark).rstrip('/')}/postflow-entries-{own}"

    def seed(self, postings: DataFrame, batch_id: int = 0) -> None:
        """Write postings that already exist elsewhere (ids and keys kept)."""
        if self.committed("postings", SEED, batch_id):
            raise ValueError(f"seed batch {batch_id} is already written")
        self.write("postings", postings, SEED, batch_id)

    def append_status(self, changes: DataFrame, batch_id: int) -> None:
        self._append("status_changes", changes, batch_id)

    def append_dead(self, marks: DataFrame, batch_id: int) -> None:
        self._append("dead_marks", marks, batch_id)

    def append_materials(self, rows: DataFrame, batch_id: int) -> None:
        self._append("materials", rows, batch_id)

    # -- the three commands of the original tool, as one call each -----------
    def check_links(self, responses: DataFrame, as_of: dt.datetime, batch_id: int, limit: int = 0,
                    mark_dead: bool = True, dead_out: str | None = None) -> DataFrame:
        """Check not-dead postings against landed responses; returns live/dead/unknown counts.

        Dead postings get one shared `dead_at` (appended to `dead_marks`) when
        `mark_dead`; `dead_out` receives the export lines when there are dead links.
        """
        from postflow.operators import links

        results = links.check_postings(self.view(exclude=("dead_marks", LINKS, batch_id)), responses, limit=limit)
        results = results.checkpoint(eager=True)  # one verdict set for counts, marks and export
        if mark_dead:
            self.write("dead_marks", links.dead_marks(results, as_of), LINKS, batch_id)
        if dead_out:
            links.export_dead(results, dead_out)
        return links.counts(results)

    def generate(self, resume_summary: str, generator, as_of: dt.datetime, batch_id: int,
                 limit: int = 0) -> DataFrame:
        """Generate both texts for pending postings (the first `limit` by id, 0 = all);
        returns generated / empty / failed / remaining counts. A committed batch is
        not generated again."""
        from postflow.operators import materials

        if not self.committed("materials", GENERATE, batch_id):
            view = self.view(exclude=("materials", GENERATE, batch_id))
            produced = materials.run_generation(view, resume_summary, generator, as_of, limit=limit)
            self.write("materials", produced, GENERATE, batch_id)
        return materials.run_summary(self.view(), self.read_batch("materials", GENERATE, batch_id))

    def set_status(self, job_board_id: str, status: str, as_of: dt.datetime, batch_id: int = 0) -> int:
        """Record a status edit when it differs from the current one; returns rows written (0 or 1).

        Edits of a key are numbered by the store, so two in one second keep their order.
        """
        job_board_id = self.key_of(job_board_id)
        change = board.status_change(board.lookup(self.view(), job_board_id), job_board_id, status, as_of)
        rows = change.collect()  # one key: one row at most
        if rows:
            mine = self.read("status_changes").filter(F.col("job_board_id") == F.lit(job_board_id))
            last = mine.agg(F.max("seq")).first()[0]
            row = {**rows[0].asDict(), "seq": 0 if last is None else int(last) + 1}
            self._append("status_changes", self.spark.createDataFrame([row], schema.STATUS_CHANGES), batch_id)
        return len(rows)

    def edit_statuses(self, edits: DataFrame, as_of: dt.datetime, batch_id: int = 0) -> DataFrame:
        """Record a table of edits (job_board_id, status, ord) in one write: each that
        differs from the status before it, in the order `ord` of its posting. Keys may be
        old ones; unknown postings are left out. Returns the rows of the batch; a
        committed batch is not written again."""
        if not self.committed("status_changes", STATUS, batch_id):
            old = self.read("aliases").select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new"))
            mine = edits.join(old, F.col("job_board_id") == F.col("_old"), "left").select(
                F.coalesce("_new", "job_board_id").alias("job_board_id"), "status", "ord")
            changes = self.read_others("status_changes", STATUS, batch_id)
            last = changes.groupBy("job_board_id").agg(F.max("seq").alias("_seq"))
            now = board.current_view(self.postings(), changes).select("job_board_id", F.col("status").alias("_now"))
            self.write("status_changes", board.numbered_changes(mine.join(now, "job_board_id").join(
                last, "job_board_id", "left"), as_of), STATUS, batch_id)
        return self.read_batch("status_changes", STATUS, batch_id)

    # -- versions ---------------------------------------------------------------
    def _new_version(self, version: int, writer: str, changed: Callable[[], dict[str, DataFrame]],
                     id_sources: list[str] | None = None, buckets: int | None = None) -> str:
        """Write every table, some of them changed, and the commit marks under the root
        `<root>_v<version>`; its manifest comes last. An existing version is an error.

        Postings become one batch, bucketed if the version is to be (None: as this one is);
        the small tables keep their writers and batches, which replayed commands read again."""
        buckets = self.buckets if buckets is None else int(buckets)
        root = f"{self.root}_v{int(version)}"
        if not self.files.create(f"{root}/_claim", json.dumps({"from": self.root, "by": writer})):
            raise ValueError(f"version {int(version)} exists already: {root}")
        tables = changed()
        for name in TABLES:
            df = tables.get(name)
            df = self.read(name, with_batch=True) if df is None else df
            if name == "postings" and buckets:
                self._write_by_key(self._typed(name, df), f"{root}/{name}/writer={writer}/batch_id=0", buckets, PARTITIONS[name])
            elif name == "postings":
                self._typed(name, df).write.partitionBy("source").parquet(f"{root}/{name}/writer={writer}/batch_id=0")
            elif set(BATCH_COLUMNS) <= set(df.columns):
                df.write.partitionBy(*BATCH_COLUMNS).parquet(f"{root}/{name}")
            else:
                self._typed(name, df).write.parquet(f"{root}/{name}/writer={writer}/batch_id=0")
        found = [p.split("/")[-4:-1] for n in TABLES for p in self.files.matching(f"{self.path(n)}/writer=*/batch_id=*/_SUCCESS")]
        marks = self.spark.createDataFrame(
            [(n, w.removeprefix("writer="), int(b.removeprefix("batch_id="))) for n, w, b in found], schema.MARKS)
        (marks.unionByName(self._marks()) if self._has_marks else marks).distinct().write.parquet(f"{root}/_marks")
        self.files.create(f"{root}/_manifest.json", json.dumps(
            {"version": int(version), "from": self.root, "by": writer, "tables": {n: f"{root}/{n}" for n in TABLES},
             "id_sources": sorted(set(self.id_sources) | set(id_sources or [])),
             "buckets": buckets, "base": f"writer={writer}/batch_id=0"}))
        return root

    def compact(self, name: str, version: int, buckets: int | None = None) -> str:
        """The whole store under a new root `<root>_v<version>`, with the batches of the
        table `name` written together. With `buckets` the new version is bucketed by key
        (0: not; None: as this one is); size them so that a bucket of postings is a few
        hundred MB.

        Readers switch by opening the new root; the old root stays readable
        until it is removed, so compaction never races a reader.
        """
        if name not in TABLES:
            raise ValueError(f"unknown table: {name}")
        return self._new_version(version, COMPACT, dict, buckets=buckets)

    def rekey(self, source: str, version: int) -> str:
        """The store under a new root with the URL-keyed rows of `source` on id-derived
        keys: postings, status edits, texts and dead marks move together, and aliases
        of the old keys are kept for the next scrape."""
        from postflow.operators import extras

        def moved() -> dict[str, DataFrame]:
            postings = self.read("postings")
            sides = {n: self.read(n, with_batch=True) for n in ("status_changes", "materials", "dead_marks")}
            tables = extras.rekey_tables(postings, source, **sides)
            tables["aliases"] = keys.chained(self.read("aliases"), keys.moved_keys(postings, source))
            return tables

        return self._new_version(version, REKEY, moved, [source])

    def prune_removed(self, version: int) -> str:
        """The store under a new root without the postings found dead, nor their side rows."""
        from postflow.operators import extras

        def listed() -> dict[str, DataFrame]:
            kept = extras.still_listed(self.view()).select("job_board_id").distinct()
            return {name: self.read(name, with_batch=True).join(kept, "job_board_id", "left_semi")
                    for name in ("postings", "status_changes", "materials", "dead_marks")}

        return self._new_version(version, COMPACT, listed)

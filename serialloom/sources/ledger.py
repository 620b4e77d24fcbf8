"""The library's commits: which Parquet files make up each table, version by version.

A library is a folder with ``data/<table>/<pass>/part-*.parquet`` and
``log/<version>.json``. A version is a JSON line for itself and one for each
file that it adds or removes, with the file's rows and the range of the column
that the table is laid out by; every ``FULL_EVERY`` versions one more file
lists all that is live, so that a reader needs no older ones. The driver reads
the list of live files, never their rows.

A :class:`Pass` is one writer's work on top of one version. It appends new rows
as new files, and changes rows by writing anew the files that hold them, no
others. Its commit makes all of it visible in one step by naming the next
version, which only one writer can do: of two passes on one version the second
is refused and changes nothing (:func:`run_pass` tries it again on the new
version). A pass that dies leaves files that no version names; ``vacuum``
deletes them.

The step is a rename that does not replace, which is atomic where the file
system's is (HDFS; on a local disk two writers within the same instant are
not told apart).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMA, TABLES

FULL_EVERY = 20
#: What a table is laid out by, the keys that no two rows share, and the column that must name a novel.
LAYOUT = {"novels": ["id"], "sources": ["novel_id", "id"], "chapters": ["novel_id", "number"], "chapter_gaps": ["novel_id", "number"], "meta": ["key"]}
UNIQUE = {"novels": [["id"]], "sources": [["id"], ["url"]], "chapters": [["novel_id", "number"]], "chapter_gaps": [["novel_id", "number"]], "meta": [["key"]]}
CHILDREN = ("sources", "chapters", "chapter_gaps")


class LedgerError(Exception):
    pass


class ConflictError(LedgerError):
    """Another pass has committed since this one began."""


@dataclass(frozen=True)
class DataFile:
    """path: below the library's folder. lo, hi: the range of the first layout column; None for strings."""

    table: str
    path: str
    rows: int
    lo: int | None = None
    hi: int | None = None


@dataclass(frozen=True)
class Version:
    number: int
    schema: int = SCHEMA
    files: tuple[DataFile, ...] = ()

    def of(self, table: str) -> list[DataFile]:
        return [f for f in self.files if f.table == table]


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _read(spark: SparkSession, path: str) -> list[dict]:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [json.loads(line) for line in text.splitlines()]


def _create(spark: SparkSession, path: str, lines: list[dict]) -> bool:
    """Whether the file was made; False if there is one of that name already."""
    jvm = spark.sparkContext._jvm
    p, fs = _hadoop(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray("".join(json.dumps(x) + "\n" for x in lines).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(p), how)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(p):
            return False
        raise LedgerError(f"cannot write {path}") from e
    return True


def version_at(spark: SparkSession, folder: str, number: int | None = None) -> Version | None:
    """The last version, or one that is asked for by its number; None where there is no library."""
    found = [x for x in names_in(spark, f"{folder}/log") if x.endswith(".json")]
    commits = sorted(int(x[:12]) for x in found if len(x) == 17)
    if not commits:
        if names_in(spark, f"{folder}/data"):
            raise LedgerError(f"{folder} holds data, but no version says which of it counts")
        return None
    want = commits[-1] if number is None else number
    if want not in commits:
        raise LedgerError(f"{folder} has no version {want}")
    full = max((int(x[:12]) for x in found if x.endswith(".full.json") and int(x[:12]) <= want), default=None)
    steps = [f"{full:012d}.full.json"] if full is not None else []
    steps += [f"{v:012d}.json" for v in commits if (full is None or v > full) and v <= want]
    live: dict[str, DataFile] = {}
    schema = SCHEMA
    for name in steps:
        head, *actions = _read(spark, f"{folder}/log/{name}")
        schema = head["schema"]
        for a in actions:
            gone = a.pop("gone", False)
            live.pop(a["path"], None)
            if not gone:
                live[a["path"]] = DataFile(**a)
    return Version(want, schema, tuple(live.values()))


def read_files(spark: SparkSession, folder: str, table: str, files: list[DataFile]) -> DataFrame:
    """The rows of these files, in the table's schema; columns that an older file lacks are null."""
    want = spark.createDataFrame([], TABLES[table]).schema
    if not files:
        return spark.createDataFrame([], want)
    return spark.read.schema(want).parquet(*[f"{folder}/{f.path}" for f in files])


def tables_at(spark: SparkSession, folder: str, version: Version) -> dict[str, DataFrame]:
    return {t: read_files(spark, folder, t, version.of(t)) for t in TABLES}


def _file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+/[^/]+)$", 1)


@dataclass
class Pass:
    """What one writer adds to and changes in a version; nothing shows before ``commit``."""

    spark: SparkSession
    folder: str
    base: Version
    schema: int = SCHEMA
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    added: list[DataFile] = field(default_factory=list)
    removed: set[str] = field(default_factory=set)
    lost_novels: bool = False
    writes: int = 0

    def files(self, table: str) -> list[DataFile]:
        """What makes up the table with this pass's work in it."""
        return [f for f in [*self.base.of(table), *(f for f in self.added if f.table == table)] if f.path not in self.removed]

    def table(self, name: str) -> DataFrame:
        return read_files(self.spark, self.folder, name, self.files(name))

    def near(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of the files whose range meets that of ``keys``: all that can hold one of them."""
        lead = LAYOUT[table][0]
        lo, hi = keys.agg(F.min(lead), F.max(lead)).first()
        files = [f for f in self.files(table) if f.lo is None or (lo is not None and f.lo <= hi and f.hi >= lo)]
        return read_files(self.spark, self.folder, table, files)

    def _write(self, table: str, rows: DataFrame, files: int = 0) -> int:
        """New files for ``rows``, each with a narrow range of the layout's columns; how many rows there are.

        Rows of so many ``files`` (named by __file) stay together as they were, and are read once; others are dealt by range.
        """
        self.writes += 1
        at = f"data/{table}/{self.name}-{self.writes}"
        columns = self.spark.createDataFrame([], TABLES[table]).columns
        dealt = rows.repartition(files, "__file") if files else rows.repartitionByRange(*LAYOUT[table])
        dealt.sortWithinPartitions(*LAYOUT[table]).select(*columns).write.parquet(f"{self.folder}/{at}")
        lead = F.col(LAYOUT[table][0])
        ranged = table != "meta"
        stats = self.spark.read.parquet(f"{self.folder}/{at}").groupBy(_file_name().alias("path")).agg(F.count("*").alias("rows"), *([F.min(lead).alias("lo"), F.max(lead).alias("hi")] if ranged else []))
        made = [DataFile(table, **r.asDict()) for r in stats.collect()]  # a row for each new file
        self.added += made
        return sum(f.rows for f in made)

    def append(self, table: str, rows: DataFrame) -> int:
        """Rows that are not there yet, as new files. Returns how many."""
        return self._write(table, rows)

    def replace(self, table: str, rows: DataFrame) -> int:
        """The whole table anew."""
        old = self.files(table)
        n = self._write(table, rows)
        self.removed |= {f.path for f in old}
        self.lost_novels |= table == "novels"
        return n

    def _touched(self, table: str, keys: DataFrame, on: list[str]) -> list[DataFile]:
        """The files that hold a row of these keys. Ranges are tried first; of the files that are left, the key columns alone are read."""
        files = self.files(table)
        lead = LAYOUT[table][0]
        if lead in on and table != "meta":
            lo, hi = keys.agg(F.min(lead), F.max(lead)).first()
            files = [] if lo is None else [f for f in files if f.lo is None or (f.lo <= hi and f.hi >= lo)]
        if not files:
            return []
        held = self.spark.read.parquet(*[f"{self.folder}/{f.path}" for f in files]).select(*on, _file_name().alias("__file"))
        hit = {r[0] for r in held.join(keys.select(*on), on, "left_semi").select("__file").distinct().collect()}  # file names
        return [f for f in files if f.path in hit]

    def delete(self, table: str, keys: DataFrame, on: list[str]) -> int:
        """Without the rows of these keys. Returns how many went; their number is that of the files' rows before and after."""
        old = self._touched(table, keys, on)
        if not old:
            return 0
        rest = read_files(self.spark, self.folder, table, old).withColumn("__file", _file_name()).join(keys.select(*on), on, "left_anti")
        n = self._write(table, rest, len(old))
        self.removed |= {f.path for f in old}
        self.lost_novels |= table == "novels"
        return sum(f.rows for f in old) - n

    def update(self, table: str, keys: DataFrame, on: list[str], new: dict[str, Column], only: Column | None = None) -> int:
        """Columns of the rows of these keys set anew; ``new`` and ``only`` may name further columns of ``keys``.

        Returns how many rows were changed, counted by the job that writes them.
        Keys must be unique. ``only`` says which of the rows are changed.
        """
        old = self._touched(table, keys, on)
        if not old:
            return 0
        rows = read_files(self.spark, self.folder, table, old)
        met = rows.withColumn("__file", _file_name()).join(keys.withColumn("__hit", F.lit(True)), on, "left")
        hit = F.coalesce(F.col("__hit") & (F.lit(True) if only is None else only), F.lit(False))
        seen = Observation()
        met = met.withColumn("__hit", hit).observe(seen, F.count_if("__hit").alias("n"))
        changed = [F.when(F.col("__hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns]
        self._write(table, met.select("__file", *changed), len(old))
        self.removed |= {f.path for f in old}
        return seen.get["n"]

    def broken(self) -> list[str]:
        """The rules that this pass breaks. Only its new files are looked at, and what the other files hold of their keys."""
        counts = []
        for table in TABLES:
            new = [f for f in self.added if f.table == table and f.path not in self.removed]
            if not new:
                continue
            rest = [f for f in self.files(table) if f not in new]
            fresh = read_files(self.spark, self.folder, table, new)
            for key in UNIQUE[table]:
                same = rest
                if key[0] == LAYOUT[table][0] and table != "meta":
                    lo, hi = min((f.lo for f in new if f.lo is not None), default=0), max((f.hi for f in new if f.hi is not None), default=-1)
                    same = [f for f in rest if f.lo is None or (f.lo <= hi and f.hi >= lo)]
                mine = fresh.select(*key)
                others = read_files(self.spark, self.folder, table, same).select(*key).join(mine, key, "left_semi")
                counts.append(mine.unionByName(others).groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{table}: {', '.join(key)} is unique").alias("rule"), "n"))
            if table in CHILDREN:
                counts.append(self._orphans(table, fresh))
        if self.lost_novels:
            counts += [self._orphans(t, self.table(t)) for t in CHILDREN if self.files(t)]
        if not counts:
            return []
        every = counts[0]
        for c in counts[1:]:
            every = every.unionByName(c)
        return sorted({r["rule"] for r in every.filter("n > 0").collect()})

    def _orphans(self, table: str, rows: DataFrame) -> DataFrame:
        known = self.table("novels").select(F.col("id").alias("novel_id"))
        return rows.select("novel_id").join(known, "novel_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{table} have a novel").alias("rule"), "n")

    def commit(self, what: str = "") -> int:
        """The version that this pass became; the base's if it changed nothing."""
        number = self.base.number + 1
        added = [f for f in self.added if f.path not in self.removed]
        old = {f.path for f in self.base.files}
        if not added and not self.removed & old and self.schema == self.base.schema:
            return self.base.number
        if bad := self.broken():
            raise LedgerError(f"the pass breaks {'; '.join(bad)}")
        head = {"version": number, "schema": self.schema, "what": what}
        lines = [head, *({"gone": True} | vars(f) for f in self.base.files if f.path in self.removed), *(vars(f) for f in added)]
        if not _create(self.spark, f"{self.folder}/log/{number:012d}.json", lines):
            raise ConflictError(f"version {number} was made by another pass")
        if number % FULL_EVERY == 0:
            live = [f for f in [*self.base.files, *added] if f.path not in self.removed]
            _create(self.spark, f"{self.folder}/log/{number:012d}.full.json", [head, *map(vars, live)])
        return number


def begin(spark: SparkSession, folder: str) -> Pass:
    base = version_at(spark, folder) or Version(0)
    return Pass(spark, folder, base, base.schema)


def run_pass(spark: SparkSession, folder: str, work: Callable[[Pass], object], what: str = "", tries: int = 3) -> tuple[int, object]:
    """Begins a pass, works and commits; from the start again if another pass came first. Returns the version and what the work returned."""
    for left in range(tries - 1, -1, -1):
        now = begin(spark, folder)
        out = work(now)
        try:
            return now.commit(what), out
        except ConflictError:
            if not left:
                raise
    raise AssertionError


def history(spark: SparkSession, folder: str) -> DataFrame:
    """version, schema, what, table, added, removed and rows (net) of each commit."""
    raw = spark.read.schema("version long, schema long, what string, table string, path string, rows long, gone boolean").json(f"{folder}/log/*[0-9].json")
    named = raw.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]{12})\.json$", 1).cast("long"))
    head = named.filter("version IS NOT NULL").select("version", "schema", "what")
    sign = F.when(F.coalesce("gone", F.lit(False)), -F.col("rows")).otherwise(F.col("rows"))
    each = named.filter("path IS NOT NULL").groupBy(F.col("file").alias("version"), "table").agg(F.count_if(F.col("gone").isNull()).alias("added"), F.count_if("gone").alias("removed"), F.sum(sign).alias("rows"))
    return head.join(each, "version", "left")


def vacuum(spark: SparkSession, folder: str, keep: int = 10, older_than_s: int = 7 * 86400, now_s: float | None = None) -> int:
    """Deletes the data that none of the last ``keep`` versions names, unless it is young (a pass may be at work). Returns how many folders and files went."""
    import time

    last = version_at(spark, folder)
    if last is None:
        return 0
    named = set()
    for v in range(max(1, last.number - keep + 1), last.number + 1):
        named |= {f.path for f in version_at(spark, folder, v).files}
    edge = ((time.time() if now_s is None else now_s) - older_than_s) * 1000
    gone = 0
    for table in names_in(spark, f"{folder}/data"):
        for made in names_in(spark, f"{folder}/data/{table}"):
            at = f"data/{table}/{made}"
            p, fs = _hadoop(spark, f"{folder}/{at}")
            if fs.getFileStatus(p).getModificationTime() > edge:
                continue
            held = [f"{at}/{x}" for x in names_in(spark, f"{folder}/{at}") if x.endswith(".parquet")]
            live = [x for x in held if x in named]
            for x in [at] if not live else [x for x in held if x not in named]:
                q, _ = _hadoop(spark, f"{folder}/{x}")
                gone += bool(fs.delete(q, True))
    return gone

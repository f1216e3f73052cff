"""Tables that change by commits: data in folders of their own, a log of versions, and a check that no other writer was first."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class Conflict(RuntimeError):
    """Another writer has committed since the version that was read."""


class Snapshots:
    """A table under ``root``, divided by the values of the column ``part``.

    Written data is new folders, seen by nobody. A commit adds one small file to the log, which
    names the folder of every part; the newest file is the table. So readers see the old
    version or the new one, whatever a writer dies at, and old versions stay readable. The
    file's name is the version, and it is moved into place only if there is none: of two
    writers that began at the same version the second gets a ``Conflict``. Parts must not be
    null; their number, not the rows', is what the driver holds.
    """

    def __init__(self, spark: SparkSession, root: str, part: str):
        self.spark, self.root, self.part = spark, root, part
        fs = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: fs.Path(p)
        self._fs = fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._once = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        self._once[0] = getattr(fs.Options.Rename, "NONE")

    # The log

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        log = self._path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def entry(self, version: int | None = None) -> dict:
        """The log's entry: ``version, parts, schema, note``."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": {}, "schema": None, "note": {}}
        text = self.spark.read.text(f"{self.root}/log/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, base: dict, changes: dict[str, str | None], schema: StructType, note: dict | None = None) -> dict:
        """The entry after ``base``, with parts set to folders, or removed (null)."""
        parts = {p: f for p, f in (base["parts"] | changes).items() if f is not None}
        schema = StructType([StructField(f.name, f.dataType) for f in schema])
        if base["schema"] and StructType.fromJson(base["schema"]).simpleString() != schema.simpleString():
            raise ValueError(f"the table's columns are {StructType.fromJson(base['schema']).simpleString()}, not {schema.simpleString()}")
        new = {"version": base["version"] + 1, "parts": parts, "schema": schema.jsonValue(), "note": note or {}}
        ready = self._path(f"{self.root}/log/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(ready, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        try:
            self._files.rename(ready, self._path(f"{self.root}/log/{new['version']:012d}.json"), self._once)
        except Exception as e:  # the file system's error comes through py4j
            self._fs.delete(ready, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new['version']} is another writer's") from None
            raise
        return new

    # Data

    @staticmethod
    def name(value: object) -> str:
        """A part's name in paths, whatever signs its value has."""
        return hashlib.sha256(str(value).encode()).hexdigest()[:24]

    def stage(self, df: DataFrame) -> dict[str, str]:
        """Write rows to a folder of their own; the parts they have and where each is."""
        folder = f"data/{uuid.uuid4().hex}"
        named = df.withColumn("_part", F.left(F.sha2(F.col(self.part).cast("string"), 256), F.lit(24)))
        named.write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        where = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return {n[6:]: f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def read(self, version: int | None = None, parts: list | None = None) -> DataFrame:
        """The table at a version (the newest), or some of its parts: the other folders aren't opened."""
        entry = self.entry(version)
        if entry["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        return self.rows(entry, StructType.fromJson(entry["schema"]), parts)

    def rows(self, entry: dict, schema: StructType, parts: list | None = None) -> DataFrame:
        wanted = entry["parts"] if parts is None else {self.name(p) for p in parts} & set(entry["parts"])
        paths = sorted(f"{self.root}/{entry['parts'][p]}" for p in wanted)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Changes

    def replace(self, df: DataFrame, base: dict | None = None, note: dict | None = None, drop: list | None = None) -> dict:
        """The parts that ``df`` has are replaced as a whole, those of ``drop`` go, all others stay."""
        base = self.entry() if base is None else base
        df = df.select(*StructType.fromJson(base["schema"]).names) if base["schema"] else df
        changes = {self.name(p): None for p in drop or []}
        return self.commit(base, changes | self.stage(df), df.schema, note)

    def update(self, touched: list, change: Callable[[DataFrame], DataFrame], schema: StructType, note: dict | None = None, tries: int = 5) -> dict:
        """``change`` of the rows of some parts, done again on the newest version when another writer was first."""
        for left in range(tries - 1, -1, -1):
            base = self.entry()
            try:
                return self.replace(change(self.rows(base, schema, touched)), base, note, drop=touched)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 1) -> int:
        """Remove the versions before the last ``keep`` and the folders that only they, or no version, name; how many folders went.

        No writer may be at work, as what it has staged is in no version yet.
        """
        last = self.version()
        kept = [self.entry(v) for v in range(max(1, last - keep + 1), last + 1)]
        for v in range(max(1, last - keep), 0, -1):
            old = self._path(f"{self.root}/log/{v:012d}.json")
            if last - keep < v or not self._fs.exists(old):
                break
            self._fs.delete(old, False)
        used, gone = {"/".join(f.split("/")[:2]) for e in kept for f in e["parts"].values()}, 0
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in used:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def publish_version(table: Snapshots, version: str, smoke: Callable[[DataFrame], bool] | None = None) -> dict:
    """Q8 as one step, on a table divided by ``corpus_version``: the candidate published, the active version inactive, the pointer moved.

    The new rows are staged and ``smoke`` looks at them as readers would see them; only if it
    passes is the entry committed, whose note has the active version. If nothing would be
    published, or the test fails or dies, nothing has changed and no restoring is needed. The
    parts of other versions are not read. Returns ``passed, active, previous, reason``.
    """
    from corpusloom.operators.quality import publish

    base = table.entry()
    previous = base["note"].get("active")
    rows = table.rows(base, StructType.fromJson(base["schema"]), [version, *([previous] if previous not in (None, version) else [])])
    new, result = publish(rows, version, previous)
    kept = {"active": previous, "previous": base["note"].get("previous")}
    if not result.first().passed:
        return {"passed": False, "reason": "nothing to publish", **kept}
    parts = table.stage(new.select(*rows.columns))
    try:
        ok = smoke is None or smoke(table.rows(base | {"parts": base["parts"] | parts}, rows.schema))
        reason = "" if ok else "smoke test failed"
    except Exception as e:  # whatever the caller's test dies of, the old version stays
        ok, reason = False, f"smoke test: {type(e).__name__}"
    if not ok:
        return {"passed": False, "reason": reason, **kept}
    table.commit(base, parts, rows.schema, {"active": version, "previous": previous})
    return {"passed": True, "reason": "", "active": version, "previous": previous}

"""The stored library: saving, deleting and migrating issues, each as one step over both tables.

Rows lie in Parquet folders dealt by a hash of issue_id. Numbered files beside them list the folders that make up each
version; a change writes new folders first and becomes visible with the rename of its one list, so that a reader sees all
of it or nothing, and what a broken change left behind belongs to no version. Deleting and migrating write anew only
the folders in which something changes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adatlas.functions import text as X
from adatlas.operators import library as L

#: Folders that the rows of a save are dealt into at most, and attempts when others commit at the same time.
BUCKETS, TRIES = 64, 20
TABLES = ("issues", "advertisers")


def place(path: str) -> str:
    """A path as it is compared: however many slashes follow its scheme."""
    return re.sub(r"^(\w+:)/+", r"\1/", path)


class Library:
    """A library under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._path = spark, spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = place(self._fs.makeQualified(self._path(root)).toString())

    # what there is

    def version(self) -> int:
        """The newest version, 0 for an empty library."""
        log = self._path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max([int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)], default=0)

    def state(self, version: int | None = None) -> dict:
        """The folders and schema of each table."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/log/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, by default the newest; None before the first save. Columns that older files lack are null."""
        own = self.state(version)["tables"].get(table)
        return self._read(own, own["folders"]) if own else None

    def _read(self, table: dict, folders: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(table["schema"]))
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in folders]) if folders else self.spark.createDataFrame([], schema)

    # changes

    def save(self, meta: DataFrame, ads: DataFrame, save_id: str | None = None, rules: DataFrame | None = None) -> bool:
        """Appends issues and their advertisers. False, with nothing written, if a save of this id is there already: a save may be repeated until it succeeds."""
        if save_id is not None and self.saved(save_id):
            return False
        self.state()  # a list that can't be read is found before anything is written
        new = {"advertisers": self._write("advertisers", L.stored_advertisers(ads, rules))}
        # advertisers are counted where they were written: what they come from is not computed again, and the counts are those of the stored rows
        new["issues"] = self._write("issues", L.stored_issues(meta, self._read(new["advertisers"], new["advertisers"]["folders"])))

        def append(state: dict) -> dict | None:
            if save_id is not None and self.saved(save_id):  # by another session meanwhile
                return None
            return {t: self._joined(state["tables"].get(t), new[t]) for t in TABLES}

        return self._commit(append, save_id)

    def saved(self, save_id: str) -> bool:
        return self.version() > 0 and bool(self.spark.read.schema("save_id STRING").json(f"{self.root}/log").where(F.col("save_id") == save_id).head(1))

    def adopt(self, table: str, path: str) -> bool:
        """Takes over a folder of files from before, whatever columns it lacks; the files stay where they are."""
        found = self.spark.read.parquet(path)
        entry = {"schema": found.schema.json(), "folders": [{"path": place(self._fs.makeQualified(self._path(path)).toString()), "bucket": None}]}
        return self._commit(lambda state: {**state["tables"], table: self._joined(state["tables"].get(table), entry)})

    def delete(self, issues: DataFrame) -> bool:
        """Takes issues and their advertisers out of the newest version; False if none of them is there. issues: issue_id."""
        ids = issues.select("issue_id").where("issue_id is not null").distinct()
        buckets = {r[0] for r in ids.select(self._bucket()).distinct().collect()}  # BUCKETS at most

        def without(state: dict) -> dict | None:
            changed = dict(state["tables"])
            for name, table in state["tables"].items():
                maybe = [f for f in table["folders"] if f["bucket"] is None or f["bucket"] in buckets]
                held = self._holding(table, maybe, lambda rows: rows.join(ids, "issue_id", "left_semi"))
                changed[name] = self._rewritten(name, table, held, lambda rows: L.without_issues(rows, ids))
            return changed if changed != state["tables"] else None

        return self._commit(without)

    def migrate(self, rules: DataFrame | None = None) -> bool:
        """Fills missing and empty sector groups from the sector; False if there are none."""

        def filled(state: dict) -> dict | None:
            table = state["tables"].get("advertisers")
            if not table:
                return None
            old = StructType.fromJson(json.loads(table["schema"]))
            new = old if "sector_group" in old.names else StructType([*old.fields]).add("sector_group", "string")
            table = {**table, "schema": new.json()}
            held = self._holding(table, table["folders"], lambda rows: rows.where(X.text(F.col("sector_group")) == ""))
            changed = self._rewritten("advertisers", table, held, lambda rows: L.migrated(rows, rules))
            return {**state["tables"], "advertisers": changed} if held or new != old else None

        return self._commit(filled)

    def tidy(self) -> int:
        """Deletes what changes that broke off have left behind; for times without running changes. The number of folders deleted."""
        data, gone = self._path(f"{self.root}/data"), 0
        kept = {f["path"] for v in range(1, self.version() + 1) for t in self.state(v)["tables"].values() for f in t["folders"]}
        for run in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if not any(k.startswith(place(run.getPath().toString()) + "/") for k in kept):
                gone += bool(self._fs.delete(run.getPath(), True))
        return gone

    # how

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("issue_id").cast("string")), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _write(self, table: str, rows: DataFrame) -> dict:
        """Writes rows into new folders; nobody sees them yet."""
        run = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(run)
        found = [place(s.getPath().toString()) for s in self._fs.listStatus(self._path(run)) if "bucket=" in s.getPath().getName()]
        return {"schema": rows.schema.json(), "folders": [{"path": p, "bucket": int(p.rpartition("=")[2])} for p in sorted(found)]}

    @staticmethod
    def _joined(old: dict | None, new: dict) -> dict:
        """Both folders' rows, with the columns of either."""
        if not old:
            return new
        schema, more = (StructType.fromJson(json.loads(t["schema"])) for t in (old, new))
        for field in more.fields:
            schema = schema if field.name in schema.names else schema.add(field)
        return {"schema": schema.json(), "folders": [*old["folders"], *new["folders"]]}

    def _holding(self, table: dict, folders: list[dict], among: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """The folders in which some rows are found."""
        rows = self._read(table, folders)
        if not folders:
            return []
        at = F.regexp_replace(F.col("__file"), "/[^/]*$", "")
        found = among(rows.select("*", F.col("_metadata.file_path").alias("__file"))).select(at.alias("at")).distinct().collect()  # as many as folders, at most
        paths = {place(r["at"]) for r in found}
        return [f for f in folders if any(p == f["path"] or p.startswith(f["path"] + "/") for p in paths)]

    def _rewritten(self, name: str, table: dict, held: list[dict], change: Callable[[DataFrame], DataFrame]) -> dict:
        if not held:
            return table
        rows = change(self._read(table, held))
        return {"schema": table["schema"], "folders": [*[f for f in table["folders"] if f not in held], *self._write(name, rows)["folders"]]}

    def _commit(self, change: Callable[[dict], dict | None], save_id: str | None = None) -> bool:
        """Applies a change to the newest version and publishes it as the next; begins anew where another came first."""
        for _ in range(TRIES):
            state = self.state()
            tables = change(state)
            if tables is None:
                return False
            if self._publish({"version": state["version"] + 1, "save_id": save_id, "tables": tables}):
                return True
        raise RuntimeError(f"{TRIES} other changes came first")

    def _publish(self, state: dict) -> bool:
        jvm = self.spark._jvm
        ready, final = self._path(f"{self.root}/log/_{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{state['version']:010d}.json")
        stream = self._fs.create(ready, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        try:
            context.rename(ready, final, none)
            return True
        except Py4JJavaError as e:
            self._fs.delete(ready, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise

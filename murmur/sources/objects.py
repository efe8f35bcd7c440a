"""Object stores as data sources: listings of keys, and documents put at their keys.

``spark.read.format("objects").load(root)`` lists what lies under ``root`` (a folder or a store's address that pyarrow
can open): key, size, modified_at. The first parts of the keys are the partitions, so prefixes are listed in parallel.
Filters are pushed into the listing: ``key LIKE 'p%'`` and ``key = ...`` keep to the prefixes that can match, ``key LIKE
'%.json'`` and bounds of ``modified_at`` drop objects where they are listed. The session must allow it
(``spark.sql.python.filterPushdown.enabled``; ``register`` sets it).

``df.write.format("documents").mode("append").save(root)`` puts each row's ``body`` at its ``key``. A document is put
under a name of its own first and moved to its key, so no reader sees half of one; each task then leaves a list of what
it put, and the commit names those lists in one small file. ``published`` reads the lists that commits name. A task that
fails and runs again, and a whole write that does, put the same bytes at the same keys; a write that never commits
leaves documents that ``published`` doesn't know. ``keyed`` makes one row a key.

Edge cases: an absent root lists nothing; a null key or body is not put; keys that leave the root ("..", a leading
slash) are refused.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

LISTED = "key string, size long, modified_at timestamp"
#: Documents' lists and commits lie here, under the root; names with a leading underscore are no objects.
BOOK = "_documents"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (fs.LocalFileSystem(), root)


@dataclass
class Prefix(InputPartition):
    """A folder to list with all below it, or (``deep`` false) its own files only."""

    path: str
    deep: bool


class _Listing(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.starts, self.ends, self.bounds, self.equal = [], [], [], []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, StringStartsWith) and column == "key":
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith) and column == "key":
                self.ends.append(f.value)
            elif isinstance(f, EqualTo) and column == "key":
                self.equal.append(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and column == "modified_at":
                self.bounds.append((type(f).__name__, f.value))
            elif not (isinstance(f, IsNotNull) and column == "key"):  # every object has one
                yield f

    def _wanted(self, folder: str) -> bool:
        """Whether keys under a folder (its key, with a slash) can match the prefixes."""
        return all(p.startswith(folder) or folder.startswith(p) for p in [*self.starts, *self.equal])

    def _matches(self, key: str, modified) -> bool:
        compare = {"GreaterThan": lambda x, y: x > y, "GreaterThanOrEqual": lambda x, y: x >= y, "LessThan": lambda x, y: x < y, "LessThanOrEqual": lambda x, y: x <= y}
        if not (all(key.startswith(p) for p in self.starts) and all(key.endswith(p) for p in self.ends) and all(key == p for p in self.equal)):
            return False
        return not self.bounds or modified is not None and all(compare[k](modified, v if v.tzinfo else v.replace(tzinfo=modified.tzinfo)) for k, v in self.bounds)

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.root)
        if store.get_file_info(root).type != fs.FileType.Directory:
            return []
        out, level = [], [root]
        for _ in range(2):  # by the first two parts of the keys
            below = []
            for path in level:
                out.append(Prefix(path, False))
                for info in store.get_file_info(fs.FileSelector(path)):
                    part = posixpath.relpath(info.path, root)
                    if info.type == fs.FileType.Directory and not info.base_name.startswith("_") and self._wanted(part + "/"):
                        below.append(info.path)
            level = below
        return [*out, *(Prefix(p, True) for p in level)]

    def read(self, partition: Prefix | None) -> Iterator[tuple]:
        import datetime as dt

        if partition is None:  # what the engine asks for where there is no partition
            return

        from pyarrow import fs

        store, root = _store(self.root)
        for info in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep, allow_not_found=True)):
            key = posixpath.relpath(info.path, root)
            if info.type == fs.FileType.File and not any(p.startswith("_") for p in key.split("/")):
                at = dt.datetime.fromtimestamp(info.mtime_ns / 1e9, dt.UTC) if info.mtime_ns else None
                if self._matches(key, at):
                    yield key, info.size, at


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"])


@dataclass
class Put(WriterCommitMessage):
    book: str | None
    documents: int


def _inside(key: str) -> str:
    if key.startswith("/") or ".." in key.split("/") or not key or key.split("/")[0] == BOOK:
        raise ValueError(f"no key under the root: {key!r}")
    return key


class _Putting(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.write_id = root.rstrip("/"), uuid.uuid4().hex

    def write(self, rows) -> Put:
        store, root = _store(self.root)
        lines = []
        for row in rows:
            key, body = row["key"], row["body"]
            if key is None or body is None:
                continue
            data = body.encode()
            at = f"{root}/{_inside(key)}"
            part = f"{posixpath.dirname(at)}/_{uuid.uuid4().hex}.part"
            store.create_dir(posixpath.dirname(at), recursive=True)
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, at)
            lines.append(json.dumps({"key": key, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data)}))
        if not lines:
            return Put(None, 0)
        store.create_dir(f"{root}/{BOOK}/lists", recursive=True)
        book = f"{BOOK}/lists/{self.write_id}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{root}/{book}") as out:
            out.write("\n".join(lines).encode())
        return Put(book, len(lines))

    def commit(self, messages) -> None:
        store, root = _store(self.root)
        done = {"write": self.write_id, "lists": [m.book for m in messages if m and m.book], "documents": sum(m.documents for m in messages if m)}
        store.create_dir(f"{root}/{BOOK}/commits", recursive=True)
        part = f"{root}/{BOOK}/commits/_{self.write_id}.part"
        with store.open_output_stream(part) as out:
            out.write(json.dumps(done).encode())
        store.move(part, f"{root}/{BOOK}/commits/{self.write_id}.json")

    def abort(self, messages) -> None:
        store, root = _store(self.root)
        for m in messages:
            if m and m.book:
                store.delete_file(f"{root}/{m.book}")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "key string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("documents are put at their keys: use append")
        return _Putting(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Objects, Documents):
        spark.dataSource.register(source)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """key, size, modified_at of what lies under a root."""
    register(spark)
    return spark.read.format("objects").load(root)


def station_ids(objects: DataFrame, prefix: str) -> DataFrame:
    """The stations that have objects: the part of the key after the prefix."""
    return objects.filter(F.col("key").startswith(prefix)).select(F.get(F.split(F.substr("key", F.lit(len(prefix) + 1)), "/"), 0).alias("station_id")).filter("station_id <> ''").distinct()


def result_objects(objects: DataFrame, prefix: str, since: Column, most: int) -> DataFrame:
    """JSON objects under a prefix since a time, the newest first, ``most`` at most."""
    return objects.filter(F.col("key").startswith(prefix) & F.col("key").endswith(".json") & (F.col("modified_at") >= since)).orderBy(F.desc("modified_at"), "key").limit(most)


def sorted_json(**fields: Column) -> Column:
    """A JSON object with its fields in the order of their names; null ones stay, as null."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def keyed(*documents: DataFrame) -> DataFrame:
    """key, body of several tables of documents, one row a key: of different bodies of one key the greatest."""
    every = documents[0].select("key", "body")
    for d in documents[1:]:
        every = every.unionByName(d.select("key", "body"))
    return every.filter("key IS NOT NULL").groupBy("key").agg(F.max("body").alias("body"))


def publish(rows: DataFrame, root: str) -> None:
    """Puts documents (key, body) under a root."""
    register(rows.sparkSession)
    rows.select("key", "body").write.format("documents").mode("append").save(root)


def published(spark: SparkSession, root: str) -> DataFrame:
    """key, sha256, size of the documents that commits name; of a key that was put often, its last state counts once if all
    writes agree."""
    commits = spark.read.schema("lists array<string>").json(f"{root}/{BOOK}/commits")
    lines = spark.read.schema("key string, sha256 string, size long").json(f"{root}/{BOOK}/lists").withColumn("list", F.regexp_extract(F.col("_metadata.file_path"), f"({BOOK}/lists/[^/]+)$", 1))
    return lines.join(commits.select(F.explode("lists").alias("list")).distinct(), "list", "left_semi").select("key", "sha256", "size").distinct()


def mention_key(mention_id: Column, at: Column, kind: str, prefix: str = "mentions/") -> Column:
    """The key of a mention's document: by day, then mention."""
    return F.concat(F.lit(prefix), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), mention_id.cast("string"), F.lit(f"/{kind}.json"))


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def mention_documents(mentions: DataFrame, prefix: str = "mentions/") -> DataFrame:
    """key, body of the three documents of each mention: metadata, transcript, analysis. mentions: mention_id,
    conversation_id, station_id, station_name, content_type, detected_language, started_at, ended_at, close_reason,
    campaign_ids, keyword_ids, evidence_key, text, missing, segments, matches (arrays of structs), analysis (JSON)."""
    c = F.col
    common = {"conversation_id": c("conversation_id"), "station_id": c("station_id"), "detected_language": c("detected_language")}
    metadata = sorted_json(
        schema=F.lit("radio.mention.v1"), mention_id=c("mention_id"), station_name=c("station_name"), content_type=c("content_type"),
        broadcast_start_utc=_iso(c("started_at")), broadcast_end_utc=_iso(c("ended_at")), duration_ms=F.unix_millis(c("ended_at").cast("timestamp")) - F.unix_millis(c("started_at").cast("timestamp")),
        close_reason=c("close_reason"), campaign_ids=c("campaign_ids"), keyword_ids=c("keyword_ids"), evidence_storage_key=c("evidence_key"), **common,
    )
    transcript = sorted_json(schema=F.lit("radio.transcript.v1"), text=c("text"), started_at_utc=_iso(c("started_at")), ended_at_utc=_iso(c("ended_at")), missing_sequences=c("missing"), segments=c("segments"), matches=c("matches"), **common)
    bodies = {"metadata": metadata, "transcript": transcript, "analysis": c("analysis")}
    each = F.explode(F.array(*[F.struct(mention_key(c("mention_id"), c("started_at"), kind, prefix).alias("key"), body.alias("body")) for kind, body in bodies.items()]))
    return mentions.select(each.alias("d")).select("d.*")


def audit_documents(scans: DataFrame, prefix: str = "semantic/") -> DataFrame:
    """key, body of the audit of each semantic scan: by station and day, then a digest of keyword and group. scans:
    keyword_id, group_key, station_id, scanned_at, and what the audit says as further columns."""
    marker = F.substring(F.sha2(F.concat_ws("|", F.col("keyword_id").cast("string"), "group_key"), 256), 1, 20)
    key = F.concat(F.lit(prefix), F.col("station_id").cast("string"), F.lit("/"), F.date_format("scanned_at", "yyyy/MM/dd"), F.lit("/"), marker, F.lit(".semantic.json"))
    return scans.select(key.alias("key"), sorted_json(**{n: _iso(F.col(n)) if n == "scanned_at" else F.col(n) for n in scans.columns}).alias("body"))

"""Archives of JSON arrays as tables: members of zip files, their records, and the curated station overlay made of them.

An archive is one row of Spark's ``binaryFile`` source and is opened by one task, so its size is bounded
(``spark.sql.sources.binaryFile.maxLength``); many archives open in parallel, and a member of more than ``MOST_BYTES`` is
refused before it is unpacked. What can't be taken is a row with its reason, not an error: unsafe names, broken archives
and members, what isn't an array, records that aren't objects or break a rule, and repeated stations.
"""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
RECORDS = "archive string, member string, place long, record string, refused string"


def _unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or name[1:2] == ":" and name[:1].isalpha() or ".." in name.replace("\\", "/").split("/")


def _members(archive: str, content: bytes, most: int):
    """member, place, record, refused of one archive; a row for each record or for each thing refused."""
    try:
        held = zipfile.ZipFile(io.BytesIO(content))
        infos = held.infolist()
    except (zipfile.BadZipFile, OSError) as error:
        yield None, None, None, f"no archive: {error}"
        return
    if bad := [i.filename for i in infos if _unsafe(i.filename)]:
        yield bad[0], None, None, "unsafe name"  # nothing of such an archive is trusted
        return
    seen = set()
    for info in infos:
        name = info.filename
        if info.is_dir() or not name.endswith(".json") or "src" not in name.split("/")[:-1]:
            continue
        if name in seen:
            yield name, None, None, "repeated member"
            continue
        seen.add(name)
        if info.file_size > most:
            yield name, None, None, "too large"
            continue
        try:
            with held.open(info) as f:
                data = f.read(most + 1)
            if len(data) > most:
                yield name, None, None, "too large"
                continue
            records = json.loads(data)
        except (zipfile.BadZipFile, zipfile.zlib.error, OSError, RuntimeError, NotImplementedError, UnicodeDecodeError, json.JSONDecodeError, RecursionError):
            yield name, None, None, "broken member"
            continue
        if not isinstance(records, list):
            yield name, None, None, "not an array"
            continue
        for i, record in enumerate(records):
            ok = isinstance(record, dict)
            yield name, i, json.dumps(record, ensure_ascii=False) if ok else None, None if ok else "not an object"


def records(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """archive, member, place, record (JSON) and refused of the zip files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, *r) for r in _members(name, content.as_py(), most)]
                for a in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[a : a + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["archive", "member", "place", "record", "refused"])

    return files.mapInArrow(run, RECORDS)


def _field(name: str) -> Column:
    return F.get_json_object("record", f"$.{name}")


def _items(text: Column, lower: bool) -> Column:
    cut = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(cut, lambda x: F.lower(x)) if lower else cut


def overlay(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """overrides (station_uuid, name, url, homepage, favicon, country_code, language_codes, tags, iso_3166_2, geo_lat,
    geo_long), deletions (station_uuid) and refused (archive, member, place, record, refused) from records; both of the
    first by station. Of a station that is overridden twice the first stays and the others are refused."""
    given = F.trim(_field("stationuuid"))
    plain = F.lower(F.regexp_replace(given, "[{}]|^urn:uuid:|-", ""))
    as_uuid = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    station = F.when(plain.rlike("^[0-9a-f]{32}$"), as_uuid).otherwise(F.lower(given))
    deletes = F.col("record").rlike(r'"delete"\s*:') & _field("delete").isNotNull()
    web = lambda c: F.coalesce(c.rlike("^https?://[^/?#:@]"), F.lit(False))
    number = lambda n: _field(n).try_cast("double")
    url, country = F.trim(_field("url")), _field("countrycode")
    reason = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.coalesce(given, F.lit("")) == "", "no station")
        .when(deletes & ~F.lower(F.trim(_field("delete"))).eqNullSafe("true"), "unclear delete")
        .when(~deletes & (F.coalesce(F.trim(_field("name")), F.lit("")) == ""), "no name")
        .when(~deletes & ~web(url), "no address")
        .when(~deletes & ~F.coalesce(country.rlike("^[A-Za-z]{2}$"), F.lit(False)), "no country")
        .when(~deletes & ((_field("geo_lat").isNotNull() & number("geo_lat").isNull()) | (_field("geo_long").isNotNull() & number("geo_long").isNull())), "no coordinate")
    )
    judged = rows.withColumn("reason", reason).withColumn("station_uuid", station).withColumn("deletes", deletes)
    first = Window.partitionBy("station_uuid").orderBy("archive", "member", "place")
    good = judged.filter("reason IS NULL AND NOT deletes").withColumn("n", F.row_number().over(first))
    optional = lambda n: F.when(web(F.trim(_field(n))), F.trim(_field(n))).otherwise("")
    overrides = good.filter("n = 1").select(
        "station_uuid", _field("name").alias("name"), url.alias("url"), optional("homepage").alias("homepage"), optional("favicon").alias("favicon"), F.upper(country).alias("country_code"),
        _items(_field("languagecodes"), True).alias("language_codes"), _items(_field("tags"), False).alias("tags"), F.nullif(F.trim(_field("iso_3166_2")), F.lit("")).alias("iso_3166_2"), number("geo_lat").alias("geo_lat"), number("geo_long").alias("geo_long"),
    )
    deletions = judged.filter("reason IS NULL AND deletes").select("station_uuid").distinct()
    kept = ["archive", "member", "place", "record"]
    refused = judged.filter("reason IS NOT NULL").select(*kept, F.col("reason").alias("refused")).unionByName(good.filter("n > 1").select(*kept, F.lit("repeated station").alias("refused")))
    return overrides.orderBy("station_uuid"), deletions.orderBy("station_uuid"), refused


def snapshot_ref(rows: DataFrame, prefix: str = "radio-database-") -> DataFrame:
    """archive, ref: what the only top folder of an archive says after the prefix, else null."""
    top = F.substring_index("member", "/", 1)
    one = rows.filter("member IS NOT NULL").groupBy("archive").agg(F.collect_set(top).alias("tops"))
    name = F.get("tops", 0)
    return one.select("archive", F.when((F.size("tops") == 1) & name.startswith(prefix), F.nullif(F.substr(name, F.lit(len(prefix) + 1)), F.lit(""))).alias("ref"))

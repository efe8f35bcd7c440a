"""The driver's tables as the engine's entities: campaigns, stations, keywords, segments, transcripts, analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Partitions that one split of a table's files is dealt into (``Views.spread``).
PER_SPLIT = 8


class Views:
    """Lazily read tables of one folder; every view prunes to the columns it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, rows: DataFrame, *keys) -> DataFrame:
        """rows, made of the named table, dealt by keys into partitions whose number grows with the table's files: a task's
        share, and its memory, stays as it is when the table grows."""
        splits = self.table(name).rdd.getNumPartitions()
        return rows.repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), PER_SPLIT * splits), *keys)

    def campaigns(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("campaign_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("paused").alias("status"), F.col("o_orderdate").alias("created_at"))

    def campaign_stations(self) -> DataFrame:
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("campaign_id"), F.col("l_suppkey").alias("station_id"))
        return self.spread("lineitem", rows, "campaign_id").distinct()

    def campaign_keywords(self) -> DataFrame:
        lines = self.spread("lineitem", self.table("lineitem").select("l_orderkey", "l_partkey", "l_linestatus"), "l_orderkey")
        link = lines.groupBy(F.col("l_orderkey").alias("campaign_id"), F.col("l_partkey").alias("keyword_id")).agg(F.max(F.col("l_linestatus") == "O").alias("enabled"))
        return link.join(self.table("part").select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("value"), F.col("p_type").alias("kind")), "keyword_id")

    def segments(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("segment_id"), F.col("user_id").alias("station_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("class"), F.col("value"))

    def mentions(self) -> DataFrame:
        """Physical mentions: documents with their analysis, if any."""
        docs = self.table("documents").select(F.col("doc_id").alias("mention_id"), F.col("source").alias("station"), "lang", "n_chars")
        marks = self.table("labels").select(F.col("doc_id").alias("mention_id"), "quality", "toxic")
        return docs.join(marks, "mention_id", "left")


#: The same views for an SQL engine that has the tables as relations.
SQL = """
campaigns AS (SELECT o_orderkey AS campaign_id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'paused' END AS status, o_orderdate AS created_at FROM orders),
campaign_stations AS (SELECT DISTINCT l_orderkey AS campaign_id, l_suppkey AS station_id FROM lineitem),
campaign_keywords AS (SELECT k.*, p_name AS value, p_type AS kind FROM (SELECT l_orderkey AS campaign_id, l_partkey AS keyword_id, max(l_linestatus = 'O') AS enabled FROM lineitem GROUP BY ALL) k JOIN part ON p_partkey = keyword_id),
segments AS (SELECT event_id AS segment_id, user_id AS station_id, ts AS started_at, event_type AS class, value FROM events),
mentions AS (SELECT d.doc_id AS mention_id, d.source AS station, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
"""

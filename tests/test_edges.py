"""Every engine query on empty tables, and on tables whose rows are all null; held against its SQL where both read nulls alike."""

import compare
import pytest

from murmur.plans import registry

SOURCE = "/root/testdata/sf0.001"
#: Sums over nothing are zero in these, null in their SQL; or a row says that nothing was refused.
EMPTY = "activation_estimate capacity_snapshot readiness refused_stations sentiment_counts".split()
#: Their SQL lets a null through where the query has a stated default for it, or takes null for a key.
NULLS = (
    "activation_estimate after_sends analysis_records audio_segments audit_keys campaign_requests campaign_totals claimed_batch created_children deleted_campaigns enqueued_jobs inserted_segments "
    "kept_events kept_windows keyword_configuration match_verdicts mention_documents merged_catalogue metadata_stations reclaimed_events refused_stations released_segments repeated_overlays "
    "replaced_bindings scan_memos selection_summaries session_states settled_records shown_analyses source_mention_ids stale_jobs station_settings subscription_states swept_jobs text_keys "
    "unpublished_mentions untracked_mentions waiting_subscriptions worker_roles"
).split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "null"):
        root = tmp_path_factory.mktemp(kind)
        for t in compare.TABLES:
            import pyarrow as pa
            import pyarrow.parquet as pq

            schema = spark.read.parquet(f"{SOURCE}/{t}.parquet").limit(0).toArrow().schema
            pq.write_table(pa.table([pa.nulls(0 if kind == "empty" else 3, f.type) for f in schema], schema=schema), f"{root}/{t}.parquet")
        out[kind] = str(root)
    return out


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_edges(spark, folders, kind):
    failed, parts = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    others = EMPTY if kind == "empty" else NULLS
    sql, held = registry.oracle_sql(), 0
    for name, query in sorted(registry.queries().items()):
        try:
            if name in sql and name not in others:
                got, want = compare.both(spark, query, sql[name], folders[kind])
                held += 1
                if got != want:
                    failed.append((name, got[:3], want[:3]))
            else:
                query(spark, folders[kind]).collect()
        except Exception as e:  # noqa: BLE001
            failed.append((name, str(e)[:200]))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert not failed and held >= (124 if kind == "empty" else 90)

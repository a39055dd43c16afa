"""The same queries in SQL, over views named as the tables."""

from __future__ import annotations

LOG = """
    log AS (
        SELECT event_id + 1 AS seqno, 'user:' || user_id AS key,
            CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || event_id END AS value,
            event_type = 'error' AS tombstone,
            CAST((event_id * 10) // (SELECT count(*) FROM events) + 1 AS BIGINT) AS run_id
        FROM events
    ),
    latest AS (
        SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno, arg_max(tombstone, seqno) AS tombstone FROM log GROUP BY key
    ),
    runs AS (
        SELECT run_id, key, arg_max(value, seqno) AS value, max(seqno) AS seqno, arg_max(tombstone, seqno) AS tombstone FROM log GROUP BY run_id, key
    ),
    manifest AS (
        SELECT run_id AS id, count(*) AS entries, CAST(sum(17 + strlen(key) + strlen(value)) AS BIGINT) AS file_size,
            min(key) AS min_key, max(key) AS max_key, min(seqno) AS min_seqno, max(seqno) AS max_seqno,
            run_id * 3600 AS created_at, lpad(CAST(run_id AS VARCHAR), 6, '0') || '.sst' AS file_name
        FROM runs GROUP BY run_id
    ),
    win AS (
        SELECT row_number() OVER (ORDER BY max_seqno DESC) AS pos, id AS newest_id, count(*) OVER w AS n,
            list(id) OVER w AS ids, CAST(sum(file_size) OVER w AS BIGINT) AS total, max(file_size) OVER w AS max_size, min(file_size) OVER w AS min_size
        FROM manifest WINDOW w AS (ORDER BY max_seqno DESC ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
    ),
    picked AS (
        SELECT ids, total, max_size <= 2.0 * min_size AS alike FROM win WHERE n = 4 ORDER BY (max_size <= 2.0 * min_size) DESC, total, pos LIMIT 1
    ),
    seg AS (SELECT run_id AS segment, seqno AS "offset", seqno, key, value, tombstone, seqno % 997 <> 0 AS valid FROM log),
    bad AS (SELECT segment, min("offset") AS bad_at FROM seg WHERE NOT valid GROUP BY segment),
    good AS (SELECT seg.* FROM seg LEFT JOIN bad USING (segment) WHERE bad_at IS NULL OR "offset" < bad_at),
    old AS (
        SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno, arg_max(tombstone, seqno) AS tombstone FROM runs WHERE run_id <= 4 GROUP BY key
    ),
    gc AS (
        SELECT o.*, m.id AS source_run,
            tombstone AND 72000 - created_at > 61200 AND (SELECT coalesce(min(min_seqno), 9223372036854775807) FROM manifest WHERE id > 4) > seqno AS dropped
        FROM old o JOIN manifest m ON m.id <= 4 AND o.seqno BETWEEN m.min_seqno AND m.max_seqno
    ),
    job AS (
        SELECT i.keys_in, i.bytes_in, g.*, keys_in - keys_out AS keys_dropped, round(100.0 * (keys_in - keys_out) / keys_in, 4) AS drop_pct
        FROM (SELECT count(*) AS keys_in, CAST(sum(17 + strlen(key) + strlen(value)) AS BIGINT) AS bytes_in FROM runs WHERE run_id <= 4) i,
            (SELECT count(*) FILTER (WHERE NOT dropped) AS keys_out,
                CAST(coalesce(sum(17 + strlen(key) + strlen(value)) FILTER (WHERE NOT dropped), 0) AS BIGINT) AS bytes_out,
                count(*) FILTER (WHERE NOT dropped AND tombstone) AS tombstones_kept,
                count(*) FILTER (WHERE dropped) AS tombstones_dropped FROM gc) g
    ),
    output AS (
        SELECT 11 AS id, count(*) AS entries, CAST(sum(17 + strlen(key) + strlen(value)) AS BIGINT) AS file_size, min(seqno) AS min_seqno, max(seqno) AS max_seqno
        FROM (SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno FROM runs WHERE list_contains((SELECT ids FROM picked), run_id) GROUP BY key)
    ),
    wanted AS (SELECT 'user:' || i AS key FROM range(0, 300, 7) t(i)),
    files AS (
        SELECT file_name FROM manifest WHERE id <> 3
        UNION ALL SELECT unnest(['000099.sst', '000100.sst', 'notes.txt'])
    ),
    trace AS (
        SELECT k.key, source_run, count(*) AS consulted, count(*) FILTER (WHERE k.key < min_key OR k.key > max_key) AS range_skipped
        FROM (SELECT key, max(run_id) AS source_run FROM runs GROUP BY key) k JOIN manifest ON id >= source_run GROUP BY k.key, source_run
    ),
    placed AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) AS place, 17 + strlen(key) + strlen(value) AS size FROM runs),
    summed AS (SELECT *, sum(size) OVER (PARTITION BY run_id ORDER BY place) AS upto FROM placed),
    blocks AS (
        SELECT run_id, 0 AS block, 1 AS first_place, (SELECT coalesce(min(s.place), max(p.place)) FROM placed p LEFT JOIN summed s ON s.run_id = p.run_id AND s.place = p.place AND s.upto >= 1024 WHERE p.run_id = r.run_id) AS last_place
        FROM (SELECT DISTINCT run_id FROM runs) r
        UNION ALL
        SELECT b.run_id, b.block + 1, b.last_place + 1,
            (SELECT coalesce(min(s.place) FILTER (WHERE s.upto - (SELECT z.upto FROM summed z WHERE z.run_id = b.run_id AND z.place = b.last_place) >= 1024), max(s.place)) FROM summed s WHERE s.run_id = b.run_id AND s.place > b.last_place)
        FROM blocks b WHERE b.last_place < (SELECT max(place) FROM placed p WHERE p.run_id = b.run_id)
    ),
    layout AS (
        SELECT b.run_id, CAST(block AS BIGINT) AS block, CAST(first_place AS BIGINT) AS first_place, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes
        FROM blocks b JOIN placed p ON p.run_id = b.run_id AND p.place BETWEEN b.first_place AND b.last_place GROUP BY ALL
    ),
    rolling AS (SELECT seqno, 25 + strlen(key) + strlen(value) AS size, sum(25 + strlen(key) + strlen(value)) OVER (ORDER BY seqno) AS upto FROM log),
    rolled AS (
        SELECT 1 AS segment, (SELECT min(seqno) FROM rolling) AS first_seqno, (SELECT max(seqno) FROM rolling WHERE 8 + upto <= 4096) AS last_seqno
        UNION ALL
        SELECT segment + 1, last_seqno + 1, (SELECT max(seqno) FROM rolling WHERE 8 + upto - (SELECT upto FROM rolling z WHERE z.seqno = r.last_seqno) <= 4096)
        FROM rolled r WHERE last_seqno < (SELECT max(seqno) FROM rolling)
    ),
    slots AS (
        SELECT o_orderkey + 1 AS seqno, 32 + strlen('order:' || o_orderkey) + strlen(o_orderstatus) + 1 + strlen(o_orderpriority) AS size FROM orders
    ),
    filling AS (SELECT seqno, size, sum(size) OVER (ORDER BY seqno) AS upto FROM slots),
    rotated AS (
        SELECT 1 AS memtable, (SELECT min(seqno) FROM filling) AS first_seqno, (SELECT coalesce(min(seqno) FILTER (WHERE upto >= 65536), max(seqno)) FROM filling) AS last_seqno
        UNION ALL
        SELECT memtable + 1, last_seqno + 1, (SELECT coalesce(min(seqno) FILTER (WHERE upto - (SELECT upto FROM filling z WHERE z.seqno = r.last_seqno) >= 65536), max(seqno)) FROM filling WHERE seqno > r.last_seqno)
        FROM rotated r WHERE last_seqno < (SELECT max(seqno) FROM filling)
    ),
    sources AS (SELECT key, max(run_id) AS source_run FROM runs GROUP BY key),
    sized AS (SELECT run_id, CAST(greatest(64, ceil(count(*) * -ln(0.01) / (ln(2) * ln(2)))) AS BIGINT) AS m FROM runs GROUP BY run_id),
    filled AS (SELECT DISTINCT run_id, (CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) + i * (CAST('0x' || substr(md5(key), 9, 7) AS BIGINT) | 1)) % m AS bit FROM runs JOIN sized USING (run_id), range(7) t(i)),
    probing AS (
        SELECT w.key, id AS run_id, false AS absent FROM wanted w LEFT JOIN sources USING (key) JOIN manifest ON w.key BETWEEN min_key AND max_key AND (source_run IS NULL OR id >= source_run)
        UNION ALL SELECT 'user:' || i || 'x', id, true FROM range(1000) t(i) JOIN manifest ON 'user:' || i || 'x' BETWEEN min_key AND max_key
    ),
    passed AS (
        SELECT p.key, p.run_id, absent, bool_and(f.bit IS NOT NULL) AS may
        FROM (SELECT key, run_id, absent, (CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) + i * (CAST('0x' || substr(md5(key), 9, 7) AS BIGINT) | 1)) % m AS bit FROM probing JOIN sized USING (run_id), range(7) t(i)) p LEFT JOIN filled f ON f.run_id = p.run_id AND f.bit = p.bit GROUP BY ALL
    ),
    stat AS (
        SELECT *, sst_live AS epoch, sst_live + 1 AS version_id, CAST(0 AS BIGINT) AS none, CASE WHEN disk_block_reads > 0 THEN 0.5 ELSE 0 END AS block_cache_hit_rate
        FROM (SELECT count(*) AS active_entries, CAST(sum(32 + strlen(key) + strlen(value)) AS BIGINT) AS active_bytes FROM runs WHERE run_id = 10),
            (SELECT count(*) AS sst_live, CAST(sum(file_size) AS BIGINT) AS sst_total_bytes, max(max_seqno) AS last_seqno FROM manifest),
            (SELECT coalesce(max(total), 0) AS compaction_backlog_bytes FROM picked),
            (SELECT count(DISTINCT run_id) AS wal_segments, CAST(8 + sum(25 + strlen(key) + strlen(value)) FILTER (WHERE run_id = 10) AS BIGINT) AS wal_active_segment_bytes, count(*) AS writes FROM log),
            (SELECT 2 * count(*) AS blooms_checked, 2 * count(*) FILTER (WHERE NOT may) AS blooms_negative, count(*) FILTER (WHERE may) AS disk_block_reads FROM passed WHERE NOT absent),
            (SELECT 2 * count(*) AS runs_consulted FROM wanted LEFT JOIN sources USING (key) JOIN manifest ON source_run IS NULL OR id >= source_run),
            (SELECT 2 * count(*) AS reads FROM wanted)
    )
"""


def over_log(sql: str) -> str:
    return f"WITH RECURSIVE {LOG} {sql}"


SQL: dict[str, str] = {
    name: over_log(sql)
    for name, sql in {
        "latest_versions": "SELECT key, value, seqno, tombstone FROM latest",
        "live_snapshot": "SELECT key, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM log) WHERE rn = 1 AND NOT tombstone",
        "snapshot_over_runs": "SELECT key, value, seqno FROM latest WHERE NOT tombstone",
        "stream_latest": "SELECT key, value, seqno, tombstone FROM latest",
        "point_get": "SELECT key, value, seqno FROM latest WHERE key = 'user:7' AND NOT tombstone",
        "multi_get": "SELECT w.key, l.value, l.key IS NOT NULL AS found FROM wanted w LEFT JOIN (SELECT * FROM latest WHERE NOT tombstone) l ON l.key = w.key",
        "get_absent": "SELECT count(*) AS probed, count(l.key) AS found FROM range(1000) t(i) LEFT JOIN latest l ON l.key = 'absent-' || i AND NOT l.tombstone",
        "get_as_of_seqno": "SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno FROM log WHERE seqno <= (SELECT count(*) // 2 FROM log) GROUP BY key HAVING NOT arg_max(tombstone, seqno)",
        "range_scan": "SELECT key, value FROM latest WHERE NOT tombstone AND key BETWEEN 'user:1' AND 'user:5'",
        "key_history": "SELECT key, count(*) AS versions, count(*) FILTER (WHERE tombstone) AS deletes, min(seqno) AS first_seqno, max(seqno) AS last_seqno FROM log GROUP BY key",
        "run_op_rollup": "SELECT run_id, op, count(*) AS n, CAST(sum(25 + strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM (SELECT *, CASE WHEN tombstone THEN 'DEL' ELSE 'PUT' END AS op FROM log) GROUP BY ROLLUP (run_id, op)",
        "get_trace": "SELECT * FROM trace",
        "memtable_stats": "SELECT count(*) AS entries, CAST(sum(32 + strlen(key) + strlen(value)) AS BIGINT) AS bytes, count(*) FILTER (WHERE tombstone) AS tombstones, max(seqno) AS newest_seqno FROM latest",
        "run_manifest": "SELECT * EXCLUDE (created_at), strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created FROM manifest",
        "manifest_totals": "SELECT count(*) AS runs, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(file_size) AS BIGINT) AS total_bytes, max(max_seqno) AS max_seqno, arg_max(id, max_seqno) AS newest_id FROM manifest",
        "range_skip": "SELECT key, count(*) FILTER (WHERE key BETWEEN min_key AND max_key) AS candidates, count(*) FILTER (WHERE NOT key BETWEEN min_key AND max_key) AS skipped FROM wanted, manifest GROUP BY key",
        "bloom_parameters": "SELECT id, entries, round(-ln(0.01) / (ln(2) * ln(2)), 6) AS bits_per_key, CAST(greatest(1, round(ln(2) * -ln(0.01) / (ln(2) * ln(2)))) AS INTEGER) AS hashes, CAST(greatest(64, ceil(entries * -ln(0.01) / (ln(2) * ln(2)))) AS BIGINT) AS bits FROM manifest",
        "bloom_no_false_negative": "SELECT run_id, count(*) AS probed, CAST(0 AS BIGINT) AS false_negatives FROM runs GROUP BY run_id",
        "flush_runs": "SELECT run_id, key, value, seqno, tombstone FROM runs",
        "sst_block_layout": "SELECT * FROM layout",
        "sst_block_stats": "SELECT run_id, count(*) AS blocks, min(bytes) AS min_bytes, max(bytes) AS max_bytes, round(avg(bytes), 4) AS avg_bytes FROM layout GROUP BY run_id",
        "sst_restart_points": "SELECT run_id, key, place - 1 AS place FROM placed WHERE (place - 1) % 16 = 0",
        "sparse_index_seek": "SELECT run_id, w.key AS wanted, max(p.key) AS seek_key FROM placed p JOIN wanted w ON p.key <= w.key WHERE (place - 1) % 16 = 0 GROUP BY run_id, w.key",
        "picker_windows": "SELECT pos, newest_id, total, max_size, min_size, max_size <= 2.0 * min_size AS qualifies FROM win WHERE n = 4",
        "picker_choice": "SELECT array_to_string(ids, ',') AS ids, total, CASE WHEN alike THEN 'runs of similar size' ELSE 'no similar runs, the smallest' END AS reason FROM picked",
        "picker_no_candidate": "SELECT '' AS ids, total, '' AS reason FROM picked WHERE false",
        "compaction_merge": "SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno, arg_max(tombstone, seqno) AS tombstone FROM runs WHERE list_contains((SELECT ids FROM picked), run_id) GROUP BY key",
        "tombstone_gc": "SELECT key, seqno, tombstone, source_run, dropped FROM gc",
        "compaction_job_stats": "SELECT * FROM job",
        "compaction_job_line": "SELECT 1 AS job_id, format('job 1: {} -> {} keys, {} -> {} bytes, dropped {:.0f}%, markers kept {}, dropped {}', keys_in, keys_out, bytes_in, bytes_out, drop_pct, tombstones_kept, tombstones_dropped) AS line FROM job",
        "amplification": "SELECT round(CAST(bytes_out AS DOUBLE) / bytes_in, 6) AS write_ratio, (SELECT round(CAST(sum(consulted) AS DOUBLE) / count(*), 6) FROM trace) AS runs_per_read FROM job",
        "compaction_manual": """
            SELECT c AS "case", n, n_live, coalesce(n_live = n AND span = n, false) AS adjacent, coalesce(n_live = n AND span = n, false) AND n >= 2 AS valid
            FROM (SELECT c, count(*) AS n, count(pos) AS n_live, max(pos) - min(pos) + 1 AS span
                FROM (VALUES ('adjacent', 4), ('adjacent', 3), ('adjacent', 2), ('gap', 5), ('gap', 3), ('unknown', 99), ('unknown', 1), ('single', 1), ('unordered', 7), ('unordered', 9), ('unordered', 8)) a(c, id)
                LEFT JOIN (SELECT id, row_number() OVER (ORDER BY max_seqno DESC) AS pos FROM manifest) m ON m.id = a.id GROUP BY c)
        """,
        "manifest_after_compaction": "SELECT id, entries, file_size, min_seqno, max_seqno FROM manifest WHERE NOT list_contains((SELECT ids FROM picked), id) UNION ALL SELECT id, entries, file_size, min_seqno, max_seqno FROM output WHERE entries > 0",
        "version_diff": "SELECT unnest(ids) AS id, 'removed' AS change FROM picked UNION ALL SELECT 11, 'added'",
        "orphan_files": "SELECT file_name FROM files WHERE file_name LIKE '%.sst' AND file_name NOT IN (SELECT file_name FROM manifest)",
        "missing_files": "SELECT file_name FROM manifest WHERE file_name NOT IN (SELECT file_name FROM files)",
        "wal_segment_list": "SELECT DISTINCT segment, lpad(CAST(segment AS VARCHAR), 6, '0') || '.wal' AS file_name FROM seg",
        "wal_recovery_report": "SELECT * FROM (SELECT count(DISTINCT segment) AS segments FROM seg), (SELECT count(*) AS truncated, max(segment) AS truncated_segment, arg_max(bad_at, segment) AS truncated_to FROM bad), (SELECT count(*) AS records, count(*) FILTER (WHERE NOT tombstone) AS puts, count(*) FILTER (WHERE tombstone) AS deletes, max(seqno) AS last_seqno FROM good)",
        "wal_valid_prefix": "SELECT segment, count(*) AS records, max(seqno) AS last_seqno FROM good GROUP BY segment",
        "wal_segment_roll": "SELECT CAST(segment AS BIGINT) AS segment, first_seqno, last_seqno, last_seqno - first_seqno + 1 AS records, CAST(8 + (SELECT sum(size) FROM rolling WHERE seqno BETWEEN first_seqno AND last_seqno) AS BIGINT) AS bytes FROM rolled",
        "memtable_rotation": "SELECT CAST(memtable AS BIGINT) AS memtable, first_seqno, last_seqno, last_seqno - first_seqno + 1 AS entries, CAST((SELECT sum(size) FROM filling WHERE seqno BETWEEN first_seqno AND last_seqno) AS BIGINT) AS bytes FROM rotated",
        "wal_cleanup": "SELECT segment, max(seqno) AS max_seqno FROM seg GROUP BY segment HAVING max(seqno) <= (SELECT max(seqno) FROM seg WHERE segment = 7) AND segment <> (SELECT max(segment) FROM seg)",
        "wal_seqno_monotonic": "SELECT count(*) FILTER (WHERE before >= seqno) AS violations FROM (SELECT seqno, lag(seqno) OVER (ORDER BY segment, \"offset\") AS before FROM seg)",
        "run_ranges_disjoint": "SELECT id, next_id FROM (SELECT id, min_seqno, lead(max_seqno) OVER w AS m, lead(id) OVER w AS next_id FROM manifest WINDOW w AS (ORDER BY max_seqno DESC)) WHERE m >= min_seqno",
        "seqno_source_run": "SELECT key, seqno, id AS source_run FROM latest JOIN manifest ON seqno BETWEEN min_seqno AND max_seqno",
        "engine_stats": "SELECT epoch, version_id, last_seqno, active_bytes, active_entries, none AS immutables, none AS immutables_bytes, sst_live, sst_total_bytes, block_cache_hit_rate, disk_block_reads, blooms_checked, blooms_negative, compaction_backlog_bytes, none AS jobs_running, wal_segments, wal_active_segment_bytes FROM stat",
        "prometheus_export": """
            SELECT r[1] AS name, r[2] AS kind, r[3] AS value FROM (SELECT unnest([('lsm_writes_total', 'counter', CAST(writes AS BIGINT)), ('lsm_wal_appends_total', 'counter', CAST(writes AS BIGINT)), ('lsm_wal_active_segment_bytes', 'gauge', CAST(wal_active_segment_bytes AS BIGINT)), ('lsm_wal_segments_total', 'gauge', CAST(wal_segments AS BIGINT)), ('lsm_memtable_active_bytes', 'gauge', CAST(active_bytes AS BIGINT)), ('lsm_memtable_active_entries', 'gauge', CAST(active_entries AS BIGINT)), ('lsm_memtables_immutable', 'gauge', CAST(none AS BIGINT)), ('lsm_flush_jobs_total', 'counter', CAST(sst_live AS BIGINT)), ('lsm_sst_created_total', 'counter', CAST(sst_live AS BIGINT)), ('lsm_sst_bytes_written_total', 'counter', CAST(sst_total_bytes AS BIGINT)), ('lsm_reads_total', 'counter', CAST(reads AS BIGINT)), ('lsm_read_hit_memtable_total', 'counter', CAST(none AS BIGINT)), ('lsm_read_sstable_consulted_total', 'counter', CAST(runs_consulted AS BIGINT)), ('lsm_bloom_checks_total', 'counter', CAST(blooms_checked AS BIGINT)), ('lsm_bloom_negative_total', 'counter', CAST(blooms_negative AS BIGINT)), ('lsm_block_cache_hits_total', 'counter', CAST(disk_block_reads AS BIGINT)), ('lsm_block_cache_misses_total', 'counter', CAST(disk_block_reads AS BIGINT)), ('lsm_disk_block_reads_total', 'counter', CAST(disk_block_reads AS BIGINT)), ('lsm_compaction_jobs_total', 'counter', CAST(none AS BIGINT)), ('lsm_compaction_bytes_in_total', 'counter', CAST(none AS BIGINT)), ('lsm_compaction_bytes_out_total', 'counter', CAST(none AS BIGINT)), ('lsm_compaction_backlog_bytes', 'gauge', CAST(compaction_backlog_bytes AS BIGINT)), ('lsm_versions_published_total', 'counter', CAST(sst_live AS BIGINT)), ('lsm_epoch_current', 'gauge', CAST(epoch AS BIGINT)), ('lsm_sst_live_total', 'gauge', CAST(sst_live AS BIGINT)), ('lsm_write_stalls_total', 'counter', CAST(none AS BIGINT))]) AS r FROM stat)
            UNION ALL SELECT 'lsm_errors_total{type="' || t || '"}', 'counter', coalesce(n, 0) FROM (SELECT unnest(['InvalidArgument', 'StoreClosed', 'IOFailure', 'CorruptionDetected', 'NotImplemented', 'Backpressure']) AS t)
            LEFT JOIN (SELECT ['InvalidArgument', 'IOFailure', 'Backpressure'][user_id % 3 + 1] AS t, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) USING (t)
        """,
        "bloom_negative_ratio": "SELECT run_id, count(*) AS checked, count(*) FILTER (WHERE NOT may) AS negative FROM passed WHERE absent GROUP BY run_id",
    }.items()
}

SQL["lineitem_latest"] = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
            l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem
    ) WHERE rn = 1
"""
SQL["write_stall_state"] = """
    SELECT tables, immutables, CASE WHEN tables > 20 THEN 'refused' WHEN immutables >= 4 THEN 'blocked' ELSE 'accepted' END AS state
    FROM range(0, 25, 3) a(tables), range(0, 6) b(immutables)
"""
SQL["error_counts"] = """
    SELECT t AS type, coalesce(n, 0) AS n FROM (SELECT unnest(['InvalidArgument', 'StoreClosed', 'IOFailure', 'CorruptionDetected', 'NotImplemented', 'Backpressure']) AS t)
    LEFT JOIN (SELECT ['InvalidArgument', 'IOFailure', 'Backpressure'][user_id % 3 + 1] AS t, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) USING (t)
"""

"""The SQL of store_queries: what the log must hold, stated from the tables."""

from __future__ import annotations

from .oracle import _CHANGES, _LOG, _MUTATIONS

_PARTS = """
parted as (select *, cast((xid - 1000) * 3 // ((select max(event_id) // 7 from events) + 1) as bigint) + 1 as segment_id from log),
segs as (
  select segment_id, count(*) as event_count, count(distinct end_lsn) as marker_count, cast(sum(payload_bytes) as bigint) as stored_bytes, min(sequence) as first_sequence, max(sequence) as last_sequence
  from parted group by segment_id
), people as (select *, row_number() over (order by sequence) as r from log where table_name = 'users')"""
_W = f"with {_CHANGES}, {_LOG}, {_PARTS} "
_JSON = "'{{\"id\":\"' || user_id || '\",\"k\":' || {k} || ',\"status\":\"' || {status} || '\"}}'"
_AFTER = _JSON.format(k="coalesce('\"' || json_extract_string(props, '$.k') || '\"', 'null')", status="event_type")
_BEFORE = _JSON.format(k="'null'", status="'old'")


def oracle_sql() -> dict[str, str]:
    gone = "gone as (select * from (select *, sum(event_count) over () - coalesce(sum(event_count) over (order by segment_id rows between unbounded preceding and 1 preceding), 0) as left_ from segs) where left_ > 2500)"
    high = "(select max(sequence) from log)"
    upto = lambda k: f"(select max(sequence) from parted where segment_id <= {k})"
    return {
        "decoded_frames": f"""with {_CHANGES}, times as (select end_lsn, min(commit_timestamp_ms) as ms from changes group by end_lsn)
            select c.xid, c.lsn as wal_start, '0/' || to_hex(end_lsn_num - 8) as commit_lsn, c.end_lsn, schema_name, table_name, operation, cast(null as varchar) as key,
                   case when operation <> 'insert' then {_BEFORE} end as before, case when operation <> 'delete' then {_AFTER} end as after, ms as commit_timestamp_ms
            from changes c join events e on e.event_id = c.wal_pos join times t on t.end_lsn = c.end_lsn where table_name in ('orders', 'users')""",
        "decoded_empty_transactions": f"with {_CHANGES} select xid, end_lsn from changes group by xid, end_lsn having count(*) filter (table_name <> 'clicks') = 0",
        "log_stream_view": _W + "select sequence, event_id, schema_name, table_name, operation from log where table_name = 'users'",
        "log_roundtrip": f"""with {_CHANGES}, {_LOG}, {_PARTS}
            select sequence, p.event_id, segment_id, lsn, xid as transaction_id, end_lsn,
                   cast(coalesce(case when operation <> 'insert' then strlen({_BEFORE}) end, 0) + coalesce(case when operation <> 'delete' then strlen({_AFTER}) end, 0) as bigint) as payload_bytes
            from parted p join events e on e.event_id = p.wal_pos""",
        "log_catalog": f"""with {_CHANGES}, {_LOG}, {_PARTS}, sized as (
              select segment_id, cast(sum(coalesce(case when operation <> 'insert' then strlen({_BEFORE}) end, 0) + coalesce(case when operation <> 'delete' then strlen({_AFTER}) end, 0)) as bigint) as stored_bytes
              from parted p join events e on e.event_id = p.wal_pos group by segment_id)
            select segs.segment_id, true as sealed, event_count, marker_count, sized.stored_bytes, first_sequence, last_sequence from segs join sized on sized.segment_id = segs.segment_id""",
        "log_markers": _W + "select distinct 'tx-v1:7:primary:' || end_lsn as marker, segment_id from parted",
        "log_verified": _W + f"select (select count(*) from log) as events, (select count(distinct end_lsn) from log) as markers, 4 as segments, 3 as sealed_segments, {high} as high_watermark",
        "log_replay_decisions": _W + f"""select * from (values (0, 'first part', 'persisted', {upto(1)}), (1, 'first part again', 'already_persisted', {upto(1)}), (2, 'second part', 'persisted', {upto(2)}),
            (3, 'second and third part', 'partially_persisted', {upto(2)}), (4, 'third part', 'persisted', {high}), (5, 'all parts', 'already_persisted', {high}), (6, 'no events', 'persisted', {high})) v(step, name, outcome, high_watermark)""",
        "log_retention": f"""with {_CHANGES}, {_LOG}, {_PARTS}, {gone},
            sized as (select segment_id, cast(sum(coalesce(case when operation <> 'insert' then strlen({_BEFORE}) end, 0) + coalesce(case when operation <> 'delete' then strlen({_AFTER}) end, 0)) as bigint) as b from parted p join events e on e.event_id = p.wal_pos group by segment_id),
            kept_ as (select min(first_sequence) as f from segs where segment_id not in (select segment_id from gone))
            select (select count(*) from gone) as deleted_segments, (select coalesce(cast(sum(event_count) as bigint), 0) from gone) as deleted_events, (select coalesce(cast(sum(b) as bigint), 0) from sized where segment_id in (select segment_id from gone)) as deleted_bytes,
                   coalesce((select f from kept_), {high} + 1) as first_retained, {high} as high_watermark, case when (select count(*) from gone) > 0 then coalesce((select f from kept_), {high} + 1) else 0 end as floor,
                   (select count(*) from log) - (select coalesce(cast(sum(event_count) as bigint), 0) from gone) as events_left""",
        "log_backup_restore": _W + "select sequence, event_id, segment_id from parted",
        "log_migrated": _W + "select sequence, event_id, segment_id, 2 as format_version from parted",
        "log_append_event": "select * from (values (0, 1, 'appended'), (1, 2, 'appended'), (2, 2, 'duplicate')) v(step, sequence, outcome)",
        "log_offsets": f"with {_CHANGES} select 'primary' as source_name, arg_max(end_lsn, end_lsn_num) as durable_lsn from changes",
        "captured_stream": _W + "select sequence, event_id, segment_id from parted",
        "consumer_deliveries": _W + "select sequence, event_id, operation from people where r <= 300",
        "consumer_offsets_walk": _W + f"""select * from (values (0, 'earliest', 0), (1, 'acknowledged', (select sequence from people where r = 30)), (2, 'acknowledged an older one', (select sequence from people where r = 30)),
            (3, 'resumed', (select sequence from people where r = 31)), (4, 'latest', {high}), (5, 'sequence', 4), (6, 'back', 0), (7, 'earliest of an empty log', {high})) v(step, name, "offset")""",
        "sink_cache_state": f"with {_CHANGES}, {_LOG}, {_MUTATIONS}, last as (select key, arg_max({{kind: kind, value: value, ttl_seconds: ttl_seconds, wal_pos: wal_pos}}, (sequence, rule_index, pos)) as m from (select mut.*, wal_pos from mut join log on log.sequence = mut.sequence) group by key)"
        + f" select key, {_AFTER} as value, m.ttl_seconds as ttl_seconds from last join events e on e.event_id = last.m.wal_pos where m.kind = 'set'",
        "benchmark_summary": """select n_name as name, n_nationkey * 100 as generated, greatest(n_nationkey * 100 - n_nationkey % 3, n_nationkey * 100 - n_nationkey % 2) as captured, n_nationkey * 100 - n_nationkey % 2 as consumed,
            n_nationkey % 2 = 0 as converged, n_nationkey % 4 as seconds,
            case when n_nationkey % 4 = 0 then 0.0 else greatest(n_nationkey * 100 - n_nationkey % 3, n_nationkey * 100 - n_nationkey % 2) / cast(n_nationkey % 4 as double) end as events_per_second, 0 as stored_bytes from nation""",
        "benchmark_artefacts": """select 'environment ' || n_name as name, n_nationkey || '=x' as value from nation union all select 'p99', cast(max(n_nationkey) as varchar) from nation
            union all select 'wal', cast(max(n_nationkey * 7) filter (n_nationkey % 5 <> 4) as varchar) from nation""",
        "connection_quoting": r"""select n_nationkey, '''' || replace(replace(n_name || '''s \ ' || n_name, '\', '\\'), '''', '\''') || '''' as quoted from nation""",
        "consumer_names": """select n_nationkey, case when n_nationkey % 5 < 2 or (n_nationkey % 5 = 2 and length(n_name) * 22 > 128) then 'invalid_argument' when n_nationkey % 4 = 3 then 'not_found'
            else 'people/' || case when n_nationkey % 5 = 2 then repeat(n_name, 22) else n_name end end as verdict from nation""",
        "principal_permissions": """select n_nationkey, case when n_nationkey % 4 = 3 then 'unauthenticated' when n_nationkey % 4 = 2 then 'permission_denied' when n_nationkey % 4 = 0 then 'allowed'
            when n_nationkey % 2 = 0 or n_nationkey % 3 = 0 then case when n_nationkey % 5 = 0 then 'permission_denied' else 'allowed' end else 'permission_denied' end as verdict from nation""",
    }

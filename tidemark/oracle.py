"""The SQL that another engine answers the registered queries with: plain statements of what each means."""

from __future__ import annotations

_CHANGES = """
changes as (
  select event_id as wal_pos,
    to_hex(event_id // 16777216) || '/' || to_hex((event_id * 256) % 4294967296) as lsn,
    '0/' || to_hex((event_id // 7 + 1) * 1792 - 128) as end_lsn, (event_id // 7 + 1) * 1792 - 128 as end_lsn_num,
    1000 + event_id // 7 as xid, 'public' as schema_name,
    case when event_type in ('click', 'view') then 'clicks' when event_type = 'purchase' then 'orders' else 'users' end as table_name,
    case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as operation,
    '{"id":"' || user_id || '"}' as key_json,
    case when event_type <> 'signup' then '{"id":"' || user_id || '","status":"old"}' end as before_json,
    case when event_type <> 'error' then '{"id":"' || user_id || '","k":"' || json_extract_string(props, '$.k') || '","status":"' || event_type || '"}' end as after_json,
    epoch_us(ts) // 1000 as commit_timestamp_ms
  from events
)"""
_ID = "'postgres:shop:main:' || xid || ':' || lsn || ':' || ordinal"
_LOG = f"""
kept as (
  select *, strlen(key_json) + coalesce(strlen(before_json), 0) + coalesce(strlen(after_json), 0) as payload_bytes from changes where table_name in ('orders', 'users')
), numbered as (
  select *, {_ID} as event_id from (select *, row_number() over (partition by end_lsn_num order by wal_pos) as ordinal from kept)
), log as (select *, row_number() over (order by wal_pos) as sequence from numbered),
tx as (
  select end_lsn, end_lsn_num, count(*) as event_count, cast(sum(payload_bytes) as bigint) as decoded_bytes, row_number() over (order by end_lsn_num) as r from kept group by end_lsn, end_lsn_num
), segev as (select *, (sequence - 1) // 500 + 1 as segment_id from log),
catalog as (
  select segment_id, count(*) as event_count, cast(sum(payload_bytes) as bigint) as stored_bytes, min(sequence) as first_sequence, max(sequence) as last_sequence,
         max(sequence) as high_watermark, min(commit_timestamp_ms) as first_timestamp_ms, max(commit_timestamp_ms) as last_timestamp_ms from segev group by segment_id
), markers as (select 'tx-v1:7:primary:' || end_lsn as marker from tx where (end_lsn_num // 1792) % 3 = 0),
base as (select sequence, 'c' || (cast(json_extract_string(key_json, '$.id') as bigint) % 3) as consumer, commit_timestamp_ms from log),
deliveries as (
  select consumer, sequence, sequence * 10 as delivered_at, commit_timestamp_ms from base
  union all select consumer, sequence, sequence * 10 + 35, commit_timestamp_ms from base where sequence % 9 = 0
), acks as (select consumer, max(sequence) as sequence from deliveries where sequence % 5 <> 0 group by consumer)"""
_BATCHES = """
fold as (
  select r, end_lsn_num, event_count as ec, decoded_bytes as db, 1 as batch_id, 1 as n, event_count as e, decoded_bytes as b from tx where r = 1
  union all
  select t.r, t.end_lsn_num, t.event_count, t.decoded_bytes, f.batch_id + cast(f.full or f.n + 1 > 10 or f.e + t.event_count > 40 or f.b + t.decoded_bytes > 4000 as integer),
         case when f.full or f.n + 1 > 10 or f.e + t.event_count > 40 or f.b + t.decoded_bytes > 4000 then 1 else f.n + 1 end,
         case when f.full or f.n + 1 > 10 or f.e + t.event_count > 40 or f.b + t.decoded_bytes > 4000 then t.event_count else f.e + t.event_count end,
         case when f.full or f.n + 1 > 10 or f.e + t.event_count > 40 or f.b + t.decoded_bytes > 4000 then t.decoded_bytes else f.b + t.decoded_bytes end
  from (select *, n >= 10 or e >= 40 or b >= 4000 as full from fold) f join tx t on t.r = f.r + 1
), totals as (select batch_id, count(*) as transactions, cast(sum(ec) as bigint) as events, cast(sum(db) as bigint) as bytes from fold group by batch_id)"""
_SEGMENTS = """
seg as (
  select batch_id, events, bytes, 1 as segment_id, events as e, bytes as b from totals where batch_id = 1
  union all
  select t.batch_id, t.events, t.bytes, s.segment_id + cast(s.full or s.e + t.events > 500 or s.b + t.bytes > 60000 as integer),
         case when s.full or s.e + t.events > 500 or s.b + t.bytes > 60000 then t.events else s.e + t.events end,
         case when s.full or s.e + t.events > 500 or s.b + t.bytes > 60000 then t.bytes else s.b + t.bytes end
  from (select *, e >= 500 or b >= 60000 as full from seg) s join totals t on t.batch_id = s.batch_id + 1
)"""


def _fold(rows: str, first: str, limits: list[tuple[str, str, int]], age: int, out: str) -> str:
    """A recursive walk over rows (k from 1, time, ...): groups end before a limit is passed, when one is reached, and when they are old."""
    sums = [f"s{i}" for i in range(len(limits))]
    stop = "f.done or " + " or ".join(f"f.{s} + {value} > {limit}" for s, (_, value, limit) in zip(sums, limits)) + f" or t.time - f.began >= {age}"
    done = lambda at: " or ".join(f"{s} >= {limit}" for s, (_, _, limit) in zip(sums, limits))
    start = ", ".join(f"{value} as {s}" for s, (_, value, _) in zip(sums, limits)).replace("t.", "")
    step = ", ".join(f"case when {stop} then {value} else f.{s} + {value} end as {s}" for s, (_, value, _) in zip(sums, limits))
    return f"""
{out} as (
  select k, 1 as g, time as began, {start} from {rows} where k = 1
  union all
  select t.k, f.g + cast({stop} as integer), case when {stop} then t.time else f.began end, {step}
  from (select *, {done("f")} as done from {out}) f join {rows} t on t.k = f.k + 1
)"""


_TIMED = f"""
timed as (
  select end_lsn_num, count(*) as events, cast(sum(payload_bytes) as bigint) as bytes, min(commit_timestamp_ms) as time, row_number() over (order by end_lsn_num) as k from kept group by end_lsn_num
), {_fold("timed", "", [("n", "1", 10), ("e", "t.events", 40), ("b", "t.bytes", 4000)], 3 * 3_600_000, "late")}, parts as (
  select g as k, cast(sum(t.events) as bigint) as events, cast(sum(t.bytes) as bigint) as bytes, max(t.time) as time from late join timed t on t.k = late.k group by g
), {_fold("parts", "", [("e", "t.events", 500), ("b", "t.bytes", 60000)], 36 * 3_600_000, "old")}"""
#: Mutations by rule, spelt out for the two rules of the queries.
_MUTATIONS = """
mut as (
  select sequence, 0 as rule_index, 0 as pos, 'del' as kind, 'user:' || json_extract_string(key_json, '$.id') as key, cast(null as varchar) as value, cast(null as bigint) as ttl_seconds
  from log where table_name = 'users' and operation = 'delete'
  union all
  select sequence, 0, 0, 'set', 'user:' || json_extract_string(after_json, '$.id'), after_json, 60 from log where table_name = 'users' and operation <> 'delete'
  union all
  select sequence, 1, 0, 'del', 'order:' || json_extract_string(before_json, '$.id') || ':' || json_extract_string(before_json, '$.status'), null, null from log where table_name = 'orders'
  union all
  select sequence, 1, 1, 'del', 'order:' || json_extract_string(after_json, '$.id') || ':' || json_extract_string(after_json, '$.status'), null, null from log where table_name = 'orders'
)"""
_NATION = """
tables as (
  select case when n_regionkey < 3 then 'public' else 'audit' end as schema_name, lower(n_name) as table_name, case when n_nationkey % 7 = 0 then 'p' else 'r' end as relkind,
         n_nationkey % 6 = 0 as is_partition, case when n_nationkey % 3 = 0 then 'f' else 'd' end as identity, n_nationkey % 4 <> 1 as has_usable_identity, n_nationkey % 8 = 3 as has_generated
  from nation
), published as (
  select case when n_regionkey < 3 then 'public' else 'audit' end as schema_name, lower(n_name) as table_name, n_nationkey % 9 = 1 as has_row_filter, n_nationkey % 11 = 2 as has_column_filter
  from nation where n_nationkey % 5 <> 0
), required as (
  select schema_name, table_name from tables where schema_name = 'public' or (schema_name = 'audit' and table_name in ('china', 'nowhere'))
  union select 'audit', 'china' union select 'audit', 'nowhere'
)"""
_LINE = """'{"sequence":' || sequence || ',"event_id":"' || event_id || '","schema":"public","table":"' || table_name || '","operation":"' || operation || '","key":' || key_json
            || ',"before":' || coalesce(before_json, 'null') || ',"after":' || coalesce(after_json, 'null') || ',"commit_timestamp_ms":' || commit_timestamp_ms || '}'"""
_VIEW = "sequence, event_id, schema_name, table_name, operation"
_L, _B, _S, _M = f"with {_CHANGES}, {_LOG} ", f"with recursive {_CHANGES}, {_LOG}, {_BATCHES} ", f"with recursive {_CHANGES}, {_LOG}, {_BATCHES}, {_SEGMENTS} ", f"with {_CHANGES}, {_LOG}, {_MUTATIONS} "
_C, _N = f"with {_CHANGES} ", f"with {_NATION} "
_SQLSTATE = "['08006', '53300', '55006', '57P01', '57P04', '42601', '57P03'][s_suppkey % 7 + 1]"
_BOUNDS = ("0.001", "0.0025", "0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10", "+Inf")
_AGED = "aged as (select * replace (case when segment_id <> 4 then last_timestamp_ms end as last_timestamp_ms) from catalog)"


def _candidates(condition: str, source: str = "catalog", more: str = "true") -> str:
    return f"""
cand as (
  select * from (
    select *, min(cast(c as integer)) over (order by segment_id rows unbounded preceding) as prefix from (
      select *, coalesce({condition}, false) and segment_id < max(segment_id) over () as c from (
        select *, coalesce(sum(event_count) over p, 0) as before_e, coalesce(sum(stored_bytes) over p, 0) as before_b, sum(event_count) over () as all_e, sum(stored_bytes) over () as all_b
        from {source} window p as (order by segment_id rows between unbounded preceding and 1 preceding)))
  ) where prefix = 1 and {more})"""


def oracle_sql() -> dict[str, str]:
    damaged = "(select * from segev where sequence not in (3, 501, 1500))"
    return {
        "change_log_projection": _C + f"select {_ID} as event_id, wal_pos, end_lsn, schema_name, table_name, operation, key_json, before_json, after_json, commit_timestamp_ms from (select *, row_number() over (partition by end_lsn_num order by wal_pos) as ordinal from changes)",
        "capture_plan_filter": _L + "select wal_pos, schema_name, table_name, operation from kept",
        "event_ordinal": _L + "select wal_pos, end_lsn, ordinal, event_id from numbered",
        "global_sequence": _L + "select sequence, event_id, wal_pos from log",
        "stream_view_exact": _L + f"select {_VIEW} from log where schema_name = 'public' and table_name = 'users'",
        "stream_view_schema_wildcard": _L + f"select {_VIEW} from log where schema_name = 'public'",
        "replay_range": _L + f"select {_VIEW} from log where sequence >= 500 order by sequence limit 256",
        "replay_count_byte_bounded": _L + "select sequence, event_id, payload_bytes from (select *, row_number() over (order by sequence) as n, sum(payload_bytes) over (order by sequence rows unbounded preceding) as b from log where sequence >= 500) where n <= 256 and (n = 1 or b <= 20000)",
        "replay_one_event_at_least": _L + "select sequence, event_id, payload_bytes from log where sequence = 500",
        "stream_replay_emitted_limit": _L + f"select {_VIEW} from log where sequence >= 100 and table_name = 'users' order by sequence limit 50",
        "recent_events": _L + f"select {_VIEW} from log order by sequence desc limit 20",
        "point_lookup": _L + f"select {_VIEW} from log where sequence = 77",
        "bounded_run_prefix": _L + "select wal_pos, end_lsn from kept where end_lsn_num in (select end_lsn_num from (select *, coalesce(sum(event_count) over (order by end_lsn_num rows between unbounded preceding and 1 preceding), 0) as b from tx) where b < 101)",
        "log_sequence_bounds": _L + "select min(sequence) as first_sequence, max(sequence) as last_sequence, coalesce(max(sequence), 0) + 1 as next_sequence from log",
        "lsn_parse_compare": _C + "select wal_pos, end_lsn, end_lsn_num as lsn_number, end_lsn as lsn_text, end_lsn_num <= 65536 as is_durable, true as bad_is_null from changes",
        "source_clock": _C + "select wal_pos, 946684800000 + case when u < 0 then -((-u) // 1000) else u // 1000 end as unix_ms from (select wal_pos, (commit_timestamp_ms - 946684800000) * 1000 + wal_pos % 1000 - 800000000000000 as u from changes)",
        "transaction_stats": _L + "select end_lsn, event_count, decoded_bytes + 200 * event_count as decoded_bytes, decoded_bytes + 200 * event_count > 1200 as is_staged from tx",
        "transaction_limit_violations": _L + "select end_lsn, event_count, decoded_bytes, case when event_count > 6 then 'event_limit' else 'byte_limit' end as violation from tx where event_count > 6 or decoded_bytes > 450",
        "replay_marker_antijoin": _L + "select wal_pos, event_id, 'tx-v1:7:primary:' || end_lsn as marker from numbered where 'tx-v1:7:primary:' || end_lsn not in (select marker from markers)",
        "duplicate_transaction_counts": _L + """
            select count(*) as transactions, cast(sum(n) as bigint) as events, count(*) filter (whole) as duplicate_transactions, cast(sum(case when whole then n else e end) as bigint) as duplicate_events
            from (select *, m or e = n as whole from (
              select end_lsn, count(*) as n, count(*) filter (wal_pos % 10 < 4) as e, bool_or('tx-v1:7:primary:' || end_lsn in (select marker from markers)) as m from numbered group by end_lsn))""",
        "event_id_exists": _L + "select event_id, wal_pos from numbered n where exists (select 1 from numbered m where m.event_id = n.event_id and m.wal_pos % 17 = 0)",
        "group_commit_batches": _B + "select end_lsn_num, cast(batch_id as bigint) as batch_id from fold",
        "group_commit_batches_delayed": f"with recursive {_CHANGES}, {_LOG}, {_TIMED} select t.end_lsn_num, cast(g as bigint) as batch_id from late join timed t on t.k = late.k",
        "segment_assignment_aged": f"with recursive {_CHANGES}, {_LOG}, {_TIMED} select t.k as batch_id, t.events, t.bytes, cast(g as bigint) as segment_id from old join parts t on t.k = old.k",
        "batch_totals": _B + "select cast(batch_id as bigint) as batch_id, transactions, events, bytes from totals",
        "segment_assignment": _S + "select cast(batch_id as bigint) as batch_id, events, bytes, cast(segment_id as bigint) as segment_id from seg",
        "segment_statistics": _L + "select * from catalog",
        "store_stats": _L + "select cast(sum(event_count) as bigint) as event_count, count(*) as segments, count(*) - 1 as sealed_segments, (select count(*) from tx) as replay_ids, 1 as source_offsets, (select count(*) from acks) as consumer_offsets from catalog",
        "retention_candidates_count": _L + "," + _candidates("all_e - before_e > 1200") + " select segment_id, event_count, last_sequence from cand",
        "retention_candidates_bytes": _L + "," + _candidates("all_b - before_b > 100000", more="before_e < 900") + " select segment_id, stored_bytes from cand",
        "retention_candidates_age": _L + f", {_AGED}," + _candidates("last_timestamp_ms <= (select max(last_timestamp_ms) from aged) - 1000", "aged") + " select segment_id, last_timestamp_ms from cand",
        "retention_outcome": _L + "," + _candidates("all_e - before_e > 1200") + """
            select (select count(*) from cand) as deleted_segments, (select cast(coalesce(sum(event_count), 0) as bigint) from cand) as deleted_events, (select cast(coalesce(sum(stored_bytes), 0) as bigint) from cand) as deleted_bytes,
                   (select min(first_sequence) from catalog where segment_id not in (select segment_id from cand)) as first_retained, max(high_watermark) as high_watermark from catalog""",
        "integrity_violations": _L + f""", real as (select segment_id, count(*) as n, cast(sum(payload_bytes) as bigint) as b, min(sequence) as lo, max(sequence) as hi from {damaged} group by segment_id),
            both_ as (select c.*, n, b, lo, hi from catalog c left join real r on r.segment_id = c.segment_id)
            select segment_id, 'event count' as violation from both_ where n is distinct from event_count union all select segment_id, 'stored bytes' from both_ where b is distinct from stored_bytes
            union all select segment_id, 'first sequence' from both_ where lo is distinct from first_sequence union all select segment_id, 'last sequence' from both_ where hi is distinct from last_sequence
            union all select segment_id, 'not contiguous' from both_ where hi - lo + 1 <> n
            union all select segment_id, 'gap between segments' from (select segment_id, lo, lag(hi) over (order by segment_id) as p from real) where lo <> p + 1""",
        "catalog_violations": _L + """, c as (select segment_id, segment_id % 5 <> 0 as sealed, case when segment_id % 4 = 0 then first_sequence - 2 else first_sequence end as first_sequence, last_sequence from catalog),
            d as (select * from c union all select * from c where segment_id = 2),
            e as (select *, lag(last_sequence) over (order by segment_id, first_sequence) as p, count(*) over (partition by segment_id) as n, max(segment_id) over () as newest from d)
            select segment_id, 'duplicate id' as violation from e where n > 1 union select segment_id, 'overlap' from e where first_sequence <= p union select segment_id, 'unsealed before the last' from e where not sealed and segment_id < newest""",
        "source_offsets": _L + "select 'primary' as source_name, arg_max(end_lsn, end_lsn_num) as durable_lsn from tx",
        "ack_monotone_offsets": _L + "select consumer, sequence from acks",
        "consumer_lag": _L + "select consumer, sequence, (select max(sequence) from log) - sequence as lag from (select consumer, max(sequence) as sequence from deliveries where sequence % 5 <> 0 and sequence % 7 <> 0 group by consumer)",
        "wal_lag": _L + "select w as wal_end, d as durable, greatest(w - d, 0) as lag, greatest(d - w, 0) as floor from (select max(end_lsn_num) as w, max(end_lsn_num) filter (end_lsn_num % 3 = 0) as d from tx)",
        "cache_invalidate_keys": _M + "select sequence, pos, kind, key from mut where rule_index = 1",
        "cache_upsert_mutations": _M + "select * replace (coalesce(ttl_seconds, 0) as ttl_seconds) from mut",
        "cache_final_state": _M + "select key, m.value as value, m.ttl_seconds as ttl_seconds, m.sequence as sequence from (select key, arg_max({kind: kind, value: value, ttl_seconds: ttl_seconds, sequence: sequence}, (sequence, rule_index, pos)) as m from mut group by key) where m.kind = 'set'",
        "cache_mapping_errors": _L + "select sequence, cast(table_name = 'orders' as integer) as rule_index, case when sequence % 50 = 0 then 'truncate' else 'image is no object' end as error from log where sequence % 50 = 0 or sequence % 7 = 0",
        "event_rule_join": _L + "select cast(table_name = 'orders' as integer) as rule_index, case when table_name = 'orders' then 'invalidate' else 'upsert' end as mode, operation, count(*) as events from log group by all",
        "stream_event_join": _C + "select stream, count(*) as events from changes, (values ('people', 'users'), ('both', 'users'), ('both', 'orders'), ('all', 'users'), ('all', 'orders'), ('all', 'clicks')) s(stream, t) where t = table_name group by stream",
        "toast_incomplete_events": _L + "select sequence, event_id from log where sequence % 11 = 0",
        "key_template_render": _L + "select sequence, 'tenant:' || json_extract_string(after_json, '$.status') || ':row:' || json_extract_string(after_json, '$.id') as cache_key, cast(null as varchar) as no_key from log",
        "tuple_json_render": "select c_custkey, '{\"blob\":{\"__binary_hex\":\"' || lower(hex(c_name)) || '\"},\"id\":\"' || c_custkey || '\",\"note\":null,\"old\":{\"__unchanged_toast\":true}}' as image from customer",
        "required_tables": _N + "select * from required",
        "required_tables_missing": _N + "select * from required except select schema_name, table_name from published",
        "restricted_tables": _N + "select * from required intersect select schema_name, table_name from published where has_row_filter or has_column_filter",
        "publication_unnecessary_tables": _N + "select schema_name, table_name from published where schema_name <> 'public' and table_name not in ('china', 'nowhere')",
        "publication_join": _N + "select t.schema_name, t.table_name, t.identity, coalesce(p.has_row_filter, false) as has_row_filter, coalesce(p.has_column_filter, false) as has_column_filter from tables t left join published p on p.schema_name = t.schema_name and p.table_name = t.table_name",
        "replica_identity_exists": _N + "select schema_name, table_name from tables t where (has_usable_identity or identity = 'f') and not exists (select 1 from tables u where u.schema_name = t.schema_name and u.table_name = t.table_name and u.has_generated)",
        "source_validation": _N + """, mine as (select t.* from tables t join required r on r.schema_name = t.schema_name and r.table_name = t.table_name)
            select * from (values ('source', 'wal_level is not logical'), ('source', 'role may not replicate'), ('source', 'slot is two-phase')) v(subject, violation)
            union all select schema_name || '.' || table_name, 'not published' from (select * from required except select schema_name, table_name from published)
            union all select schema_name || '.' || table_name, 'published with a filter' from (select * from required intersect select schema_name, table_name from published where has_row_filter or has_column_filter)
            union all select schema_name || '.' || table_name, 'partition is published through its root' from mine where is_partition
            union all select schema_name || '.' || table_name, 'no usable replica identity' from mine where not has_usable_identity
            union all select schema_name || '.' || table_name, 'generated columns' from mine where has_generated""",
        "resume_gap": _L + "select end_lsn as local_lsn, '0/' || to_hex(c) as confirmed_lsn from (select end_lsn, end_lsn_num, end_lsn_num + (end_lsn_num % 5 - 2) * 1792 as c from tx) where c > end_lsn_num",
        "commit_latency_histogram": _C + " union all ".join(f"select {i} as bucket, '{b}' as le, count(*) {'' if b == '+Inf' else f'filter (wal_pos * 37 % 12000 / 1000.0 <= {b})'} as n from changes" for i, b in enumerate(_BOUNDS)),
        "latency_quantiles": _C + "select table_name, quantile_cont(ms, 0.5) as p50, quantile_cont(ms, 0.95) as p95, quantile_cont(ms, 0.99) as p99, max(ms) as max from (select table_name, cast(wal_pos * 37 % 12000 as double) as ms from changes) group by table_name",
        "interval_throughput": _L + "select *, events / 3600.0 as events_per_second, bytes / 3600.0 as bytes_per_second, events / commits as events_per_commit from (select commit_timestamp_ms // 3600000 * 3600000 as interval_start_ms, count(*) as events, count(distinct end_lsn) as commits, cast(sum(payload_bytes) as bigint) as bytes from kept group by 1)",
        "end_to_end_latency_samples": _L + "select count(*) filter (t and l >= 0) as samples, count(*) filter (t and l < 0) as clock_skew, count(*) filter (not t) as missing, cast(sum(l) filter (t and l >= 0) as bigint) as latency_ms from (select sequence % 10 <> 0 as t, sequence % 40 - 5 as l from deliveries)",
        "redelivery_counts": _L + "select consumer, count(*) filter (not again) as new_events, count(*) filter (again) as redelivered from (select consumer, coalesce(sequence <= max(sequence) over (partition by consumer order by delivered_at rows between unbounded preceding and 1 preceding), false) as again from deliveries) group by consumer",
        "event_size_guard": _L + "select sequence, z as encoded_size from (select sequence, strlen(event_id) + 6 + strlen(table_name) + 8 + strlen(lsn) + payload_bytes as z from log) where z > 150",
        "event_json_line": _L + f"select sequence, {_LINE} as line from log",
        "transaction_staged_bytes": _L + f"select end_lsn, count(*) as event_count, cast(12 + sum(8 + strlen({_LINE})) as bigint) as staged_bytes from log group by end_lsn",
        "wire_projection": _L + "select sequence, event_id, case operation when 'insert' then 1 when 'update' then 2 else 3 end as operation, after_json is not null as has_after from log",
        "retryable_sqlstate": f"select s_suppkey, case when s_suppkey % 4 <> 0 then c end as state, s_suppkey % 4 <> 0 and c not in ('57P04', '42601') as retryable from (select s_suppkey, {_SQLSTATE} as c from supplier)",
        "backoff_schedule": "select range as attempt, least(15000, 250 * cast(pow(2, least(range, 16)) as bigint)) as delay_ms from range(20)",
        "display_columns": "select p_partkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KiB', n / 1024.0) when n < 1073741824 then printf('%.1f MiB', n / 1048576.0) else printf('%.1f GiB', n / 1073741824.0) end as size, case when length(p_name) <= 12 then p_name else left(p_name, 9) || '...' end as name, case when length(p_name) <= 2 then p_name else '..' end as dots, 'source-' || lower(hex(p_name)) as staging from (select *, p_partkey * p_partkey * 7 as n from part)",
        "zero_safe_ratio": "select s_suppkey, case when s_suppkey % 3 = 0 then 0.0 else s_suppkey / cast(s_suppkey % 3 as double) end as ratio from supplier",
        "storage_ready": "select s_suppkey, s_suppkey % 50 <> 49 and bool_and(s_suppkey % 50 <> 49) over (partition by s_suppkey % 8 order by s_suppkey rows unbounded preceding) and s_suppkey * 13 % 100 < 80 and 100 - s_suppkey * 13 % 100 > 10 as ready from supplier",
        "backup_file_order": _L + "select 'segment-' || lpad(cast(segment_id as varchar), 20, '0') as path, stored_bytes from catalog order by path",
        "inspect_tables": _L + "select schema_name, table_name, operation, count(*) as events, max(sequence) as last_sequence from log group by all",
        "artefact_parsing": "select o_orderkey, o_orderkey * 977 as processed, round(o_orderkey / 8.0, 3) as tps from orders",
        "orders_change_feed": "select o_orderkey as k, o_orderstatus as status, 1 + cast(o_orderstatus <> 'O' as bigint) as changes, epoch_us(o_orderdate) // 1000 as commit_timestamp_ms from orders",
    }

"""What a source's catalog says of its settings, publication and tables, as the frames that validation takes.

Each question is one SQL text, answered by whatever reads SQL from the source: `jdbc` for a live one (its driver must
be on the class path), any function in tests. Catalogs have a row for each table, not for each change.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError
from ..operators import validate
from ..plans import CapturePlan

if TYPE_CHECKING:
    from ..config import Source

Read = Callable[[str], DataFrame]


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def settings_sql(source: Source) -> str:
    """One row whatever is missing: a role, publication or slot that is not there leaves nulls, which count as violations."""
    return f"""
select w.setting as wal_level, r.rolreplication as can_replicate, r.rolsuper as is_superuser,
  p.pubinsert and p.pubupdate and p.pubdelete and p.pubtruncate as publishes_all, p.pubviaroot as publish_via_root,
  cast(k.slot_type as text) as slot_type, cast(k.plugin as text) as plugin, cast(k.database as text) as slot_database,
  k.two_phase as two_phase, cast(current_database() as text) as database
from pg_catalog.pg_settings w
left join pg_catalog.pg_roles r on r.rolname = current_user
left join pg_catalog.pg_publication p on p.pubname = {literal(source.publication)}
left join pg_catalog.pg_replication_slots k on k.slot_name = {literal(source.slot)}
where w.name = 'wal_level'"""


def published_sql(source: Source) -> str:
    return f"""
select cast(t.schemaname as text) as schema_name, cast(t.tablename as text) as table_name, t.rowfilter is not null as has_row_filter,
  exists (select 1 from pg_catalog.pg_publication_rel l join pg_catalog.pg_publication p on p.oid = l.prpubid
          where p.pubname = t.pubname and l.prrelid = c.oid and l.prattrs is not null) as has_column_filter
from pg_catalog.pg_publication_tables t
join pg_catalog.pg_namespace n on n.nspname = t.schemaname
join pg_catalog.pg_class c on c.relnamespace = n.oid and c.relname = t.tablename
where t.pubname = {literal(source.publication)}"""


TABLES_SQL = """
select cast(n.nspname as text) as schema_name, cast(c.relname as text) as table_name, cast(c.relkind as text) as relkind,
  c.relispartition as is_partition, cast(c.relreplident as text) as identity,
  c.relreplident = 'f' or exists (
    select 1 from pg_catalog.pg_index i where i.indrelid = c.oid and i.indisvalid
    and (c.relreplident = 'd' and i.indisprimary or c.relreplident = 'i' and i.indisreplident)) as has_usable_identity,
  exists (select 1 from pg_catalog.pg_attribute a
          where a.attrelid = c.oid and a.attnum > 0 and not a.attisdropped and a.attgenerated <> '') as has_generated
from pg_catalog.pg_class c join pg_catalog.pg_namespace n on n.oid = c.relnamespace
where c.relkind in ('r', 'p') and c.relpersistence = 'p' and n.nspname not in ('pg_catalog', 'information_schema')"""

IDENTITY_SQL = """
select cast(s.system_identifier as text) as system_identifier, cast(d.oid as bigint) as database_oid
from pg_catalog.pg_control_system() s cross join pg_catalog.pg_database d where d.datname = current_database()"""


def jdbc(spark: SparkSession, source: Source) -> Read:
    options = {
        "url": f"jdbc:postgresql://{source.host}:{source.port}/{source.database}",
        "driver": "org.postgresql.Driver",
        "user": source.user,
        "password": source.secret().resolve(),
    }
    return lambda sql: spark.read.format("jdbc").options(**options).option("query", sql).load()


def violations(read: Read, source: Source, plan: CapturePlan) -> DataFrame:
    """(subject, violation) of the source for what the plan captures."""
    tables = read(TABLES_SQL)
    return validate.source_violations(read(settings_sql(source)), plan.required_tables(tables), read(published_sql(source)), tables)


def unnecessary(read: Read, source: Source, plan: CapturePlan) -> DataFrame:
    """Tables that the publication sends and the plan drops."""
    return validate.unnecessary_tables(read(published_sql(source)), plan)


def identity(read: Read) -> tuple[str, int]:
    """What a log is bound to (`LogStore.bind_identity`): the cluster's identifier and the database's number."""
    row = read(IDENTITY_SQL).first()
    if row is None:
        raise ConfigError("the source does not tell its identity")
    return row.system_identifier, row.database_oid

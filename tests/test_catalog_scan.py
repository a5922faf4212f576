"""The catalog's questions, asked of a small imitation of a catalog in another SQL engine."""

import duckdb
import pytest
from tidemark.config import Source
from tidemark.plans import CapturePlan, Stream
from tidemark.sources import catalog

CATALOG = """
create schema fake;
create table fake.pg_settings as select 'wal_level' as name, 'logical' as setting union all select 'port', '5432';
create table fake.pg_roles as select current_user as rolname, true as rolreplication, false as rolsuper;
create table fake.pg_publication (oid int, pubname text, pubinsert bool, pubupdate bool, pubdelete bool, pubtruncate bool, pubviaroot bool);
insert into fake.pg_publication values (1, 'it''s', true, true, true, true, false), (2, 'half', true, true, false, true, true);
create table fake.pg_replication_slots as select 'main' as slot_name, 'logical' as slot_type, 'pgoutput' as plugin, current_database() as database, false as two_phase;
create table fake.pg_namespace (oid int, nspname text);
insert into fake.pg_namespace values (10, 'public'), (11, 'pg_catalog'), (12, 'other');
create table fake.pg_class (oid int, relname text, relnamespace int, relkind text, relpersistence text, relispartition bool, relreplident text);
insert into fake.pg_class values
  (100, 'orders', 10, 'r', 'p', false, 'd'), (101, 'bare', 10, 'r', 'p', false, 'd'), (102, 'full_one', 10, 'r', 'p', false, 'f'),
  (103, 'indexed', 10, 'r', 'p', false, 'i'), (104, 'parted', 10, 'p', 'p', false, 'd'), (105, 'leaf', 10, 'r', 'p', true, 'd'),
  (106, 'silent', 10, 'r', 'p', false, 'n'), (107, 'a_view', 10, 'v', 'p', false, 'n'), (108, 'fleeting', 10, 'r', 't', false, 'd'),
  (109, 'pg_class', 11, 'r', 'p', false, 'n'), (110, 'orders', 12, 'r', 'p', false, 'd');
create table fake.pg_index (indrelid int, indisvalid bool, indisprimary bool, indisreplident bool);
insert into fake.pg_index values (100, true, true, false), (103, true, false, true), (104, true, true, false), (105, true, true, false), (106, true, true, false), (110, false, true, false);
create table fake.pg_attribute (attrelid int, attnum int, attisdropped bool, attgenerated text);
insert into fake.pg_attribute values (100, 1, false, ''), (102, 1, false, 's'), (103, 2, true, 's'), (104, -1, false, 's');
create table fake.pg_publication_tables (pubname text, schemaname text, tablename text, rowfilter text);
insert into fake.pg_publication_tables values
  ('it''s', 'public', 'orders', null), ('it''s', 'public', 'full_one', '(id > 1)'), ('it''s', 'public', 'indexed', null), ('it''s', 'public', 'parted', null),
  ('it''s', 'public', 'leaf', null), ('it''s', 'public', 'silent', null), ('it''s', 'other', 'orders', null), ('half', 'public', 'bare', null);
create table fake.pg_publication_rel (prpubid int, prrelid int, prattrs int[]);
insert into fake.pg_publication_rel values (1, 103, [1, 2]), (1, 100, null), (2, 100, [1]);
create table fake.pg_database as select 16384 as oid, current_database() as datname union all select 5, 'postgres';
create macro fake.pg_control_system() as table select 7123456789012345678 as system_identifier;
"""
SOURCE = Source(publication="it's", slot="main")
PLAN = CapturePlan.of("p", [Stream("a", "p", ("public.*",))])


@pytest.fixture
def read(spark):
    db = duckdb.connect()
    db.execute(CATALOG)
    db.execute("use memory")

    def run(sql):
        rel = db.sql(sql.replace("pg_catalog.pg_", "fake.pg_"))
        types = {"VARCHAR": "string", "BOOLEAN": "boolean", "BIGINT": "bigint"}
        return spark.createDataFrame(rel.fetchall(), ", ".join(f"{c} {types[str(t)]}" for c, t in zip(rel.columns, rel.types)))

    run.db = db
    return run


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(read):
    got = {(r.schema_name, r.table_name): (r.relkind, r.is_partition, r.identity, r.has_usable_identity, r.has_generated) for r in read(catalog.TABLES_SQL).collect()}
    assert got == {
        ("public", "orders"): ("r", False, "d", True, False),
        ("public", "bare"): ("r", False, "d", False, False),
        ("public", "full_one"): ("r", False, "f", True, True),
        ("public", "indexed"): ("r", False, "i", True, False),
        ("public", "parted"): ("p", False, "d", True, False),
        ("public", "leaf"): ("r", True, "d", True, False),
        ("public", "silent"): ("r", False, "n", False, False),
        ("other", "orders"): ("r", False, "d", False, False),
    }


def test_violations(read):
    assert rows(catalog.violations(read, SOURCE, PLAN)) == sorted(
        [
            ("public.bare", "no usable replica identity"),
            ("public.bare", "not published"),
            ("public.full_one", "generated columns"),
            ("public.full_one", "published with a filter"),
            ("public.indexed", "published with a filter"),
            ("public.parted", "partitioned table is published by its leaves"),
            ("public.silent", "no usable replica identity"),
        ]
    )
    assert rows(catalog.unnecessary(read, SOURCE, PLAN)) == [("other", "orders")]


def test_settings_that_are_wrong_or_missing(read):
    only = CapturePlan.of("p", [Stream("a", "p", ("public.bare",))])
    got = [v for s, v in rows(catalog.violations(read, Source(publication="half", slot="gone"), only)) if s == "source"]
    assert got == ["publication does not publish all operations", "slot belongs to another database", "slot is not logical", "slot is two-phase", "slot uses another plugin"]
    read.db.execute("update fake.pg_settings set setting = 'replica' where name = 'wal_level'; delete from fake.pg_roles; update fake.pg_replication_slots set two_phase = true")
    got = [v for s, v in rows(catalog.violations(read, Source(publication="none"), PLAN)) if s == "source"]
    assert got == ["publication does not publish all operations", "role may not replicate", "slot is two-phase", "wal_level is not logical"]


def test_identity(read):
    assert catalog.identity(read) == ("7123456789012345678", 16384)


def test_a_live_source_is_asked_through_jdbc(spark):
    """No driver is installed here: the request must get as far as the driver."""
    with pytest.raises(Exception, match="org.postgresql.Driver"):
        catalog.jdbc(spark, Source(password="x"))(catalog.IDENTITY_SQL)

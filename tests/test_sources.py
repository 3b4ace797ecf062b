"""Reading, typing, writing, and the catalog."""

from __future__ import annotations

import pytest

from tests.frames import by_id, same_rows
from txrisk.operators import prepare
from txrisk.plans.scoring import score
from txrisk.plans.tables import build_scored, build_transactions
from txrisk.schema import SCORED_COLUMNS, TRANSACTIONS
from txrisk.sources.lines import (
    MISSING,
    OPEN_QUOTE,
    STRAY_QUOTE,
    SURPLUS,
    read_lines,
    rejected_lines,
    sound_rows,
)
from txrisk.sources.readers import read_dictionary, read_transactions
from txrisk.sources.staging import CHECKPOINT_DIR, shared_folder, stage
from txrisk.sources.tables import list_tables, replace_table, schema_listing, write_table

HEADER = ",".join(TRANSACTIONS.fieldNames())
GOOD = [
    "5000000000,7,2024-01-01 00:00:00,12,US,mobile,web,3,0,true,2,0",
    "5000000001,7,2024-01-01 00:10:00,13.5,US,mobile,web,3.0,0,false,2,1",
    "5000000001,7,2024-01-01 00:20:00,14,US,mobile,web,3,0,0,2,1",
]
BAD = "5000000002,8,2024-01-02 00:00:00,abc,FR,tablet,app,4,1,1,1,0"


def csv(tmp_path, lines):
    path = tmp_path / "transactions.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


@pytest.mark.parametrize("infer", [False, True])
def test_csv_is_typed(spark, tmp_path, infer):
    raw = read_transactions(spark, csv(tmp_path, GOOD), infer=infer)
    typed = prepare.cast_to_schema(raw)
    assert {f.name: f.dataType for f in typed.schema} == {f.name: f.dataType for f in TRANSACTIONS}
    first = by_id(typed)[5000000000]
    assert (first["amount"], first["hour"], first["coupon_applied"]) == (12.0, 3, 1)


def test_bad_value_fails_or_turns_null(spark, tmp_path):
    raw = read_transactions(spark, csv(tmp_path, [*GOOD, BAD]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        prepare.cast_to_schema(raw).collect()
    typed = prepare.cast_to_schema(raw, lenient=True)
    assert by_id(typed)[5000000002]["amount"] is None
    rejects = {r["column"]: r["rejected"] for r in prepare.reject_counts(raw).collect()}
    assert rejects["amount"] == 1 and sum(rejects.values()) == 1


DAMAGED = [
    (GOOD[1] + ",surplus", SURPLUS),
    (GOOD[1].rsplit(",", 1)[0], MISSING),
    ("", None),
    (GOOD[1].replace("US", '"US'), OPEN_QUOTE),
    (GOOD[1].replace("US", 'U"S"'), STRAY_QUOTE),
    ('1,7,2024-01-01 00:10:00,13.5,"U', OPEN_QUOTE),
    ('S",mobile,web,3,0,0,2,1', OPEN_QUOTE),
    ("\u0001 not a row", MISSING),
]
QUOTED = [
    GOOD[1].replace("US", '"U,S"').replace("01,7", "02,7"),
    GOOD[1].replace("US", '"a\\"b, c"').replace("01,7", "03,7"),
]


def test_damaged_lines_are_kept_apart(spark, tmp_path):
    path = csv(tmp_path, [GOOD[0], *[x for x, _ in DAMAGED], *QUOTED])
    found = read_lines(spark, path)
    rejected = rejected_lines(found).collect()
    assert sorted((r["line"], r["reason"]) for r in rejected) == sorted(x for x in DAMAGED if x[1])
    assert {r["file"].replace("///", "/") for r in rejected} == {f"file:{path}"}
    rows = by_id(prepare.cast_to_schema(read_transactions(spark, path)))
    assert set(rows) == {5000000000, 5000000002, 5000000003}
    assert [rows[k]["country"] for k in (5000000002, 5000000003)] == ["U,S", 'a"b, c']


def test_every_file_has_its_header_and_ends_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(("\ufeff" + HEADER + "\r\n" + GOOD[0] + "\r\n").encode())
    (tmp_path / "in" / "b.csv").write_text(HEADER + "\n" + GOOD[1])
    (tmp_path / "in" / "c.csv").write_text(HEADER)
    found = read_lines(spark, str(tmp_path / "in"), TRANSACTIONS.fieldNames())
    assert rejected_lines(found).count() == 0
    assert {r["is_fraud"] for r in sound_rows(found).collect()} == {"0", "1"}


def test_doubled_quotes_and_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x""y, z"\n2,"two\nlines"\n3\n4,5,6\n')
    by_line = read_lines(spark, str(path), escape='"')
    assert [tuple(r) for r in sound_rows(by_line).collect()] == [("1", 'x"y, z')]
    assert rejected_lines(by_line).count() == 4
    whole = read_lines(spark, str(path), escape='"', multi_line=True)
    assert sorted(tuple(r) for r in sound_rows(whole).collect()) == [("1", 'x"y, z'), ("2", "two\nlines")]
    assert sorted((r["reason"], r["line"]) for r in rejected_lines(whole).collect()) == [(MISSING, "3"), (SURPLUS, "4,5,6")]


def test_a_very_long_line_and_an_empty_file(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n" + "x" * 200_000 + ',"' + "y," * 100_000 + '"\n' + "z," * 50_000 + "\n")
    found = read_lines(spark, str(path))
    assert [len(r["b"]) for r in sound_rows(found).collect()] == [200_000]
    assert [r["reason"] for r in rejected_lines(found).collect()] == [SURPLUS]
    path.write_text("a,b\n")
    assert read_lines(spark, str(path)).count() == 0


def test_build_keeps_damaged_lines_or_fails(spark, tmp_path):
    path = csv(tmp_path, [*GOOD, BAD, DAMAGED[0][0]])
    tables = [f"d_payments{x}" for x in ("", "_rejects", "_reject_counts", "_damaged")]
    try:
        with pytest.raises(ValueError, match="surplus fields"):
            build_transactions(spark, path, tables[0], lenient=True)
        tx = build_transactions(spark, path, tables[0], lenient=True, damaged=tables[3])
        assert {r["transaction_id"] for r in tx.collect()} == {5000000000, 5000000001, 5000000002}
        counts = {r["column"]: r["rejected"] for r in spark.table(tables[2]).collect()}
        assert counts["amount"] == 1 and sum(counts.values()) == 1
        assert [(r["reason"], r["line"]) for r in spark.table(tables[3]).collect()] == [(SURPLUS, DAMAGED[0][0])]
    finally:
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="is_fraud"):
        prepare.cast_to_schema(spark.range(1))


def test_dictionary(spark, tmp_path):
    path = tmp_path / "dictionary.csv"
    path.write_text("column,description\namount,what was paid\n")
    assert read_dictionary(spark, str(path)).collect() == [("amount", "what was paid")]


def test_file_to_scored_table(spark, tmp_path):
    try:
        tx = build_transactions(spark, csv(tmp_path, GOOD), "t_transactions")
        assert tx.count() == 2
        # The first of the two rows with one id, and the one before it.
        scored = build_scored(spark, "t_transactions", "t_scored", by_month=True)
        assert set(SCORED_COLUMNS) < set(scored.columns)
        assert {r["event_month"] for r in scored.collect()} == {"2024-01"}
        assert by_id(scored)[5000000001]["txn_count_1hr"] == 1
        names = {r["tableName"] for r in list_tables(spark).collect()}
        assert {"t_transactions", "t_scored"} <= names
        # A table can be replaced from itself.
        replace_table(spark.table("t_transactions").filter("amount > 13"), "t_transactions")
        assert spark.table("t_transactions").count() == 1
        assert read_transactions(spark, "t_transactions", fmt="table").count() == 1
        write_table(spark.table("t_scored").select("user_id"), "t_users")
        assert spark.table("t_users").count() == 2
    finally:
        for table in ("t_transactions", "t_scored", "t_users"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_schema_listing(tx):
    listing = schema_listing(tx).collect()
    assert [r["column"] for r in listing] == TRANSACTIONS.fieldNames()
    assert listing[3]["type"] == "double"


def test_staged_rows_are_the_same(tx):
    assert same_rows(stage(score(tx), "again"), score(tx))


def test_parquet_is_read(spark, tx, tmp_path):
    tx.write.parquet(str(tmp_path / "tx"))
    assert same_rows(read_transactions(spark, str(tmp_path / "tx"), fmt="parquet"), tx)


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default):
            return "hdfs://shared/check" if key == CHECKPOINT_DIR else default

    class Session:
        conf = Conf()

    assert shared_folder(Session()) == "hdfs://shared/check"

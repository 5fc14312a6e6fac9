"""V1–V11 and the field split, on the adversarial cases of the contract."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.csvfields import is_complete_record, split_fields
from ledgerline.operators.ladder import classify

OK = None
T = "2025-01-02T03:04:05Z"
CASES = [
    (f"txn-1,{T},10.50,food", OK),
    ("txn-1,2025-01-02T03:04Z,10.50,food", OK),
    ("txn-1,2025-01-02T03:04:05.123456789Z,10.50,food", OK),
    ("txn-1,2025-01-02T03:04:05+00:00,10.50,food", OK),
    ("txn-1,2025-01-02T03:04:05-00:00,10.50,food", OK),
    ("txn-1,2025-01-02T03:04:05+00,10.50,food", OK),
    ("txn-1,2025-01-02t03:04:05z,10.50,food", OK),
    ("txn-1,2025-01-02T03:04:05.Z,10.50,food", OK),
    ("txn-1,2025-01-02T03:04:05-03:00,10.50,food", "OCCURRED_AT_NOT_UTC"),
    ("txn-1,2025-01-02T03:04:05+01:00,10.50,food", "OCCURRED_AT_NOT_UTC"),
    ("txn-1,2025-01-02 03:04:05Z,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-01-02,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-01-02T03:04:05,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-01-02T03:04:05+0000,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-01-02T03:04:05+19:00,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-01-02T24:00:00Z,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-01-02T23:59:60Z,10.50,food", "OCCURRED_AT_INVALID"),
    ("txn-1,2025-02-30T03:04:05Z,10.50,food", "OCCURRED_AT_INVALID"),
    (f"txn-1,{T},1.00E0,food", OK),
    (f"txn-1,{T},100E-2,food", OK),
    (f"txn-1,{T},.50,food", OK),
    (f"txn-1,{T},+1.00,food", OK),
    (f"txn-1,{T},0000000000000000000001.00,food", OK),
    (f"txn-1,{T},12345678901234567.89,food", OK),
    (f"txn-1,{T},123456789012345678.90,food", "AMOUNT_PRECISION_INVALID"),
    (f"txn-1,{T}, 1.00,food", "AMOUNT_INVALID"),
    (f"txn-1,{T},1.00d,food", "AMOUNT_INVALID"),
    (f"txn-1,{T},.,food", "AMOUNT_INVALID"),
    (f"txn-1,{T},,food", "AMOUNT_INVALID"),
    (f"txn-1,{T},1E99999999999,food", "AMOUNT_INVALID"),
    (f"txn-1,{T},1E2,food", "AMOUNT_SCALE_INVALID"),
    (f"txn-1,{T},5.,food", "AMOUNT_SCALE_INVALID"),
    (f"txn-1,{T},0.000,food", "AMOUNT_SCALE_INVALID"),
    (f"txn-1,{T},-0.00,food", "AMOUNT_ZERO"),
    (f"txn-1,{T},0E-2,food", "AMOUNT_ZERO"),
    (f"txn-0003,{T},0.00,saúde", "AMOUNT_ZERO"),
    (f" ,{T},1.00,food", OK),                    # NBSP is not blank in Java
    (f"\t,{T},1.00,food", "TRANSACTION_ID_REQUIRED"),
    (f" ,{T},1.00,food", "TRANSACTION_ID_REQUIRED"),
    (f"\u001c,{T},1.00,food", "TRANSACTION_ID_REQUIRED"),
    (f",{T},12.00,transporte", "TRANSACTION_ID_REQUIRED"),
    ("\U0001F600" * 33 + f",{T},1.00,food", "TRANSACTION_ID_TOO_LONG"),  # 66 UTF-16 units
    ("\U0001F600" * 32 + f",{T},1.00,food", OK),
    (f"a,{T},1.00," + "x" * 101, "CATEGORY_TOO_LONG"),
    (f"a,{T},1.00," + "x" * 100, OK),
    (f"a,{T},1.00,   ", "CATEGORY_REQUIRED"),
    ("", "COLUMN_COUNT"),
    ("a,b,c", "COLUMN_COUNT"),
    ("a,b,c,d,e", "COLUMN_COUNT"),
    (",,,", "TRANSACTION_ID_REQUIRED"),
    (f'txn-0001,{T},10.50,"alimentação, especial"', OK),
    (f'txn-0001,{T},10.50,"a""b"  ', OK),
]


def test_ladder_codes(spark):
    df = spark.createDataFrame(list(enumerate(c for c, _ in CASES)), "i int, line string")
    out = classify(df.withColumn("fields", split_fields(F.col("line")))).orderBy("i").collect()
    got = [r.error_code for r in out]
    assert got == [e for _, e in CASES]


def test_typed_projection(spark):
    rows = [("a,2025-01-02T03:04:05.9999995Z,1.00E0,x",), ('b,2025-01-31T23:59:59Z,-25.50,"p,""q"""',)]
    df = spark.createDataFrame(rows, "line string").withColumn("fields", split_fields(F.col("line")))
    out = classify(df).collect()
    assert str(out[0].occurred_at) == "2025-01-02 03:04:06"   # nanoseconds rounded half-up
    assert str(out[0].amount) == "1.00"
    assert str(out[1].amount) == "-25.50" and out[1].category == 'p,"q"'


@pytest.mark.parametrize("line,ok", [
    ('a,"b,c",d', True), ('a,"b""c",d', True), ('"a"b,c', False), ('a,"open', False), ('a,b"c,d', True),
    ('"x"  ,y', True), ("", True),
])
def test_record_grammar(spark, line, ok):
    r = spark.range(1).select(is_complete_record(F.lit(line)).alias("ok")).first()
    assert r.ok is ok

"""S5/S6 against brute force: random CSV files (quoted commas, escaped
quotes, quoted newlines, blank lines) ingested with tiny split sizes must
give exactly the records Python's csv module parses, numbered the same."""

import csv
import io
import random

from conftest import write
from ledgerline.plans.ingest import ingest, read_errors, read_transactions

HDR = "transaction_id,occurred_at,amount,category\n"
ALPHABET = ["a", "b", "z", "é", " ", ",", '"', "\n", "x", "1"]


def _field(rng, max_len):
    return rng.choice("abcdefgh") + "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, max_len)))


def _quote(v):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') or v.startswith(" ") else v


def _make_file(rng, n):
    parts, expected = [HDR], {}
    row = 2
    for _ in range(n):
        if rng.random() < 0.05:
            parts.append("\n")  # blank line: a one-field record, rejected
            row += 1
            continue
        tid, cat = _field(rng, 12), _field(rng, 30)
        parts.append(",".join([_quote(tid), "2025-01-02T03:04:05Z", "1.00", _quote(cat)]) + "\n")
        expected[row] = (tid, cat)
        row += 1
    return "".join(parts), expected, row - 2


def _brute(text):
    recs = list(csv.reader(io.StringIO(text, newline="")))
    return {i + 2: (r[0], r[3]) for i, r in enumerate(recs[1:]) if len(r) == 4}


def test_random_files_against_csv_module(spark, tmp):
    rng = random.Random(20261202)
    exp_all, totals = {}, {}
    for k in range(4):
        text, expected, n = _make_file(rng, 400)
        assert _brute(text) == expected  # the generator agrees with the csv module
        write(f"{tmp}/in/f{k}.csv", text)
        exp_all[f"f{k}.csv"], totals[f"f{k}.csv"] = expected, n
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rep = ingest(spark, f"{tmp}/in", f"{tmp}/store")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for imp in rep["imports"]:
        name = imp["path"].rsplit("/", 1)[-1]
        got = {r.source_row: (r.transaction_id, r.category)
               for r in read_transactions(spark, f"{tmp}/store", imp["import_id"]).collect()}
        errs = {r.source_row: r.error_code for r in read_errors(spark, f"{tmp}/store", imp["import_id"]).collect()}
        assert got == exp_all[name], name
        assert set(errs.values()) <= {"COLUMN_COUNT"}
        assert len(got) + len(errs) == totals[name]
        assert sorted(list(got) + list(errs)) == list(range(2, totals[name] + 2))


def test_multiline_junk_and_unterminated(spark, tmp):
    ok = "a,2025-01-02T03:04:05Z,1.00,x\n"
    write(f"{tmp}/in/junk.csv", HDR + ok + 'b,2025-01-02T03:04:05Z,1.00,"x\ny"z\n' + ok)
    write(f"{tmp}/in/open.csv", HDR + ok + ok + 'c,2025-01-02T03:04:05Z,1.00,"never closed\n' + ok + ok)
    write(f"{tmp}/in/fine.csv", HDR + 'd,2025-01-02T03:04:05Z,1.00,"x\n""y"",\n z"  \n' + ok)
    rep = {i["path"].rsplit("/", 1)[-1]: i for i in ingest(spark, f"{tmp}/in", f"{tmp}/store", batch_size=1)["imports"]}
    assert (rep["junk.csv"]["fault"], rep["junk.csv"]["bad_record"], rep["junk.csv"]["accepted"]) == ("CSV_SYNTAX", 3, 1)
    assert (rep["open.csv"]["fault"], rep["open.csv"]["bad_record"], rep["open.csv"]["accepted"]) == ("CSV_SYNTAX", 4, 2)
    assert rep["fine.csv"]["status"] == "COMPLETED" and rep["fine.csv"]["accepted"] == 2
    cats = sorted(r.category for r in read_transactions(spark, f"{tmp}/store", rep["fine.csv"]["import_id"]).collect())
    assert cats == ["x", 'x\n"y",\n z']

"""Splittable, strictly validated CSV scan.

Pipeline (all DataFrame ops, no driver loops over data):

1. :func:`manifest` — file admission from file metadata only (content pruned).
2. :func:`scan_lines` — `spark.read.text` over all admitted files, split at LF
   only, tagged with ``_metadata.file_path``/``file_block_start``. A line keeps
   its separator (LF, CRLF, or a lone CR at which it is split further) and gets
   ``monotonically_increasing_id()``. Rows of one (file, block) are contiguous
   in one task, so ``mid - min(mid)`` numbers lines inside the block; a tiny
   per-block summary (one row per input split) gives block offsets.
3. Fast path — every physical line of the file is a complete record: line =
   record, no shuffle.
4. Slow path (quoted newlines) — each line is a transfer function over the
   quote state {outside, inside}; windows inside each chunk of consecutive lines
   of a block compose it, a per-chunk summary composes chunks, and only records
   that straddle lines are grouped and concatenated.
5. :func:`file_verdicts` — first faulty record per file (UTF-8, oversize,
   syntax; header first) and the committed-prefix cut. The bytes of a file's
   lines must add up to its size; a file that could not be read to its end is an
   I/O fault of that file alone, apart from its content.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import contract as C
from ledgerline.functions import csvfields as CF
from ledgerline.functions.text import utf16_length
from ledgerline.operators.ledger import bounded_failure_reason

try:  # executor-side functions of this module ship by value (workers need no install)
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

# Above this many per-block summary rows the summary is shuffle-joined
# instead of broadcast (each row is ~ path + 40 bytes).
BROADCAST_SUMMARY_BYTES = 128 * 1024 * 1024

#: Bytes held at once while files are put behind one another.
JOIN_BYTES = 8 * 1024 * 1024

#: Lines of a block whose quote states one window composes: 2 to the power of this.
CHUNK_BITS = 12

FAULT_RANK = {C.FILE_BAD_UTF8: 1, C.FILE_OVERSIZE: 2, C.FILE_SYNTAX: 3, C.FILE_HEADER: 4}


# --------------------------------------------------------------------------- S1
def import_id_for(path, mtime):
    """Stable import id from path and modification time, UUID-shaped."""
    h = F.sha2(F.concat_ws("|", path, mtime.cast("string")), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def literal_path(path: str) -> str:
    """A path for Spark's readers, which take patterns."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def manifest(spark: SparkSession, paths: list[str] | str, recursive: bool = True) -> DataFrame:
    """List files with metadata only and decide admission.

    ``binaryFile`` prunes the content column when it is not selected, so this
    reads no file bytes. 0-byte files, which yield no split and so no row, come
    from the names in the same file index."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    src = reader.load(paths)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    listed = src.select(plain.alias("path"), "length", F.col("modificationTime").alias("modification_time"))
    # the index's names are encoded URIs, the rows' paths are plain: one spelling for both
    names = spark._jvm.org.apache.hadoop.util.StringUtils.join("\0", src._jdf.inputFiles())
    uri = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    index = (spark.createDataFrame([(names,)], "names string").select(F.explode(F.split("names", "\0")).alias("path"))
             .select(F.regexp_replace(uri, "^file:/+", "file:/").alias("path")).filter("path <> ''").distinct())
    empty = index.join(listed, "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modification_time"))
    files = listed.unionByName(empty)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    norm_name = F.lower(F.trim(name))
    refusal = (F.when((F.length(F.trim(name)) == 0) | ~norm_name.endswith(".csv"), F.lit(C.FILE_REFUSED_NAME))
               .when(F.col("length") <= 0, F.lit(C.FILE_REFUSED_EMPTY)))
    return files.select(
        "path",
        name.alias("original_filename"),
        F.col("length").alias("file_size"),
        "modification_time",
        import_id_for(F.col("path"), F.col("modification_time")).alias("import_id"),
        refusal.alias("refusal"),
        refusal.isNull().alias("admitted"),
    )


def _bom_probe(batches):
    """First three bytes of each file (executor-side, one small read per
    file); null if it cannot be read, which its byte count will show."""
    import pandas as pd
    import pyarrow.fs as pafs
    for pdf in batches:
        flags = []
        for p in pdf["path"]:
            if p.startswith(("file:", "/")):
                fs, rel = pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", p)
            else:  # a store that cannot be opened is an error: the verdict must not depend on it
                fs, rel = pafs.FileSystem.from_uri(quote(p, safe=":/@"))
            try:
                with fs.open_input_stream(rel) as f:
                    flags.append(f.read(3) == b"\xef\xbb\xbf")
            except OSError:
                flags.append(None)
        yield pd.DataFrame({"path": pdf["path"], "bom": pd.array(flags, dtype="boolean")})


def _delete_files(batches):
    """Executor-side removal of one file per row; a missing one is no error."""
    import pyarrow.fs as pafs
    for pdf in batches:
        for p in pdf["path"]:
            if p.startswith(("file:", "/")):
                fs, rel = pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", p)
            else:
                fs, rel = pafs.FileSystem.from_uri(quote(p, safe=":/@"))
            try:
                fs.delete_file(rel)
            except FileNotFoundError:
                pass
        yield pdf


def delete_files(paths: DataFrame) -> None:
    """K6: remove consumed input files."""
    paths.select("path").mapInPandas(_delete_files, "path string").write.format("noop").mode("overwrite").save()


def _join_files(batches):
    """Executor-side: the bytes of ``parts`` one behind the other as one new
    file in the folder ``to``, a block at a time. The file gets its name when it
    is whole."""
    import uuid

    import pyarrow.fs as pafs
    for pdf in batches:
        for to, parts in zip(pdf["to"], pdf["parts"]):
            if parts[0].startswith(("file:", "/")):
                fs, rel = pafs.LocalFileSystem(), lambda p: re.sub(r"^file:/+", "/", p)
            else:
                fs = pafs.FileSystem.from_uri(quote(parts[0], safe=":/@"))[0]
                rel = lambda p: pafs.FileSystem.from_uri(quote(p, safe=":/@"))[1]
            folder, tmp = rel(to), f"_{uuid.uuid4().hex}.tmp"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{tmp}") as out:
                for p in parts:
                    with fs.open_input_stream(rel(p)) as f:
                        while block := f.read(JOIN_BYTES):
                            out.write(block)
            fs.move(f"{folder}/{tmp}", f"{folder}/part-00000.csv")
        yield pdf[["to"]]


def join_files(files: DataFrame) -> None:
    """Per row: the files ``parts``, in this order, become one CSV file in ``to``."""
    files.mapInPandas(_join_files, "to string").write.format("noop").mode("overwrite").save()


def bom_flags(files: DataFrame) -> DataFrame:
    """Hadoop's line reader silently drops a UTF-8 BOM; the contract treats
    it as part of the header (so a BOM fails the header check)."""
    return files.select("path").mapInPandas(_bom_probe, "path string, bom boolean")


# --------------------------------------------------------------------------- S2/S6
def load_paths(spark: SparkSession, files: DataFrame):
    """The files' paths as the reader takes them: Spark's file index lives in
    the driver's JVM, and the names go there without passing through Python."""
    literal = files.select(F.regexp_replace("path", r"([\\\[\]{}*?])", r"\\$1").alias("p"))
    return getattr(literal._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING()).collect()


def scan_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Physical lines with file, block, separator and a per-task ordinal.

    LF, CRLF and lone CR end lines, as in the contract. The scan splits at LF
    (so a split's border never falls into a CRLF); a line that holds lone CRs is
    split at them here."""
    reader = spark._jsparkSession.read().format("text").option("lineSep", "\n")
    # a fault while reading ends that file's rows, not the run; the byte count tells
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    text = DataFrame(reader.load(load_paths(spark, files)), spark)
    # the metadata column is an encoded URI; the manifest has plain paths ("+" is no space in a path)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    crlf = F.endswith("value", F.lit("\r"))
    body = F.when(crlf, F.expr("left(value, char_length(value) - 1)")).otherwise(F.col("value"))
    raw = text.select(F.regexp_replace(plain, "^file:/+", "file:/").alias("path"),
                      F.col("_metadata.file_block_start").alias("block"),
                      F.is_valid_utf8("value").alias("utf8_ok"),
                      F.octet_length("value").alias("n_bytes"),
                      F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n")).alias("last_sep"), body.alias("body"))
    # an invalid line stays whole: splitting would repair its bytes
    parts = F.when(F.col("utf8_ok") & F.contains("body", F.lit("\r")), F.split("body", "\r")).otherwise(F.array("body"))
    lines = raw.select("path", "block", "utf8_ok", "last_sep", "n_bytes", F.size(parts).alias("n"),
                       F.posexplode(parts).alias("k", "value"))
    last = F.col("k") == F.col("n") - 1
    return lines.select("value", F.when(last, F.col("last_sep")).otherwise(F.lit("\r")).alias("sep"), "path", "block",
                        "utf8_ok", F.when(last, F.col("n_bytes") + 1).otherwise(0).alias("n_bytes"),
                        F.monotonically_increasing_id().alias("mid"))


def _line_facts(lines: DataFrame, max_chars: int) -> DataFrame:
    v = F.col("value")
    u16 = utf16_length(v)
    too_long = u16 > max_chars
    return lines.select(
        "path", "block", "mid", "value", "sep", "utf8_ok", "n_bytes",
        u16.alias("u16"),
        # length guard first: the regex never runs on an oversize line
        F.when(too_long, F.lit(False)).otherwise(CF.is_complete_record(v)).alias("complete"),
    )


def block_summary(facts: DataFrame) -> DataFrame:
    """Per (file, block) line count and first ordinal; block offsets by
    a running sum over the (tiny) summary; per-file fast-path flag."""
    per_block = facts.groupBy("path", "block").agg(
        F.min("mid").alias("min_mid"),
        F.count("*").alias("n_lines"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.when(F.col("complete"), 0).otherwise(1)).alias("n_incomplete"))
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    wf = Window.partitionBy("path")
    return per_block.select(
        "path", "block", "min_mid", "n_lines", "n_bytes",
        F.coalesce(F.sum("n_lines").over(w), F.lit(0)).alias("line_offset"),
        (F.sum("n_incomplete").over(wf) > 0).alias("slow"),
    )


# --------------------------------------------------------------------------- S5 slow
def _xor(a, b):
    return F.when(a == b, F.lit(0)).otherwise(F.lit(1))


def _compose(df: DataFrame, part: list[str], order: list[str], f_out: str, f_in: str, prefix: str) -> DataFrame:
    """State before each row of an ordered sequence of transfer functions over
    {0 = outside, 1 = inside}, for both possible start states.

    A function is identity, swap or constant; the state before row i is the
    value of the last constant before i flipped by the parity of the swaps
    after it, else the start state flipped by the parity of all swaps."""
    w = Window.partitionBy(*part).orderBy(*order)
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fo, fi = F.col(f_out), F.col(f_in)
    is_swap = ((fo == 1) & (fi == 0)).cast("int")
    is_const = fo == fi
    df = df.withColumn("_sw", F.sum(is_swap).over(cum))
    df = (df.withColumn("_ksw", F.last(F.when(is_const, F.col("_sw")), ignorenulls=True).over(before))
            .withColumn("_kv", F.last(F.when(is_const, fo), ignorenulls=True).over(before)))
    sw_before = F.col("_sw") - is_swap
    fixed = F.when(F.col("_kv").isNotNull(), _xor(F.col("_kv"), F.pmod(sw_before - F.col("_ksw"), F.lit(2))))
    par = F.pmod(sw_before, F.lit(2))
    return (df.withColumn(prefix + "0", F.coalesce(fixed, par))
              .withColumn(prefix + "1", F.coalesce(fixed, _xor(F.lit(1), par)))
              .drop("_sw", "_ksw", "_kv"))


CARRIED = ["hdr_ok", "error_code", "transaction_id", "occurred_at", "amount", "category"]


def slow_records(numbered: DataFrame, cut_path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """S5 slow path for files with quoted newlines (or oversize lines).

    One shuffle of the slow files' lines by (file, block, chunk) — a chunk is at
    most 2^CHUNK_BITS consecutive lines, so no window holds a whole block —
    windows compose the quote state inside the chunk, a window over the tiny
    chunk summary composes a file's chunks, and only lines of multi-line records
    are grouped (lengths first, text only for records within the limit)."""
    v = F.col("value")
    guard = F.col("u16") > F.col("max_chars")
    carry = carry or []
    chunk = ["path", "block", "chunk"]
    # the text of an oversize line is no part of any record within the limit
    lines = numbered.filter(F.col("slow")).select(
        "path", "block", F.shiftright("mid", CHUNK_BITS).alias("chunk"), "mid", F.when(~guard, v).alias("value"), "sep", "utf8_ok", "u16", "max_chars", *carry,
        F.when(guard, F.lit(CF.ERR)).otherwise(CF.end_state_from_outside(v)).alias("a"),
        F.when(guard, F.lit(CF.ERR)).otherwise(CF.end_state_from_inside(v)).alias("b"))
    # ERR folds to "outside" for composition; states up to the first real
    # error stay exact and nothing after it is kept.
    lines = (lines.withColumn("fa", F.when(F.col("a") == CF.IN, 1).otherwise(0))
                  .withColumn("fb", F.when(F.col("b") == CF.IN, 1).otherwise(0)))
    lines = _compose(lines, chunk, ["mid"], "fa", "fb", "st")
    cum = Window.partitionBy(*chunk).orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    for h in ("0", "1"):
        st = F.col("st" + h)
        lines = (lines.withColumn("end" + h, F.when(st == 0, F.col("fa")).otherwise(F.col("fb")))
                      .withColumn("starts" + h, F.sum((st == 0).cast("int")).over(cum)))
    chunks = lines.groupBy(*chunk).agg(
        F.max_by("end0", "mid").alias("e0"), F.max_by("end1", "mid").alias("e1"),
        F.max("starts0").alias("r0"), F.max("starts1").alias("r1"))
    chunks = _compose(chunks, ["path"], ["block", "chunk"], "e0", "e1", "bs")
    chunks = chunks.withColumn("s_start", F.col("bs0"))  # a file starts outside quotes
    r_here = F.when(F.col("s_start") == 0, F.col("r0")).otherwise(F.col("r1"))
    before = Window.partitionBy("path").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("rec_offset", F.coalesce(F.sum(r_here).over(before), F.lit(0)))
    # the lines are dealt and ordered by chunk already: a merge join moves only the summary
    lines = lines.join(chunks.select(*chunk, "s_start", "rec_offset"), chunk)
    h1 = F.col("s_start") == 1
    st = F.when(h1, F.col("st1")).otherwise(F.col("st0"))
    lines = lines.select(
        "path", "mid", "value", "sep", "utf8_ok", "u16", "max_chars", *carry,
        st.alias("st"),
        F.when(st == 0, F.col("fa")).otherwise(F.col("fb")).alias("end"),
        (F.when(st == 0, F.col("a")).otherwise(F.col("b")) == CF.ERR).alias("err"),
        (F.col("rec_offset") + F.when(h1, F.col("starts1")).otherwise(F.col("starts0"))).alias("record_no"))
    if cut_path is not None:  # lineage cut: the grouping branches read this, not the source
        lines.write.mode("overwrite").parquet(cut_path)
        lines = numbered.sparkSession.read.parquet(cut_path)
    one_line = (F.col("st") == 0) & (F.col("end") == 0)
    single = lines.filter(one_line).select(
        "path", "record_no",
        F.when(F.col("u16") <= F.col("max_chars"), F.col("value")).alias("record"),
        "utf8_ok", F.col("u16").alias("rec_len"), F.col("err").alias("syntax_bad"), *carry,
        F.lit(True).alias("_single"))
    multi = lines.filter(~one_line)
    # separators inside a record belong to it, the one that ends it does not
    facts = multi.groupBy("path", "record_no").agg(
        (F.sum(F.col("u16") + F.length("sep")) - F.max_by(F.length("sep"), "mid")).alias("rec_len"),
        F.min(F.col("utf8_ok").cast("int")).alias("_u"),
        F.max(F.col("err").cast("int")).alias("_e"),
        F.max_by("end", "mid").alias("_last_end"),
        F.first("max_chars").alias("max_chars"))
    facts = facts.select(
        "path", "record_no", "rec_len", "max_chars",
        (F.col("_u") == 1).alias("utf8_ok"),
        ((F.col("_e") == 1) | (F.col("_last_end") == 1)).alias("syntax_bad"))
    # text only for records within the limit: every collected group is bounded
    small = facts.filter(F.col("rec_len") <= F.col("max_chars")).select("path", "record_no")
    text = (multi.join(small, ["path", "record_no"], "left_semi")
            .groupBy("path", "record_no")
            .agg(F.array_sort(F.collect_list(F.struct("mid", "value", "sep"))).alias("_l"))
            .select("path", "record_no", F.concat(
                F.array_join(F.transform(F.slice("_l", 1, F.size("_l") - 1), lambda x: F.concat(x["value"], x["sep"])), ""),
                F.element_at("_l", -1)["value"]).alias("record")))
    carried_types = dict(numbered.dtypes)
    multi_rec = facts.join(text, ["path", "record_no"], "left").select(
        "path", "record_no", "record", "utf8_ok", "rec_len", "syntax_bad",
        *[F.lit(None).cast(carried_types[c]).alias(c) for c in carry], F.lit(False).alias("_single"))
    return single.unionByName(multi_rec)


# --------------------------------------------------------------------------- S3/S4/S7/S8
def header_ok(raw):
    """Record 1 decodes to exactly the expected names (no trim, case-sensitive)."""
    ok = F.size(raw) == len(C.EXPECTED_HEADER)
    for i, name in enumerate(C.EXPECTED_HEADER):
        ok = ok & F.coalesce(CF.unquote(F.get(raw, i)) == F.lit(name), F.lit(False))
    return ok


def _fault(hdr_ok_col) -> "F.Column":
    return (F.when(~F.col("utf8_ok"), F.lit(C.FILE_BAD_UTF8))
            .when(F.col("rec_len") > F.col("max_chars"), F.lit(C.FILE_OVERSIZE))
            .when(F.col("syntax_bad"), F.lit(C.FILE_SYNTAX))
            .when((F.col("record_no") == 1) & ~hdr_ok_col, F.lit(C.FILE_HEADER)))


def classified_single_faults(records: DataFrame) -> DataFrame:
    """Single-line records of slow-path files: their ladder result was
    computed while staging the line; only the record-level faults remain."""
    out = records.withColumn("fault", _fault(F.coalesce(F.col("hdr_ok"), F.lit(False))))
    data = F.col("fault").isNull() & (F.col("record_no") >= 2)
    return out.select("path", "record_no", "record", "utf8_ok", "rec_len", "syntax_bad", "max_chars", "fault",
                      *[F.when(data, F.col(c)).alias(c) for c in ("error_code", "transaction_id", "occurred_at",
                                                                   "amount", "category")])


def record_faults(records: DataFrame) -> DataFrame:
    """Per-record fault kind by precedence (UTF-8, oversize, syntax), the
    header check on record 1, and the row ladder on data records — all in the
    one pass that stages the records, so later steps only filter stored
    columns (pushed down into the Parquet scan)."""
    from ledgerline.operators import ladder
    raw = CF.raw_fields(F.col("record"))
    out = records.withColumn("fault", _fault(header_ok(raw))).withColumn("_raw", raw)
    classified = ladder.classify(out, "_raw", quoted=True)
    data = F.col("fault").isNull() & (F.col("record_no") >= 2)
    return classified.select(
        *[c for c in records.columns], "fault",
        *[F.when(data, F.col(c)).alias(c) for c in ("error_code", "transaction_id", "occurred_at",
                                                     "amount", "category")])


def file_verdicts(spark: SparkSession, files: DataFrame, staged: DataFrame, read_bytes: DataFrame,
                  batch_size: int) -> DataFrame:
    """Per admitted file: first faulty record, its kind and message, counts of
    records, and the committed-prefix cut (K5). ``read_bytes`` (path, n_bytes)
    counts the bytes of a file's lines; ``io_fault`` says that they are not the
    file's (R4): then no other column is a statement about the file."""
    rank = F.element_at(F.create_map(*sum(([F.lit(k), F.lit(v)] for k, v in FAULT_RANK.items()), [])),
                        F.col("fault"))
    # a number for record and rank, a list for the one header: least structs and greatest
    # strings have no hash aggregate, each task would sort all its records with their text
    per_file = staged.groupBy("path").agg(
        F.min(F.when(F.col("fault").isNotNull(), F.col("record_no") * 8 + rank)).alias("_ff"),
        F.max("record_no").alias("n_records"),
        F.collect_list(F.when(F.col("record_no") == 1, F.col("record"))).alias("_header"))
    ff_rank = F.col("_ff").bitwiseAND(7).cast("int")
    kinds = F.array(*[F.lit(k) for k in sorted(FAULT_RANK, key=FAULT_RANK.get)])
    per_file = per_file.select(
        "path", F.when(F.col("_ff").isNotNull(), F.struct(
            F.shiftright("_ff", 3).alias("record_no"), ff_rank.alias("rank"),
            F.element_at(kinds, ff_rank).alias("kind"))).alias("ff"),
        "n_records", F.array_max("_header").alias("header_text"))
    v = files.join(per_file, "path", "left").join(bom_flags(files), "path", "left").join(
        read_bytes.select("path", F.col("n_bytes").alias("_bytes")), "path", "left")
    # every line is counted with a separator, which the last one may lack; a BOM is not counted
    over = (F.coalesce(F.col("_bytes"), F.lit(0)) + F.when(F.col("bom"), F.lit(3)).otherwise(F.lit(0))
            - F.col("file_size"))
    io_fault = F.col("bom").isNull() | ~over.isin(0, 1)
    bom_hdr = F.coalesce(F.col("bom"), F.lit(False)) & ~F.coalesce(
        (F.col("ff.record_no") == 1) & (F.col("ff.rank") < FAULT_RANK[C.FILE_HEADER]), F.lit(False))
    v = v.withColumn("ff", F.when(bom_hdr, F.struct(F.lit(1).cast("long").alias("record_no"),
                                                    F.lit(FAULT_RANK[C.FILE_HEADER]).alias("rank"),
                                                    F.lit(C.FILE_HEADER).alias("kind"))).otherwise(F.col("ff")))
    v = v.withColumn("header_text", F.when(bom_hdr, F.concat(F.lit("\ufeff"), F.col("header_text")))
                     .otherwise(F.col("header_text")))
    bad = F.col("ff.record_no")
    B = F.lit(batch_size)
    msg = (F.when(F.col("ff.kind") == C.FILE_BAD_UTF8, F.lit("The CSV file must be valid UTF-8."))
           .when(F.col("ff.kind") == C.FILE_OVERSIZE,
                 F.format_string("CSV record %d exceeds the limit of %d characters.", bad, F.col("max_chars")))
           .when(F.col("ff.kind") == C.FILE_SYNTAX, F.lit("Syntactically invalid CSV content."))
           .when(F.col("ff.kind") == C.FILE_HEADER,
                 F.concat(F.lit("Invalid CSV header. Expected [" + ", ".join(C.EXPECTED_HEADER) + "] and received ["),
                          F.array_join(CF.split_fields(F.col("header_text")), ", "), F.lit("].")))
           .when(F.col("n_records").isNull(),
                 F.lit("Invalid CSV header. Expected [" + ", ".join(C.EXPECTED_HEADER) + "] and received []."))
           )
    fault_kind = F.when(F.col("n_records").isNull(), F.lit(C.FILE_HEADER)).otherwise(F.col("ff.kind"))
    bad_row = F.when(F.col("n_records").isNull(), F.lit(1)).otherwise(bad)
    # data records with source_row < cut_row are committed
    cut = F.when(bad_row.isNull(), F.lit(None).cast("long")).otherwise(
        F.floor((bad_row - 2) / B) * B + 2)
    return v.select(
        *files.columns, io_fault.alias("io_fault"),
        fault_kind.alias("fault"), bad_row.alias("bad_record"),
        F.when(fault_kind.isNotNull(), bounded_failure_reason(msg)).alias("failure_reason"),
        F.greatest(F.when(bad_row.isNotNull(), cut).otherwise(F.coalesce(F.col("n_records"), F.lit(1)) + 1),
                   F.lit(2)).cast("long").alias("cut_row"))


# --------------------------------------------------------------------------- driver of the scan
def stage_lines(lines: DataFrame, max_chars: int) -> DataFrame:
    """Pass A, the only pass over the text: per physical line the file
    checks, the record-grammar test and — for the common case where the line
    is the whole record — the header test and the full row ladder."""
    from ledgerline.operators import ladder
    facts = _line_facts(lines, max_chars)
    raw = CF.raw_fields(F.col("value"))
    with_raw = facts.withColumn("_raw", F.when(F.col("complete"), raw))
    classified = ladder.classify(with_raw, "_raw", quoted=True)
    return classified.select(
        "path", "block", "mid", "value", "sep", "utf8_ok", "n_bytes", "u16", "complete",
        F.coalesce(header_ok(F.col("_raw")), F.lit(False)).alias("hdr_ok"),
        "error_code", "transaction_id", "occurred_at", "amount", "category")


def fast_view(lines: DataFrame, summary: DataFrame, bound_ok: bool, max_chars: int) -> DataFrame:
    """Staged lines of fast-path files as records: line = record, numbered
    with the split offsets (a broadcast join of the per-split summary)."""
    s = F.broadcast(summary) if bound_ok else summary
    j = lines.drop("n_bytes").join(s.filter(~F.col("slow")).drop("n_bytes"), ["path", "block"])
    record_no = F.col("mid") - F.col("min_mid") + F.col("line_offset") + 1
    j = j.withColumn("record_no", record_no)
    fault = (F.when(~F.col("utf8_ok"), F.lit(C.FILE_BAD_UTF8))
             .when((F.col("record_no") == 1) & ~F.col("hdr_ok"), F.lit(C.FILE_HEADER)))
    j = j.withColumn("fault", fault)
    data = F.col("fault").isNull() & (F.col("record_no") >= 2)
    return j.select(
        "path", "record_no", F.col("value").alias("record"), "utf8_ok", F.col("u16").cast("long").alias("rec_len"),
        F.lit(False).alias("syntax_bad"), F.lit(max_chars).alias("max_chars"), "fault",
        *[F.when(data, F.col(c)).alias(c) for c in ("error_code", "transaction_id", "occurred_at",
                                                     "amount", "category")])


def stage_records(spark: SparkSession, admitted: DataFrame, staging_path: str,
                  max_chars: int = C.MAX_RECORD_CHARS_DEFAULT) -> "Staged":
    """Scan all admitted files once, number logical records, run the record
    checks and the ladder.

    Pass A writes every line (with its checks and ladder result) to the
    shared folder — the only pass over the text and a lineage cut. The
    per-split summary, the fast-path records and the verdicts then read
    small Parquet columns. Files with multi-line records (rare) re-assemble
    their records from the staged lines, never from the source."""
    # pass A: the text, once
    stage_lines(scan_lines(spark, admitted), max_chars).write.mode("overwrite").parquet(staging_path + "/lines")
    lines = spark.read.parquet(staging_path + "/lines")
    # per-split summary from five small columns -> shared folder (tiny)
    block_summary(lines).write.mode("overwrite").parquet(staging_path + "/summary")
    summary = spark.read.parquet(staging_path + "/summary")
    size = summary.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("path")), F.lit(0)).alias("p"),
                       F.coalesce(F.max(F.col("slow").cast("int")), F.lit(0)).alias("slow")).first()
    bound_ok = size["n"] * (size["p"] + 64) <= BROADCAST_SUMMARY_BYTES
    slow = None
    if size["slow"]:
        s = F.broadcast(summary) if bound_ok else summary
        numbered = (lines.join(s.filter(F.col("slow")).drop("n_bytes"), ["path", "block"])
                    .select("path", "block", "mid", "value", "sep", "utf8_ok", "u16", F.lit(max_chars).alias("max_chars"),
                            F.lit(True).alias("slow"), *CARRIED))
        recs = slow_records(numbered, cut_path=staging_path + "/slowlines", carry=CARRIED) \
            .withColumn("max_chars", F.lit(max_chars))
        single = classified_single_faults(recs.filter(F.col("_single")))
        multi = record_faults(recs.filter(~F.col("_single")).drop(*CARRIED, "_single"))
        single.unionByName(multi).write.mode("overwrite").parquet(staging_path + "/slow")
        slow = spark.read.schema(STAGED_SCHEMA).parquet(staging_path + "/slow")
    return Staged(lines, summary, slow, bound_ok, max_chars)


class Staged:
    """The staged records of a run, whole or a range of record numbers."""

    def __init__(self, lines: DataFrame, summary: DataFrame, slow: DataFrame | None, bound_ok: bool, max_chars: int):
        self.lines, self.summary, self.slow = lines, summary, slow
        self.bound_ok, self.max_chars = bound_ok, max_chars

    def records(self) -> DataFrame:
        fast = fast_view(self.lines, self.summary, self.bound_ok, self.max_chars)
        return fast if self.slow is None else fast.unionByName(self.slow)

    def between(self, first: int, last: int) -> DataFrame:
        """Records ``first`` to ``last`` of every file. Of the staged lines only
        the row groups of splits that hold some are read: ordinals of such
        splits bound the scan (a file's splits lie in order)."""
        end = F.col("line_offset") + F.col("n_lines")
        here = self.summary.filter((F.col("line_offset") < last) & (end >= first))
        span = here.filter(~F.col("slow")).agg(F.min("min_mid").alias("lo"), F.max(F.col("min_mid") + F.col("n_lines"))
                                               .alias("hi")).first()
        lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, 0)
        lines = self.lines.filter((F.col("mid") >= lo) & (F.col("mid") < hi))
        in_range = F.col("record_no").between(first, last)
        fast = fast_view(lines, here, self.bound_ok, self.max_chars).filter(in_range)
        return fast if self.slow is None else fast.unionByName(self.slow.filter(in_range))

    def read_bytes(self) -> DataFrame:
        return self.summary.groupBy("path").agg(F.sum("n_bytes").alias("n_bytes"))


STAGED_SCHEMA = ("path string, record_no long, record string, utf8_ok boolean, rec_len long, "
                 "syntax_bad boolean, max_chars int, fault string, error_code string, "
                 "transaction_id string, occurred_at timestamp, amount decimal(19,2), category string")

"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A node is (rows passed, role state); the states follow ``(s?(ua)+)?`` over role
initials. Edges are the edits: Keep 0, Insert an empty user/assistant row 2,
Rerole to user/assistant 2, Delete 3, and 1 more for a truncated row that stays;
blank and duplicate rows can only be deleted. A forward and a reverse heap meet
in the middle and run on until every crossing of the least cost is settled. Each
letter leads from a node to one other node, so among the cheapest paths the
audit (D, I, K, R in order) that is least in ASCII is found from the left,
letter by letter, over nodes that lead to a crossing.

Rows are sorted by (conversation, turn, ...) over range partitions. A
conversation that lies inside one partition and is no longer than a block is
repaired there. One that a partition's border or the block bound cuts, however
long, goes on by blocks: a block's least cost and audit for every pair of entry
and exit state, the cheapest chain of blocks, then the chosen audits. Inserts
belong to the row they stand before, so no audit of a block is the beginning of
another, and the order of audits in a block decides ties of the whole. Only the
digest of a repaired conversation is one stream in one task, in constant memory.

Defined results: rows of one turn are taken by role, then by the MD5 of the
text; a null role or text is one space, as in the damage key; a null conv_id is
a conversation of its own; a row whose role does not begin with s, u or a (empty
included) is illegal and cannot be kept; a table without rows gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sized, staged, table

#: A block holds at most this many rows and, but for its last row, characters.
BLOCK_ROWS = 2048
BLOCK_CHARS = 1 << 23

SPACES = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
# role states: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FILL = (USER, USER, ASSISTANT, USER)  # the state after the user or assistant row that may follow
FILLER = ("user", "user", "assistant", "user")
CLOSE = ("", "II", "I", "")  # inserts that end a conversation from a state
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Edges = Callable[[int], list[tuple]]


def least_path(source: int, targets: list[int], out: Edges, back: Edges) -> tuple[int, list] | None:
    """Cost and labels of the cheapest path, the least by labels among equals;
    None if no target is reached. ``out(v)`` gives (label, node, cost) by rising
    label, each label once, ``back(v)`` gives (node, cost)."""
    inf = float("inf")
    ahead, behind = {source: 0}, dict.fromkeys(targets, 0)
    done_ahead: set[int] = set()
    done_behind: set[int] = set()
    heap_a, heap_b = [(0, source)], [(0, t) for t in sorted(targets)]
    best = min((0 for t in targets if t == source), default=inf)
    while heap_a and heap_b and heap_a[0][0] + heap_b[0][0] <= best:
        forward = heap_a[0][0] <= heap_b[0][0]
        heap, dist, done, other = ((heap_a, ahead, done_ahead, behind) if forward
                                   else (heap_b, behind, done_behind, ahead))
        d, v = heappop(heap)
        if v in done:
            continue
        done.add(v)
        for edge in (out(v) if forward else back(v)):
            w, c = edge[-2], d + edge[-1]
            if c < dist.get(w, inf):
                dist[w] = c
                heappush(heap, (c, w))
            if c + other.get(w, inf) < best:
                best = c + other[w]
    if best == inf:
        return None
    ends = set(targets)

    def crosses(w: int, c: int) -> bool:
        return (w in done_behind or w in ends) and c + behind[w] == best

    useful = {v for v in done_ahead
              if crosses(v, ahead[v]) or any(crosses(w, ahead[v] + c) for _, w, c in out(v))}
    stack = list(useful)
    while stack:
        v = stack.pop()
        for p, c in back(v):
            if p in done_ahead and p not in useful and ahead[p] + c == ahead[v]:
                useful.add(p)
                stack.append(p)
    labels, v, cost = [], source, 0
    while not (cost == best and v in ends):
        for label, w, c in out(v):
            c += cost
            if crosses(w, c) or (w in useful and ahead[w] == c):
                labels.append(label)
                v, cost = w, c
                break
        else:
            raise RuntimeError("no cheapest path goes on")
    return best, labels


def repair(rows: list[tuple[str, bool, bool]], entry: int = START, exits: tuple[int, ...] = (START, ASSISTANT),
           insert_last: bool = True) -> tuple[int, str] | None:
    """Cost and audit for rows of (role initial, must go, truncated) from the
    state ``entry`` to one of ``exits``. Without ``insert_last`` nothing is
    inserted after the last row."""
    n = len(rows)

    def out(v: int) -> list[tuple]:
        i, q = divmod(v, 4)
        edges = []
        if i < n:
            edges.append(("D", v + 4, DELETE))
        if i < n or insert_last:
            edges.append(("I", i * 4 + FILL[q], INSERT))
        if i < n:
            initial, must_go, truncated = rows[i]
            if not must_go:
                to = STEP.get((q, initial))
                if to is not None:
                    edges.append(("K", (i + 1) * 4 + to, KEEP + TRUNCATED * truncated))
                edges.append(("R", (i + 1) * 4 + FILL[q], REROLE + TRUNCATED * truncated))
        return edges

    def back(v: int) -> list[tuple]:
        i, q = divmod(v, 4)
        edges = []
        if i < n or insert_last:
            edges += [(i * 4 + p, INSERT) for p in range(4) if FILL[p] == q]
        if i:
            initial, must_go, truncated = rows[i - 1]
            edges.append((v - 4, DELETE))
            if not must_go:
                for p in range(4):
                    if STEP.get((p, initial)) == q:
                        edges.append(((i - 1) * 4 + p, KEEP + TRUNCATED * truncated))
                    if FILL[p] == q:
                        edges.append(((i - 1) * 4 + p, REROLE + TRUNCATED * truncated))
        return edges

    found = least_path(entry, [n * 4 + q for q in exits], out, back)
    return None if found is None else (found[0], "".join(found[1]))


def replay(audit: str, initials: list[str], entry: int = START) -> Iterator[tuple[list[str], str, str | None]]:
    """Per row: roles inserted before it, its edit and its new role (None: its
    own); a last entry with the edit '' holds inserts after all rows."""
    q, i, inserted = entry, 0, []
    for edit in audit:
        if edit == "I":
            inserted.append(FILLER[q])
            q = FILL[q]
            continue
        role = None
        if edit == "K":
            q = STEP[q, initials[i]]
        elif edit == "R":
            role, q = FILLER[q], FILL[q]
        yield inserted, edit, role
        inserted, i = [], i + 1
    yield inserted, "", None


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The damaged rows; of a dropped row the ids stay, with ``gone``."""
    conv, turn = df[conv_col].cast("long"), df[turn_col].cast("long")
    named = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)]
    rows = df.select(conv.alias("conv"), turn.alias("turn"), F.coalesce(df[role_col], F.lit(" ")).alias("role"),
                     F.coalesce(df[text_col], F.lit(" ")).alias("text"),
                     (F.crc32(F.concat_ws(":", *named)) % 20).alias("fault"))
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    gone = F.col("fault") == 0
    rows = rows.select("conv", "turn", gone.alias("gone"),
                       F.when(gone, F.lit("")).when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(gone, F.lit("")).otherwise(text).alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    return rows.select("conv", "turn", "gone", "role", "text", (last == "").alias("blank"),
                       (~last.isin(".", "!", "?")).alias("truncated"), F.md5("text").alias("digest"),
                       F.monotonically_increasing_id().alias("key"))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string"
OPEN = "blk long, idx int, gone boolean, turn long, role string, text string, is_blank boolean, is_truncated boolean"


class _Facts:
    """Counts over rows in order."""

    def __init__(self) -> None:
        self.low = self.high = self.initial = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.distinct += 1
            self.high = turn
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not blank and not duplicate
        if self.initial is None:
            self.first = initial
        else:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def _whole(rows: list[tuple]) -> tuple:
    """The result of a conversation from all its rows (turn, role, text, blank,
    truncated), dropped ones left out."""
    facts, seen, lattice = _Facts(), set(), []
    for turn, role, text, blank, truncated in rows:
        duplicate = (role, text) in seen
        seen.add((role, text))
        facts.add(turn, role[:1], blank, duplicate, truncated)
        lattice.append((role[:1], blank or duplicate, truncated))
    cost, audit = repair(lattice)
    lines = []
    for k, (inserted, edit, role) in enumerate(replay(audit, [r[0] for r in lattice])):
        lines += [x + ":" for x in inserted]
        if edit in ("K", "R"):
            lines.append((role or rows[k][1]) + ":" + rows[k][2])
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, digest


def _first_pass(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition: results of conversations that lie inside it,
    numbered rows of the others by block."""
    schema = _arrow(f"conv long, {RESULT}, {OPEN}")
    names = schema.names
    blank_result, blank_open = (None,) * 8, (None,) * 8
    part = TaskContext.get().partitionId()
    none = object()
    conv, rows, chars, is_open, block = none, [], 0, True, 0
    out: list[tuple] = []

    def flush() -> None:  # the held rows become a block
        nonlocal rows, chars, block
        for k, (gone, turn, role, text, blank, truncated) in enumerate(rows):
            out.append((conv, *blank_result, part << 32 | block, k, gone, turn, role, text, blank, truncated))
        rows, chars, block = [], 0, block + 1

    for b in batches:
        for c, turn, gone, role, text, blank, truncated in zip(*(b.column(k).to_pylist() for k in range(7))):
            if conv is none or c != conv:
                if rows and is_open:
                    flush()
                elif rows:
                    out.append((conv, *_whole([r[1:] for r in rows if not r[0]]), *blank_open))
                is_open = conv is none  # the first may have begun in the partition before
                conv, rows, chars = c, [], 0
            elif len(rows) >= block_rows or chars >= BLOCK_CHARS:
                is_open = True
                flush()
            rows.append((gone, turn, role, text, blank, truncated))
            chars += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], names=names)
            out = []
    if rows:  # the last may go on in the next partition
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], names=names)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


BLOCK = ("ck string, conv long, blk long, first string, last string, low long, high long, turns long, blank long, "
         "duplicate long, truncated long, illegal long, initials array<string>, costs array<long>, ranks array<int>, "
         "audits array<string>")


def _block(group: pa.Table) -> pa.Table:
    """Facts of a block, and for every entry and exit state its least cost, its
    audit and that audit's rank among those of the entry."""
    rows = sorted(group.select(["idx", "gone", "turn", "role", "is_blank", "duplicate", "is_truncated"]).to_pylist(),
                  key=lambda r: r["idx"])
    facts, lattice = _Facts(), []
    for r in rows:
        if not r["gone"]:
            facts.add(r["turn"], r["role"][:1], r["is_blank"], r["duplicate"], r["is_truncated"])
            lattice.append((r["role"][:1], r["is_blank"] or r["duplicate"], r["is_truncated"]))
    costs: list = []
    audits: list = []
    ranks: list = []
    for q in range(4):
        found = [repair(lattice, q, (to,), False) for to in range(4)]
        order = sorted({f[1] for f in found if f})
        costs += [f[0] if f else None for f in found]
        audits += [f[1] if f else None for f in found]
        ranks += [order.index(f[1]) if f else None for f in found]
    one = {"ck": group["ck"][0].as_py(), "conv": group["conv"][0].as_py(), "blk": group["blk"][0].as_py(),
           "first": facts.first, "last": facts.initial, "low": facts.low, "high": facts.high, "turns": facts.distinct,
           "blank": facts.blank, "duplicate": facts.duplicate, "truncated": facts.truncated, "illegal": facts.illegal,
           "initials": [r[0] for r in lattice], "costs": costs, "ranks": ranks, "audits": audits}
    return pa.Table.from_pylist([one], schema=pa.schema(
        [("ck", pa.string()), ("conv", pa.int64()), ("blk", pa.int64()), ("first", pa.string()), ("last", pa.string())]
        + [(n, pa.int64()) for n in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
        + [("initials", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
           ("audits", pa.list_(pa.string()))]))


CHAIN = ("ck string, blk long, entry int, leave int, is_last boolean, conv long, gaps long, blank long, duplicate long, "
         "truncated long, illegal long, cost long")


def _chain(group: pa.Table) -> pa.Table:
    """The cheapest chain of a conversation's blocks; facts on its last row."""
    blocks = sorted(group.to_pylist(), key=lambda r: r["blk"])
    n = len(blocks)

    def out(v: int) -> list[tuple]:
        i, q = divmod(v, 4)
        if i >= n:
            return [(0, 4 * n + 4, INSERT * len(CLOSE[q]))] if i == n else []
        b = blocks[i]
        return sorted((b["ranks"][4 * q + to], 4 * i + 4 + to, b["costs"][4 * q + to])
                      for to in range(4) if b["costs"][4 * q + to] is not None)

    def back(v: int) -> list[tuple]:
        i, q = divmod(v, 4)
        if i > n:
            return [(4 * n + p, INSERT * len(CLOSE[p])) for p in range(4)]
        if not i:
            return []
        costs = blocks[i - 1]["costs"]
        return [(4 * i - 4 + p, costs[4 * p + q]) for p in range(4) if costs[4 * p + q] is not None]

    cost, labels = least_path(START, [4 * n + 4], out, back)
    path, v = [START], START
    for label in labels[:-1]:
        v = next(w for x, w, _ in out(v) if x == label)
        path.append(v % 4)
    low = high = last = None
    gaps = illegal = 0
    for b in blocks:
        if b["low"] is not None:
            low = b["low"] if low is None else low
            gaps -= b["turns"] - (b["low"] == high)
            high = b["high"]
        illegal += b["illegal"]
        if b["first"] is not None:
            illegal += last is not None and last + b["first"] not in LEGAL
            last = b["last"]
    facts = {"conv": blocks[0]["conv"], "gaps": 0 if low is None else high - low + 1 + gaps, "illegal": illegal, "cost": cost,
             **{k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated")}}
    rows = [{"ck": b["ck"], "blk": b["blk"], "entry": path[k], "leave": path[k + 1], "is_last": k == n - 1,
             **(facts if k == n - 1 else {"conv": b["conv"]})} for k, b in enumerate(blocks)]
    return pa.Table.from_pylist(rows, schema=pa.schema(
        [("ck", pa.string()), ("blk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("is_last", pa.bool_()),
         *[(n, pa.int64()) for n in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]]))


def _actions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per kept-on row of a block (dropped ones not counted): inserted lines
    before it, its edit, its new role; after a last block the closing inserts."""
    for b in batches:
        out = []
        for ck, blk, entry, leave, is_last, initials, audit in zip(*(b.column(k).to_pylist() for k in range(7))):
            for k, (inserted, edit, role) in enumerate(replay(audit, initials, entry)):
                before = "\n".join(x + ":" for x in inserted) or None
                if edit:
                    out.append((ck, blk, k, before, edit, role))
            if is_last and CLOSE[leave]:
                tail, q = [], leave
                for _ in CLOSE[leave]:
                    tail.append(FILLER[q] + ":")
                    q = FILL[q]
                out.append((ck, blk, 1 << 30, "\n".join(tail), "", None))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))],
            names=["ck", "blk", "nth", "before", "edit", "as_role"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by conversation and place: a running SHA-256."""
    ck, digest, started = None, None, False
    out: list[tuple] = []
    for b in batches:
        for c, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if c != ck:
                if ck is not None:
                    out.append((ck, digest.hexdigest()))
                ck, digest, started = c, hashlib.sha256(), False
            if line is not None:
                digest.update(("\n" + line if started else line).encode())
                started = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["ck", "sha256"])
            out = []
    if ck is not None:
        yield pa.RecordBatch.from_arrays([pa.array([ck]), pa.array([digest.hexdigest()])], names=["ck", "sha256"])


def _open_results(rows: DataFrame) -> DataFrame:
    """Results of the conversations whose rows lie in several blocks."""
    rows = rows.select(F.coalesce(F.col("conv").cast("string"), F.lit("null")).alias("ck"), "conv",
                       *[x.split()[0] for x in OPEN.split(", ")])
    said = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    first = cut(rows.filter(~F.col("gone")).groupBy(F.col("ck").alias("f_ck"), said.alias("f_said"))
                .agg(F.min(F.struct("blk", "idx")).alias("f_at")))
    marked = rows.select("ck", "conv", "blk", "idx", "gone", "turn", "role", "is_blank", "is_truncated", said.alias("said")).join(
        sized(first), (F.col("ck") == F.col("f_ck")) & (F.col("said") == F.col("f_said")), "left")
    marked = marked.withColumn("duplicate", F.coalesce(F.struct("blk", "idx") != F.col("f_at"), F.lit(False)))
    blocks = cut(marked.drop("said", "f_ck", "f_said", "f_at").groupBy("blk", "ck").applyInArrow(_block, BLOCK))
    chain = cut(blocks.drop("audits", "initials").groupBy("ck").applyInArrow(_chain, CHAIN))
    c = chain.select(F.col("ck").alias("c_ck"), F.col("blk").alias("c_blk"), "entry", "leave", "is_last")
    chosen = cut(blocks.join(c, (F.col("ck") == F.col("c_ck")) & (F.col("blk") == F.col("c_blk"))).select(
        "ck", "blk", "entry", "leave", "is_last", "initials",
        F.element_at("audits", F.col("entry") * 4 + F.col("leave") + 1).alias("audit")))
    acts = chosen.mapInArrow(_actions, "ck string, blk long, nth int, before string, edit string, as_role string")
    acts = cut(acts)
    # idx counts dropped rows, nth does not
    nth = F.sum((~F.col("gone")).cast("int")).over(Window.partitionBy("ck", "blk").orderBy("idx")) - 1
    numbered = rows.select("ck", "blk", "gone", "role", "text", nth.cast("int").alias("nth"))
    a = acts.filter(F.col("edit") != "").select(F.col("ck").alias("a_ck"), F.col("blk").alias("a_blk"),
                                                F.col("nth").alias("a_nth"), "before", "edit", "as_role")
    kept = F.when(F.col("edit").isin("K", "R"),
                  F.concat(F.coalesce("as_role", "role"), F.lit(":"), F.col("text")))
    line = F.concat_ws("\n", "before", kept)
    either = F.col("before").isNotNull() | kept.isNotNull()
    lines = numbered.filter(~F.col("gone")).join(
        a, (F.col("ck") == F.col("a_ck")) & (F.col("blk") == F.col("a_blk")) & (F.col("nth") == F.col("a_nth"))).select(
        "ck", F.when(either, line).alias("line"), "blk", "nth")
    lines = lines.unionByName(acts.filter("edit = ''").select("ck", F.col("before").alias("line"), "blk", "nth"))
    lines = lines.unionByName(chosen.filter("is_last").select(  # a conversation without lines has a digest too
        "ck", F.lit(None).cast("string").alias("line"), "blk", F.lit((1 << 30) + 1).alias("nth")))
    digests = cut(lines.repartition("ck").sortWithinPartitions("ck", "blk", "nth").select("ck", "line").mapInArrow(
        _digests, "ck string, sha256 string"))
    closing = F.element_at(F.array(*[F.lit(x) for x in CLOSE]), F.col("leave") + 1)
    audits = chosen.groupBy("ck").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "audit"))),
                                          lambda x: x["audit"]), ""),
                 F.max(F.when(F.col("is_last"), closing))).alias("audit"))
    facts = chain.filter("is_last").select(
        F.col("ck").alias("l_ck"), "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = facts.join(audits, F.col("l_ck") == F.col("ck")).drop("ck")
    return joined.join(digests, F.col("l_ck") == F.col("ck")).select(
        "conv", *[x.split()[0] for x in RESULT.split(", ")])


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv and the columns of RESULT for every conversation of ``rows`` (see
    ``damage``)."""
    order = ["conv", "turn", "role", "digest", "key"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    done = staged(ranged.select("conv", "turn", "gone", "role", "text", "blank", "truncated").mapInArrow(
        lambda batches: _first_pass(batches, block_rows), f"conv long, {RESULT}, {OPEN}"), "repair")
    names = [x.split()[0] for x in RESULT.split(", ")]
    return done.filter("blk is null").select("conv", *names).unionByName(_open_results(done.filter("blk is not null")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(damage(table(spark, sf_dir, "conversations")))
    return found.withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})

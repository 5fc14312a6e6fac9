"""Near-duplicate classes by Order MinHash.

1. Every document becomes its set of five-word shingles, equal shingles
   labelled by occurrence (a document of one to four words is one shingle of
   all its words). ``SKETCHES`` times the ``TUPLE`` labelled shingles with the
   smallest hashes are taken and hashed in the order they have in the text, so
   that texts which agree in content and order share sketches.
2. Texts of the same word sequence are one node (copies are never expanded).
   Nodes that share a sketch stand in one bucket. In each bucket a
   representative is compared with the others: the node with the largest
   buckets first, so that the middle of a group of copies is found at once.
   Only the pair (representative, other) is ever made, never all pairs.
3. A candidate pair must agree in ``AGREE`` sketch and in length; then a
   banded alignment of the labelled shingles (longest common subsequence
   inside a band that is wide enough for any pair at the threshold) gives
   shared / (all - shared) >= 0.8.
4. Verified links are contracted to components. A bucket whose members are
   all in one component is done. In the others, the members outside the main
   component meet the members of other components in blocks of ``BLOCK`` by
   ``BLOCK`` rows inside the tasks: first by sketches, then, for rows that
   still have a likely partner, by shared shingles and alignment. Only links
   that join two components leave a block. Nothing is capped.

Chance that a pair just at the threshold is missed, that is none of 16 sketches
agrees: with s of n shingles shared a sketch agrees with C(s, 3) / C(n, 3), so
3e-4 for 4 of 5 shingles, 4e-5 for 8 of 10, 1e-5 for long texts.

Defined results: null and empty texts, and texts of white space, have no
shingles and are each a class of their own; equal word sequences are always
one class; the class id is the smallest id in the class, nulls last. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import common as K
from ledgerline.llm.common import cut, fresh, keep_one, mix, sized, staged, table
from ledgerline.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
TUPLE = 3
AGREE = 1
#: Rows on each side of a block.
BLOCK = 512
_BASE2 = 0xD1342543DE82EF95


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE):
    """(labelled shingle keys in text order, shingles before each row,
    word sequence digests as 16 bytes a row, words of each row)."""
    s, e, first = K.words(data, offs)
    wh = K.word_hashes(data, s, e)
    n = np.diff(first)
    sums, sums2 = K.prefix_sums(wh), K.prefix_sums(wh, _BASE2)
    node = np.empty((len(n), 2), dtype=">u8")
    node[:, 0] = K.span_hash(sums, first[:-1], first[1:])
    node[:, 1] = K.span_hash(sums2, first[:-1], first[1:], _BASE2)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    before = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    lo = first[:-1][row] + np.arange(before[-1]) - before[:-1][row]
    key = K.span_hash(sums, lo, np.minimum(lo + k, first[1:][row]))
    # occurrence labels: rank among equal shingles of the same row
    order = np.lexsort((key, row)) if len(n) > 1 else np.argsort(key, kind="stable")
    sk, sr = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (sk[1:] != sk[:-1]) | (sr[1:] != sr[:-1])
    at = np.arange(len(key))
    occ = np.empty(len(key), dtype=np.uint64)
    occ[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(key + occ * np.uint64(0x9E3779B97F4A7C15)), before, node, n


def sketches(keys: np.ndarray, before: np.ndarray, m: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """For every row with shingles, m hashes of its ``size`` smallest keys in
    text order. Rows without shingles are left out."""
    live = np.flatnonzero(np.diff(before))
    lo = before[:-1][live]
    out = np.empty((len(live), m), dtype=np.uint64)
    if not len(live):
        return out
    big = np.uint64(0xFFFFFFFFFFFFFFFF)
    count = np.diff(before)[live]
    seg = np.repeat(np.arange(len(live)), count)
    for j in range(m):
        v = mix(keys, 0x632BE59BD9B4E019 * (j + 1))
        at = np.empty((size, len(live)), dtype=np.int64)
        for t in range(size):
            least = np.minimum.reduceat(v, lo)
            hit = np.flatnonzero(v == least[seg])
            hseg = seg[hit]
            head = np.ones(len(hit), dtype=bool)
            head[1:] = hseg[1:] != hseg[:-1]
            at[t] = hit[head]
            v[at[t]] = big
        # rows with fewer shingles repeat positions; sorted they still agree
        short = count[None, :] <= np.arange(size)[:, None]
        at = np.where(short, at[0][None, :], at)
        at.sort(axis=0)
        h = np.zeros(len(live), dtype=np.uint64)
        for t in range(size):
            h = mix(h * np.uint64(31) + keys[at[t]], j + 1)
        out[:, j] = h
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in K.text_slices(b.column(1), K.STAGE_SLICE_BYTES):
            keys, before, node, _ = shingles(data, offs)
            n = np.diff(before)
            sk = np.zeros((hi - lo, SKETCHES), dtype=np.uint64)
            sk[n > 0] = sketches(keys, before)
            flat = pa.array(sk.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sk.size + 1, SKETCHES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in node], pa.binary()),
                 pa.array(n.astype(np.int64)), lists, b.column(2).slice(lo, hi - lo)],
                names=["id", "node", "n", "sk", "t"])


def _body_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled shingle keys (32 bits each) of each text."""
    for b in batches:
        for _, hi, data, offs in K.text_slices(b.column(0), K.STAGE_SLICE_BYTES):
            keys, before, node, _ = shingles(data, offs)
            short = keys.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in node], pa.binary()),
                 pa.array([short[before[i]:before[i + 1]].tobytes() for i in range(len(node))], pa.binary())],
                names=["node", "body"])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two texts by banded alignment of their labelled
    shingles. The keys are distinct within a text, so the alignment is the
    longest increasing run of matched positions. At the threshold at most
    ``slack`` shingles stay unmatched, which bounds every shift: the band."""
    slack = int((len(a) + len(b)) * (1 - similarity) / (1 + similarity)) + 1
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa], b[ob]
    j = np.searchsorted(sb, sa)
    j[j == len(sb)] = 0
    hit = sb[j] == sa
    i, j = oa[hit], ob[j[hit]]
    band = np.abs(i - j) <= slack
    i, j = i[band], j[band]
    order = np.argsort(i, kind="stable")
    j = j[order]
    if len(j) > 1 and not np.all(j[1:] > j[:-1]):
        from bisect import bisect_left
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            if p == len(tails):
                tails.append(x)
            else:
                tails[p] = x
        shared = len(tails)
    else:
        shared = len(j)
    return shared / max(1, len(a) + len(b) - shared)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [[np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in b.column(c)] for c in (2, 3)]
        keep = [i for i, (x, y) in enumerate(zip(*bodies)) if aligned(x, y) >= SIMILARITY]
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the alignment; skewed sides are split by the
    adaptive join, as no grouping follows."""
    both = (pairs.join(bodies.withColumnRenamed("node", "a").withColumnRenamed("body", "body_a"), "a")
            .join(bodies.withColumnRenamed("node", "b").withColumnRenamed("body", "body_b"), "b")
            .select("a", "b", "body_a", "body_b"))
    return cut(both.mapInArrow(_verify_batches, "a binary, b binary"))


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs that can reach the threshold by length and share enough sketches."""
    a = sigs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sk").alias("sk_a"))
    b = sigs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sk").alias("sk_b"))
    agree = F.aggregate(F.zip_with("sk_a", "sk_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    fits = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").filter(fits & (agree >= AGREE)).select("a", "b")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading key columns, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], axis=1)
        at = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *at.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            here = tuple(k[lo])
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block (bucket, mb, qb, j, query, node, comp, n, sk) the rows
    that have a likely partner there. A pair counts in the first sketch that
    it shares, so that it is looked at once."""
    out: list[pa.Table] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out.clear()

    for g in _groups(batches, 3):
        query = np.asarray(g.column("query").to_numpy(), dtype=bool)
        if query.all() or not query.any():
            continue
        sk = g.column("sk").combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
        comp, n = g.column("comp").to_numpy(), g.column("n").to_numpy().astype(np.float64)
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        eq = sk[q][:, None, :] == sk[m][None, :, :]
        ok = (eq.sum(axis=2) >= AGREE) & (eq.argmax(axis=2) == g.column("j")[0].as_py())
        ok &= comp[q][:, None] != comp[m][None, :]
        ok &= np.minimum(n[q][:, None], n[m][None, :]) >= SIMILARITY * np.maximum(n[q][:, None], n[m][None, :])
        keep = np.concatenate((q[ok.any(axis=1)], m[ok.any(axis=0)]))
        if len(keep):
            out.append(g.select(["bucket", "mb", "qb", "query", "node", "comp"]).take(pa.array(keep)))
            rows += len(keep)
            if rows >= 4096:
                yield from flush()
                rows = 0
    yield from flush()


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, from blocks (bucket, mb, qb, query, node,
    comp, body): shared shingles bound the similarity from above, then the
    alignment decides."""
    a_out: list[bytes] = []
    b_out: list[bytes] = []
    for g in _groups(batches, 3):
        query = np.asarray(g.column("query").to_numpy(), dtype=bool)
        if query.all() or not query.any():
            continue
        bodies = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in g.column("body")]
        nodes, comp = g.column("node").to_pylist(), g.column("comp").to_pylist()
        sizes = np.array([len(x) for x in bodies])
        vocab, ix = np.unique(np.concatenate(bodies), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        m = np.flatnonzero(~query)
        flat = np.concatenate([ix[starts[i]:starts[i + 1]] for i in m])
        m_starts = np.concatenate(([0], np.cumsum(sizes[m])[:-1]))
        parent = {c: c for c in comp}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for q in np.flatnonzero(query):
            flag = np.zeros(len(vocab), dtype=np.int32)
            flag[ix[starts[q]:starts[q + 1]]] = 1
            both = np.add.reduceat(flag[flat], m_starts)
            near = both >= SIMILARITY * (sizes[q] + sizes[m] - both)
            for i in m[near]:
                if find(comp[q]) != find(comp[i]) and aligned(bodies[q], bodies[i]) >= SIMILARITY:
                    parent[find(comp[q])] = find(comp[i])
                    a_out.append(nodes[q])
                    b_out.append(nodes[i])
    yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], names=["a", "b"])


def _joining_links(members: DataFrame, comp: DataFrame, sigs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links between different components of ``comp`` inside buckets."""
    open_ = staged(members.select("bucket", "j", "node").join(comp, "node", "left")
                   .select("bucket", "j", "node", F.coalesce("label", "node").alias("label")), "omh-open")
    sizes = open_.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = cut(sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("parts"),
                                           F.sum("n").alias("size"))
               .filter("parts > 1").select("bucket", F.col("main.label").alias("main"), "size",
                                           (F.col("size") - F.col("main.n")).alias("others")))
    rows = open_.join(main, "bucket").withColumns({
        "nb": F.ceil(F.col("size") / BLOCK).cast("long"), "nq": F.ceil(F.col("others") / BLOCK).cast("long")})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    slot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    common = ["bucket", "j", "node", F.xxhash64("label").alias("comp")]
    as_member = rows.select(*common, F.lit(0).alias("query"), slot("nb", 1).alias("mb"), every("nq").alias("qb"))
    as_query = rows.filter("label <> main").select(*common, F.lit(1).alias("query"), every("nb").alias("mb"),
                                                   slot("nq", 2).alias("qb"))
    key = ["bucket", "mb", "qb"]
    both = as_member.unionByName(as_query).join(sigs, "node")
    both = both.select(*key, "j", "query", "node", "comp", "n", "sk").repartition(*key).sortWithinPartitions(*key)
    likely = staged(both.mapInArrow(_likely_rows, "bucket long, mb long, qb long, query int, node binary, comp long"),
                    "omh-likely")
    full = likely.join(bodies, "node").select(*key, "query", "node", "comp", "body")
    full = full.repartition(*key).sortWithinPartitions(*key)
    return cut(full.mapInArrow(_block_links, "a binary, b binary"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, class_id, class_size, no_words, label, t) for each row of
    ``docs``; label names the class, t is a hash of the text."""
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"),
                        F.xxhash64(docs[text_col]).alias("t"))
    rows = staged(texts.mapInArrow(_sketch_batches, "id long, node binary, n long, sk array<long>, t long"), "omh")
    sigs = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sk").alias("sk"))
    sk = sigs.select("node", F.posexplode("sk").alias("j", "h")).select(
        F.xxhash64("j", "h").alias("bucket"), "j", "node")
    # small sides are stored before a join, so that the adaptive join can split a hot bucket
    sk = staged(sk, "omh-sketches")
    shared = cut(sk.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    members = staged(sk.join(shared, "bucket"), "omh-buckets")
    weight = members.groupBy("node").agg(F.sum("size").alias("w"))
    members = staged(members.join(weight, "node").select("bucket", "j", "node", "w"), "omh-members")
    near = members.select("node").distinct()
    sigs = staged(sigs.join(near, "node", "left_semi"), "omh-sigs")
    texts = docs.select(docs[text_col].alias("text")).mapInArrow(_body_batches, "node binary, body binary")
    bodies = staged(texts.join(sized(sigs.select("node")), "node", "left_semi").dropDuplicates(["node"]), "omh-bodies")

    # first round: every node against the heaviest representative of its buckets
    star = cut(members.groupBy("bucket").agg(F.max(F.struct("w", "node")).alias("rep")))
    pairs = (members.join(star, "bucket").filter("node <> rep.node").groupBy(F.col("node").alias("b"))
             .agg(F.max("rep").alias("rep")).select(F.col("rep.node").alias("a"), "b"))
    links = _verified(_likely(pairs, sigs), bodies)
    comp = components(links)
    more = _joining_links(members, comp, sigs, bodies)
    if not more.isEmpty():
        comp = components(links.union(more))
    named = rows.select("id", "node", "n", "t").join(comp, "node", "left")
    # rows without words stay alone: their class is their own id
    named = cut(named.withColumn("label", F.coalesce("label", "node")))
    lead = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    classes = cut(named.filter("n > 0").groupBy(F.col("label").alias("c_label")).agg(
        lead.alias("lead"), F.count("*").alias("size")))
    out = named.join(classes, (F.col("label") == F.col("c_label")) & (F.col("n") > 0), "left")
    return out.select("id", "node", F.when(F.col("n") > 0, F.col("lead.id")).otherwise(F.col("id")).alias("class_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
                      (F.col("n") == 0).alias("no_words"), "label", "t")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class stays (smallest id, then smallest hash of text and
    row); rows without words all stay. All columns are kept."""
    found = staged(near_classes(docs, id_col, text_col).filter("class_size > 1").select("label", "id", "t"), "omh-found")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "t")
    lead = cut(found.groupBy(F.col("label").alias("l_label")).agg(F.min(first).alias("lead")))
    per = found.groupBy("label", "id", "t").agg(F.count("*").alias("n")).join(lead, F.col("label") == F.col("l_label"))
    stays = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("t") == F.col("lead.t"))
    per = staged(per.select(F.col("id").alias("g_id"), F.col("t").alias("g_t"), "n", stays.alias("stays")), "omh-per")
    gone = cut(per.filter("not stays").select("g_id", "g_t"))
    # rows are told apart by id and text, so that a null id is no identity
    key = fresh(docs, "t")
    keyed = docs.withColumn(key, F.xxhash64(docs[text_col]))
    same = keyed[id_col].eqNullSafe(F.col("g_id")) & (keyed[key] == F.col("g_t"))
    rest = keyed.join(sized(gone), same, "left_anti")
    twice = cut(per.filter("stays and n > 1").select("g_id", "g_t"))
    return keep_one(rest, twice, {id_col: "g_id", key: "g_t"}).drop(key)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size",
                        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))

"""N-gram Jaccard self-join over a token-group matrix.

A document is the set of its distinct word shingles (tokens). Documents with
equal sets are one node. Similar nodes are partitioned into groups of bounded
size; for each group the union of its members' tokens is the group's row of the
matrix. A node that meets a group is first bounded by its overlap with that
union, and the group is opened only if a member could reach the threshold.

Which groups meet follows from the rarest tokens. All documents count their
tokens once, in ranges of the token space (``census``), and each document's
tokens are put in one order for all, rare ones first. A token that no other
document has links nothing and is never indexed. If x and y are linked, then
their first common token in that order stands at a place i of x with
n_x - i >= |x & y|, so it can only be linked with sets of up to
(n_x - i) (1 + t) / t - n_x tokens (``cap``), and with none below t n_x. Tokens
for which that range is empty are left out; a passage that many documents share
stands at the end of the order and does not bring them together. No link is lost.

Links that are implied by links found before are not looked for again: groups
are linked inside first, then their leaders with the first group of their kind,
and only groups of different components meet afterwards. So a family of near
copies costs comparisons in proportion to its size. A family whose members share
most tokens and yet stay below the threshold pair by pair still has to be
compared group by group.

A null doc_id or an empty set is linked with nothing. Rows that repeat a doc_id
are rows of their own. Texts are read whole. An empty table gives no rows. Sets
are compared by 64-bit hashes of their shingles. ``docs`` is read more than once
and has to be a stored table, not a random computation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from ._common import flat_bytes, materialise, mix, pieces, release, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Params:
    """Shingles of ``words`` words; a link where 100 * intersection >= ``percent`` * union.

    The others change only the cost, never the links: ``group`` nodes and ``group_tokens``
    tokens at most in a group (one longer document is a group of its own), components below
    ``pooled`` nodes share groups, ``chunk_bytes`` of text are counted at a time, a group of
    the census counts the tokens of about ``range_bytes`` of text (of up to
    ``most_range_bytes`` where there are many, so that a chunk has more than a token or
    two for each), and up to ``broadcast_rows`` counted ids are broadcast to fetch texts.
    """

    words: int = 5
    percent: int = 80
    group: int = 256
    group_tokens: int = 500_000
    pooled: int = 64
    chunk_bytes: int = 4 << 20
    range_bytes: int = 8 << 20
    most_range_bytes: int = 128 << 20
    broadcast_rows: int = 1_000_000


def token_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted 64-bit tokens of each text."""
    data, offsets = flat_bytes(texts)
    for i, j in pieces(offsets):
        hashes, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            own = hashes[at[k] : at[k + 1]]
            yield np.unique(shingle_hashes(own, min(words, len(own)))) if len(own) else own


def set_hash(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(flat.astype(np.int64, copy=False)))


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(t.values).view(np.uint64) for t in column.combine_chunks()] if len(column) else []


# --- the census of tokens

_PARTS = "abcdef"
_ROW = "kind int, place long, " + ", ".join(f"{c} binary" for c in _PARTS)


def _row(to: int, chunk: int, kind: int, place: int, *parts: np.ndarray) -> dict:
    return {"to": to, "chunk": chunk, "kind": kind, "place": place} | {c: x.tobytes() for c, x in zip(_PARTS, parts, strict=False)}


def _table(rows: list[dict], *names: str) -> pa.RecordBatch:
    whole = [*names, "kind", "place", *_PARTS]
    kinds = {"kind": pa.int32()} | dict.fromkeys(_PARTS, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.int64())) for c in whole], names=whole)


def _count_out(p: Params, ranges: int):
    """Each chunk of documents sends its tokens to the ranges, and what it need not ask for to itself."""
    words, most = p.words, p.chunk_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0), np.int64))))
            for i, j in ((s, min(s + 32768, j)) for i, j in pieces(offsets, most) for s in range(i, j, 32768)):
                b = whole.slice(i, j - i)
                valid = np.asarray(b.column(0).is_valid())
                sets = list(token_sets(b.column(1), words))
                n = np.array([len(s) for s in sets], np.uint32)
                node = np.array([set_hash(s) if len(s) else 0 for s in sets], np.int64)
                token = np.concatenate([s for s, ok in zip(sets, valid, strict=True) if ok] or [np.zeros(0, np.uint64)])
                doc = np.repeat(np.arange(len(sets), dtype=np.uint16)[valid], n[valid])
                key = ((((token >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(key)))
                again = np.repeat(count > 1, count)
                ids = np.asarray(b.column(0).fill_null(0)).astype(np.int64)
                rows = [_row(-1 - chunk, chunk, 1, 0, ids, n, node, valid.astype(np.uint8), key[again], doc[again])]
                one, many = first[count == 1], first[count > 1]
                place = (key >> np.uint64(32)).astype(np.int64)
                left = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for r in np.unique(place):
                    s = one[slice(*np.searchsorted(place[one], [r, r + 1]))]
                    m = many[slice(*np.searchsorted(place[many], [r, r + 1]))]
                    c = count[count > 1][slice(*np.searchsorted(place[many], [r, r + 1]))]
                    rows.append(_row(int(r), chunk, 0, int(r), left[s], doc[s], left[m], c.astype(np.uint32)))
                yield _table(rows, "to", "chunk")
                chunk += 1

    return run


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin."""
    arrays = [np.frombuffer(x, kind) if x else np.zeros(0, kind) for x in column.to_pylist()]
    return np.concatenate(arrays or [np.zeros(0, kind)]), np.cumsum([0, *(len(x) for x in arrays)])


def _answer(table: pa.Table) -> pa.Table:
    """One range counts its tokens; each chunk learns how common those are that occur more than once.

    A chunk asks for a token once, so even a token of all documents is counted here once a chunk.
    """
    if table["kind"][0].as_py() == 1:
        return table.drop_columns(["to"])
    chunks, place = table["chunk"].to_pylist(), table["place"][0].as_py()
    (one, at), (doc, _), (many, many_at), (times, _) = (_joined(table[c], k) for c, k in zip("abcd", (np.uint32, np.uint16, np.uint32, np.uint32), strict=True))
    left, inverse = np.unique(np.concatenate((one, many)), return_inverse=True)
    df = np.bincount(inverse, np.concatenate((np.ones(len(one)), times)), len(left))
    common = np.minimum(255, 8 * np.log2(np.maximum(df, 1)) + 1).astype(np.uint8)[inverse]
    shared = (df >= 2)[inverse]
    rows = []
    for k, chunk in enumerate(chunks):
        s, m = slice(at[k], at[k + 1]), slice(many_at[k], many_at[k + 1])
        kept, level = shared[s], common[len(one) :][m]
        if kept.any() or len(level):
            rows.append(_row(0, chunk, 2, place, one[s][kept], doc[s][kept], common[s][kept], many[m], level))
    return pa.Table.from_batches([_table(rows, "chunk")])


def _heads(p: Params):
    """A chunk's documents with the tokens that index them, rare ones first."""
    percent = p.percent

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.equal(table["kind"], 1))
        ids, n, node, valid, key, doc = (_joined(own[c], k)[0] for c, k in zip("abcdef", (np.int64, np.uint32, np.int64, np.uint8, np.uint64, np.uint16), strict=True))
        told = table.filter(pc.equal(table["kind"], 2))
        place = np.asarray(told["place"].to_numpy(), np.uint64) << np.uint64(32)
        (one, at), (one_doc, _), (level, _), (many, many_at), (many_level, _) = (_joined(told[c], k) for c, k in zip("abcde", (np.uint32, np.uint16, np.uint8, np.uint32, np.uint8), strict=True))
        one = one | np.repeat(place, np.diff(at))
        many = many | np.repeat(place, np.diff(many_at))
        order = np.argsort(many)
        many, many_level = many[order], many_level[order]
        if len(key):
            level = np.concatenate((level, many_level[np.searchsorted(many, key)]))
        key, doc = np.concatenate((one, key)), np.concatenate((one_doc, doc)).astype(np.int64)
        order = np.lexsort((key, level, doc))
        key, doc = key[order], doc[order]
        shared = np.bincount(doc, minlength=len(ids))
        size = n.astype(np.int64)
        rank = np.arange(len(key)) - np.repeat(np.cumsum(shared) - shared, shared)
        rest = shared[doc] - rank  # of the document's tokens, those from this place on
        cap = rest * (100 + percent) // percent - size[doc]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
        kept = fresh & (100 * cap >= percent * size[doc])
        counts = np.bincount(doc[kept], minlength=len(ids))
        some = pa.array(size > 0)
        null = pa.scalar(None, pa.int64())
        return pa.table(
            {
                "doc_id": pc.if_else(pa.array(valid.astype(bool)), pa.array(ids), null),
                "n_shingles": pa.array(size),
                "node": pc.if_else(some, pa.array(node), null),
                "head": _lists(key[kept].view(np.int64), counts),
                "cap": _lists(cap[kept], counts),
            }
        )

    return run


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set), head (the tokens that index the set), cap (for each, the largest set it can be linked with)."""
    texts = docs.select("doc_id", "text")
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(-(-bytes_ // p.range_bytes), 4096 + bytes_ // p.most_range_bytes))
    out = texts.mapInArrow(_count_out(p, ranges), f"to long, chunk long, {_ROW}")
    census = materialise(out.groupBy("to").applyInArrow(_answer, f"chunk long, {_ROW}"), "jaccard-census")
    heads = materialise(census.groupBy("chunk").applyInArrow(_heads(p), "doc_id long, n_shingles long, node long, head array<long>, cap array<long>"), "jaccard-sketch")
    release(census)
    return heads


# --- groups

def _tokens_of(docs: DataFrame, wanted: DataFrame, p: Params, columns: str) -> DataFrame:
    """``columns`` of ``wanted`` (doc_id, node, ...) with the node's tokens, from the text of one of its documents."""
    words, names = p.words, [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = list(token_sets(b.column(0), words))
                node = b.column(1).to_pylist()
                same = pa.array([len(t) > 0 and set_hash(t) == k for t, k in zip(sets, node, strict=True)])  # a repeated doc_id may have another text
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                out = pa.RecordBatch.from_arrays([*b.columns[1:], _lists(flat.view(np.int64), np.array([len(t) for t in sets], np.int64))], names=[*names, "tokens"])
                yield out.filter(same)

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("text", *names).mapInArrow(run, f"{columns}, tokens array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``, a block of tokens at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat_a, flat_b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    both = np.intersect1d(flat_a, flat_b)
    if not len(both):
        return out

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[col] == flat
        row, col = row[hit], col[hit]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    (row_a, col_a), (row_b, col_b) = places(flat_a, a), places(flat_b, b)
    for low in range(0, len(both), block):
        parts = []
        for row, col, size in ((row_a, col_a, len(a)), (row_b, col_b, len(b))):
            s = slice(*np.searchsorted(col, [low, low + block]))
            m = np.zeros((size, min(block, len(both) - low)), np.float32)
            m[row[s], col[s] - low] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``a`` are linked with which of ``b``. The matrix row of ``b`` decides which sets of ``a`` open it."""
    out = np.zeros((len(a), len(b)), bool)
    if not a or not b:
        return out
    union = np.unique(np.concatenate(b))
    at = [np.minimum(np.searchsorted(union, q), len(union) - 1) for q in a]
    opens = [k for k, q in enumerate(a) if 100 * int((union[at[k]] == q).sum()) >= percent * len(q)]
    both = overlaps([a[k] for k in opens], b)
    n, m = np.array([len(a[k]) for k in opens], np.int64)[:, None], np.array([len(x) for x in b], np.int64)[None, :]
    out[opens] = (both > 0) & (100 * both >= percent * (n + m - both))
    return out


def _link_groups(p: Params):
    percent = p.percent

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        fresh = np.concatenate(([True], node[1:] != node[:-1]))
        table, node = table.filter(pa.array(fresh)), node[fresh]
        near = links(s := _sets(table["tokens"]), s, percent)
        root = np.full(len(node), -1)
        for k in range(len(node)):
            if root[k] < 0:  # everything reachable from here
                front = np.zeros(len(node), bool)
                front[k], reached = True, np.zeros(len(node), bool)
                while front.any():
                    reached |= front
                    front = near[front].any(axis=0) & ~reached
                root[reached] = k
        return pa.table({"gid": table["gid"], "node": table["node"], "root": pa.array(node[root]), "n": pa.array(np.array([len(x) for x in s], np.int64)), "tokens": table["tokens"]})

    return run


def _open_pair(p: Params):
    """Rows of side 0 against the group of side 1: for each two components that are linked, one link between them."""
    percent = p.percent

    def run(table: pa.Table) -> pa.Table:
        side, comp = table["side"].to_numpy(), table["comp"].to_numpy()
        sets = _sets(table["tokens"])
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        i, j = np.nonzero(links([sets[k] for k in a], [sets[k] for k in b], percent))
        pair = np.stack((comp[a][i], comp[b][j]), axis=1)
        pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
        return pa.table({"u": pa.array(pair[:, 0], pa.int64()), "v": pa.array(pair[:, 1], pa.int64())})

    return run


def _lots(nodes: DataFrame, keys: list[str], p: Params, name: str) -> DataFrame:
    """Nodes of equal ``keys`` in groups of bounded size, called ``name``."""
    sizes = nodes.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / p.group), F.ceil(F.sum("n") / p.group_tokens)).alias("_lots"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    dealt = nodes.alias("l").join(sizes.alias("r"), same).select("l.*", "r._lots")
    return dealt.withColumn(name, F.xxhash64(*keys, F.pmod(F.xxhash64("node"), "_lots"))).drop("_lots")


def link_components(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    sketch = sketches(docs, p)
    usable = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = usable.where(F.size("head") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n_shingles", "head", "cap")).alias("h"))
    index = heads.select("node", "doc_id", F.col("h.n_shingles").alias("n"), F.explode(F.arrays_zip("h.head", "h.cap")).alias("e"))
    index = index.select("node", "doc_id", "n", F.col("e.head").alias("token"), F.col("e.cap").alias("cap"))
    shared = index.groupBy("token").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("cap").alias("most")).where("c > 1")
    index = materialise(index.join(shared, "token").where("cap >= least AND n <= most").drop("least", "most"), "jaccard-index")

    # groups of nodes that have their most common index token in common and are of about one size
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / p.percent)))
    kind = index.groupBy("node", "doc_id", "n").agg(F.max(F.struct("c", "token")).getField("token").alias("top"), (F.max("cap") >= F.col("n")).alias("reach")).withColumn("band", band)
    kind = materialise(_lots(kind, ["top", "band", "reach"], p, "gid"), "jaccard-kinds")
    wanted = kind.select("doc_id", "node", "gid")
    if kind.count() <= p.broadcast_rows:
        wanted = F.broadcast(wanted)
    members = _tokens_of(docs, wanted, p, "node long, gid long")
    members = materialise(members.groupBy("gid").applyInArrow(_link_groups(p), "gid long, node long, root long, n long, tokens array<long>"), "jaccard-members")

    # leaders against the first group of their kind
    pair = "pid long, side int, comp long, tokens array<long>"
    columns = [c.split()[0] for c in pair.split(", ")]
    groups = kind.select("top", "gid").distinct()
    first = groups.groupBy("top").agg(F.min("gid").alias("first"))
    star = groups.join(first, "top").where("gid <> first").select("gid", "first")
    blocks = star.join(members.where("node = root").select("gid", "root"), "gid").select("first", "root", "gid")
    count = blocks.groupBy("first").agg(F.ceil(F.count("*") / p.group).alias("blocks"))
    asks = blocks.join(count, "first").select(F.xxhash64("first", F.pmod(F.xxhash64("root"), "blocks")).alias("pid"), F.lit(0).alias("side"), "root")
    asks = asks.join(members.where("node = root").select("root", "tokens"), "root").select("pid", "side", F.col("root").alias("comp"), "tokens")
    told = count.select(F.col("first").alias("gid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(members, "gid")
    told = told.select(F.xxhash64("gid", "block").alias("pid"), F.lit(1).alias("side"), F.col("root").alias("comp"), "tokens")
    found = asks.select(columns).unionByName(told.select(columns)).groupBy("pid").applyInArrow(_open_pair(p), "u long, v long")
    edges = members.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)
    known = graph.components(edges)

    # what is left: groups of different components that have an index token in common
    comp = members.select("node").join(known, "node", "left").select("node", F.coalesce("label", "node").alias("comp"))
    count = comp.groupBy("comp").agg(F.count("*").alias("csize")).where(F.col("csize") >= p.pooled)
    comp = comp.join(count, "comp", "left").select("node", "comp", "csize", F.when(F.col("csize").isNotNull(), F.col("comp")).alias("large"))
    comp = materialise(_lots(kind.drop("gid").join(comp, "node"), ["top", "band", "reach", "large"], p, "uid"), "jaccard-comp")
    at = index.select("token", "node", "cap").join(comp.select("node", "n", "uid", "large", "csize"), "node")
    at = at.groupBy("token", "uid", "large", "csize").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("cap").alias("cap"))
    top = at.groupBy("token").agg(F.max(F.when(F.col("large").isNotNull(), F.struct("csize", "large"))).alias("t"))
    at = at.join(top, "token").select("token", "uid", "large", "n0", "n1", "cap", F.coalesce(F.col("large") == F.col("t.large"), F.lit(False)).alias("main"))
    ask = at.where("NOT main").select("token", *[F.col(c).alias(f"q_{c}") for c in ("uid", "large", "n0", "n1", "cap")])
    once = F.col("main") | (F.col("q_uid") < F.col("uid")) | ((F.col("q_uid") == F.col("uid")) & F.col("large").isNull())
    apart = F.col("q_large").isNull() | F.col("large").isNull() | (F.col("q_large") != F.col("large"))
    fits = (F.col("q_cap") >= F.col("n0")) & (F.col("cap") >= F.col("q_n0")) & (100 * F.col("q_n1") >= p.percent * F.col("n0")) & (100 * F.col("n1") >= p.percent * F.col("q_n0"))
    meet = materialise(ask.join(at, "token").where(once & apart & fits).select("q_uid", "uid").distinct(), "jaccard-meet")
    pid = F.xxhash64("q_uid", "uid").alias("pid")
    sides = meet.select(pid, F.when(F.col("q_uid") == F.col("uid"), F.lit(2)).otherwise(F.lit(0)).alias("side"), F.col("q_uid").alias("unit"))
    sides = sides.unionByName(meet.where("q_uid <> uid").select(pid, F.lit(1).alias("side"), F.col("uid").alias("unit")))
    hoard = comp.select("node", "comp", F.col("uid").alias("unit")).join(members.select("node", "tokens"), "node")
    late = sides.join(hoard, "unit").select(columns).groupBy("pid").applyInArrow(_open_pair(p), "u long, v long")
    merged = graph.components(late)

    final = comp.select("node", "doc_id", "comp").join(merged.select(F.col("node").alias("comp"), "label"), "comp", "left").select("node", "doc_id", F.coalesce("label", "comp").alias("comp"))
    smallest = final.groupBy("comp").agg(F.min("doc_id").alias("component"))
    by_node = final.join(smallest, "comp").select("node", "component")
    own = usable.groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("c")).where("c > 1").drop("c")
    named = materialise(own.join(by_node, "node", "full").select("node", F.coalesce("component", "own").alias("component")), "jaccard-named")
    release(index, kind, members, known, comp, meet, merged)
    key = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    out = sketch.select("doc_id", "n_shingles", key.alias("node")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id.

    Documents without a doc_id or without words stay; rows that repeat a doc_id stay or go together.
    """
    linked_to = link_components(docs, p)
    gone = materialise(linked_to.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    if gone.count() <= p.broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

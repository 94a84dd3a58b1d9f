"""N-gram Jaccard join by chosen paths: all pairs of texts whose word-shingle sets have Jaccard similarity >= 0.8.

Texts with equal shingle sets form one class, and classes are joined.  In a run, every set picks each of its tokens with
probability SPREAD / |set|, by a hash that all sets share; a set goes to the node of each token it picked.  A node of at
most LEAF sets is compared by brute force.  In a larger one its sets pick again, by a hash of the node, and so on: similar
sets tend to pick the same paths, other sets part.  A pair of similarity 0.8 shares at least SPREAD * 0.8 picked tokens on
average in each level, which bounds the chance that it shares a path of ``levels`` nodes; the number of runs follows from
that chance for LEVELS levels and the target recall (most pairs meet in the first level already), and SPARE.  Nodes may have to be
split further, at most to DEPTH.  That matters for a set if OFTEN or more of its first-level nodes are split: it gets more runs, as many
as the target asks for if all its paths need DEPTH levels.  With fewer, the tokens that lead to small nodes suffice: where
a share f of a pair's shared tokens leads to DEPTH levels, the pair is missed with exp(-SPREAD * similarity * runs * (1 - f * 0.65)),
that is 0.2 % at f = 0.62, the most that a set below OFTEN can share with a partner of similarity 0.8.

A node that keeps more than half of its parent's sets holds sets that are truly alike, such as a big group of near copies;
splitting it further would not help.  It is compared in blocks of about BLOCK_TOKENS tokens: a task gets two blocks, so
no node lands in one task.  Nodes with the same members are compared once, and a pair that meets in several nodes is
compared in the first of them only.  Comparing is exact (intersections over the sets); a node returns the links of each
set (a number) and a spanning forest, never its pairs, so results stay linear.

Token sets are fetched for those classes only that share a node with another.

Defined results: a null text counts as empty; texts without words are equal to each other and like no other text; a text
of one to four words has one shingle, all its words; repeated rows are members of one class; ids may repeat or be null; an
empty table gives an empty table; other columns are ignored, or carried along by ``drop_near_copies``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_rows import group_starts, map_batches, map_whole_groups
from .common import filled, packed, small_enough, stored
from .components import connected_components
from .shingles import BYTE, mix64, set_key, shingle_sets

SIMILARITY = 0.8
RECALL = 0.995
LEVELS = 3
SPREAD = 1.5
LEAF = 256
KEPT = 0.5
DEPTH = 12
BLOCK_TOKENS = 1 << 20
FLAT = 1 << 20
SPARE = 1
OFTEN = 0.5


def meeting(levels: int, similarity: float = SIMILARITY, spread: float = SPREAD) -> float:
    """Least chance that a pair of this similarity shares a path of so many nodes in one run."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - math.exp(-spread * similarity * meet)
    return meet


def runs_for(recall: float, similarity: float = SIMILARITY, levels: int = LEVELS, spread: float = SPREAD) -> int:
    """Runs until a pair of this similarity has met with probability ``recall``, if it needs all levels."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(levels, similarity, spread)))


def more_runs_for(recall: float, similarity: float, runs: int) -> int:
    """Runs beyond ``runs`` until a pair that needs all DEPTH levels meets with ``recall``.

    A pair is missed if it has no path of LEVELS nodes, or if it has one, loses it further down and misses the further runs too.
    """
    if DEPTH <= LEVELS:
        return 0
    deep = 1 - meeting(DEPTH, similarity)
    never = (1 - meeting(LEVELS, similarity)) ** runs
    later, room = deep ** runs - never, max(1 - recall - never, 1e-3 * (1 - recall))
    return max(math.ceil(math.log(room / later) / math.log(deep)), 0)


class Sets:
    """Token sets, and what they pick in nodes."""

    def __init__(self, sets: list[np.ndarray], spread: float = SPREAD):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        # A token is picked when 63 bits of its hash are below this; sets of at most ``spread`` tokens pick all.
        share = np.minimum(spread / np.maximum(self.sizes, 1), 1.0)
        self.limit = (share * 2.0 ** 62).astype(np.uint64) * np.uint64(2)

    def pick(self, owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of a set and a node: (index of the pair, child node) of every token picked."""
        index, child = [], []
        size = self.sizes[owner]
        for a, b in _spans(np.cumsum(size), FLAT):
            n = size[a:b]
            which = np.repeat(np.arange(a, b), n)
            token = self.flat[np.repeat(self.starts[owner[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            draw = mix64(token ^ node[which])
            hit = (draw >> np.uint64(1)) <= self.limit[owner[which]]
            index.append(which[hit])
            child.append(mix64(draw[hit] + BYTE[4]))
        if not index:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(index), np.concatenate(child)


def _spans(ends: np.ndarray, limit: int):
    """Index ranges whose sizes add up to about ``limit``."""
    at, n = 0, len(ends)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def _roots(first: int, runs: int) -> np.ndarray:
    return mix64(np.arange(first + 1, first + runs + 1, dtype=np.uint64) * BYTE[3])


def shingle_paths(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """id, digest (of the text), key (128 bits of the set), n (its size) and the nodes of the first level."""
    rows = docs.select(F.col(id_col).alias("id"), F.md5(filled(text_col)).alias("digest"), F.col(text_col).alias("text"))

    def make():
        roots = _roots(0, runs)

        def each(batch):
            sets = list(shingle_sets([t or "" for t in batch.column(2).to_pylist()]))
            # Pairs in order of set, then run, so the nodes of a set lie together.
            index, node = Sets(sets).pick(np.repeat(np.arange(len(sets)), runs), np.tile(roots, len(sets)))
            offsets = np.searchsorted(index, np.arange(len(sets) + 1) * runs).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_key(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(node.view(np.int64)))], ["id", "digest", "key", "n", "nodes"])
        return each

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, make, f"id {kind}, digest string, key binary, n bigint, nodes array<bigint>")


def packed_tokens(tokens: np.ndarray) -> bytes:
    """48 bits of each token: inside one node that tells tokens apart, and it takes less room."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_tokens(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0]


def _children(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """node, key, n, parent_members of the next level, for rows (node, key, n, members)."""
    rows = rows.join(sets.where("big").select("key", "tokens"), "key").select("node", "key", "n", "members", "tokens")

    def make():
        def each(batch):
            tokens = Sets([unpacked_tokens(t) for t in batch.column(4).to_pylist()])
            index, child = tokens.pick(np.arange(batch.num_rows), batch.column(0).to_numpy().view(np.uint64))
            at = pa.array(index)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(k).take(at) for k in (1, 2, 3))],
                                             ["node", "key", "n", "parent_members"])
        return each
    return map_batches(rows, make, "node bigint, key binary, n bigint, parent_members bigint")


def compare_nodes(sets: DataFrame, similarity: float) -> DataFrame:
    """Exact comparison inside nodes: rows (a, b, links).

    ``sets`` has node, i, j (the blocks compared), side, key, weight, nodes (all nodes of the set, sorted) and tokens.
    A row with b is an edge of the spanning forest; one without gives the weight of the sets that a was found to be like.
    """
    def make():
        def links_of(group: pa.Table, node: int, across: bool):
            keys = group.column("key").to_pylist()
            first = {}
            for r, k in enumerate(keys):
                first.setdefault(k, r)
            rows = np.array(sorted(first.values()))
            if len(rows) < 2:
                return
            tokens = [unpacked_tokens(group.column("tokens")[int(r)].as_py()) for r in rows]
            sizes = np.array([len(t) for t in tokens])
            order = np.argsort(sizes, kind="stable")
            rows, sizes, tokens = rows[order], sizes[order], [tokens[k] for k in order]
            weight = group.column("weight").to_numpy()[rows]
            side = group.column("side").to_numpy()[rows]
            flat, local = np.unique(np.concatenate(tokens), return_inverse=True)
            starts = np.append(0, np.cumsum(sizes))
            # Nodes before this one in which more than one of these sets is: one bit each.
            lists = [[x for x in group.column("nodes")[int(r)].as_py() if x < node] for r in rows]
            seen, shared = set(), {}
            for x in (x for one in lists for x in one):
                if x in seen:
                    shared.setdefault(x, len(shared))
                seen.add(x)
            bits = np.zeros((len(rows), 1 + len(shared) // 64), np.uint64)
            for r, one in enumerate(lists):
                for x in one:
                    if x in shared:
                        bits[r, shared[x] // 64] |= np.uint64(1) << np.uint64(shared[x] % 64)
            links = np.zeros(len(rows), np.int64)
            root = list(range(len(rows)))

            def top(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            mark = np.zeros(len(flat), np.int32)
            for x in range(len(rows) - 1):
                to = int(np.searchsorted(sizes, sizes[x] / similarity + 1e-9, "right"))
                if to <= x + 1:
                    continue
                own = local[starts[x]:starts[x + 1]]
                mark[own] = 1
                inter = np.add.reduceat(mark[local[starts[x + 1]:starts[to]]], starts[x + 1:to] - starts[x + 1])
                mark[own] = 0
                alike = inter / (sizes[x] + sizes[x + 1:to] - inter) >= similarity
                if across:
                    alike &= side[x + 1:to] != side[x]
                if shared:
                    alike &= ~(bits[x + 1:to] & bits[x]).any(axis=1)
                for y in np.flatnonzero(alike) + x + 1:
                    links[x] += weight[y]
                    links[y] += weight[x]
                    a, b = top(x), top(int(y))
                    if a != b:
                        root[b] = a
            for r in np.flatnonzero(links):
                yield keys[rows[r]], None, int(links[r])
                a = top(int(r))
                if a != r:
                    yield keys[rows[r]], keys[rows[a]], None

        def each(table):
            bounds = group_starts(table, ["node", "i", "j"])
            node, i, j = (table.column(c).to_numpy() for c in ("node", "i", "j"))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a > 1:
                    out += links_of(table.slice(int(a), int(b - a)), int(node[a]), bool(i[a] != j[a]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()),
                                                  pa.array([r[2] for r in out], pa.int64())], ["a", "b", "links"])
        return each

    return map_whole_groups(sets, ["node", "i", "j"], make, "a binary, b binary, links bigint")


def _counted(rows: DataFrame) -> DataFrame:
    """node, members, tokens, parent_members and a digest (x, y) of the members, of nodes with two members or more."""
    return stored(rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"), F.max("parent_members").alias("parent_members"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("members > 1"))


def _split(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Splits nodes until they are small or do not part.

    Returns, of each level, the nodes to compare and the memberships (key, node), and (key, n) of the sets in nodes that
    were split after LEVELS, None if there are none.
    """
    chosen, memberships, deep = [], [], None
    for depth in range(1, DEPTH + 1):
        whole = F.col("members") > KEPT * F.coalesce("parent_members", F.lit(float("inf")))
        done = (F.col("members") <= LEAF) | whole | F.lit(depth == DEPTH)
        chosen.append(nodes.where(done))
        memberships.append(rows.select("key", "node"))
        big = nodes.where(~done).select("node", "members")
        if not big.take(1):
            break
        rows = rows.select("node", "key", "n").join(small_enough(big), "node")
        if depth == LEVELS:
            deep = rows.select("key", "n").distinct()
        rows = stored(_children(rows, sets))
        nodes = _counted(rows)
    return chosen, memberships, deep


def _nodes_to_compare(rows: DataFrame, nodes: DataFrame, sets: DataFrame, often: DataFrame, runs: int,
                      more: int) -> tuple[DataFrame, DataFrame]:
    """The nodes to compare (node, blocks) and the memberships (key, node), with ``more`` runs for the sets that need them."""
    chosen, memberships, deep = _split(rows, nodes, sets)
    if deep is not None and more:
        roots = F.explode(F.array(*[F.lit(int(r)) for r in _roots(runs, more).view(np.int64)]))
        rows = deep.join(often, "key").select(roots.alias("node"), "key", "n", F.lit(None).cast("bigint").alias("members"))
        rows = stored(_children(rows, sets))
        for all_, new in zip((chosen, memberships), _split(rows, _counted(rows), sets)):
            all_ += new
    every, pairs = chosen[0], memberships[0]
    for c, m in zip(chosen[1:], memberships[1:]):
        every, pairs = every.unionByName(c), pairs.unionByName(m)
    # Nodes with the same members: the first stands for all.
    every = every.groupBy("members", "tokens", "x", "y").agg(F.min("node").alias("node"))
    return every.select("node", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks")), pairs


def _first(id_: str, digest: str):
    """Orders rows by id, a null last, then by the text's digest."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(digest).alias("digest"))


def _joined(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows (id, digest, key) and what is known of each class: key, rep, class_size, first, n_links."""
    runs = runs_for(recall, similarity, LEVELS) + SPARE
    rows = stored(shingle_paths(docs, id_col, text_col, runs))
    classes = stored(rows.groupBy("key").agg(
        F.min(_first("id", "digest")).alias("rep"), F.count(F.lit(1)).alias("class_size"), F.max("n").alias("n"),
        F.any_value("nodes").alias("nodes")))

    level = classes.select("key", "n", F.explode("nodes").alias("node"), F.lit(None).cast("bigint").alias("parent_members"))
    nodes = _counted(level)
    company = level.join(nodes.select("node", "members"), "node").groupBy("key").agg(F.count_if(F.col("members") > LEAF).alias("split"))
    company = stored(classes.select("key", "rep", F.col("class_size").alias("weight"), F.size("nodes").alias("all")).join(
        company, "key").withColumns({"big": F.col("split") > 0, "often": F.col("split") >= OFTEN * F.col("all")}).drop("split", "all"))
    # Tokens are read again for each level that is split: those of sets in big nodes lie in files of their own.
    sets = stored(_sets_of(company, docs, id_col, text_col), "big")
    chosen, memberships = _nodes_to_compare(level, nodes, sets, company.where("often").select("key"), runs,
                                            more_runs_for(recall, similarity, runs))
    members = memberships.join(chosen, "node").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("node", "blocks"))).alias("nodes"))
    compared = cut_lineage(compare_nodes(_by_block(members.join(sets, "key")), similarity))
    links = compared.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = connected_components(compared.where(F.col("b").isNotNull()), "a", "b")

    info = classes.select("key", "rep", "class_size").join(links, "key", "left").join(
        roots.select(F.col("node").alias("key"), "root"), "key", "left")
    info = info.withColumn("root", F.coalesce("root", "key"))
    first = info.groupBy("root").agg(F.min("rep").alias("first"))
    return rows.select("id", "digest", "key"), info.join(first, "root").select(
        "key", "rep", "class_size", "first", (F.coalesce("links", F.lit(0)) + F.col("class_size") - 1).alias("n_links"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                 recall: float = RECALL) -> DataFrame:
    """One row per input row: id, rep_id, class_size, class_id, n_links.

    ``rep_id`` is the smallest id with the same shingle set and ``class_size`` their number; ``n_links`` counts the other
    rows whose similarity is at least ``similarity``; ``class_id`` is the smallest id that links lead to.
    """
    rows, info = _joined(docs, id_col, text_col, similarity, recall)
    return rows.select("id", "key").join(info, "key").select(
        F.col("id").alias(id_col), F.col("rep.id").alias("rep_id"), "class_size", F.col("first.id").alias("class_id"), "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                     recall: float = RECALL) -> DataFrame:
    """One row of each group of linked texts, the first by id, with all its columns."""
    _, info = _joined(docs, id_col, text_col, similarity, recall)
    keys = ["id_key", "digest"]
    id_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_key")
    stay = info.select(id_key("first.id"), F.col("first.digest").alias("digest")).distinct()
    rows = packed(docs).select("_row", id_key(f"_row.`{id_col}`"), F.md5(filled(F.col(f"_row.`{text_col}`"))).alias("digest"))
    kept = rows.join(stay, keys, "left_semi")
    return kept.groupBy(*keys).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


def _sets_of(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, weight, big, tokens of classes (key, rep, weight, big).

    Texts meet the classes by the id and digest of their first row, so copies are not fetched.
    """
    id_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_key")
    texts = docs.select(id_key(id_col), F.md5(filled(text_col)).alias("digest"), F.col(text_col).alias("text"))
    members = members.select("key", "weight", "big", id_key("rep.id"), F.col("rep.digest").alias("digest"))
    found = members.join(texts, ["id_key", "digest"]).select("key", "weight", "text", "big")

    def make():
        seen = set()  # rows that repeat id and text meet here one after the other; their set is needed once

        def each(batch):
            keys = batch.column(0).to_pylist()
            if len(seen) > 100_000:
                seen.clear()
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(new, pa.int64()))
            sets = shingle_sets([t or "" for t in batch.column(2).to_pylist()])
            tokens = pa.array([packed_tokens(np.unique(s & np.uint64((1 << 48) - 1))) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, batch.column(3)], ["key", "weight", "tokens", "big"])
        return each

    return map_batches(found, make, "key binary, weight bigint, tokens binary, big boolean")


def _by_block(members: DataFrame) -> DataFrame:
    """A row for each node of a set and each other block of that node: node, i, j, side, key, weight, nodes, tokens."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = ["node", "i", "j", "side", "key", "weight", "nodes", "tokens"]

    def make():
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def each(batch):
            out, size = [], 0
            for key, own, weight, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = [x["node"] for x in own]
                for x in own:
                    block = int.from_bytes(key[:4], "big") % x["blocks"]
                    for other in range(x["blocks"]):
                        out.append((x["node"], min(block, other), max(block, other), block, key, weight, ids, data))
                        size += len(data)
                        if size > 1 << 24:
                            yield batch_of(out)
                            out, size = [], 0
            if out:
                yield batch_of(out)
        return each

    return map_batches(members.select("key", "nodes", "weight", "tokens"), make,
                       "node bigint, i int, j int, side int, key binary, weight bigint, nodes array<bigint>, tokens binary")

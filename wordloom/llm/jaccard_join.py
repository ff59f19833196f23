"""Exact n-gram Jaccard join, by rare tokens and signature trees.

A document's set is its distinct w-word shingles, as 64-bit hashes (lower-cased A-Z; words end at ASCII white space).
Documents with equal sets are one vertex, known by a 64-bit fingerprint.  Two vertices link when
``den * |intersection| >= num * |union|``.  All links count, whatever their number:

1.  A partner of x lacks at most ``n - ceil(num * n / den)`` of its n shingles.  So of x's prefix (that many and ``l``
    more, smallest hashes first) ``l`` at least also stand in another prefix.  Vertices that fail this have no link.
2.  Over what is left, shingles are counted.  A vertex with more singletons than a partner may lack has no link; the
    others give their rarest shingles as keys.  Linked vertices share a key, so they fall into one block (a component of
    the key graph).
3.  In a block, a signature tree holds in every node the OR and AND of its members' bitmaps and their range of sizes.
    A dual traversal skips pairs of nodes whose largest possible overlap is too small, or whose members are connected
    already; what is left at the leaves is compared exactly.
4.  A large block is dealt to groups that also get a few common pivots.  Members outside the block's largest component
    then meet every other group of it, in chunks, so that no pair of different components goes uncompared.

Shingles that a bounded sample shows to be very frequent are counted as repeated without being shuffled; this moves
work only, since any total order of shingles gives the same links.

Defined results: null, empty and all-space texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; a text of any length has all its shingles; a repeated row is in its copy's component; rows of one
id with different texts are a document each; rows without an id are left out; ties go to the smallest id; extra columns,
whatever their names, are ignored by ``join_components`` and kept by ``one_of_each``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.components import connected_components
from wordloom.llm.shared import IdFilter, bounded_sample, grouped, map_batches, map_in_arrow, materialise, text_slices

#: Documents looked at for very frequent shingles, about, at most; a shingle in HOT_DOCS of them is one; at most MAX_HOT.
SAMPLE_DOCS, HOT_DOCS, MAX_HOT = 4_096, 8, 1 << 16
#: Part of a set by which prefixes are longer than a partner may lack.
EXTRA = 0.07
#: Members of a group of a large block, and pivots that all its groups get, on average.
GROUP, PIVOTS = 64, 8
#: Bytes of (shingle, fingerprint) pairs that a task holds before it sends them on, and that a bucket holds about.
FLUSH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Bytes of text whose shingles are made at once; the arrays take about sixty times as much.
SLICE = 256 << 10
SIGNATURE_WORDS, FANOUT = 16, 8

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.arange(1, 257, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE_CODE = mix(_BYTE * _STEP)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of lower-cased bytes."""
    inside = np.concatenate([[False], ~_WHITE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * _powers(_STEP, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one text after another, and the texts' offsets (one more than texts)."""
    lowered = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    begins = np.cumsum([0] + [len(t) + 1 for t in lowered])
    words, starts = word_hashes(np.frombuffer(b" ".join(lowered), np.uint8))
    bounds = np.searchsorted(starts, begins)
    owner = np.searchsorted(begins, starts, side="right") - 1
    n = np.diff(bounds)
    rank = np.arange(len(words)) - bounds[:-1][owner]
    heads = np.flatnonzero((rank + width <= n[owner]) | ((rank == 0) & (n[owner] < width)))
    code = np.zeros(len(heads), np.uint64)
    for k in range(width):
        at = heads + k
        here = at < bounds[1:][owner[heads]]
        code = np.where(here, mix(code + words[np.minimum(at, len(words) - 1)] * U64(2 * k + 3)), code + U64(1))
    code, own = mix(code), owner[heads]
    order = np.lexsort((code, own))
    code, own = code[order], own[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
    code, own = code[new], own[new]
    return code, np.searchsorted(own, np.arange(len(texts) + 1))


def fingerprints(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set (0 for empty ones); sets differ in it unless hashes collide."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes ^ _STEP))])
    n = np.diff(offsets).astype(np.uint64)
    return np.where(n > 0, mix(sums[offsets[1:]] - sums[offsets[:-1]] + n), U64(0))


def may_lack(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of its n shingles a partner may lack at most."""
    return n - -(-num * n // den)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def packed(rows: Iterator[np.ndarray], buckets: int, name: str) -> Iterator[pa.RecordBatch]:
    """Rows of 64-bit integers, dealt by the first of them: one row a bucket and ``FLUSH_BYTES``, with the bucket's rows end to end as bytes."""

    def flush() -> pa.RecordBatch:
        both = np.concatenate(held)
        bucket = (both[:, 0] % U64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at, both = bucket[order], both[order]
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return pa.record_batch([pa.array(at[heads]), pa.array([x.tobytes() for x in np.split(both, heads[1:])], pa.binary())], ["bucket", name])

    held, size = [], 0
    for some in rows:
        if len(some):
            held.append(some)
            size += some.nbytes
        if size >= FLUSH_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


class SignatureTree:
    """Sets in the order of their sizes, under nodes of FANOUT children."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], self.size))
        bits = np.zeros((len(sets), SIGNATURE_WORDS), np.uint64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        np.bitwise_or.at(bits, (owner, ((flat >> U64(6)) % U64(SIGNATURE_WORDS)).astype(np.int64)), U64(1) << (flat & U64(63)))
        self.bits = bits
        low = np.arange(0, len(sets), FANOUT)
        high = np.minimum(low + FANOUT, len(sets))
        self.nodes: list[tuple] = []  # (first, last + 1, OR, AND, smallest, largest, children)
        level = []
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            own = self.order[a:b]
            level.append(len(self.nodes))
            self.nodes.append((a, b, np.bitwise_or.reduce(bits[own]), np.bitwise_and.reduce(bits[own]), int(self.size[own[0]]), int(self.size[own[-1]]), ()))
        while len(level) > 1:
            upper = []
            for i in range(0, len(level), FANOUT):
                kids = [self.nodes[k] for k in level[i : i + FANOUT]]
                upper.append(len(self.nodes))
                self.nodes.append((kids[0][0], kids[-1][1], np.bitwise_or.reduce([k[2] for k in kids]), np.bitwise_and.reduce([k[3] for k in kids]), kids[0][4], kids[-1][5], tuple(level[i : i + FANOUT])))
            level = upper
        self.root = level[0]


class Forest:
    """Union-find in which the smallest index stands for its component."""

    def __init__(self, labels: list[int]):
        seen: dict[int, int] = {}
        self.up = [seen.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def tree_join(left: SignatureTree, right: SignatureTree, forest: Forest, num: int, den: int, shift: int = 0) -> None:
    """Connect in ``forest`` the linked pairs between two trees; vertex i of ``right`` is i + shift there."""
    todo = [(left.root, right.root)]
    while todo:
        i, j = todo.pop()
        a, b = left.nodes[i], right.nodes[j]
        # the largest overlap and the smallest that links: (num + den) * overlap >= num * (sizes)
        over = min(a[5] - int(np.bitwise_count(a[3] & ~b[2]).sum()), b[5] - int(np.bitwise_count(b[3] & ~a[2]).sum()))
        if (num + den) * over < num * (a[4] + b[4]):
            continue
        roots = {forest.find(int(k)) for k in left.order[a[0] : a[1]]} | {forest.find(int(k) + shift) for k in right.order[b[0] : b[1]]}
        if len(roots) == 1:
            continue
        if a[6] or b[6]:
            if a[6] and (not b[6] or a[1] - a[0] >= b[1] - b[0]):
                todo += [(k, j) for k in a[6] if left is not right or left.nodes[k][0] <= b[1]]
            else:
                todo += [(i, k) for k in b[6] if left is not right or right.nodes[k][1] >= a[0]]
            continue
        x, y = left.order[a[0] : a[1]], right.order[b[0] : b[1]]
        most = np.minimum(
            left.size[x][:, None] - np.bitwise_count(left.bits[x][:, None] & ~right.bits[y][None]).sum(-1, dtype=np.int64),
            right.size[y][None] - np.bitwise_count(right.bits[y][None] & ~left.bits[x][:, None]).sum(-1, dtype=np.int64),
        )
        enough = (num + den) * most >= num * (left.size[x][:, None] + right.size[y][None])
        for p, q in np.argwhere(enough).tolist():
            u, v = int(x[p]), int(y[q])
            if forest.find(u) != forest.find(v + shift):
                small, large = sorted((left.sets[u], right.sets[v]), key=len)
                same = int(member(small, large).sum())
                if den * same >= num * (len(small) + len(large) - same):
                    forest.join(u, v + shift)


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packed rows of one bucket after another; the batches are sorted by bucket."""
    for _, held in grouped(batches, 1):
        yield [x for b in held for x in b.column(1).to_pylist()]


class Join:
    """One run of the join over ``(id, text)`` rows."""

    def __init__(self, rows: DataFrame, width: int, num: int, den: int):
        if not (width > 0 and 0 < num <= den):
            raise ValueError("a shingle has a word at least, and a similarity lies above 0 and at most at 1")
        self.rows, self.width, self.num, self.den = rows, width, num, den
        self.spark = rows.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.hot = self.spark.sparkContext.broadcast(self.frequent())
        self.buckets = self.parts

    def frequent(self) -> np.ndarray:
        width = self.width

        def make():
            def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
                code, n = np.unique(shingle_sets(batch.column(1).to_pylist(), width)[0], return_counts=True)
                return pa.record_batch([as_long(code), pa.array(n, pa.int64())], ["token", "n"])

            return tokens

        counts = map_batches(bounded_sample(self.rows, "id", SAMPLE_DOCS), "text", "token long, n long", make, SLICE).groupBy("token").agg(F.sum("n").alias("n"))
        top = counts.where(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "token").limit(MAX_HOT).collect()
        return np.sort(np.array([r.token for r in top], np.int64).view(np.uint64))

    def sets(self) -> DataFrame:
        """``(id, fp, n, need)``: need is how many repeated shingles, beside the frequent ones, the prefix must have."""
        width, num, den, hot = self.width, self.num, self.den, self.hot

        def make():
            def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
                code, offsets = shingle_sets(batch.column(1).to_pylist(), width)
                n = np.diff(offsets)
                prefix, extra = prefix_lengths(n, num, den)
                rank = np.arange(len(code)) - np.repeat(offsets[:-1], n)
                known = np.concatenate([[0], np.cumsum(member(code, hot.value) & (rank < np.repeat(prefix, n)))])
                need = extra - (known[offsets[1:]] - known[offsets[:-1]])
                return pa.record_batch([batch.column(0), as_long(fingerprints(code, offsets)), pa.array(n, pa.int64()), pa.array(need, pa.int64())], ["id", "fp", "n", "need"])

            return describe

        return map_batches(self.rows, "text", "id long, fp long, n long, need long", make, SLICE)

    def pairs(self, rows: DataFrame, prefix_only: bool, known=None) -> DataFrame:
        """``(bucket, pairs)``: (shingle, fingerprint) pairs of the texts' shingles that aren't frequent, dealt by shingle.

        With ``known``, an id filter's table, ``rows`` have its places, and only rows that it knows count.
        """
        width, num, den, hot, buckets = self.width, self.num, self.den, self.hot, self.buckets

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for piece in text_slices(IdFilter.screened(batch, known) if known else batch, "text", SLICE):
                    code, offsets = shingle_sets(piece.column(1).to_pylist(), width)
                    n, fp = np.diff(offsets), fingerprints(code, offsets)
                    first = np.zeros(len(n), bool)
                    first[np.unique(fp, return_index=True)[1]] = True  # a copy says nothing new
                    rank = np.arange(len(code)) - np.repeat(offsets[:-1], n)
                    keep = np.repeat(first, n) & ~member(code, hot.value)
                    if prefix_only:
                        keep &= rank < np.repeat(prefix_lengths(n, num, den)[0], n)
                    yield np.stack([code[keep], np.repeat(fp, n)[keep]], 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return packed(made(batches), buckets, "pairs")

        return self.dealt(map_in_arrow(rows, run, "bucket int, pairs binary"))

    def dealt(self, packs: DataFrame) -> DataFrame:
        """Packed rows, those of a bucket together: a worker holds one bucket at a time."""
        return packs.repartition(self.parts, "bucket").sortWithinPartitions("bucket")

    def survivors(self, vertices: DataFrame) -> DataFrame:
        """The vertices whose prefixes have enough repeated shingles."""

        buckets = self.buckets

        def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for raw in buckets_of(batches):
                _, fp, df = counted(raw)
                fp, n = np.unique(fp[df > 1], return_counts=True)
                yield np.stack([fp, n.astype(np.uint64)], 1)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return packed(repeats(batches), buckets, "items")

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw in buckets_of(batches):
                items = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
                fp, where = np.unique(items[:, 0], return_inverse=True)
                n = np.bincount(where, items[:, 1].astype(np.float64)).astype(np.int64)
                yield pa.record_batch([as_long(fp), pa.array(n, pa.int64())], ["fp", "repeated"])

        partial = map_in_arrow(self.pairs(self.rows, True), count, "bucket int, items binary")
        repeated = map_in_arrow(self.dealt(partial), total, "fp long, repeated long")
        return vertices.join(repeated, "fp", "left").where(F.coalesce("repeated", F.lit(0)) >= F.col("need")).select("fp", "rep", "n")

    def texts_of(self, chosen: DataFrame) -> DataFrame:
        """Rows of the documents whose ids are the chosen vertices' ``rep``, and perhaps a few more: no shuffle of texts."""
        return IdFilter(chosen, "rep").filtered(self.rows.select("id", "text"), "id", True)

    def keys(self, chosen: DataFrame) -> DataFrame:
        """``(token, fp)``: the rarest shingles of the vertices that can have a partner among the chosen ones."""
        wanted = IdFilter(chosen, "rep")
        rows, known = wanted.spotted(self.rows.select("id", "text"), "id"), wanted.table
        buckets, width, num, den, hot = self.buckets, self.width, self.num, self.den, self.hot
        frequent = np.iinfo(np.int64).max

        def rows_of(fp: np.ndarray, token: np.ndarray, df: np.ndarray) -> np.ndarray:
            return np.stack([fp, token, df.astype(np.uint64)], 1)

        def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for raw in buckets_of(batches):
                token, fp, df = counted(raw)
                yield rows_of(fp[df > 1], token[df > 1], df[df > 1])

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            """Sizes (with df 0) and frequent shingles, which the counts leave out."""
            for batch in batches:
                for piece in text_slices(IdFilter.screened(batch, known), "text", SLICE):
                    code, offsets = shingle_sets(piece.column(1).to_pylist(), width)
                    n, fp = np.diff(offsets), fingerprints(code, offsets)
                    here, sized = member(code, hot.value), n > 0
                    yield rows_of(
                        np.concatenate([fp[sized], np.repeat(fp, n)[here]]),
                        np.concatenate([n[sized].astype(np.uint64), code[here]]),
                        np.concatenate([np.zeros(sized.sum(), np.int64), np.full(here.sum(), frequent)]),
                    )

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return packed(repeats(batches), buckets, "items")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return packed(described(batches), buckets, "items")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw in buckets_of(batches):
                yield chosen_of(raw)

        def chosen_of(raw: list[bytes]) -> pa.RecordBatch:
            items = np.unique(np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 3), axis=0)
            fp, token, df = items[:, 0], items[:, 1], items[:, 2]
            order = np.lexsort((token, df, fp))
            fp, token, df = fp[order], token[order], df[order]
            heads = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            count = np.diff(np.append(heads, len(fp)))
            real = df[heads] == 0  # counts of a vertex whose text is not here can't occur; the size comes first
            n = np.where(real, token[heads], 0).astype(np.int64)
            left = may_lack(n, num, den) + 1 - (n - (count - 1))
            rank = np.arange(len(fp)) - np.repeat(heads, count)
            chosen_here = (rank > 0) & (rank <= np.repeat(np.where(real, left, 0), count))
            return pa.record_batch([as_long(token[chosen_here]), as_long(fp[chosen_here])], ["token", "fp"])

        counts = map_in_arrow(self.pairs(rows, False, known), back, "bucket int, items binary")
        sizes = map_in_arrow(rows, own, "bucket int, items binary")
        return map_in_arrow(self.dealt(counts.union(sizes)), choose, "token long, fp long")

    def links(self, rows: DataFrame, keys: list[str], cross: bool) -> DataFrame:
        """``(u, v)`` over groups of rows ``(*keys, fp, label, side, text)``: each member and the first of its component.

        Within a group, every pair counts; with ``cross``, only pairs of a side 0 with a side 1.  Equal labels are
        connected from the start.
        """
        width, num, den, k = self.width, self.num, self.den, len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, held in grouped(batches, k):
                table = pa.Table.from_batches(held)
                fp, label, side = (table.column(c).to_numpy().astype(np.int64) for c in ("fp", "label", "side"))
                code, offsets = shingle_sets(table.column("text").to_pylist(), width)
                # a repeated id may bring another text along: its fingerprint differs
                good = np.flatnonzero((fingerprints(code, offsets).view(np.int64) == fp) & (np.diff(offsets) > 0))
                good = good[np.unique(fp[good], return_index=True)[1]] if not cross else good[np.unique(np.stack([side[good], fp[good]], 1), axis=0, return_index=True)[1]]
                if cross:
                    good = good[np.argsort(side[good], kind="stable")]
                sets = [code[offsets[i] : offsets[i + 1]] for i in good]
                forest = Forest(label[good].tolist())
                if cross:
                    cut = int((side[good] == 0).sum())
                    if not 0 < cut < len(good):
                        continue
                    tree_join(SignatureTree(sets[:cut]), SignatureTree(sets[cut:]), forest, num, den, cut)
                elif len(sets) > 1:
                    tree = SignatureTree(sets)
                    tree_join(tree, tree, forest, num, den)
                root = [forest.find(i) for i in range(len(good))]
                yield pa.record_batch([pa.array(fp[good], pa.int64()), pa.array(fp[good][root], pa.int64())], ["u", "v"])

        placed = rows.select(*keys, "fp", "label", "side", "text").repartition(self.parts, *keys).sortWithinPartitions(*keys)
        return map_in_arrow(placed, run, "u long, v long")

    def components(self) -> DataFrame:
        """``(id, n_shingles, component_id)``."""
        described = materialise(self.sets(), "join-sets")
        self.buckets = max(self.parts, -(-16 * (described.agg(F.sum("n")).first()[0] or 0) // BUCKET_BYTES))
        vertices = materialise(described.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("need").alias("need"), F.count("*").alias("copies")), "join-vertices")
        alive = materialise(self.survivors(vertices), "join-survivors")
        keys = materialise(self.keys(alive), "join-keys")
        centres = keys.groupBy("token").agg(F.min("fp").alias("u"), F.count("*").alias("g")).where("g > 1").select("token", "u")
        blocks = connected_components(keys.join(centres, "token").select("u", F.col("fp").alias("v")))
        sizes = blocks.groupBy("c").agg(F.count("*").alias("size"))
        members = materialise(blocks.join(sizes, "c").select(F.col("v").alias("fp"), F.col("c").alias("block"), "size").join(vertices.select("fp", "rep"), "fp"), "join-members")
        texts = self.texts_of(members).join(members.withColumnRenamed("rep", "id"), "id")
        groups = F.ceil(F.col("size") / GROUP).cast("long")
        pool = materialise(texts.select("block", "fp", "size", groups.alias("k"), F.pmod(F.xxhash64("fp"), groups).alias("g"), "text"), "join-pool")

        home = pool.select("block", "k", "g", "fp", F.col("fp").alias("label"), F.lit(0).alias("side"), "text")
        pivots = pool.where((F.col("k") > 1) & (F.pmod(F.xxhash64("fp", F.lit(7)), F.col("size")) < PIVOTS))
        guests = pivots.select("block", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("g"), F.col("g").alias("own"), "fp", F.col("fp").alias("label"), F.lit(0).alias("side"), "text").where("g <> own").drop("own")
        near = materialise(self.links(home.unionByName(guests), ["block", "g"], False), "join-links")
        labels = connected_components(near)
        # vertices that no link touches stand for themselves
        labels = materialise(members.select("fp", "block", "size").join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "block", "size", F.coalesce("c", "fp").alias("label")), "join-labels")

        open_blocks = labels.where(F.col("size") > GROUP).groupBy("block", "label").agg(F.count("*").alias("n")).groupBy("block").agg(F.count("*").alias("parts"), F.max(F.struct("n", F.col("label").alias("major"))).alias("top")).where("parts > 1")
        open_blocks = materialise(open_blocks.select("block", "top.major", (F.col("top.n")).alias("n")), "join-open")
        if not open_blocks.isEmpty():
            wide = pool.join(open_blocks.withColumnRenamed("n", "top"), "block").join(labels.select("fp", "label"), "fp")
            chunks = F.ceil((F.col("size") - F.col("top")) / GROUP).cast("long")
            wide = materialise(wide.select("block", "fp", "size", "k", "g", "text", "label", (F.col("label") != F.col("major")).alias("minor"), chunks.alias("m")), "join-wide")
            everyone = wide.select("block", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("h"), "fp", "label", F.lit(0).alias("side"), "text")
            strays = wide.where("minor").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("g"), F.pmod(F.xxhash64("fp", F.lit(3)), F.col("m")).alias("h"), "fp", "label", F.lit(1).alias("side"), "text")
            far = self.links(everyone.unionByName(strays), ["block", "g", "h"], True)
            again = connected_components(near.union(materialise(far, "join-far")).union(labels.select("fp", "label")))
            labels = materialise(labels.drop("label").join(again.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "block", "size", F.coalesce("c", "fp").alias("label")), "join-labels")
        smallest = labels.join(vertices.select("fp", "rep"), "fp").groupBy("label").agg(F.min("rep").alias("component_id"))
        final = labels.join(smallest, "label").select("fp", "component_id")
        named = vertices.join(final, "fp", "left").select("fp", "copies", F.coalesce("component_id", "rep").alias("component_id"))
        # a set that a thousandth of all documents share meets them by broadcast: there are a thousand such sets at most
        many = described.count() / 1000
        heavy = F.broadcast(named.where(F.col("copies") > many).select("fp", "component_id"))
        light = described.join(heavy.select("fp"), "fp", "left_anti").join(named.where(F.col("copies") <= many).select("fp", "component_id"), "fp", "left")
        out = described.join(heavy, "fp").unionByName(light)
        return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def prefix_lengths(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of prefixes and how many repeated shingles each must have."""
    lack = may_lack(n, num, den)
    extra = np.minimum(np.maximum(1, np.ceil(EXTRA * n).astype(np.int64)), np.maximum(n - lack, 1))
    return lack + extra, extra


def counted(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, fingerprint) pairs and how many fingerprints the shingle has."""
    both = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    token, fp = both[order, 0], both[order, 1]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
    token, fp = token[new], fp[new]
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    n = np.diff(np.append(heads, len(token)))
    return token, fp, np.repeat(n, n)


def join_components(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: a component's id is the smallest document id in it."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return Join(rows, width, num, den).components().select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, and rows without an id; of rows with one id and text, one stays.

    Only rows that go, or may have to, are shuffled.
    """
    found = materialise(join_components(docs, width, num, den, id_col, text_col), "join-found")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    twice = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__gone"))
    known = IdFilter(gone.union(twice), "__gone")
    own = "__id"
    while own in docs.columns:
        own += "_"
    keyed = docs.withColumn(own, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    doubtful = known.filtered(keyed, own, True)
    named = doubtful.where(F.col(id_col).isNotNull()).join(gone.withColumnRenamed("__gone", f"{own}_"), F.col(own) == F.col(f"{own}_"), "left_anti").dropDuplicates([id_col, text_col])
    return known.filtered(keyed, own, False).union(named).union(doubtful.where(F.col(id_col).isNull())).drop(own)

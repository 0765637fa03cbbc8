"""N-gram Jaccard self-join by a token-group matrix, exact.

A document is its set of distinct k-word shingles (64-bit hashes).  Two documents link when
``100 * |A & B| >= percent * |A | B|``.

1. Rows are nodes.  Equal sets form a class; one node, of the smallest doc_id, stands for it from here on.
2. Tokens are ordered by how many documents hold them (lone ones first, frequent ones last), then by hash.  Two sets
   that link share a token among the first ``n - ceil(percent * n / 100) + 1`` of each, so only those *probe tokens* are
   compared.  Tokens that no other document holds are counted among them, but are in no other set, so they go no
   further: a document with enough of its own has nothing to compare, however large the corpus.  A passage that many
   documents share consists of frequent tokens and stays out of the probes of all documents but those made of it.
3. Similar documents are partitioned into groups, by the commonest probe token that they share with another document;
   groups are salted into parts of about ``GROUP_TOKENS`` tokens and ``GROUP_DOCUMENTS`` documents, so no group grows
   with the data.
4. First each part is compared within itself and with the first part of its group.  The components of these links are
   known from here on; those of ``FAMILY`` documents or more are families, and parts are divided by family.
5. The token-group matrix has a row for every probe token in the union of a part's probe tokens.  Pairs of parts with a
   token in common, but not two parts of one family, are the only ones that can hold a link between components.  So a
   large family of near copies costs in proportion to its size.
6. For each such pair the overlap of every document with those of the other part is bounded from short counts of tokens
   by hash range (no set has to move for that).  Only documents and pairs whose bound reaches the needed overlap are
   opened; there, queries are bounded again by the union of the other part's tokens, and overlaps are counted exactly
   by a product of incidence matrices.  A pair of parts returns a spanning forest of its links, not all pairs.
7. Connected components of the forests and the classes.

Document frequencies are counted over all documents.  They only order the tokens, so the table of frequent ones that
travels with the tasks may leave out the less frequent powers of two, so that it has at most ``FREQUENT_TOKENS`` entries
(5 MB), without any effect on the result.  Tokens of several documents are bits by hash, at most ``SHARED_BITS`` (16 MB);
a lone token with the bit of another is taken for a shared one, which costs comparisons and no link.

Null or wordless texts have no shingles and link with nothing; a text of fewer than k words is one shingle of all its
words.  Rows with a null doc_id link with nothing and have a null component.  Repeated rows come back each; a doc_id
with several different texts is one node for each text.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import text as T
from pixelloom.llm.components import components
from pixelloom.llm.storage import drop, save

WORDS, PERCENT = 5, 80
#: A token in at least so many documents is looked up as frequent.
FREQUENT = 8
FREQUENT_TOKENS = 500_000
#: Bits of the table of tokens that several documents hold, and how many there are for each such token below that.
SHARED_BITS, BITS_A_TOKEN = 1 << 27, 4
BLOCK_TOKENS = 1_000_000
GROUP_TOKENS, GROUP_DOCUMENTS = 65_536, 1024
FAMILY = 256
#: Ids beyond this number are joined by a shuffle instead of a broadcast (16 MB).
BROADCAST_IDS = 2_000_000
#: Columns of an incidence matrix that are multiplied at once; pairs of documents, and bytes of counts, that are compared at once.
MATRIX_COLUMNS, PAIRS_AT_ONCE, BOUND_BYTES = 8192, 250_000, 1 << 22
_RANGES, _FULL = 6, 255


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for row, end, offsets, raw in T.slices(column):
        h, first = T.shingles(T.words(offsets, raw), k)
        for d in range(end - row):
            yield np.unique(h[first[d] : first[d + 1]])


def range_counts(u: np.ndarray) -> np.ndarray:
    """How many tokens lie in each of 64 equal hash ranges; twice as many ranges for each doubling beyond 512 tokens."""
    ranges = max(_RANGES, (len(u) - 1).bit_length() - 3)
    return np.minimum(np.bincount((u >> np.uint64(64 - ranges)).astype(np.int64), minlength=1 << ranges), _FULL).astype(np.uint8)


class _Documents:
    """Flat columns of a list column of documents (node, n, counts, component); row r holds first[r] to first[r + 1]."""

    def __init__(self, column: pa.ListArray):
        self.first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
        flat = column.flatten()
        self.node, self.n, self.component = (flat.field(name).to_numpy() for name in ("node", "n", "component"))
        at, raw = T.text_buffer(flat.field("counts"))
        self.ranges = np.diff(at)
        self.slot, self.counts = np.zeros(len(flat), np.int64), {}  # by number of ranges: a matrix of counts
        for m in np.unique(self.ranges).tolist():
            own = np.flatnonzero(self.ranges == m)
            self.slot[own] = np.arange(len(own))
            self.counts[m] = raw[at[own][:, None] + np.arange(m)]


def _bounds(left: _Documents, right: _Documents, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of left i with right j, from counts by range, at the coarser ranges of the two."""
    out = np.zeros(len(i), np.int64)
    p, q = left.ranges[i], right.ranges[j]
    for wide_left, wide_right in {(int(x), int(y)) for x, y in zip(*np.unique(np.stack([p, q]), axis=1), strict=True)}:
        own, m = np.flatnonzero((p == wide_left) & (q == wide_right)), min(wide_left, wide_right)
        for part in np.array_split(own, len(own) * max(wide_left, wide_right) // BOUND_BYTES + 1):
            x, y = left.counts[wide_left][left.slot[i[part]]], right.counts[wide_right][right.slot[j[part]]]
            beyond = (x == _FULL).any(1) | (y == _FULL).any(1)  # such a range may hold any number
            x, y = (z if z.shape[1] == m else z.reshape(len(z), m, -1).sum(2, dtype=np.uint16 if z.shape[1] // m < 256 else np.int64) for z in (x, y))
            out[part] = np.where(beyond, 1 << 62, np.minimum(x, y).sum(1, dtype=np.int64))
    return out


def _may_link(left: _Documents, right: _Documents, rows: range, within: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which documents (flat places, left and right) of these rows may link with one of the other side, by sizes, components and counts."""
    first, many, other = left.first[rows.start : rows.stop], np.diff(left.first)[rows.start : rows.stop], np.diff(right.first)[rows.start : rows.stop]
    row = np.repeat(np.arange(len(many)), many * other)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many * other) - many * other, many * other)
    i, j = first[row] + at // other[row], right.first[rows.start : rows.stop][row] + at % other[row]
    n, m = left.n[i], right.n[j]
    fit = (percent * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (left.component[i] != right.component[j]) & ~(within[rows.start : rows.stop][row] & (left.node[i] >= right.node[j]))
    i, j, n, m = i[fit], j[fit], n[fit], m[fit]
    good = _bounds(left, right, i, j) >= needed(n, m, percent)
    return i[good], j[good]


def _named(docs: DataFrame) -> DataFrame:
    """name (the doc_id), h (a hash of the text) and text: a doc_id may have several texts."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("name"), F.xxhash64(text).alias("h"), text.alias("text"))


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


@dataclass
class Frequencies:
    """What is known of the tokens of hash below ``top``: of how many documents they are.

    shared: bits by the last bits of a token; an unset one says that a single document holds it.  frequent and
    power: tokens of many documents, sorted, and the power of two of their document frequency.
    """

    top: np.uint64
    shared: np.ndarray
    frequent: np.ndarray
    power: np.ndarray

    def classes(self, u: np.ndarray) -> np.ndarray:
        """The first key of the order of sorted tokens: 0 for lone ones, 1 for the rest, more for frequent ones."""
        out = np.ones(len(u), np.int8)
        known = u[: np.searchsorted(u, self.top)]
        at = known & np.uint64(len(self.shared) * 64 - 1)
        out[: len(known)] = (self.shared[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        if len(self.frequent):
            maybe = np.flatnonzero(out[: len(known)])
            at = np.minimum(np.searchsorted(self.frequent, u[maybe]), len(self.frequent) - 1)
            hit = self.frequent[at] == u[maybe]
            out[maybe[hit]] = self.power[at[hit]] + 1
        return out


def frequencies(docs: DataFrame, k: int, percent: int) -> Frequencies:
    """Which tokens several documents hold, and which many.

    Probes are the first tokens by hash, so frequencies are counted for the lower part of the hash range, three times
    as large as a probe set.  Counts are summed in blocks of tokens before they are shuffled.
    """
    top = np.uint64(min(2**64 - 1, 3 * (100 - percent) * 2**64 // 100))

    def summed(block: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(block), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for u in _sets(batch.column("text"), k):
                block.append(u[: np.searchsorted(u, top)])
                held += len(block[-1])
                if held >= BLOCK_TOKENS:
                    yield summed(block)
                    block, held = [], 0
        if block:
            yield summed(block)

    counted = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = save(counted.where("n > 1").select("token", F.floor(F.log2(F.when(F.col("n") >= FREQUENT, F.col("n")).otherwise(1))).cast("int").alias("power")), "frequent")
    least, held, tokens = 64, 0, 0
    for power, n in sorted(often.groupBy("power").count().collect(), reverse=True):  # a row per power of two
        tokens += n
        if power and (held := held + n) <= FREQUENT_TOKENS:
            least = power
    bits = min(SHARED_BITS, max(64, 1 << (BITS_A_TOKEN * tokens).bit_length()))
    place = F.col("token").bitwiseAND(F.lit(bits - 1))
    words = often.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    shared = np.zeros(bits >> 6, np.uint64)
    shared[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    rows = often.where(F.col("power") >= least).toArrow()
    drop(often)
    token = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return Frequencies(top, shared, token[order], rows["power"].to_numpy()[order].astype(np.int8))


def probes(named: DataFrame, known: Frequencies, k: int, percent: int) -> DataFrame:
    """name, h, n (set size), f1 and f2 (fingerprint of the set), counts (tokens by hash range), probes (those of its first tokens that another document may hold; none if no other set can link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f1, f2, counts, first = [], [], [], [], []
            for u in _sets(batch.column("text"), k):
                n = len(u)
                with np.errstate(over="ignore"):
                    mixed = T.mix64(u + np.uint64(0x9E3779B97F4A7C15))
                size.append(n)
                f1.append(int(mixed.sum(dtype=np.uint64)) if n else 0)
                f2.append(int(np.bitwise_xor.reduce(T.mix64(mixed))) if n else 0)
                counts.append(range_counts(u).tobytes())
                least = -(-percent * n // 100)
                if n == 0 or (least == n and n * 100 // percent == n):
                    first.append(u[:0].view(np.int64))
                    continue
                m, of = n - least + 1, known.classes(u)
                m -= np.count_nonzero(of == 0)
                rest = np.flatnonzero(of)
                first.append(u[rest[np.argsort(of[rest], kind="stable")[: max(m, 0)]]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), batch.column("h"), pa.array(size, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(counts, pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                ["name", "h", "n", "f1", "f2", "counts", "probes"],
            )

    kind = named.schema["name"].dataType.simpleString()
    return named.mapInArrow(run, f"name {kind}, h long, n long, f1 long, f2 long, counts binary, probes array<long>")


def _members(sets: DataFrame) -> DataFrame:
    """token, node, n, held (nodes with that probe token), of tokens that several nodes probe."""
    rows = sets.select("node", "n", F.explode("probes").alias("token"))
    held = save(rows.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "held")
    members = save(rows.join(held, "token"), "members")
    drop(held)
    return members


def _groups(members: DataFrame) -> DataFrame:
    """node, g (group token), part: the group of every node that shares a probe token."""
    best = save(members.groupBy("node").agg(F.max_by("token", F.struct("held", "token")).alias("g"), F.max("n").alias("n")), "best")
    many = F.ceil(F.greatest(F.sum("n") / GROUP_TOKENS, F.count("*") / GROUP_DOCUMENTS))
    parts = save(best.groupBy("g").agg(many.alias("parts")), "parts")  # so that AQE can split the join
    groups = save(best.join(parts, "g").select("node", "g", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")), "groups")
    drop(best, parts)
    return groups


def _part(family: Column) -> Column:
    return F.struct("g", "part", family.alias("family"))


def _packed(placed: DataFrame) -> DataFrame:
    """p (a part) and its documents; placed: p, node, n, counts, component."""
    return placed.groupBy("p").agg(F.collect_list(F.struct("node", "n", "counts", "component")).alias("docs"))


def _across(held: DataFrame) -> DataFrame:
    """(a, b): pairs of parts with a token in common, of (token, p), but for two parts of one family (-1: of none)."""
    rows = held.select("token", "p", F.col("p.family").alias("family"))
    family = rows.select("token", "family").distinct()
    other = family.select("token", F.col("family").alias("family2"))
    met = family.join(other, "token").where("family < family2 or family = family2 and family = -1")
    left, right = rows.withColumnRenamed("p", "a"), rows.select("token", F.col("p").alias("b"), F.col("family").alias("family2"))
    pairs = met.join(left, ["token", "family"]).join(right, ["token", "family2"])
    return pairs.where("family < family2 or a < b").select("a", "b").distinct()


def _opened(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b, node, is_right: documents of a pair of parts (or of one, against itself) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            within = pc.is_null(batch.column("right_docs")).to_numpy(zero_copy_only=False)
            left = _Documents(batch.column("docs"))
            right = _Documents(pc.if_else(pc.is_null(batch.column("right_docs")), batch.column("docs"), batch.column("right_docs")))
            work = np.cumsum(np.diff(left.first) * np.diff(right.first))
            opened, start = [np.zeros(len(left.node), bool), np.zeros(len(right.node), bool)], 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
                for side, found in zip(opened, _may_link(left, right, range(start, stop), within, percent), strict=True):
                    side[found] = True
                start = stop
            out = []
            for side, docs, is_right in zip(opened, (left, right), (False, True), strict=True):
                found = np.flatnonzero(side)
                row = np.searchsorted(docs.first, found, "right") - 1
                out.append((row, docs.node[found], is_right & ~within[row]))
            row, node, is_right = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(row)), batch.column("b").take(pa.array(row)), pa.array(node), pa.array(is_right)], ["a", "b", "node", "is_right"])

    part = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "docs", "right_docs").mapInArrow(run, f"a {part}, b {part}, node long, is_right boolean").distinct()


def _tokens(named: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, copies, tokens (bytes of the sorted set) of ids (node, name, h, copies), whose texts are found by name and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array([u.tobytes() for u in _sets(batch.column("text"), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), tokens], ["node", "copies", "tokens"])

    return named.join(_few(ids), ["name", "h"]).select("node", "copies", "text").mapInArrow(run, "node long, copies long, tokens binary")


def _linked(a: list, b: list, percent: int) -> np.ndarray | None:
    """Which sets of a link with which of b; None if none can."""
    own, other = ([np.frombuffer(x["tokens"], np.uint64) for x in side] for side in (a, b))
    size_a, size_b = np.array([len(s) for s in own]), np.array([len(s) for s in other])
    union = np.unique(np.concatenate(other))
    flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), size_a)
    at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
    common = union[at] == flat
    bound = np.bincount(of[common], minlength=len(own))  # overlap of each query with the part's union
    opened = bound >= needed(size_a, np.maximum(size_b.min(), -(-percent * size_a // 100)), percent)
    if not opened.any():
        return None
    keep = common & opened[of]
    used, column = np.unique(at[keep], return_inverse=True)
    flat_b, of_b = np.concatenate(other), np.repeat(np.arange(len(other)), size_b)
    place = np.minimum(np.searchsorted(union[used], flat_b), len(used) - 1)
    hit = union[used][place] == flat_b
    sides = []
    for row, col in ((of[keep], column), (of_b[hit], place[hit])):
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    overlap = np.zeros((len(own), len(other)), np.float32)
    for low in range(0, len(used), MATRIX_COLUMNS):
        block = []
        for (row, col), height in zip(sides, overlap.shape, strict=True):
            span = slice(*np.searchsorted(col, (low, low + MATRIX_COLUMNS)))
            block.append(np.zeros((height, min(MATRIX_COLUMNS, len(used) - low)), np.float32))
            block[-1][row[span], col[span] - low] = 1
        overlap += block[0] @ block[1].T
    return overlap.round().astype(np.int64) >= needed(size_a[:, None], size_b[None, :], percent)


def _forest(linked: np.ndarray, ids: list, ids_b: list) -> Iterator[tuple]:
    """A spanning forest of the links."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(ids[i]), root(ids_b[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield ids[i], ids_b[j]


def _links(a: list, b: list, percent: int, count: bool) -> Iterator[tuple]:
    """A spanning forest (a, b, null) of the links between the sets of two parts, or within one (b empty).

    With ``count`` also (a, null, n): the rows in other classes that a links with, each link of the pair of parts counted.
    """
    a, b = (list({x["node"]: x for x in side}.values()) for side in (a, b))  # repeated rows have one set
    within, b = not b, b or a
    linked = _linked(a, b, percent)
    if linked is None:
        return
    if within:
        np.fill_diagonal(linked, False)
    ids, ids_b = ([x["node"] for x in side] for side in (a, b))
    if count:
        for names, matrix, others in [(ids, linked, b)] if within else [(ids, linked, b), (ids_b, linked.T, a)]:
            n = matrix @ np.array([x["copies"] for x in others], np.int64)
            yield from ((names[i], None, int(n[i])) for i in np.flatnonzero(n))
    yield from ((x, y, None) for x, y in _forest(np.triu(linked) if within else linked, ids, ids_b))


def _verify(pairs: DataFrame, percent: int, count: bool) -> DataFrame:
    """(a, b, n) of rows with the opened sets of one part (right_sets empty) or of two, see _links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for left, right in zip(batch.column("sets"), batch.column("right_sets"), strict=True) for row in _links(left.as_py(), right.as_py(), percent, count)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    return pairs.select("sets", "right_sets").mapInArrow(run, "a long, b long, n long")


def _compare(named: DataFrame, nodes: DataFrame, packed: DataFrame, pairs: DataFrame, k: int, percent: int, inside: bool, count: bool) -> DataFrame:
    """(a, b, n) links of the given pairs of parts and, if ``inside``, within the parts; written to the shared folder."""
    left, right = packed.select(F.col("p").alias("a"), "docs"), packed.select(F.col("p").alias("b"), F.col("docs").alias("right_docs"))
    todo = pairs.join(left, "a").join(right, "b").select("a", "b", "docs", "right_docs")
    if inside:
        nothing = F.lit(None).cast(packed.schema["docs"].dataType)
        todo = todo.unionByName(left.where(F.size("docs") > 1).select("a", F.col("a").alias("b"), "docs", nothing.alias("right_docs")))
    opened = save(_opened(todo, percent), "opened")
    ids = save(opened.select("node").distinct().join(nodes, "node"), "ids")
    tokens = _tokens(named, ids, k)
    one = F.struct(*tokens.columns)
    full = opened.join(tokens, "node").groupBy("a", "b").agg(F.collect_list(F.when(~F.col("is_right"), one)).alias("sets"), F.collect_list(F.when(F.col("is_right"), one)).alias("right_sets"))
    links = save(_verify(full, percent, count), "links")
    drop(opened, ids)
    return links


def find_links(named: DataFrame, sets: DataFrame, nodes: DataFrame, k: int, percent: int, count: bool = False) -> list[DataFrame]:
    """Tables (a, b, n) of links between different sets, enough to connect all that link (b not null).

    With ``count`` also the sums of all links by pair of parts (see _links); then no comparison is left out.
    """
    members = _members(sets)
    groups = _groups(members)
    counted = groups.join(sets.select("node", "n", "counts"), "node")
    matrix = lambda placed: members.select("token", "node").join(placed.select("node", "p"), "node").select("token", "p").distinct()
    several = lambda rows: rows.join(rows.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"), "token").select("token", "p")
    none = counted.select(_part(F.lit(-1).cast("long")).alias("p"), "node", "n", "counts", F.col("node").alias("component"))
    if count:
        union = save(matrix(none), "matrix")
        across = save(_across(several(union)), "across")
        links = [_compare(named, nodes, _packed(none), across, k, percent, True, True)]
        drop(members, groups, union, across)
        return links
    to_first = none.where("p.part > 0").select(F.col("p").alias("a"), F.struct("p.g", F.lit(0).alias("part"), "p.family").alias("b")).distinct()
    near = _compare(named, nodes, _packed(none), to_first, k, percent, True, False)
    known = components(near)
    families = known.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= FAMILY).select(F.col("component").alias("family"))
    known = save(known.join(families, F.col("component") == F.col("family"), "left").select("node", "component", F.coalesce("family", F.lit(-1)).alias("family")), "known")
    placed = counted.join(known, "node", "left").select(_part(F.coalesce("family", F.lit(-1))).alias("p"), "node", "n", "counts", F.coalesce("component", "node").alias("component"))
    union = save(matrix(placed), "matrix")
    across = save(_across(several(union)).where("not (a.g = b.g and (a.part = 0 or b.part = 0 or a.part = b.part))"), "across")
    far = _compare(named, nodes, _packed(placed), across, k, percent, False, False)
    drop(members, groups, union, across, known)
    return [near, far]


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, count: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest doc_id with an equal set), component_id, of every row of documents.

    With ``count`` also n_links: the other rows that link with the row, equal ones too.  Every link is counted then, so
    no comparison is left out for documents that are connected already: a family of different texts costs the square of
    its size in products (of 0/1 matrices), its sets move once for every part of the family, and its counts are a row
    for each document and pair of parts.
    """
    return _joined(docs, k, percent, count).drop("h")


def _joined(docs: DataFrame, k: int, percent: int, count: bool) -> DataFrame:
    """The rows of join, with h, the hash of the text."""
    keys = ["f1", "f2", "n"]
    named = _named(docs)
    sets = save(probes(named, frequencies(docs, k, percent), k, percent).withColumn("node", F.monotonically_increasing_id()), "sets")
    able = sets.where("name is not null and n > 0")
    classes = able.groupBy(*keys).agg(F.min(F.struct("name", "node")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    classes = save(classes.select(*keys, F.col("first.name").alias("class_id"), F.col("first.node").alias("first"), "copies"), "classes")  # written, so that AQE can split the join for a hot class
    own = F.col("name").isNotNull() & (F.col("n") > 0)
    classed = sets.select("node", "name", "h", *keys).join(classes, keys, "left")
    classed = save(
        classed.select("name", "h", "n", "node", F.when(own, F.coalesce("first", "node")).alias("rep"), F.when(own, F.coalesce("class_id", "name")).otherwise(F.col("name")).alias("class_id"), F.when(own, F.coalesce("copies", F.lit(1))).otherwise(1).alias("copies")),
        "classed",
    )
    others = _few(classed.where("rep != node").select("node"))
    alone = sets.where("name is not null").where(F.size("probes") > 0).join(others, "node", "left_anti")
    nodes = classed.where("rep = node").select("node", "name", "h", "copies")
    links = find_links(named, alone, nodes, k, percent, count)
    drop(sets, classes)
    every = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    parts = components(every.where("b is not null").select("a", "b"))
    least = parts.join(nodes.select("node", "name"), "node").groupBy("component").agg(F.min("name").alias("component_id"))
    found = parts.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    if count:
        found = found.join(every.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked")), "rep")
    found = save(found, "found")
    drop(*links)
    joined = classed.join(found, "rep", "left")
    n_links = [(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")] if count else []
    return joined.select(F.col("name").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", *n_links, F.coalesce("component_id", "class_id").alias("component_id"), "h")


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id; all documents without a link stay.

    Every column is returned.  Repeated rows of a document that stays all stay, as do rows with a null doc_id.
    """
    gone = save(_joined(docs, k, percent, False).where("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct(), "gone")
    same = (docs["doc_id"] == F.col("_gone")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_h"))
    return docs.join(_few(gone), same, "left_anti")

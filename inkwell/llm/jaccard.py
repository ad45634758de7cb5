"""N-gram Jaccard join over a count-vector R-tree, exact, and the groups that its links form.

A document's set holds the hashes of its distinct word shingles. Two sets of n and m shingles with a similarity of at
least s differ in at most (n + m)(1 - s) / (1 + s) shingles. So if the hash space is cut into more groups than that,
some group of both holds exactly the same shingles: documents that agree in a whole group are candidates, and no link
is lost. The same holds for the rare shingles alone, so most documents sign for these only, and a passage that very
many documents share makes no candidates of them, and groups beyond the bound let each sign for its most telling ones
alone. Chains of candidates are coarse families; within a family the counts
of each document's shingles in groups, the more groups the larger its set, are points of an R-tree, the summed
coordinate minima bound the overlap from above, and pairs that survive the bound are compared. A pair whose ends are
known to be connected adds nothing to the groups and is passed over, so that a family of thousands of copies needs few
comparisons.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_rows, materialize, reachable, scratch
from .components import connected

WIDTH = 3
LEVEL = (90, 100)
#: Texts of a family that meet in one task; larger families are cut into tiles of this size. Texts of finer families.
TILE = 64
BLOCK = 128
#: Least number of groups of a count vector.
DIMENSIONS = 64
#: Texts on either side of a block in which only counts are compared.
POINTS = 2048
FANOUT = 8
#: Cells of the sketch that tells common shingles, and bytes of signatures that meet in a task.
CELLS = 1 << 18
MEET_BYTES = 8 << 20
#: Signatures, and nodes (below 2^16), that a task gathers before it sends them; ranges of signatures sorted in turn.
GATHER = 3 << 20
GATHER_NODES = 1 << 15
RANGES = 16
#: Documents with this share of rare shingles sign for these alone.
RARE = 0.7
#: Most times that large families are parted by signatures in other groups.
REGROUPS = 3
_M1, _M2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(56)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words as bytes, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    h = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        h = mix(h * _P + w[k : len(words) - span + 1 + k])
    return np.unique(h)


def fingerprint(items: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    size = np.full(1, items.size, np.uint64)
    return int(mix(np.bitwise_xor.reduce(mix(items + _P)) + size * _P).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, level: tuple[int, int]) -> bool:
    both = a.size + b.size
    # |intersection| >= s |union|, in whole numbers; sizes first
    if min(a.size, b.size) * level[1] < max(a.size, b.size) * level[0]:
        return False
    small, large = (a, b) if a.size <= b.size else (b, a)
    at = np.searchsorted(large, small)
    at[at == large.size] = 0
    common = int(np.count_nonzero(large[at] == small))
    return common * level[1] >= (both - common) * level[0]


class Classes:
    """Size classes [start, next start) of the smaller set of a pair, and the number of groups in each, for a similarity level."""

    def __init__(self, level: tuple[int, int]) -> None:
        num, den = level
        self.level, self.starts, self.groups, self.slack = level, [], [], []
        # Smaller sets that differ at all are below the level.
        start = max(1, -(-num // (den - num))) if num < den else 1 << 62
        while start < 1 << 40:
            end = max(start + 1, start * den // num)
            most = (end - 1 + (end - 1) * den // num) * (den - num) // (den + num)
            slack = (most + 1) // 2 + 1
            self.starts.append(start)
            self.slack.append(slack)
            self.groups.append(most + 1 + slack)
            start = end

    def of(self, n: int) -> range:
        """The classes that a set of n signs for: its own, and those of its smallest partners."""
        own = int(np.searchsorted(self.starts, n, "right")) - 1
        least = int(np.searchsorted(self.starts, -(-n * self.level[0] // self.level[1]), "right")) - 1
        return range(max(0, least), own + 1)

    def signatures(self, items: np.ndarray, common: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """A hash of the content of each group, for each class. Of two linked sets at least one is the same.
        Another seed groups anew. The first byte names the class.

        common: marks cells of the hash space that hold common shingles. Linked sets lack at most 1 - s of one
        another, so where one has a share of RARE rare shingles or more, the other has (RARE - (1 - s)) s or more. Sets
        between these bounds sign for their rare shingles and for all, so that any two linked sets do one of the two.
        """
        s = self.level[0] / self.level[1]
        seldom = np.ones(items.size, bool) if common is None else ~common[cell_of(items, common.size)]
        if seed:
            items = mix(items + np.uint64(seed * int(_P) % (1 << 64)))
            order = np.argsort(items)
            items, seldom = items[order], seldom[order]
        rare, out = items[seldom], []
        if rare.size < RARE * items.size:
            out.append(self._signed(items, np.where(seldom, 4, 1), items.size, 1))
        if rare.size >= (RARE - (1 - s)) * s * items.size - 1e-6:
            out.append(self._signed(rare, np.full(rare.size, 4), items.size, 0))
        return np.concatenate(out)

    def _signed(self, items: np.ndarray, worth: np.ndarray, n: int, kind: int) -> np.ndarray:
        """Linked sets share slack + 1 groups or more, so each need not sign for its slack least telling groups: empty
        ones, then those of least worth, in an order by content alone. Of the shared groups the last in that order
        stands behind slack others in both sets, so both sign for it. Groups of one shingle, which chance makes equal
        far more often than groups of more, so mostly go."""
        out = []
        spread = mix(items ^ _P)
        # Groups are ranges of the hash space, so sorted items are in order of their groups.
        top = (items >> np.uint64(11)).astype(np.float64) * 2.0**-53
        for k in self.of(n):
            groups = self.groups[k]
            member = np.minimum((top * groups).astype(np.int64), groups - 1)
            first = np.flatnonzero(np.diff(member, prepend=-1))
            sums, which = (np.add.reduceat(spread, first) if first.size else spread), member[first].astype(np.uint64)
            weight = np.add.reduceat(worth, first) if first.size else worth
            spare = self.slack[k] - (groups - first.size)
            if spare < 0:
                empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), which)
                sums, which, weight = np.r_[sums, np.zeros(empty.size, np.uint64)], np.r_[which, empty], np.r_[weight, np.zeros(empty.size, weight.dtype)]
                spare = self.slack[k]
            signed = _classed(mix(sums + mix(which * _P + np.uint64(2 * k + kind))), np.uint64(k % 256) << _TOP)
            out.append(signed[np.lexsort((signed, weight))[spare:]])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _classed(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes whose first byte gives way to a class in the first byte."""
    return hashes >> np.uint64(8) | classes


def cell_of(items: np.ndarray, cells: int) -> np.ndarray:
    """The sketch's cell of each shingle (cells is a power of two), by bits that groups don't begin with."""
    return ((items >> np.uint64(16)) & np.uint64(cells - 1)).astype(np.int64)


def dimensions(n: int) -> int:
    """Groups of the count vector of a set of n: a power of two, two to four shingles a group."""
    return max(DIMENSIONS, 1 << max(0, int(n).bit_length() - 2))


def counts(items: np.ndarray, groups: int) -> np.ndarray:
    """How many of the set's shingles fall into each group, by bits that grouping for signatures doesn't use first."""
    return np.bincount((items & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors of more groups as those of fewer."""
    return vectors.reshape(*vectors.shape[:-1], -1, groups).sum(axis=-2)


class CountTree:
    """An R-tree over count vectors, packed top down: each node is halved along the coordinate that varies most.

    Nodes keep coordinate maxima, and least and largest sizes.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = self._packed(points, sizes)
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while self.levels[-1][0].shape[0] > FANOUT:
            high, least, most = self.levels[-1]
            at = np.arange(0, high.shape[0], FANOUT)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    @staticmethod
    def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places in the order of their leaves: parts are multiples of FANOUT, halved until they fill one leaf."""
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(sizes))]
        while todo:
            part = todo.pop()
            if part.size <= FANOUT:
                leaves.append(part)
                continue
            own = sizes[part]
            by = own if own.max() * 4 > own.min() * 5 else points[part, int(np.argmax(np.ptp(points[part], axis=0)))]
            half = (-(-part.size // FANOUT) + 1) // 2 * FANOUT
            split = np.argpartition(by, half - 1) if half < part.size else np.arange(part.size)
            todo += [part[split[half:]], part[split[:half]]]
        return np.concatenate(leaves) if leaves else np.empty(0, np.int64)

    def search(self, point: np.ndarray, size: int, level: tuple[int, int]) -> np.ndarray:
        """Places of the points whose summed minima allow the level."""
        num, den = level
        at = np.arange(self.levels[-1][0].shape[0])
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = (x[at] for x in self.levels[depth])
            # overlap >= s / (1 + s) * (n + m); m is at least the node's least size and at least s * n
            partner = np.maximum(least, -(-size * num // den))
            fits = (np.minimum(high, point).sum(axis=1) * (num + den) >= num * (size + partner)) & (most * den >= size * num) & (least * num <= size * den)
            at = at[fits]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < self.levels[depth - 1][0].shape[0]]
        return self.order[at]


class Forest:
    """Count trees, one for each number of groups, searched with vectors of any number."""

    def __init__(self, vectors: list[np.ndarray], sizes: list[int]) -> None:
        self.by: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            self.by.setdefault(v.size, []).append(k)
        self.vectors, self.sizes = vectors, np.array(sizes)
        self.trees: dict[tuple[int, int], CountTree] = {}

    def search(self, vector: np.ndarray, size: int, level: tuple[int, int]) -> np.ndarray:
        found = []
        for groups, places in self.by.items():
            low = min(groups, vector.size)
            # Sizes of linked sets differ by at most the level, and so do their numbers of groups.
            if self.sizes[places].max() * level[1] < size * level[0] or self.sizes[places].min() * level[0] > size * level[1]:
                continue
            if (groups, low) not in self.trees:
                self.trees[groups, low] = CountTree(folded(np.stack([self.vectors[k] for k in places]).astype(np.int64), low), self.sizes[places])
            found.append(np.array(places)[self.trees[groups, low].search(folded(vector.astype(np.int64), low), size, level)])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def link_groups(sets: list[np.ndarray], labels: list[int], asks: list[int], level: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect what is connected: pairs of places, no cycle. asks: the places to search for; labels: known components."""
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    points = [counts(s, dimensions(s.size)) for s in sets]
    tree, out, done = Forest(points, [s.size for s in sets]), [], np.zeros(len(sets), bool)
    for i in asks:
        done[i] = True
        near = tree.search(points[i], sets[i].size, level)
        for j in near[~done[near]]:
            a, b = root(labels[i]), root(labels[int(j)])
            if a != b and linked(sets[i], sets[int(j)], level):
                parent[a] = b
                out.append((i, int(j)))
    return out


def _sets(df: DataFrame, width: int) -> DataFrame:
    """doc_id, key, n, node: the size and the hash of each row's set; and rows of cell, times: the sketch of each task.

    A cell's times are the shingles of all documents that fall into it. One pass gives both, so one table holds both.
    """

    def sets(batches):
        import pyarrow as pa

        times = np.zeros(CELLS, np.int64)
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                found = [shingles(t, width, hashes) for t in rows.column("text").to_pylist()]
                for s in found:
                    times += np.bincount(cell_of(s, CELLS), minlength=CELLS) if s.size > CELLS // 8 else 0
                small = [s for s in found if 0 < s.size <= CELLS // 8]
                if small:
                    times += np.bincount(cell_of(np.concatenate(small), CELLS), minlength=CELLS)
                nothing = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), rows.column("key"), pa.array([s.size for s in found], pa.int64()), pa.array([fingerprint(s) if s.size else None for s in found], pa.int64()), nothing.cast(pa.int32()), nothing],
                    names=["doc_id", "key", "n", "node", "cell", "times"],
                )
        at = np.flatnonzero(times)
        nothing = pa.nulls(at.size, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(at, pa.int32()), pa.array(times[at], pa.int64())], names=["doc_id", "key", "n", "node", "cell", "times"])

    return df.mapInArrow(sets, "doc_id long, key long, n long, node long, cell int, times long")


def _common(table: DataFrame) -> np.ndarray:
    """Which cells hold shingles far more frequent than chance lets cells be: ten standard deviations above the mean.

    Counts over all documents; what reaches the driver is a number a cell. Any answer gives the same links: it only
    decides which documents are held against one another.
    """
    sums = table.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(CELLS, np.int64)
    times[sums.column("cell").to_numpy()] = sums.column("times").to_numpy()
    mean = times.sum() / CELLS
    return times > mean + 10 * np.sqrt(mean) + 10


def _buckets(sizes: DataFrame, level: tuple[int, int]) -> np.ndarray:
    """How many buckets the signatures of each first byte get: about MEET_BYTES each, by sets of size n; a few hundred numbers reach the driver."""
    classes, signed = Classes(level), np.zeros(256)
    for r in sizes.where("n > 0").groupBy(F.floor(F.log2("n") * 8).alias("octave")).agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max("n").alias("most")).collect():
        for k in range(classes.of(r["least"]).start, classes.of(r["most"]).stop):
            signed[k % 256] += r["many"] * (classes.groups[k] - classes.slack[k])
    return np.ceil(signed * 10 / MEET_BYTES).astype(np.int64)  # ten bytes a signature, about


def _candidates(df: DataFrame, width: int, level: tuple[int, int], common: np.ndarray, each: np.ndarray, seed: int = 0) -> DataFrame:
    """a, b: edges that connect all nodes which share a signature; where df has a family, within it. each: _buckets.

    A task gathers signatures up to a fixed number, however long or short the texts, joins its own nodes of a signature
    to the least of them and sends on that one alone, packed with others into one value for each bucket of the hash
    space: signatures, places in a list of nodes, and that list. So a signature that very many share costs one entry
    each time. Buckets are as many as the corpus' shingles ask for, so that what meets in a task stays as large whatever
    the corpus. Each size class has buckets of its own, so that sets which share many signatures meet in few of them:
    every bucket names the same edges again.
    """
    begins, buckets = np.cumsum(each) - each, max(1, int(each.sum()))
    packed = np.packbits(common).tobytes()
    apart = "family" in df.columns

    def bucket_of(sig: np.ndarray) -> np.ndarray:
        """Rises with sig."""
        out = np.empty(sig.size, np.int32)
        for at in range(0, sig.size, 1 << 18):
            part = sig[at : at + (1 << 18)]
            kind, spot = (part >> _TOP).astype(np.int64), (part >> np.uint64(24)).astype(np.int64) & 0xFFFFFFFF
            out[at : at + part.size] = np.minimum(begins[kind] + (spot * each[kind] >> 32), buckets - 1)
        return out

    def send(nodes: dict[int, np.ndarray]):
        import pyarrow as pa

        out = {"bucket": [], "signatures": [], "places": [], "nodes": [], "edges": []}
        names = np.sort(np.fromiter(nodes, np.int64, len(nodes)))
        every = [nodes.pop(n) for n in names.tolist()]
        owners = np.repeat(np.arange(names.size, dtype=np.uint16), [x.size for x in every])
        signed = np.concatenate(every)
        del every
        ranges, ends = (bucket_of(signed) * np.int32(RANGES) // np.int32(buckets)).astype(np.uint8), [np.empty((2, 0), np.uint16)]
        for r in range(RANGES):
            this = ranges == r
            if not this.any():
                continue
            edges, sig, low = _stars(signed[this], owners[this])
            ends.append(np.stack(edges))
            where = bucket_of(sig)
            first = np.flatnonzero(np.diff(where, prepend=-1))
            for k, start, end in zip(where[first], first, np.r_[first[1:], where.size], strict=True):
                part = slice(start, end)
                there, place = np.unique(low[part], return_inverse=True)
                out["bucket"].append(int(k))
                # The bucket says the class: six bytes tell its signatures apart.
                out["signatures"].append(sig[part].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                out["places"].append(place.astype(np.uint16).tobytes())
                out["nodes"].append(names[there].tobytes())
                out["edges"].append(b"")
        a, b = np.unique(np.concatenate(ends, axis=1), axis=1)
        if a.size:  # edges found here travel along, to any bucket
            out["bucket"].append(int(names[a[0]] % buckets))
            for column in ("signatures", "places", "nodes"):
                out[column].append(b"")
            out["edges"].append(names[a].tobytes() + names[b].tobytes())
        kinds = {"bucket": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()], names=list(out))

    def gather(batches):
        hashes, classes = WordHashes(), Classes(level)
        marks = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        nodes: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                families = some.column("family").to_pylist() if apart else [None] * some.num_rows
                for text, family in zip(some.column("text").to_pylist(), families, strict=True):
                    items = shingles(text, width, hashes)
                    if items.size and (node := fingerprint(items)) not in nodes:
                        signed = classes.signatures(items, marks, seed)
                        if apart:
                            signed = _classed(mix(signed + np.array([family]).view(np.uint64)), signed >> _TOP << _TOP)
                        nodes[node] = signed
                        held += nodes[node].size
                        if held >= GATHER or len(nodes) >= GATHER_NODES:
                            yield send(nodes)
                            held = 0
        if nodes:
            yield send(nodes)

    def meet(table):
        import pyarrow as pa

        sigs, owns, ends = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty((2, 0), np.int64)]
        for s, p, n, e in zip(*(table.column(c).to_pylist() for c in ("signatures", "places", "nodes", "edges")), strict=True):
            whole = np.zeros((len(s) // 6, 8), np.uint8)
            whole[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
            sigs.append(whole.view(np.uint64).ravel())
            owns.append(np.frombuffer(n, np.int64)[np.frombuffer(p, np.uint16)])
            ends.append(np.frombuffer(e, np.int64).reshape(2, -1))
        (a, b), _, _ = _stars(np.concatenate(sigs), np.concatenate(owns))
        c, d = np.concatenate(ends, axis=1)
        return pa.table({"a": pa.array(np.r_[a, c], pa.int64()), "b": pa.array(np.r_[b, d], pa.int64())})

    sent = df.select("text", *["family"] * apart).mapInArrow(gather, "bucket int, signatures binary, places binary, nodes binary, edges binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _stars(sig: np.ndarray, own: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Distinct edges from each signature's nodes to its least node; the signatures in order, and those least nodes."""
    if not sig.size:
        return (own, own), sig, own
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    low = np.repeat(own[first], np.diff(np.r_[first, sig.size]))
    apart = own != low
    edges = np.unique(np.stack([own[apart], low[apart]]), axis=1)
    return (edges[0], edges[1]), sig[first], own[first]


def _linked_edges(members: DataFrame, width: int, level: tuple[int, int]) -> DataFrame:
    """a, b: verified links within each (family, tile, part) of members: node, label, asks, text."""

    def work(table):
        import pyarrow as pa

        hashes, sets, labels, asks = WordHashes(), {}, {}, set()
        for node, label, ask, text in zip(*(table.column(c).to_pylist() for c in ("node", "label", "asks", "text")), strict=True):
            if node not in sets:
                items = shingles(text, width, hashes)
                if not items.size or fingerprint(items) != node:  # another row of the same key
                    continue
                sets[node], labels[node] = items, label
            if ask:
                asks.add(node)
        nodes = list(sets)
        place = {n: k for k, n in enumerate(nodes)}
        found = link_groups([sets[n] for n in nodes], [labels[n] for n in nodes], [place[n] for n in sorted(asks & sets.keys())], level) if nodes else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return members.groupBy("family", "tile", "part").applyInArrow(work, "a long, b long")


def _possible(points: DataFrame, labelled: DataFrame, outside: DataFrame, level: tuple[int, int]) -> DataFrame:
    """node, close: finer families, connected by pairs of an outsider and a text of another component that the bound allows.

    points: node, size, counts. Only counts travel, about a byte a shingle, so blocks may be POINTS wide; a block names
    only pairs that connect what it has not connected yet. Documents that share a passage, and so a signature, but
    little else end here: their texts are not copied, and families that met by such documents part again.
    """

    many = lambda df, name: df.groupBy("family").agg(F.ceil(F.count("*") / POINTS).cast("int").alias(name))
    wide = materialize(many(labelled, "columns").join(many(outside, "rows"), "family"), "grid")
    spot = lambda seed, of: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asking = outside.join(wide, "family").select("family", "node", "label", spot(3, "rows").alias("row"), every("columns").alias("column"), F.lit(True).alias("asks"))
    asked = labelled.join(wide, "family").select("family", "node", "label", every("rows").alias("row"), spot(4, "columns").alias("column"), F.lit(False).alias("asks"))

    def bound(table):
        import pyarrow as pa

        rows = [dict(zip(("node", "label", "asks", "size", "counts"), r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in ("node", "label", "asks", "size", "counts")), strict=True)]
        held, seek = [r for r in rows if not r["asks"]], [r for r in rows if r["asks"]]
        parent = {r["node"]: r["node"] for r in rows}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        if held and seek:
            labels = np.array([r["label"] for r in held])
            tree = Forest([np.frombuffer(r["counts"], np.uint16) for r in held], [r["size"] for r in held])
            for r in seek:
                near = tree.search(np.frombuffer(r["counts"], np.uint16), r["size"], level)
                for k in near[labels[near] != r["label"]]:
                    x, y = root(r["node"]), root(held[k]["node"])
                    if x != y:
                        parent[x] = y
                        edges.append((r["node"], held[k]["node"]))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    grid = asking.unionByName(asked).join(points, "node")
    edges = grid.groupBy("family", "row", "column").applyInArrow(bound, "a long, b long")
    return connected(edges).withColumnRenamed("component", "close")


def _members(docs: DataFrame, carriers: DataFrame, width: int) -> DataFrame:
    """family, tile, tiles, node, text: one row a node, or a few of them where rows are equal in id and text; with size and counts in large families.

    Rows meet their key by a sort-merge join, so equal rows stand beside one another and all but the first of a batch
    go before texts are dealt out.
    """

    def batch(rows: dict) -> dict:
        hashes = WordHashes()
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        seen = set()
        for family, tile, tiles, node, text in zip(*(rows[c] for c in ("family", "tile", "tiles", "node", "text")), strict=True):
            if (node, text) in seen:
                continue
            seen.add((node, text))
            items = shingles(text, width, hashes) if tiles > 1 else None
            if items is not None and (not items.size or fingerprint(items) != node):  # another row of the same key
                continue
            vector = None if items is None else counts(items, dimensions(items.size)).astype(np.uint16).tobytes()
            for column, value in zip(out, (family, tile, tiles, node, text, None if items is None else items.size, vector), strict=True):
                out[column].append(value)
        return out

    schema = "family long, tile int, tiles int, node long, text string, size long, counts binary"
    joined = docs.select("key", "text").join(carriers.hint("merge"), "key").select("family", "tile", "tiles", "node", "text")
    return map_rows(joined, batch, schema)


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, level: tuple[int, int] = LEVEL) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest id that it reaches by links, itself included.

    Rows link if level[1] * intersection >= level[0] * union of their sets. Null and blank texts have an empty set and
    link with nothing; a text of fewer words than width is one shingle. Equal sets are one node, so exact copies and
    repeated rows cost a hash each. Ids may be null or repeated, whatever the texts; null ids are passed over by the
    minimum unless a group has no other. An empty table gives no rows; other columns don't matter.

    Families of more than TILE distinct texts are cut into tiles by hash. Each tile is joined with itself and with the
    family's first. What then stands outside the family's largest component is held against the whole family in blocks
    of counts; texts that the bound allows to link form finer families, which are compared block by block.
    Work on a family whose members link with one another is so proportional to its size. Tables written on the way go
    at the end, but for the two that the result reads.
    """
    spark = df.sparkSession
    reachable(spark)
    docs = columns(df, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    with scratch(spark) as keep:
        whole = materialize(_sets(docs, width), "sets")
        sets = whole.where("n is not null").drop("cell", "times")
        common = _common(whole)
        coarse = connected(_candidates(docs, width, level, common, _buckets(sets, level)))
        coarse = materialize(coarse.select("node", F.col("component").alias("family")), "families")
        # One row a node before the join: exact copies have met by partial sums.
        carriers = _tiled(sets.where("n > 0").groupBy("node").agg(F.min("key").alias("key")).join(coarse, "node"), coarse, "carriers")
        # Dealt by key at every size: only families travel on, but which these are is known too late to be read first.
        members = materialize(_members(docs, carriers, width), "members")
        members, wide = _regrouped(members, carriers.where("tiles > 1").drop("key"), width, level, common)
        groups = _verified(members, wide, width, level)
        lone = F.xxhash64(F.lit("empty"), F.col("key"))
        rooted = sets.join(groups, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(lone).alias("root"))
        rooted = materialize(rooted, "rooted")
        least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
        least = materialize(least, "least")
        named = rooted.join(least, "root", "left")
        keep(rooted, least)
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _tiled(nodes: DataFrame, families: DataFrame, name: str) -> DataFrame:
    """nodes with their family's number of tiles, and their tile. families: one row a node."""
    sizes = materialize(families.groupBy("family").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "tiles")
    tile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    return materialize(nodes.join(sizes, "family").withColumn("tile", tile), name)


def _regrouped(members: DataFrame, wide: DataFrame, width: int, level: tuple[int, int], common: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """members and wide (node, family, tile, tiles of large families) after large families have parted.

    Linked sets share a signature however shingles are grouped, and chance links others. So each large family is
    connected again within itself by signatures in other groups: what chance alone had chained parts, nodes without a
    partner go, no link is lost, and the work is in proportion to the family. Families of more than POINTS texts
    after that are parted again, REGROUPS times at most.
    """
    least = TILE
    for seed in range(1, REGROUPS + 1):
        large = materialize(wide.groupBy("family").agg(F.count("*").alias("many")).where(F.col("many") > least).select("family"), "large")
        if large.isEmpty():
            break
        texts = materialize(members.where("tiles > 1").join(large, "family").drop("tile", "tiles"), "texts")
        each = _buckets(texts.select(F.col("size").alias("n")), level)
        close = connected(_candidates(texts, width, level, common, each, seed))
        close = materialize(close.select("node", F.col("component").alias("family")), "families")
        close = _tiled(close, close, "regrouped")
        members = members.join(large, "family", "left_anti").unionByName(texts.drop("family").join(close, "node").select(members.columns))
        members = materialize(members, "members")
        wide = materialize(wide.join(large, "family", "left_anti").unionByName(close.where("tiles > 1").select(wide.columns)), "wide")
        least = POINTS
    return members, wide


def _verified(members: DataFrame, wide: DataFrame, width: int, level: tuple[int, int]) -> DataFrame:
    """node, component by the links of all families. wide: node, family, tile, tiles of the large ones."""
    spread = F.when((F.col("tile") == 0) & (F.col("tiles") > 1), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    own = members.select("family", F.explode(spread).alias("tile"), F.lit(0).alias("part"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"), "text")
    links = materialize(_linked_edges(own, width, level), "links")
    groups = materialize(connected(links), "groups")
    if wide.isEmpty():
        return groups
    labelled = wide.join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = materialize(labelled, "labelled")
    largest = labelled.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    largest = materialize(largest, "largest")
    outside = materialize(labelled.join(largest, "family").where("label <> main").drop("main"), "outside")
    if outside.isEmpty():
        return groups
    points = materialize(members.where("tiles > 1").select("node", "size", "counts").dropDuplicates(["node"]), "points")
    close = materialize(_possible(points, labelled, outside, level), "close")
    finer = lambda df: df.drop("family").join(close, "node").withColumnRenamed("close", "family")
    outside, labelled = materialize(finer(outside), "outside"), materialize(finer(labelled), "labelled")
    many = lambda df, name: df.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    parts = materialize(many(outside, "parts").join(many(labelled, "columns"), "family"), "parts")
    part, column = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns")).cast("int")
    asking = outside.join(parts, "family").select("family", "node", "label", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("tile"), part.alias("part"), F.lit(True).alias("asks"))
    asked = labelled.join(parts, "family").select("family", "node", "label", column.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    blocks = asking.unionByName(asked)
    rest = blocks.join(members.where("tiles > 1").select("node", "text").hint("merge"), "node")
    links = links.unionByName(materialize(_linked_edges(rest, width, level), "links"))
    return materialize(connected(links), "groups")


#: DuckDB: shingles as text, all pairs that share one, and reachability by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS ss FROM w
), u AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS shingle FROM s
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs WHERE 100 * c >= 90 * (n + m - c)
), reach AS (
  SELECT doc_id, doc_id AS c FROM s UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.doc_id
), least AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id FROM s JOIN least ON s.doc_id = least.doc_id
"""

"""N-gram Jaccard join: grouped prefix join with exact verification, and the classes that its links form.

A document is the set of its word n-grams, hashed to 64 bits and sorted. By the prefix lemma two sets with
Jaccard similarity t or more share a member among the first p = n - ceil(t n) + 1 of each, in any order that is the
same for all documents. The order here puts members that are frequent among prefixes last and else follows the hash.
So that the frequent ones can be skipped, a document hands in an extended prefix of about 3p/2 members; where too few
infrequent ones are in it, the document is *plain*: it is joined by the pure hash order, which is an order as well.

1. Equal sets collapse to one node (by fingerprint), at first within an Arrow batch.
2. Nodes of one size with identical extended prefixes form a group; only its leader enters the lists of prefix members.
   Linked sets share not one but 1 + x members of prefixes that are x longer, so a group that shares fewer with all
   others together leaves the lists. Most documents that share a passage alone go here, before anything is compared. Of
   lists that hold the same groups one stays.
3. Each list is filtered by size and by a parity sketch, whose differing bits never exceed the symmetric difference,
   so the filter rejects no link. Short lists give every pair that passes; in a longer one each leader keeps an edge to
   one earlier leader, and outside lists each other node of a group one to its leader: about as many edges as nodes,
   however large a group of near copies is.
4. Edges are verified on whole sets and joined into classes. Then groups expand: in lists whose pairs weren't all
   tried and in groups of three nodes or more, where they still hold several classes, nodes are gathered into clusters:
   whatever pairs of nodes of different classes that pass the filter connect. A cluster is a row for each of its nodes,
   not for each of its pairs; its sets are sent to one task, which verifies pairs until one class is left or all pairs
   of different classes have been tried, and gives a link for each two classes that it joins.

Lists of more than LIST nodes or MEMBERS shingles are dealt out by pairs of blocks, and so are their clusters. No task
holds a class or all members of a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import C1, Workspace, binary_slices, mixed, with_keys, word_hashes

#: Leaders that may share a prefix member before it counts as frequent.
FREQUENT = 48
#: Entries up to which a list gives all pairs at once, and entries and shingles up to which one task compares them with each other.
SHORT, LIST, MEMBERS = 16, 4096, 1 << 22
#: Times that groups which share too few members are left out.
ROUNDS = 2
#: Bits of the widest sketch that travels with an entry; for longer sets it filters less. In a cluster sketches have no such bound.
WIDEST = 1 << 17


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each document's n-grams of words; with fewer words, of the whole sequence."""
    h, _, first = word_hashes(data, offsets)
    out = []
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for i in range(words if len(grams) else 0):
            grams = grams * C1 + h[i : len(grams) + i]
        grams = mixed(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for x in h[a:b]:
                    whole = whole * C1 + x
                out.append(mixed(whole + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def handed_in(n: int, percent: int) -> int:
    """Members of the extended prefix."""
    p = prefix_length(n, percent)
    return min(n, p + p // 2 + 4)


def most_apart(n: int, m: int, percent: int) -> int:
    """The largest symmetric difference that two linked sets of these sizes can have."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def sketch_bits(n: int, widest: int = WIDEST) -> int:
    """Two to four bits a member."""
    return min(widest, max(64, 1 << (2 * n - 1).bit_length()))


def parity_sketch(members: np.ndarray, bits: int) -> bytes:
    odd = np.bincount(((members >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _read(words: int, percent: int, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tk, text) to READ: size, fingerprint and group of each set, and the sketch where a batch has it first."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            sizes, prints, groups, sketches, seen = [], [], [], [], set()
            for _, data, offsets in binary_slices(batch.column(2)):
                for members in shingle_sets(data, offsets, words):
                    n, mark = len(members), xxhash.xxh3_128_digest(members.tobytes(), seed=seed)
                    new = n > 0 and mark not in seen
                    seen.add(mark)
                    sizes.append(n)
                    prints.append(mark)
                    groups.append(group_key(members, percent))
                    sketches.append(parity_sketch(members, sketch_bits(n)) if new else None)
            marks = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            arrays = [batch.column(0), batch.column(1), pa.array(range(uid, uid + len(sizes)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(groups, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=READ)
            uid += len(sizes)

    return read


READ = ["doc_id", "tk", "uid", "n", "fa", "fb", "gk", "sketch"]
READ_SCHEMA = "doc_id long, tk long, uid long, n long, fa long, fb long, gk long, sketch binary"


def group_key(members: np.ndarray, percent: int) -> int:
    """A hash of a set's size and extended prefix. Groups that collide by chance only add candidates."""
    import xxhash

    n = len(members)
    return xxhash.xxh3_64_intdigest(members[: handed_in(n, percent)].tobytes(), seed=n) - (1 << 63)


def _packed(words: int, percent: int, buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to a row for each bucket: members, groups, and whether each is in the plain prefix.

    A member of more than FREQUENT groups of a batch is known to be shared. Its entries go to buckets of their groups, from
    ``buckets`` on, and to the member's own just a mark, so that no bucket takes more than a few of it from each batch.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes: dict[int, np.ndarray] = {}
            plains: list[np.ndarray] = []
            for _, data, offsets in binary_slices(batch.column(0)):
                for members in shingle_sets(data, offsets, words):
                    if (n := len(members)) and (key := group_key(members, percent)) not in prefixes:
                        prefixes[key] = members[: handed_in(n, percent)].copy()
                        plains.append(np.arange(len(prefixes[key])) < prefix_length(n, percent))
            if not prefixes:
                continue
            counts = [len(x) for x in prefixes.values()]
            member, plain = np.concatenate(list(prefixes.values())), np.concatenate(plains)
            group = np.repeat(np.fromiter(prefixes, np.int64, len(counts)), counts)
            with np.errstate(over="ignore"):
                bucket = ((member * C1) >> np.uint64(20)) % np.uint64(buckets)
            hot, at, times = np.unique(member, return_inverse=True, return_counts=True)
            often = times > FREQUENT
            if often.any():
                bucket = np.where(often[at], (group.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets) + np.uint64(buckets), bucket)
                with np.errstate(over="ignore"):
                    bucket = np.append(bucket, ((hot[often] * C1) >> np.uint64(20)) % np.uint64(buckets))
                n = int(often.sum())
                member, group, plain = np.append(member, hot[often]), np.append(group, np.full(n, MARK)), np.append(plain, np.zeros(n, bool))
            way = np.argsort(bucket, kind="stable")
            member, group, plain = member[way], group[way], plain[way]
            cuts = np.searchsorted(bucket[way], np.arange(2 * buckets + 1)).tolist()
            rows = [(b, member[i:j].tobytes(), group[i:j].tobytes(), np.packbits(plain[i:j]).tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=PACKED)

    return packed


#: What stands for the groups of a member that are elsewhere.
MARK = np.iinfo(np.int64).min
PACKED = ["bucket", "members", "gk", "plain"]
PACKED_SCHEMA = "bucket int, members binary, gk binary, plain binary"


def _lists(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Entries of the members of a bucket that several groups share; hot: some batch had it often, and there may be others like it."""
    return lambda table: _shared_entries(table, table.column("bucket")[0].as_py() >= buckets)


def _shared_entries(table: pa.Table, known: bool) -> pa.Table:
    members, groups, plains = (table.column(c).to_pylist() for c in PACKED[1:])
    member, group = np.frombuffer(b"".join(members), np.uint64), np.frombuffer(b"".join(groups), np.int64)
    plain = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=len(m) // 8) for p, m in zip(plains, members)]).astype(bool)
    way = np.lexsort((group, member))
    member, group, plain = member[way], group[way], plain[way]
    new = np.ones(len(way), bool)
    new[1:] = (member[1:] != member[:-1]) | (group[1:] != group[:-1])
    member, group, plain = member[new], group[new], plain[new]
    same = np.append(member[1:] == member[:-1], False)
    some = same | np.append(False, same[:-1])
    hot = np.ones(len(member), bool) if known else np.isin(member, member[group == MARK])
    some = (some | hot) & (group != MARK)
    return pa.table({"member": member[some].view(np.int64), "gk": group[some], "in_plain": plain[some], "hot": hot[some]})


LISTS_SCHEMA = "member long, gk long, in_plain boolean, hot boolean"


class _Entry:
    __slots__ = ("node", "n", "sketch", "bits", "size", "rare", "plain", "hash_order", "kind", "side")

    def __init__(self, node: int, n: int, sketch: bytes, rare: bool = True, plain: bool = False, in_plain: bool = True, kind: int = 0, side: int = -1):
        self.node, self.n, self.sketch, self.size, self.bits = node, n, sketch, len(sketch) * 8, None
        #: rare: the member isn't frequent. plain: the node is joined by hash order. hash_order: the member is in that prefix.
        self.rare, self.plain, self.hash_order, self.kind, self.side = rare, plain, in_plain, kind, side

    def at(self, size: int) -> int:
        """The sketch folded to a smaller size."""
        if self.bits is None:
            self.bits = {self.size: int.from_bytes(self.sketch, "little")}
        if size not in self.bits:
            whole = self.at(size * 2)
            self.bits[size] = (whole >> size) ^ (whole & ((1 << size) - 1))
        return self.bits[size]

    def may_link(self, other: _Entry, percent: int) -> bool:
        if self.plain or other.plain:
            if not (self.hash_order and other.hash_order):
                return False
        elif not self.rare:
            return False
        size = min(self.size, other.size)
        return (self.at(size) ^ other.at(size)).bit_count() <= most_apart(self.n, other.n, percent)


class _Sorted:
    """Entries of one list in order of size, each compared with all before it at once."""

    def __init__(self, entries: list[_Entry], percent: int):
        self.percent, self.rare = percent, entries[0].rare
        self.n, self.side, self.kind = (np.array([getattr(e, k) for e in entries], np.int64) for k in ("n", "side", "kind"))
        self.plain, self.hash_order = (np.array([getattr(e, k) for e in entries], bool) for k in ("plain", "hash_order"))
        self.low = np.searchsorted(self.n * 100, self.n * percent)
        widths = [len(e.sketch) for e in entries]  # which grow with the sizes
        cuts = [i for i in range(len(widths)) if i == 0 or widths[i] != widths[i - 1]]
        self.parts = [(a, b, np.frombuffer(b"".join(e.sketch for e in entries[a:b]), np.uint64).reshape(b - a, -1)) for a, b in zip(cuts, [*cuts[1:], len(widths)])]

    def before(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Earlier entries that may be linked with the i-th, and how many bits of the sketches differ."""
        found, apart = [], []
        own = next(part[i - a] for a, b, part in self.parts if i < b)
        for a, b, part in reversed(self.parts):
            if a >= i:
                continue
            if b <= self.low[i]:
                break
            while len(own) > part.shape[1]:
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]
            first, last = max(a, int(self.low[i])), min(b, i)
            bits = np.bitwise_count(part[first - a : last - a] ^ own).sum(axis=1, dtype=np.int64)
            both = self.n[first:last] + self.n[i]
            ok = bits <= both - 2 * -(-self.percent * both // (100 + self.percent))
            by_order = self.plain[first:last] | self.plain[i]
            ok &= np.where(by_order, self.hash_order[first:last] & self.hash_order[i], self.rare)
            found.append(first + np.flatnonzero(ok))
            apart.append(bits[ok])
        return (np.concatenate(found), np.concatenate(apart)) if found else (np.zeros(0, np.int64),) * 2


def _near(entries: list[_Entry], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a list that may be linked: all of a short one, else an edge of each entry to one earlier leader."""
    entries.sort(key=lambda e: (e.n, e.node))
    pair = lambda e, other: (min(other.node, e.node), max(other.node, e.node))
    if len(entries) <= SHORT:
        low = 0
        for i, e in enumerate(entries):
            while entries[low].n * 100 < e.n * percent:
                low += 1
            for other in entries[low:i]:
                if other.may_link(e, percent):
                    yield pair(e, other)
        return
    ordered, leads = _Sorted(entries, percent), np.ones(len(entries), bool)
    for i, e in enumerate(entries):
        earlier = ordered.before(i)[0]
        earlier = earlier[leads[earlier]]
        if len(earlier):
            leads[i] = False
            yield pair(e, entries[int(earlier.max())])


def _connected(entries: list[_Entry], percent: int) -> list[list[_Entry]]:
    """What pairs of entries of different kinds (and sides) that may be linked connect, two entries or more each."""
    entries.sort(key=lambda e: (e.n, e.node))
    ordered, part = _Sorted(entries, percent), np.arange(len(entries))
    for i in range(len(entries)):
        earlier = ordered.before(i)[0]
        earlier = earlier[(ordered.kind[earlier] != ordered.kind[i]) & ((ordered.side[earlier] != ordered.side[i]) | (ordered.side[i] < 0))]
        for root in np.unique(part[earlier]):
            part[part == part[i]] = root
    way = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[way])) + 1
    return [[entries[i] for i in own] for own in np.split(way, cuts) if len(own) > 1]


def _by_list(batches: Iterable[pa.RecordBatch]) -> Iterator[list[_Entry]]:
    """The entries of each (member, block) of rows that come sorted by it."""
    held: list[_Entry] = []
    at = None
    for batch in batches:
        for member, block, node, n, sketch, frequent, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (member, block) != at:
                if len(held) > 1:
                    yield held
                held, at = [], (member, block)
            held.append(_Entry(node, n, sketch, not frequent, *rest))
    if len(held) > 1:
        yield held


def _candidates(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) of lists."""

    def out(found: set[tuple[int, int]]) -> pa.RecordBatch:
        rows = sorted(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for entries in _by_list(batches):
            found.update(_near(entries, percent))
            if len(found) > 200_000:
                yield out(found)
        yield out(found)

    return candidates


def _clusters(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Clusters of lists as (cluster, node, kind); equal clusters have equal names. Those that collide only try more pairs."""

    def clusters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: set[int] = set()
        for entries in _by_list(batches):
            rows = []
            for own in _connected(entries, percent):
                own.sort(key=lambda e: e.node)
                name = xxhash.xxh3_64_intdigest(np.array([e.node for e in own], np.int64).tobytes()) - (1 << 63)
                if name not in known:
                    known.add(name)
                    rows += [(name, e.node, e.kind) for e in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["cluster", "node", "kind"])

    return clusters


def _joined(nodes: list[int], kinds: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of kinds that linked sets of a cluster join, until no two kinds are left that a link could join."""
    widest = 1 << 30
    way = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    ordered = _Sorted([_Entry(nodes[i], len(sets[i]), parity_sketch(sets[i], sketch_bits(2 * len(sets[i]), widest)), kind=kinds[i]) for i in way], percent)
    root, kinds = ordered.kind.copy(), ordered.kind
    for i, at in enumerate(way):
        earlier, apart = ordered.before(i)
        for j in earlier[np.argsort(apart, kind="stable")].tolist():
            if root[i] != root[j]:
                x, y = sets[way[j]], sets[at]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    yield int(kinds[j]), int(kinds[i])
                    root[root == root[j]] = root[i]


def _linked(words: int, percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) between kinds from the clusters of a partition sorted by cluster: cluster, node, kind, text."""

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, ([], [], []), []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])
        for batch in batches:
            clusters, nodes, kinds = (batch.column(i).to_pylist() for i in range(3))
            for first, data, offsets in binary_slices(batch.column(3)):
                for i, members in enumerate(shingle_sets(data, offsets, words), first):
                    if clusters[i] != at:
                        if at is not None:
                            rows += _joined(*held, percent)
                        at, held = clusters[i], ([], [], [])
                    for column, value in zip(held, (nodes[i], kinds[i], members.copy())):
                        column.append(value)
            yield out()
            rows = []
        if at is not None:
            rows += _joined(*held, percent)
        yield out()

    return linked


ENTRY = ["member", "block", "node", "n", "sketch", "frequent", "plain", "in_plain", "kind", "side"]


def _verified(words: int, percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, text of a, text of b) to the pairs whose sets are similar enough."""

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        coded = column.dictionary_encode()
        own = [s for _, data, offsets in binary_slices(coded.dictionary) for s in shingle_sets(data, offsets, words)]
        return [own[i] for i in coded.indices.to_pylist()]

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                good = []
                for x, y in zip(sets_of(part.column(2)), sets_of(part.column(3))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

    return verified


def classes(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, label for each node of links (a, b): the smallest node that it is connected with.

    Every round takes the smallest label next to a node and then the label of that label, so distances halve;
    tables are cut off their lineage in the shared folder.
    """
    both = space.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = space.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0")
    turn = 0
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        nearer = space.keep(nearer, f"{name}-near-{turn}")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = nearer.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "next"), "label").alias("label"), "was")
        turn += 1
        jumped = space.keep(jumped, f"{name}-{turn}")
        space.drop(f"{name}-near-{turn - 1}")
        if jumped.filter("label <> was").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, keeps, uid and tk (the text's hash).

    A document's set holds the distinct n-grams of its words in ASCII lower case, split at ASCII white space; with
    fewer words the whole sequence is its one member. Documents link when 100 * |intersection| >= percent * |union|; a
    document without words or text (null or empty) links with nothing. component_id is the smallest id that links
    reach, itself included (null only where all are null); keeps is true for one row of each component, of the smallest
    id. Repeated rows have equal sets and so one component. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard-join")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).select("doc_id", F.xxhash64("text").alias("tk"), "text")

    # Equal sets become one node. Should two different sets share 64 bits, another seed parts them.
    for seed in range(16):
        rows = space.keep(own.mapInArrow(_read(words, percent, seed), READ_SCHEMA), f"rows{seed}")
        home = F.min(F.struct(F.isnull("doc_id").alias("absent"), "doc_id", "tk")).alias("home")
        nodes = rows.filter("n > 0").groupBy("fa").agg(home, F.min("n").alias("n"), F.min("gk").alias("gk"), F.max("sketch").alias("sketch"), F.min("fb").alias("low"), F.max("fb").alias("high"))
        nodes = space.keep(nodes.select(F.col("fa").alias("node"), "home.doc_id", "home.tk", "n", "gk", "sketch", (F.col("low") < F.col("high")).alias("clash")), f"nodes{seed}")
        if nodes.filter("clash").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells all sets apart")

    # Lists of the members of extended prefixes that several groups share.
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * (150 - percent) // (100 * MEMBERS))
    packed = own.select("text").mapInArrow(_packed(words, percent, buckets), PACKED_SCHEMA)
    entries = space.keep(packed.groupBy("bucket").applyInArrow(_lists(buckets), LISTS_SCHEMA), "entries")
    entries = entries.filter("NOT hot").unionByName(entries.filter("hot").dropDuplicates(["member", "gk"])).drop("hot")

    # Groups that share too few members to be linked with any other go, and with them members that one group is left with.
    prefix = lambda n: n - F.ceil(n * percent / F.lit(100)) + 1
    spare = lambda n: F.least(n, prefix(n) + F.floor(prefix(n) / 2) + 4) - prefix(n)
    groups = space.keep(nodes.groupBy("gk").agg(F.min("node").alias("lead"), F.min("n").alias("n"), F.count("*").alias("own")), "groups")
    least = groups.select("gk", (1 + spare(F.ceil(F.col("n") * percent / F.lit(100)))).alias("least"))
    for turn in range(ROUNDS):
        shared = entries.groupBy("gk").agg(F.count("*").alias("shared")).join(least, "gk").filter("shared >= least").select("gk")
        entries = space.keep(entries.join(shared, "gk", "left_semi"), f"entries{turn}")
        if turn < ROUNDS - 1:
            entries = entries.join(entries.groupBy("member").agg(F.count("*").alias("here")).filter("here > 1"), "member").drop("here")
    # Of lists that hold the same groups one stays; equal lists have equal sums of two hashes of their entries.
    sums = [F.bit_xor(F.xxhash64("gk", "in_plain", F.lit(k))).alias(f"s{k}") for k in (1, 2)]
    listed = entries.groupBy("member").agg(F.count("*").alias("size"), *sums).filter("size > 1").withColumn("frequent", F.col("size") > FREQUENT)
    listed = space.keep(listed, "listed")
    crowded = entries.join(listed.filter("frequent").select("member"), "member", "left_semi").groupBy("gk").agg(F.count("*").alias("frequents"))
    entries = space.keep(entries.join(listed.groupBy("s1", "s2", "frequent").agg(F.min("member").alias("member")).select("member", "frequent"), "member"), "own-entries")
    known = nodes.join(groups.select("gk", "lead", "own"), "gk").join(shared.withColumn("listed", F.lit(True)), "gk", "left").filter("listed OR own > 1")
    known = known.join(crowded, "gk", "left").select("node", "gk", "lead", "n", "sketch", (F.coalesce("frequents", F.lit(0)) > spare(F.col("n"))).alias("plain"))
    known = space.keep(known, "known")
    for name in ["entries", *(f"entries{turn}" for turn in range(ROUNDS))]:
        space.drop(name)
    leaders = known.filter("node = lead")
    # Frequent members serve plain nodes alone, and those by the pure hash order.
    often = entries.filter("frequent AND in_plain").join(leaders.select("gk", "plain"), "gk")
    sizes = often.groupBy("member").agg(F.count("*").alias("size"), F.max("plain").alias("any_plain")).filter("any_plain").select("member", "size")
    sizes = space.keep(sizes, "sizes")
    rare = entries.filter("NOT frequent").withColumn("size", F.lit(0).cast("long"))
    lists = rare.unionByName(entries.filter("frequent AND in_plain").join(sizes, "member"))

    # First the pairs of short lists, and an edge for each node.
    block = F.pmod(F.xxhash64("node", "member"), F.greatest(F.ceil(F.col("size") / F.lit(LIST)), F.lit(1)))
    first = lists.join(leaders, "gk").withColumns({"block": block, "kind": F.lit(0).cast("long"), "side": F.lit(-1).cast("long")})
    edges = _dealt(first, ENTRY, "member", "block").mapInArrow(_candidates(percent), "a long, b long").distinct()
    edges = edges.union(known.filter("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")))
    links = space.keep(_links(space.keep(edges, "edges"), nodes, own, words, percent, space), "links")
    space.drop("edges-texts")
    labels = classes(links, space, "first")

    # Then whatever may still connect two classes.
    classed = known.join(labels, "node", "left").select("node", "gk", "n", "sketch", "plain", F.coalesce("label", "node").alias("kind"))
    kinds = classed.groupBy("gk").agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.count("*").alias("own"), F.sum("n").alias("size"))
    mixed_lists = lists.drop("size").join(kinds, "gk").groupBy("member").agg(F.count("*").alias("groups"), F.sum("own").alias("total"), F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("own").alias("most"))
    left = mixed_lists.filter("low < high").filter((F.col("groups") > SHORT) | (F.col("most") > 1)).select("member", "total", "size")
    second = lists.drop("size").join(left, "member").join(classed, "gk")
    # Nodes of a group needn't meet in any list, so each group of several classes is a list of its own. Of two nodes the pair has been tried.
    alone = kinds.filter("low < high AND own > 2").select("gk", F.col("gk").alias("member"), F.col("own").alias("total"), "size")
    alone = alone.join(classed.withColumn("plain", F.lit(False)), "gk").withColumns({"in_plain": F.lit(False), "frequent": F.lit(False)})
    blocks = F.ceil(F.greatest(F.col("total") / F.lit(LIST), F.col("size") / F.lit(MEMBERS))).cast("long")
    second = second.unionByName(alone).withColumn("blocks", blocks)
    second = second.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    second = second.withColumns({"block": pair, "side": F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own"))})
    clusters = _dealt(second, ENTRY, "member", "block").mapInArrow(_clusters(percent), "cluster long, node long, kind long").distinct()
    clusters = space.keep(clusters, "clusters")
    labels = labels.withColumnRenamed("label", "kind")
    if clusters.isEmpty():
        labels = labels.withColumnRenamed("kind", "label")
    else:
        texts = _texts(clusters.select("node").distinct(), nodes, own, space, "clusters")
        found = _dealt(clusters.join(texts, "node"), ["cluster", "node", "kind", "text"], "cluster").mapInArrow(_linked(words, percent), "a long, b long")
        over = classes(space.keep(found.distinct(), "more-links"), space, "second").withColumnRenamed("node", "kind")
        space.drop("clusters-texts")
        labels = nodes.select("node").join(labels, "node", "left").withColumn("kind", F.coalesce("kind", "node")).join(over, "kind", "left").select("node", F.coalesce("label", "kind").alias("label"))

    # The smallest id of each class, and back to the rows.
    of_node = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = of_node.join(least, "label").select(F.col("node").alias("fa"), "label", "component_id")
    placed = rows.select("doc_id", "uid", "tk", "n", "fa").join(of_node, "fa", "left")
    some = F.col("n") > 0
    placed = placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "uid", "tk", "n", F.when(some, F.col("label")).otherwise(F.col("uid")).alias("label"))
    keeper = placed.groupBy("label", some.alias("some")).agg(F.min(F.struct(F.isnull("doc_id").alias("absent"), "doc_id", "uid")).alias("keeper"))
    same = (F.col("p.label") == F.col("k.label")) & ((F.col("p.n") > 0) == F.col("k.some"))
    return placed.alias("p").join(keeper.alias("k"), same).select("p.doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("keeper.uid")).alias("keeps"), "uid", "tk")


def _dealt(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys)


def _texts(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node and text of the wanted nodes. Other texts aren't shuffled."""
    keyed = nodes.select("node", "doc_id", "tk").join(wanted, "node")
    same = F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.tk") == F.col("k.tk"))
    known = with_keys(texts, keyed, ["doc_id", "tk"]).alias("t").join(keyed.alias("k"), same).select("k.node", "t.text").dropDuplicates(["node"])
    return space.keep(known, f"{name}-texts")


def _links(edges: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, space: Workspace) -> DataFrame:
    """The edges (a, b) whose sets are similar enough, on whole texts."""
    known = _texts(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), nodes, texts, space, "edges")
    paired = edges.join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return paired.select("a", "b", "text_a", "text_b").mapInArrow(_verified(words, percent), "a long, b long")

"""N-gram Jaccard self-join through parity sketches: all pairs of documents whose shingle sets are alike enough.

Two sets of a <= b elements with Jaccard similarity of at least s differ in d <= a (1 - s) / s elements. Every element
falls into one part of its set's sketch, by its hash; a part is the XOR of the hashes of its elements, so equal elements
leave no trace in the difference of two sketches, and at most d parts differ. Sketches of d + 1 + spare parts therefore
share spare + 1 parts at least (pigeonhole): documents meet in an equi-join on (size band, part number, part). The number
of parts is fixed by size band; near the lower end of a band a set joins the band below as well.

Parts of few elements say little: a line that thousands of documents share would bring them all together. So every set
leaves out its `spare` lightest parts (by number of elements, then by value) and is indexed by d + 1. No pair is lost: of
the spare + 1 or more parts that two sets share, the heaviest has at least `spare` lighter ones in either set.

Candidates are then compared by bit sketches, in which every element flips one bit: their Hamming distance is at most d.
What is left is verified on the whole sets. Steps:

1. `signatures`: size and 64-bit fingerprint (`node`) of each set. Equal sets become one node; groups of copies meet
   only in partial sums. A second hash proves that no two sets share a node, else another seed is taken.
2. `shared_parts`: the join; each task drops repeated nodes before the shuffle and keys held by one node after it.
3. First round: in each key every node is paired with one of them, the hub, so a group of n nodes makes n - 1 pairs.
4. Second round, exact: in keys whose other nodes are not yet all connected, every pair of nodes of different components is
   compared by bit sketches inside tasks, in blocks of at most `block` nodes each way. First only a nearest spanning forest
   of the pairs that pass leaves the task and is verified, which connects nearly all that is connected; then, in keys with a
   pair that proved not similar, every pair that passes between components that are left. Skipped are only pairs whose nodes
   are connected by verified links, and keys that hold the same nodes as another.

Odd cases: texts without words (null, empty, blank) have the empty set and no links. A text of fewer than k words has its
whole sequence as its one shingle. Repeated rows and repeated ids are linked by their texts alone; a null doc_id takes
part but is never the smallest id, unless a component has no other. No rows give no rows. Candidates are found by 64-bit
hashes of shingles and verified by others that are independent of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm import frames, words
from crowdlens.llm.components import stars
from crowdlens.operators.joins import lookup_join
from crowdlens.session import stage


@dataclass(frozen=True)
class Settings:
    k: int = 5
    percent: int = 80  # least similarity
    spare: float = 0.4  # parts that are left out, as a share of d
    block: int = 512
    seed: int = 0


def _bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + edges[-1] // 2 + 1)
    return np.array(edges, np.int64)


#: First size of each band; every band is half as long again as the one before.
BANDS = _bands()


def most_different(size: np.ndarray | int, percent: int):
    """Elements in which a similar pair may differ, by the size of its smaller set."""
    return size * (100 - percent) // percent


def parts_of(band: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts in a band and how many of them are left out; none where only equal sets are similar."""
    different = most_different(BANDS[band + 1] - 1, s.percent)
    spare = np.where(different > 0, (different * s.spare).astype(np.int64) + 1, 0)
    return np.where(different > 0, different + 1 + spare, 0), spare


def set_elements(texts: words.Texts, s: Settings, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the shingles of each text; the `second` hashes are independent of the first."""
    return words.shingles(texts, texts.hashes(words.LOWERED, 2 * s.seed + second), s.k)


def node_of(doc: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprint of each set."""
    node = np.zeros(n, np.uint64)
    np.add.at(node, doc, words.mix(hashed + np.uint64(1)))
    return words.mix(node).astype(np.int64)


# ---------------------------------------------------------------- signatures and parts

def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the mark is a hash of the text, so that (doc_id, mark) tells different texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, mark, n, node (null for an empty set), check (a second fingerprint) and clash (the two kinds of hashes tell
    different numbers of shingles apart) of every document."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("text"), words.SPACED):
                (doc, hashed), (doc2, hashed2) = set_elements(texts, s), set_elements(texts, s, second=True)
                n, n2 = (np.bincount(x, minlength=len(texts)) for x in (doc, doc2))
                node, check = node_of(doc, hashed, len(texts)), node_of(doc2, hashed2, len(texts))
                own = slice(texts.first, texts.first + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[own], batch.column("mark")[own], pa.array(n, pa.int64()),
                     pa.array(node, mask=n == 0), pa.array(check), pa.array(n != n2)],
                    names=["doc_id", "mark", "n", "node", "check", "clash"])
    return frames.map_rows(keyed(docs), task, "doc_id long, mark long, n long, node long, check long, clash boolean")


def part_keys(doc: np.ndarray, hashed: np.ndarray, sizes: np.ndarray, s: Settings) -> Iterator[tuple]:
    """(set, key) of the parts under which each set is indexed; `doc` and `hashed` as from `words.shingles`."""
    place = words.mix(hashed ^ np.uint64(0xD1B54A32D192ED03))
    home = np.searchsorted(BANDS, np.maximum(sizes, 1), "right") - 1
    least = -(-sizes * s.percent // 100)  # size of the smallest similar set
    step = 0
    while True:
        band = home - step
        here = (sizes > 0) & (band >= 0)
        if step:
            here &= least < BANDS[np.maximum(band, 0) + 1]
        if not here.any():
            return
        count, spare = (np.where(here, x, 0) for x in parts_of(np.maximum(band, 0), s))
        base = np.cumsum(count) - count
        total = int(count.sum())
        chosen = count[doc] > 0
        d = doc[chosen]
        cell = base[d] + (place[chosen] % count[d].astype(np.uint64)).astype(np.int64)
        value = np.zeros(total, np.uint64)
        np.bitwise_xor.at(value, cell, hashed[chosen])
        weight = np.bincount(cell, minlength=total)
        owner = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(total) - base[owner]
        key = words.mix(value + words.mix((band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))
        order = np.lexsort((key, weight, owner))  # lightest first in each set
        used = order[number >= spare[owner]]
        yield owner[used], key[used]
        step += 1


def shared_parts(docs: DataFrame, s: Settings) -> DataFrame:
    """(key, hub, node): the nodes of every key that more than one node has, with one of them as hub."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task: at most its number of documents
        for batch in batches:
            for texts in words.slices(batch.column("text"), words.SPACED):
                doc, hashed = set_elements(texts, s)
                sizes = np.bincount(doc, minlength=len(texts))
                node = node_of(doc, hashed, len(texts))
                new = np.zeros(len(texts), bool)
                for i, x in enumerate(node.tolist()):
                    if sizes[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                keep = new[doc]
                for owner, key in part_keys(doc[keep], hashed[keep], np.where(new, sizes, 0), s):
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(node[owner])],
                                                     names=["key", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, equal nodes together. The last row waits for the next batch."""
        key, node, hub, paired = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

        def out(chosen: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[chosen]), pa.array(hub[chosen]), pa.array(node[chosen])],
                                              names=["key", "hub", "node"])
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting = len(key)
            key = np.concatenate((key, np.asarray(batch.column("key"))))
            node = np.concatenate((node, np.asarray(batch.column("node"))))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            follows = np.zeros(len(key), bool)
            follows[1:] = key[1:] == key[:-1]
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(key))))
            heads = node.copy()
            if waiting:
                heads[0], follows[0] = hub[0], paired[0]
            hub, paired = heads[first], follows
            chosen = paired.copy()
            chosen[:-1] |= paired[1:] & (key[1:] == key[:-1])
            chosen[-1] = False
            yield out(chosen)
            key, node, hub, paired = key[-1:], node[-1:], hub[-1:], paired[-1:]
        if len(key):
            yield out(paired)
    rows = frames.map_rows(keyed(docs).select("text"), emit, "key long, node long")
    # The first node of a key is its hub: by one of three orders of the nodes, so that a group meets several hubs.
    turn = F.xxhash64("node", F.pmod("key", F.lit(3)))
    return rows.repartition("key").sortWithinPartitions("key", turn, "node").mapInArrow(meet, "key long, hub long, node long")


# ---------------------------------------------------------------- comparing candidates

def bit_sketch(hashed: np.ndarray) -> np.ndarray:
    """Parity of the elements on each of 2n to 4n bits (a power of two, so that longer sketches fold onto shorter ones)."""
    bits = 1 << max(6, int(2 * len(hashed) - 1).bit_length())
    bit = (words.mix(hashed ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, length: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, length), axis=0)


def hamming(sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch_a ^ sketch_b).sum(axis=-1, dtype=np.int64)


def allowed(distance, size_a, size_b, percent: int):
    """Whether size and Hamming distance allow similarity: 100 i >= percent u means d (100 + percent) <= (a + b) (100 - percent)."""
    return distance * (100 + percent) <= (size_a + size_b) * (100 - percent)


def spanning_forest(group: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> list[int]:
    """Positions of the pairs (i, j) that connect the groups of nodes with the least distances (Prim's algorithm)."""
    size = int(group.max()) + 1
    best, pair = np.full((size, size), np.inf), np.zeros((size, size), np.int64)
    order = np.argsort(-np.tile(far, 2), kind="stable")  # the nearest pair of two groups is written last
    a, b = group[np.concatenate((i, j))][order], group[np.concatenate((j, i))][order]
    best[a, b], pair[a, b] = np.tile(far, 2)[order], order % len(far)
    out, todo, distance, source = [], np.ones(size, bool), np.full(size, np.inf), np.zeros(size, np.int64)
    for _ in range(size):
        at = int(np.argmin(np.where(todo, distance, np.inf)))
        if not todo[at] or distance[at] == np.inf:
            at = int(np.argmax(todo))  # a new tree
        else:
            out.append(int(pair[source[at], at]))
        todo[at] = False
        closer = todo & (best[at] < distance)
        distance[closer], source[closer] = best[at][closer], at
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, needed: DataFrame, s: Settings, whole: bool) -> DataFrame:
    """(node, n, sketch) of the needed nodes, or with `whole` (node, elements: the second hashes), each from the text of `one`:
    the node's smallest (doc_id, mark)."""
    chosen = nodes.join(needed, "node").select("node", F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark"))
    chosen = stage(chosen, "jaccard-representatives")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in words.slices(batch.column("text"), words.SPACED):
                doc, hashed = set_elements(texts, s, second=whole)
                sets = np.split(hashed, np.searchsorted(doc, np.arange(1, len(texts))))
                node = batch.column("node")[texts.first: texts.first + len(texts)]
                if whole:
                    yield pa.RecordBatch.from_arrays(
                        [node, pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "elements"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [node, pa.array([len(x) for x in sets], pa.int64()),
                         pa.array([bit_sketch(x).tobytes() for x in sets], pa.binary())], names=["node", "n", "sketch"])
    joined = keyed(docs).join(frames.small_side(chosen, 300_000),
                              F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    schema = "node long, elements binary" if whole else "node long, n long, sketch binary"
    return stage(frames.map_rows(joined.select("node", "text"), task, schema).dropDuplicates(["node"]), "jaccard-sets")


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """`pairs` (a, b) with the columns of both nodes as a_ and b_."""
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), *[F.col(name).alias(f"{side}_{name}") for name in columns])
        pairs = pairs.join(own, side)
    return pairs


def _pair_batch(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(keep, pa.bool_())) for x in "ab"], names=["a", "b"])


def possible(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs that their bit sketches allow."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("a_sketch", "b_sketch", "a_n", "b_n")]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                length = min(len(x), len(y))
                keep.append(bool(allowed(hamming(folded(x, length), folded(y, length)), n, m, s.percent)))
            yield _pair_batch(batch, keep)
    return frames.map_rows(_beside(pairs, sets, "n", "sketch"), task, "a long, b long")


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose whole sets are similar."""
    sets = sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), s, whole=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_elements"), batch.column("b_elements")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= s.percent * (len(x) + len(y) - common))
            yield _pair_batch(batch, keep)
    return stage(frames.map_rows(_beside(pairs, sets, "elements"), task, "a long, b long"), "jaccard-links")


def cross_pairs(shared: DataFrame, roots: DataFrame, sets: DataFrame, s: Settings, forest: bool) -> DataFrame:
    """(key, a, b): pairs of nodes that share a key, lie in different components, and pass the bit sketches.

    With `forest`, of each block only the pairs of a spanning forest of its components, the nearest ones.
    Pairs with a key's hub have been compared in the first round. Of keys with the same other nodes one will do;
    two fingerprints tell their sets of nodes apart.
    """
    rows = shared.where("node <> hub").select("key", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    prints = [F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")]
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), *prints)
    mixed = mixed.where("lo < hi").groupBy("f", "g", "size").agg(F.min("key").alias("key")).select(
        "key", F.ceil(F.col("size") / s.block).alias("blocks"))
    rows = rows.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.join(sets.select("node", "n", "sketch"), "node").withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root",
                       "n", "sketch")

    def compare(group: pa.Table, x: int, y: int) -> pa.RecordBatch:
        key = group["key"][0].as_py()
        node, root, n, own = (group[c].to_numpy() for c in ("node", "root", "n", "own"))
        raw = [np.frombuffer(v, np.uint64) for v in group["sketch"].to_pylist()]
        length = min(map(len, raw))
        bits = np.stack([folded(v, length) for v in raw])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        first, second, far = [], [], []
        for position, i in enumerate(left):
            rest = left[position + 1:] if x == y else right
            rest = rest[(root[rest] != root[i]) & (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * s.percent)]
            distance = hamming(bits[rest], bits[i])
            near = allowed(distance, n[rest], n[i], s.percent)
            first.append(np.full(near.sum(), i))
            second.append(rest[near])
            far.append(distance[near])
        i, j, far = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (first, second, far))
        if forest and len(i):
            chosen = spanning_forest(np.unique(root, return_inverse=True)[1], i, j, far)
            i, j = i[chosen], j[chosen]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), key)), pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))],
            names=["key", "a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, x, y: at most 2 blocks of nodes for each."""
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            ids = [rest[c].to_numpy() for c in ("key", "x", "y")]
            cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1
            for low, high in zip(np.concatenate(([0], cuts[:-1])), cuts) if len(cuts) else ():
                yield compare(rest.slice(low, high - low), int(ids[1][low]), int(ids[2][low]))
            if len(cuts):
                rest = rest.slice(cuts[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield compare(rest, rest["x"][0].as_py(), rest["y"][0].as_py())
    frames.bounded_batches(rows.sparkSession)
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return dealt.mapInArrow(task, "key long, a long, b long")


# ---------------------------------------------------------------- the join

@dataclass
class Joined:
    signed: DataFrame  # doc_id, mark, n, node of every document
    links: DataFrame  # (a, b) nodes that are similar, enough of them to connect whatever similarity connects
    roots: DataFrame  # (node, root) of linked nodes
    sizes: DataFrame  # (node, least): smallest doc_id of each node


def join(docs: DataFrame, s: Settings = Settings()) -> Joined:
    signed = stage(signatures(docs, s), "jaccard-signatures")
    nodes = stage(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("one"),
        ((F.min("check") != F.max("check")) | F.bool_or("clash")).alias("clash")), "jaccard-nodes")
    if nodes.where("clash").limit(1).count():
        return join(docs, Settings(s.k, s.percent, s.spare, s.block, s.seed + 1))
    shared = stage(shared_parts(docs, s), "jaccard-shared")
    sketches = sets_of(docs, nodes, shared.select("node").distinct(), s, whole=False)
    first = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = stage(possible(first, sketches, s), "jaccard-pairs")
    links = similar(first, docs, nodes, s)
    roots = stars(links)
    checked = first
    for forest in (True, False):
        found = stage(cross_pairs(shared, roots, sketches, s, forest), "jaccard-cross")
        pairs = stage(found.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
        more = similar(pairs, docs, nodes, s)
        if more.limit(1).count():
            links = links.union(more)
            roots = stars(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))
        if forest:
            # Where all pairs of a forest are links, whatever passes in that key is connected by them.
            checked = checked.union(pairs)
            failed = stage(found.join(more, ["a", "b"], "left_anti").select("key").distinct(), "jaccard-keys")
            if not failed.limit(1).count():
                break
            shared = shared.join(frames.small_side(failed), "key", "left_semi")
    return Joined(signed, links, roots, nodes.select("node", "least"))


def components(joined: Joined) -> DataFrame:
    """doc_id, mark, n_shingles, node, root (null: no words), component_id (smallest doc_id) of every document."""
    # A root may have a third of all nodes, and a node a third of all documents: frequent keys are joined apart from the others.
    sizes = stage(joined.sizes.join(joined.roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-sizes")
    least = stage(sizes.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-least")
    of_node = stage(lookup_join(sizes, least, "root", ["node"], "inner").select("node", "root", "component_id"), "jaccard-components")
    full = lookup_join(joined.signed.where("node IS NOT NULL"), of_node, "node", ["doc_id", "mark"], "inner")
    none = joined.signed.where("node IS NULL").withColumns(
        {"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    columns = ["doc_id", "mark", F.col("n").alias("n_shingles"), "node", "root", "component_id"]
    return full.select(*columns).union(none.select(*columns))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` with one row of each group of linked documents: the smallest doc_id, of several texts under it the smallest
    mark. Texts without words are linked with nothing and all stay."""
    found = components(join(docs, s)).where("root IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))
    rows = stage(found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times")), "jaccard-rows")
    best = stage(rows.groupBy("root").agg(F.min(rank).alias("best")), "jaccard-best")
    judged = stage(lookup_join(rows, best, "root", ["doc_id", "mark"], "inner").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "times", (rank == F.col("best")).alias("wins"))
        .where("NOT wins OR times > 1"), "jaccard-judged")
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))

    def same(rows: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(rows["_id"]) & (text == rows["_mark"])
    gone = judged.select("_id", "_mark")
    kept = docs.join(frames.small_side(gone, 300_000), same(gone), "left_anti")
    again = judged.where("wins").select("_id", "_mark")
    if again.limit(1).count():  # of rows repeated under one id one stays
        kept = kept.union(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept

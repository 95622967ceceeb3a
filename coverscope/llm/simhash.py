"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.llm.common import as_bytes, map_slices, tidy
from coverscope.operators.components import LOCAL_LINKS, connected_components
from coverscope.runtime import salted_join, settle

SEED = 42
#: Members of a block's group that one task compares with as many others; larger groups are dealt out as pairs of such chunks.
CHUNK = 1024
#: Members, and distinct shingles, of a family's chunk that one task compares with as many others by their shingles.
FAMILY_CHUNK, FAMILY_SHINGLES = 512, 4_000_000
#: Salts of joins on a key that a great part of the rows may have.
SALTS = 32
#: Wide fingerprints, for texts alike by WIDE_SHINGLE-word shingles to ALIKE or more: their bits; and bits in which two may differ
#: that need no further check, and at most. A similarity of ALIKE gives 155 on average at most, with a standard deviation of 11.5; the two are 4 of these away.
WIDE_SHINGLE, WIDE_BITS, ALIKE, SURE_DISTANCE, WIDE_DISTANCE = 5, 1024, 0.8, 105, 201
#: Shingles of a text up to which its fingerprint is too coarse to tell, so that its pairs are all compared by their shingles.
FEW = 64
#: Shingles of a text up to which they go with it, in 32 bits: those of the texts that can be alike to one of FEW.
SHORT = FEW * 5 // 4
#: Rows (of 16 bytes) up to which those that go are sent to all tasks; beyond, they are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Members of a block's group that are written as pairs; larger groups are compared by chunks.
PAIRED = 32
#: Shingles that many texts share come last in the order of blocks: those that FREQUENT texts of one in SAMPLE have in theirs, MOST at most.
FREQUENT, SAMPLE, MOST = 8, 16, 1_000_000


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, repeats included; of the whole sequence where it is shorter; none of no words."""
    words = data.lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows (n x w 64-bit words) have each of the 64 w bits set."""
    total = np.zeros(hashes.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255 * 64]).view(np.uint8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # a byte holds as many
            total += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return total


def majority(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit words whose bits are set in over half the rows."""
    return np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(data: bytes, size: int = 4) -> int:
    """The 64-bit SimHash of a text in UTF-8, unsigned; 0 where it has no words."""
    hashes = shingle_hashes(data, size)
    return int(majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


_ODD = (np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash as `words` 64-bit words."""
    x = hashes[:, None] * _ODD[None, :words]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def block_shingles(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles of a text of which one at least is among those of any other text that is alike to ALIKE or more.

    hashes: the text's distinct ones, sorted; frequent: sorted ones that come last in the order. Pigeonhole: in such a pair each text has
    ALIKE of its shingles at least in common with the other, so of its first (1 - ALIKE) n + 1, in any one order of all
    shingles, one is shared; and the first one of the order that is shared is among both texts' first.
    """
    n = len(hashes)
    if len(frequent) and n:
        at = np.searchsorted(frequent, hashes)
        late = frequent[np.minimum(at, len(frequent) - 1)] == hashes
        hashes = np.concatenate((hashes[~late], hashes[late]))
    return hashes[: n - _least_shared(n) + 1] if n else hashes


def _least_shared(n: int) -> int:
    """Shingles that a text of n has in common at least with one alike to ALIKE; exact, as n * 4 / 5 of integers."""
    return -(-n * 4 // 5)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of distinct shingles' hashes in WIDE_BITS bits."""
    sums = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        sums += bit_counts(widened(hashes[at : at + 8192], WIDE_BITS // 64))
    return np.packbits(2 * sums > len(hashes), bitorder="little").tobytes()


def pigeonhole_masks(n: int, distance: int) -> list[int]:
    """Masks of 64-bit fingerprints such that any two at `distance` bits or fewer are equal under one of them.

    The bits are split into m blocks; as at most `distance` blocks can differ, m - distance agree. m grows with the number n
    of fingerprints until unrelated ones share few masks; any m gives the same links.
    """
    for m in range(distance + 1, 17):
        agree = m - distance
        if n * comb(m, agree) / 2.0 ** (64 * agree / m) <= 4:
            break
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]
    return [sum(c) for c in combinations(blocks, agree)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _forest(nodes: np.ndarray, sigs: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect what lies within `distance` bits, directly or through others; fewer links than nodes."""
    us: list[int] = []
    vs: list[int] = []
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(sigs[left] ^ sigs[x]).sum(axis=1) <= distance
            if near.any():
                found, left = left[near], left[~near]
                us += [int(nodes[x])] * len(found)
                vs += nodes[found].tolist()
                queue += found.tolist()
    return us, vs


def _dealt(shared: DataFrame, chunks: Column | None = None) -> DataFrame:
    """(key, a, b, node) of (key, node, n): a key's n nodes in chunks (of CHUNK) by hash, and each pair a <= b of chunks."""
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("c")).cast("int")
    dealt = shared.withColumn("c", (F.ceil(F.col("n") / CHUNK) if chunks is None else chunks).cast("int")).withColumn("a", mine).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return dealt.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "node")


def chunk_links(shared: DataFrame, sigs: DataFrame) -> DataFrame:
    """(u, v, sure): pairs of large groups of (key, node, n) that are near beyond doubt, or may be, by (node, size, sig, own): as few as connect the same nodes in their chunks."""
    dealt = salted_join(_dealt(shared), sigs, ["node"], F.col("key"), 1)
    groups = dealt.groupBy("key", "a", "b").agg(F.collect_list(F.struct("node", "size", "sig", "own")).alias("x")).select(*[F.col(f"x.{c}").alias(f"{c}s") for c in ("node", "size", "sig", "own")])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, sizes, sigs, own = (batch.column(k)[i].values for k in range(4))
                nodes = nodes.to_numpy()
                yield _near_in_group(nodes, sizes.to_numpy(), np.frombuffer(b"".join(sigs.to_pylist()), np.uint64).reshape(len(nodes), -1), own.to_pylist())
        tidy()

    return groups.mapInArrow(links, "u long, v long, sure boolean")


def _forest_of_short(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (of numbers of sets) that connect what is alike to ALIKE, directly or through others; fewer links than sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([np.empty(0, np.uint32), *sets])
    _, kind = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(kind, kind="stable")
    having, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(kind))))  # by shingle, the sets that have it
    at = np.cumsum(sizes) - sizes
    us, vs = [], []
    left = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue:
            x = queue.pop()
            shared = np.bincount(np.concatenate([np.empty(0, np.int64), *(having[begin[k] : begin[k + 1]] for k in kind[at[x] : at[x] + sizes[x]].tolist())]), minlength=len(sets))
            near = np.flatnonzero(left & (5 * shared >= 4 * (sizes + sizes[x] - shared)))
            left[near] = False
            us += [x] * len(near)
            vs += near.tolist()
            queue += near.tolist()
    return us, vs


def _near_in_group(nodes: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, own: list[bytes]) -> pa.RecordBatch:
    """(u, v, sure) of a group: links that connect what is near beyond doubt by fingerprints or, of short texts, by their shingles; then links that connect what may be near besides. Together fewer than its nodes."""
    many, short = np.flatnonzero(sizes > FEW), np.flatnonzero(sizes <= SHORT)
    us, vs = _forest(many, sigs[many], SURE_DISTANCE)
    found = _forest_of_short([np.frombuffer(own[i], np.uint32) for i in short.tolist()])
    part = np.arange(len(nodes))
    x, y = [], []
    for u, v in zip([*us, *short[found[0]].tolist()], [*vs, *short[found[1]].tolist()], strict=True):
        if part[u] != part[v]:
            part[part == part[v]] = part[u]
            x.append(u)
            y.append(v)
    n_sure = len(x)
    for i in range(len(nodes) - 1):
        later = sizes[i + 1 :]
        ok = (part[i + 1 :] != part[i]) & (5 * np.minimum(later, sizes[i]) >= 4 * np.maximum(later, sizes[i])) & (np.maximum(later, sizes[i]) > SHORT)
        at = np.flatnonzero(ok) + i + 1
        at = at[np.bitwise_count(sigs[at] ^ sigs[i]).sum(axis=1, dtype=np.int64) <= WIDE_DISTANCE]
        for other in np.unique(part[at]).tolist():
            x.append(i)
            y.append(int(at[part[at] == other][0]))
        part[np.isin(part, part[at])] = part[i]
    a, b = nodes[np.array(x, np.int64)], nodes[np.array(y, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(a)) < n_sure)], names=["u", "v", "sure"])


def block_links(keyed: DataFrame, distance: int) -> DataFrame:
    """(u, v): links between nodes that share a key and that differ in `distance` bits or fewer.

    keyed: key, node long; the node itself is the 64-bit signature. The links of a group connect
    all that lie within the distance, directly or through members of the group, but are fewer than its members. Keys of one
    node go first. A group of more than CHUNK members is dealt out by hash into chunks, and each pair of chunks is a
    task's work: no group is gathered whole, and nothing is left out.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = _dealt(salted_join(keyed, sizes, ["key"], F.col("node"), 4)).groupBy("key", "a", "b").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1).select("nodes")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            nodes = batch.column(0)
            flat, cuts = nodes.flatten().to_numpy(zero_copy_only=False), np.asarray(nodes.offsets) - nodes.offsets[0].as_py()
            words = flat.view(np.uint64).reshape(-1, 1)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                u, v = _forest(flat[a:b], words[a:b], distance)
                us += u
                vs += v
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return groups.mapInArrow(links, "u long, v long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed long; a null text counts as empty."""

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column(0), "fp": np.array([fingerprint(x, size) for x in as_bytes(batch.column(1))], np.uint64).view(np.int64).tolist()}

    return map_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, fp long", of, [("doc_id", pa.int64()), ("fp", pa.int64())])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint: 16 hex digits. Fingerprints that differ in `distance` bits or fewer are linked, exactly; component_id is the
    smallest doc_id that can be reached. A null text counts as empty; texts without words have fingerprint zero. Rows
    with the same doc_id each come back. Rows with a null doc_id join the others of their fingerprint but don't make links and give no
    component_id; it is null if all are such. Other columns of docs are not read. An empty table gives no rows.
    """
    prints = settle(fingerprints(docs, id_col, text_col, size))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep is not null"))
    masks = pigeonhole_masks(nodes.count(), distance)
    keyed = nodes.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(_long(m))) for i, m in enumerate(masks)])).alias("key"), F.col("fp").alias("node"))
    labels = connected_components(block_links(keyed, distance))
    return _assigned(prints, nodes, labels).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _assigned(prints: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """prints (doc_id, fp) with component_id, from nodes (fp, rep, n) and labels (node, label)."""
    labels = settle(labels.withColumnRenamed("node", "fp").join(nodes, "fp"))
    reps = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = salted_join(labels.select("fp", "label"), reps, ["label"], F.col("fp"), SALTS).select("fp", "component_id")
    copies = nodes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    out = salted_join(prints, linked.unionAll(copies), ["fp"], F.coalesce("doc_id", F.lit(0)), SALTS, "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text); text_key: hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def frequent_shingles(source: DataFrame) -> np.ndarray:
    """Shingles that many texts have, from one text in SAMPLE. It matters to the time that blocks take alone; any set gives the same links."""

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        each = [block_shingles(np.unique(shingle_hashes(x, WIDE_SHINGLE)), np.empty(0, np.uint64)) for x in as_bytes(batch.column(0))]
        return {"key": np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64).tolist()}

    some = source.where(F.pmod(F.xxhash64("text_key", F.lit(3)), F.lit(SAMPLE)) == 0).select("text_key", "text").dropDuplicates(["text_key"]).select("text")
    counts = map_slices(some, "key long", of, [("key", pa.int64())]).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(MOST).collect()], np.int64).view(np.uint64))


def _near_links(source: DataFrame, wide: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links between nodes that connect all that are alike to ALIKE or more.

    Blocks' groups give links between what is near beyond doubt by its fingerprints (or, of short texts, by its shingles), and between what may be near: not all pairs, but as few as connect the same nodes. What is connected
    so is a family, and within a family that has a doubtful link all pairs are compared by fingerprints and, where these can't tell, by shingles.
    """
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = settle(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"))
    sigs = nodes.select("node", "size", "sig", "own")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            cuts = np.asarray(batch.column(0).offsets) - batch.column(0).offsets[0].as_py()
            lengths = np.diff(cuts)
            for n in np.unique(lengths).tolist():
                members = flat[cuts[:-1][lengths == n][:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                us.append(members[:, i].ravel())
                vs.append(members[:, j].ravel())
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    small = shared.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_list("node").alias("nodes")).select("nodes")
    pairs = small.mapInArrow(paired, "u long, v long").distinct()
    of = lambda c: sigs.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sig").alias(f"{c}_sig"), F.col("own").alias(f"{c}_own"))
    pairs = pairs.join(of("u"), "u").join(of("v"), "v")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("u_sig", "v_sig"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            small, large = (f(batch.column("u_size").to_numpy(), batch.column("v_size").to_numpy()) for f in (np.minimum, np.maximum))
            sure = (apart <= SURE_DISTANCE) & (small > FEW)
            keep = (5 * small >= 4 * large) & (apart <= WIDE_DISTANCE)
            # Of short texts the shingles tell.
            for i in np.flatnonzero((5 * small >= 4 * large) & (large <= SHORT)).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint32) for c in ("u_own", "v_own"))
                keep[i] = sure[i] = alike(x, y)
            out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sure)], names=["u", "v", "sure"])
            yield out.filter(pa.array(keep))
        tidy()

    found = pairs.mapInArrow(judged, "u long, v long, sure boolean")
    large = shared.where(F.col("n") > PAIRED).select("key", "node", "n")
    found = settle(found.unionAll(chunk_links(large, sigs)).groupBy("u", "v").agg(F.bool_or("sure").alias("sure")))
    families = settle(connected_components(found, LOCAL_LINKS)).select("node", F.col("label").alias("key"))
    doubtful = found.where("not sure").select(F.col("u").alias("node")).join(families, "node").select("key").distinct()
    members = families.join(doubtful, "key", "left_semi").join(nodes.select("node", "size", "sig"), "node")
    return found.where("sure").select("u", "v").unionAll(_family_links(source, wide, settle(members)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a similarity of ALIKE or more; exact, as 4 / 5 of integers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _family_links(source: DataFrame, wide: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v): links that connect the nodes of each family (key, node, size, sig) that are alike to ALIKE or more, directly or through others; fewer than its nodes for each pair of its chunks.

    Each text's shingles are hashed again, in 32 bits. A family is dealt out as pairs of chunks of so many nodes and shingles that a task can hold them.
    """
    one = wide.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        return {"node": batch.column(0), "set": [np.unique(shingle_hashes(x, WIDE_SHINGLE).astype(np.uint32)).tobytes() for x in as_bytes(batch.column(1))]}

    texts = source.select("text_key", "text").join(one, "text_key").select("node", "text").dropDuplicates(["node"])
    sets = settle(map_slices(texts, "node long, set binary", of, [("node", pa.int64()), ("set", pa.binary())]))
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    chunks = F.ceil(F.greatest(F.col("n") / FAMILY_CHUNK, F.col("total") / FAMILY_SHINGLES))
    dealt = _dealt(salted_join(members.select("key", "node"), large, ["key"], F.col("node"), 4), chunks)
    rows = dealt.join(members.select("node", "size", "sig"), "node").join(sets, "node")
    groups = rows.groupBy("key", "a", "b").agg(F.collect_list(F.struct("node", "size", "sig", "set")).alias("x")).select(*[F.col(f"x.{c}").alias(f"{c}s") for c in ("node", "size", "sig", "set")])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, sizes, sigs, own = (batch.column(k)[i].values for k in range(4))
                nodes = nodes.to_numpy()
                x, y = _alike_in_family(sizes.to_numpy(), np.frombuffer(b"".join(sigs.to_pylist()), np.uint64).reshape(len(nodes), -1), [np.frombuffer(z, np.uint32) for z in own.to_pylist()])
                a, b = nodes[x], nodes[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])
        tidy()

    return groups.mapInArrow(compared, "u long, v long")


def _alike_in_family(sizes: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is alike: a pair is compared by its shingles if its fingerprints can't tell and its two aren't connected."""
    part = np.arange(len(sizes))
    x, y = [], []

    def link(i: int, j: int) -> None:
        part[part == part[j]] = part[i]
        x.append(i)
        y.append(j)

    many = np.flatnonzero(sizes > FEW)
    for u, v in zip(*_forest(many, sigs[many], SURE_DISTANCE), strict=True):
        link(u, v)
    for i in range(len(sizes) - 1):
        later = sizes[i + 1 :]
        at = np.flatnonzero((part[i + 1 :] != part[i]) & (5 * np.minimum(later, sizes[i]) >= 4 * np.maximum(later, sizes[i]))) + i + 1
        apart = np.bitwise_count(sigs[at] ^ sigs[i]).sum(axis=1, dtype=np.int64)
        near = (np.minimum(sizes[at], sizes[i]) <= FEW) | (apart <= WIDE_DISTANCE)
        at, apart = at[near], apart[near]
        for j in at[np.argsort(apart, kind="stable")].tolist():  # the likeliest first
            if part[j] != part[i] and alike(sets[i], sets[j]):
                link(i, j)
    return np.array(x, np.int64), np.array(y, np.int64)


def _near(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, group) of every row: group is a number that near-duplicates share."""
    source = _source(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(source))

    def of(batch: pa.RecordBatch) -> dict[str, list]:
        each = [np.unique(shingle_hashes(x, WIDE_SHINGLE)) for x in as_bytes(batch.column(2))]
        nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in each], np.uint64).view(np.int64)
        keys = [block_shingles(h, sent.value).view(np.int64) for h in each]
        return {"doc_id": batch.column(0), "text_key": batch.column(1), "node": nodes.tolist(), "size": list(map(len, each)), "sig": [wide_fingerprint(h) for h in each], "own": [np.unique(h.astype(np.uint32)).tobytes() if len(h) <= SHORT else b"" for h in each], "keys": keys}

    columns = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("sig", pa.binary()), ("own", pa.binary()), ("keys", pa.list_(pa.int64()))]
    wide = settle(map_slices(source, "doc_id long, text_key long, node long, size long, sig binary, own binary, keys array<long>", of, columns))
    # Texts of the same shingles are one node.
    nodes = wide.groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("own").alias("own"), F.first("keys").alias("keys"))
    labels = settle(connected_components(_near_links(source, wide.select("node", "text_key"), nodes)).withColumnRenamed("label", "group"))
    rows = wide.select("doc_id", "text_key", "node")
    return settle(salted_join(rows, labels, ["node"], F.coalesce("doc_id", F.lit(0)), SALTS, "left").select("doc_id", "text_key", F.coalesce("group", "node").alias("group")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: near-duplicates by distinct five-word shingles, at a similarity of ALIKE or more.

    64 bits can't tell that similarity, so fingerprints have WIDE_BITS bits. To be sure of a shared block of such bits, they would have to be split into
    over WIDE_DISTANCE blocks of 5, which all texts share; so what is split is the set of shingles that the fingerprint is made of (block_shingles):
    any two texts that are alike share a block. Candidates are verified by the Hamming distance of their fingerprints: at
    SURE_DISTANCE or less they are alike, beyond WIDE_DISTANCE they aren't, and between by their shingles, which decide. Texts of up to FEW
    shingles are all decided so. Components are those of the links; component_id is the smallest doc_id of them. Texts are taken whole; other cases as in
    simhash_components.
    """
    near = _near(docs, id_col, text_col)
    least = near.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return salted_join(near.select("doc_id", "group"), least, ["group"], F.coalesce("doc_id", F.lit(0)), SALTS, "left").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id, and of its texts that are in the group the one of least hash.

    Rows of one id whose texts aren't near-duplicates of each other are of different groups, and each stays. Of rows with the same id and text one stays.
    Rows with a null id stay. All columns of docs come back as they are, whatever they are called.
    """
    near = _near(docs, id_col, text_col).where("doc_id is not null")
    keep = near.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.doc_id", "x.text_key").distinct()
    counted = near.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    marked = settle(counted.join(keep.withColumn("keep", F.lit(True)), ["doc_id", "text_key"], "left").where("keep is null or n > 1"))
    # Rows that go, and rows that stay once; few beside the documents, and sent to all where they are few by count.
    gone, again = marked.select("doc_id", "text_key"), marked.where("keep").select("doc_id", "text_key")
    if marked.count() <= BROADCAST_ROWS:
        gone, again = F.broadcast(gone), F.broadcast(again)
    id_of, key_of = F.col(f"d.{id_col}").cast("long"), F.xxhash64(F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit("")))
    matches = (id_of == F.col("k.doc_id")) & (key_of == F.col("k.text_key"))
    kept = docs.alias("d").join(gone.alias("k"), matches, "left_anti")
    return kept.unionByName(docs.alias("d").join(again.alias("k"), matches, "left_semi").dropDuplicates([id_col, text_col]))

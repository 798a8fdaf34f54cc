"""Near duplicates by MinHash: banded candidates, sequential Bayesian pruning, exact verification, connected components.

Free style: numpy in Arrow batches for hashing and comparing; Spark deals, joins and groups.

1. Each text becomes a set of hashes of five consecutive words, a class (the set's digest), one byte of each of 192 minima, and
   24 band keys of five minima (36 at a threshold of 0.80). Texts of one class are one node, so copies meet once.
2. Nodes that share a band key are candidates. A node is first compared with the least node it shares most bands with. Then,
   in every bucket whose nodes are in several components, all nodes of different components are compared, in blocks of
   bounded size; a pair is compared in the first bucket it shares, and all work on it stays inside the block.
3. A comparison reads the signatures in batches of 32 and stops once P(similarity >= threshold | matches so far) is below the
   miss probability. Survivors are verified on full sets: 100 * |A and B| >= per_cent * |A or B|. A block gives back as many verified
   links as connect its nodes, so rows grow with nodes, not with pairs.
4. Verified links are contracted to stars, with every round written to the shared folder.

A pair at the threshold shares no band with a probability below 1e-6, and is pruned with a probability of at most `miss` a
batch. Links inside one component are not all listed; no link between components is left out.

Defined results. Null or empty text, or one without words: an empty set, linked with nothing. Fewer than five words: the whole
text is one shingle. Null ids: such a row has the smallest id of its component, or null if that has none. Repeated rows and
equal ids are separate rows with the same component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_column, written
from .words import shingles, text_slices, word_hashes

#: Minima of a band, bands at PER_CENT, minima compared at once, and all minima; the bands take the first of them.
ROWS, BANDS, BATCH, SIZE = 5, 24, 32, 192
#: Links, unless the caller names another threshold: PER_CENT * union <= 100 * intersection.
PER_CENT = 85
#: Nodes of a bucket compared in one task with as many others.
BLOCK = 256
#: Bytes of a shingle set up to which it counts as one node of a part; two parts of a group hold some 32 MB of sets.
SET_BYTES = 1 << 16

_RNG = np.random.Generator(np.random.PCG64(5150))
_TIMES = (_RNG.integers(0, 2**31, SIZE, dtype=np.int64) * 2 + 1).astype(np.uint32)
_PLUS = _RNG.integers(0, 2**32, SIZE, dtype=np.uint64).astype(np.uint32)
_BAND = (_RNG.integers(0, 2**62, ROWS + 1, dtype=np.int64) * 2 + 1).astype(np.uint64)


def bands_for(per_cent: int) -> int:
    """Fewest bands that miss a pair at the threshold no more often than BANDS miss one at PER_CENT."""
    missed = lambda t, n: (1 - (t / 100) ** ROWS) ** n
    found = next((n for n in range(1, SIZE // ROWS + 1) if missed(per_cent, n) <= missed(PER_CENT, BANDS)), None)
    if found is None or per_cent > 100:
        raise ValueError(f"no {SIZE // ROWS} bands of {ROWS} minima find pairs at {per_cent} of 100")
    return found


def minima(hashes: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """The least value of each of SIZE permutations over a set of hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIZE, 2**32 - 1, np.uint32)
    for i in range(0, len(x), at_once):
        np.minimum(out, (x[None, i:i + at_once] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=out)
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def node_of(hashes: np.ndarray) -> int:
    """The class of a set: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(s: np.ndarray, n_bands: int) -> tuple[bytes, np.ndarray]:
    """Signature and band keys of a set."""
    least = minima(s)
    keys = least[:ROWS * n_bands].reshape(n_bands, ROWS).astype(np.uint64) @ _BAND[:ROWS] + np.arange(n_bands, dtype=np.uint64) * _BAND[ROWS]
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (_scramble(least) & np.uint32(255)).astype(np.uint8).tobytes(), keys.view(np.int64)


def _sketches(n_bands: int):
    def sketch(batches):
        for batch in batches:
            rows: list[tuple] = []
            for _, _, data, offsets in text_slices(batch.column(1)):
                words, counts = word_hashes(data, offsets)
                at = 0
                for n in counts.tolist():
                    s = shingles(words[at:at + n])
                    at += n
                    if not len(s):
                        rows.append((0, None, None))
                        continue
                    rows.append((len(s), node_of(s), _signed(s, n_bands)[1]))
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "node", "bands"])
    return sketch


def _sets(n_bands: int):
    def full(batches):
        for batch in batches:
            nodes, sigs, bands, sets = [], [], [], []
            for _, _, data, offsets in text_slices(batch.column(0)):
                words, counts = word_hashes(data, offsets)
                at = 0
                for n in counts.tolist():
                    s = shingles(words[at:at + n])
                    at += n
                    sig, keys = _signed(s, n_bands)
                    nodes.append(node_of(s))
                    sigs.append(sig)
                    bands.append(keys)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                ["node", "sig", "bands", "set"])
    return full


def least_matches(miss: float, per_cent: int = PER_CENT) -> np.ndarray:
    """Fewest matches after 1, 2, ... batches with which P(similarity >= threshold | matches) is still `miss` or more.

    With a flat prior the posterior of the match rate after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at t is
    a binomial sum: P(rate >= t) = P(Binomial(n + 1, t) <= m). Bytes of different minima agree by chance once in 256.
    """
    t = per_cent / 100 + (1 - per_cent / 100) / 256
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """Indices of the pairs (rows of two signature matrices) that no batch prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def _verifier(fewest: np.ndarray, per_cent: int):
    def verify(batches):
        for batch in batches:
            u, v, sig_u, sig_v, set_u, set_v = (batch.column(i) for i in range(6))
            as_matrix = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIZE)
            linked = []
            for i in surviving(as_matrix(sig_u), as_matrix(sig_v), fewest).tolist() if len(u) else []:
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (set_u, set_v))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= per_cent * (len(x) + len(y) - common):
                    linked.append(i)
            index = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([u.take(index), v.take(index)], ["u", "v"])
    return verify


def _linked(pairs: DataFrame, sets: DataFrame, fewest: np.ndarray, per_cent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar enough."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("sig").alias(f"sig_{n}"), F.col("set").alias(f"set_{n}"))
    return (pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "sig_u", "sig_v", "set_u", "set_v")
            .mapInArrow(_verifier(fewest, per_cent), "u bigint, v bigint"))


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of every set of `left` with every set of `right`, by products of membership matrices."""
    used = np.unique(np.concatenate([left, right]))
    values, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    a, b = np.searchsorted(used, left), np.searchsorted(used, right)
    out = np.zeros((len(a), len(b)), np.float64)
    for first in range(0, len(values), at_once):
        x, y = np.searchsorted(place, (first, first + at_once))
        member = np.zeros((len(used), min(at_once, len(values) - first)), np.float32)
        member[row[x:y], place[x:y] - first] = 1
        out += member[a] @ member[b].T
    return out.astype(np.int64)


def _comparer(fewest: np.ndarray, per_cent: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j, key = group["i"].iloc[0], group["j"].iloc[0], int(group["key"].iloc[0])
        sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, SIZE)
        bands = np.stack(group["bands"].to_list())
        node, label, part = (group[c].to_numpy() for c in ("node", "label", "part"))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        todo = label[left][:, None] != label[right][None, :]
        if i == j:
            todo &= node[left][:, None] < node[right][None, :]
        # Pairs that share an earlier band meet there.
        for k in range(int(np.flatnonzero(bands[0] == key)[0])):
            todo &= bands[left, k][:, None] != bands[right, k][None, :]
        a, b = np.nonzero(todo)
        a, b = left[a], right[b]
        alive = surviving(sig[a], sig[b], fewest)
        a, b = a[alive], b[alive]
        links: list[tuple[int, int]] = []
        if len(a):
            sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
            size = np.array([len(x) for x in sets])
            rows, columns = np.unique(a), np.unique(b)
            common = common_counts(sets, rows, columns)[np.searchsorted(rows, a), np.searchsorted(columns, b)]
            linked = 100 * common >= per_cent * (size[a] + size[b] - common)
            parent = {x: x for x in set(label.tolist())}

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x
            for u, v in zip(a[linked].tolist(), b[linked].tolist()):
                x, y = find(int(label[u])), find(int(label[v]))
                if x != y:
                    parent[x] = y
                    links.append((int(max(node[u], node[v])), int(min(node[u], node[v]))))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    return compare


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u, v): stars made by turns of joining larger and smaller neighbours to the least."""
    edge = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = written(small.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "edges")
        now = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _blocks(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, i, j, part, node, label): the nodes of `labelled` (key, node, label) by pairs of parts of a bucket with links left to find.

    A bucket's nodes are dealt into parts of about BLOCK nodes, fewer where their sets are large. A label with half a part or more has
    parts of its own; the others share parts. Two parts of one label are not compared, so a bucket of one large label
    and a few other nodes gives each of its nodes as many copies as the others need parts.
    """
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    weight = sets.select("node", F.greatest(F.lit(1.0), F.octet_length("set") / F.lit(SET_BYTES)).alias("weight"))
    inside = written(labelled.join(mixed, "key", "left_semi").join(weight, "node"), "inside")
    sizes = inside.groupBy("key", "label").agg(F.sum("weight").alias("size"))
    rest = sizes.where(F.col("size") < BLOCK / 2).groupBy("key").agg(F.sum("size").alias("rest"))
    own = F.when(F.col("size") >= BLOCK / 2, F.col("label"))
    count = F.ceil(F.when(F.col("size") >= BLOCK / 2, F.col("size")).otherwise(F.col("rest")) / BLOCK)
    placed = inside.join(sizes, ["key", "label"]).join(rest, "key", "left").select(
        "key", "node", "label", own.alias("own"), F.concat_ws(":", own.cast("string"), F.pmod(F.xxhash64("node"), count).cast("string")).alias("part"))
    placed = written(placed, "placed")
    parts = placed.groupBy("key", "own", "part").agg(F.min("label").alias("low"), F.max("label").alias("high"))

    def side(n: str) -> DataFrame:
        return parts.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("own", "part", "low", "high")])
    shared = lambda n: side(n).where(F.col(f"own_{n}").isNull())
    alone = lambda n: side(n).where(F.col(f"own_{n}").isNotNull())
    several = (F.col("low_i") < F.col("high_i")) | (F.col("low_j") < F.col("high_j")) | (F.col("low_i") != F.col("low_j"))
    among = shared("i").join(shared("j"), "key").where((F.col("part_i") <= F.col("part_j")) & several)
    across = shared("i").join(alone("j"), "key")
    # Labels are paired before their parts, so that a large label's parts are not paired with each other.
    names = lambda n: alone(n).select("key", f"own_{n}").distinct()
    apart = names("i").join(names("j"), "key").where("own_i < own_j").join(alone("i"), ["key", "own_i"]).join(alone("j"), ["key", "own_j"])
    pairs = [p.select("key", F.col("part_i").alias("i"), F.col("part_j").alias("j")) for p in (among, across, apart)]
    pairs = pairs[0].unionByName(pairs[1]).unionByName(pairs[2])
    each = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    return each.join(placed.select("key", "part", "node", "label"), ["key", "part"])


def near_duplicates(docs: DataFrame, miss: float = 1e-6, per_cent: int = PER_CENT) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_shingles, component_id, kept, root (the component's node; null for empty sets).

    Texts are linked from a similarity of per_cent / 100 on, which may be 0.80 or more.
    """
    small_batches(docs.sparkSession)
    fewest, n_bands = least_matches(miss, per_cent), bands_for(per_cent)
    texts = docs.select("doc_id", text_column().alias("text")).withColumn("h", F.xxhash64("text"))
    sketches = written(texts.select("doc_id", "text", "h").mapInArrow(
        _sketches(n_bands), "doc_id bigint, h bigint, n_shingles bigint, node bigint, bands array<bigint>"), "sketches")
    bands = sketches.where("node IS NOT NULL").select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    members = written(bands.join(shared.select("key", "first"), "key").distinct(), "members")
    # Of each node the smallest id, and one row whose text gives its full set; copies are reduced before any exchange.
    lows = written(sketches.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "h")).alias("row")), "nodes")
    chosen = (lows.join(members.select("node").distinct(), "node", "left_semi")
              .select(F.col("row.doc_id").alias("_id"), F.col("row.h").alias("_h")))
    sets = written(texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("text")
                   .mapInArrow(_sets(n_bands), "node bigint, sig binary, bands array<bigint>, set binary").dropDuplicates(["node"]), "sets")

    stars = members.where("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    nearest = stars.groupBy("node").agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("best"))
    pairs = nearest.select(F.col("node").alias("u"), (-F.col("best.f")).alias("v"))
    edges = written(_linked(pairs, sets, fewest, per_cent), "links")
    labels = components(edges)

    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    blocks = _blocks(labelled, sets).join(sets, "node")
    more = written(blocks.groupBy("key", "i", "j").applyInPandas(_comparer(fewest, per_cent), "u bigint, v bigint"), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    classes = lows.join(labels, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(classes.join(least, "root").select("node", "root", "component_id"), "components")
    out = sketches.select("doc_id", "h", "n_shingles", "node").join(named, "node", "left")
    return (out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "h", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root"))

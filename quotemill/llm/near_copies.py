"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. every text becomes its SimHash, its set of shingle hashes (64 bits) and a node, the hash of that set, so that exact copies cost
   nothing further;
2. SimHashes of at most 3 differing bits are linked by the pivot table of simhash.py. Each of these links is verified by the exact
   similarity of its sets, and the nodes that it connects are contracted;
3. SimHashes leave links over: at 0.8 some 10 of 64 bits differ, and no block keys of useful width cover that. So BANDS keys of
   ROWS MinHashes each deal the nodes into buckets. Two sets of similarity s share none with probability
   (1 - s^ROWS)^BANDS, 7 in a million at 0.8. A node is compared with a leader of each of its buckets, if they still lie in
   different components, by their exact similarity.
   The rows of a leader are dealt over as many tasks as there are thousands of them, and each task holds the leader alone;
4. buckets whose nodes still lie in different components are compared in whole: a bucket is cut into chunks bounded in rows and
   bytes, each pair of chunks goes to a task, which counts the shared shingles of all its pairs at once and sends back a spanning
   forest of its links, never the pairs. A link between two nodes of one component adds nothing, so the components are those of
   all pairs of all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import durable, join_spread, whole_runs
from quotemill.llm.components import connected_components
from quotemill.llm.simhash import fingerprint, fingerprint_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, HASH_SEED = 30, 5, 20240311
#: Nodes that a task compares with one leader; rows and bytes of shingles in a chunk of a bucket.
PER_LEADER, CHUNK, CHUNK_BYTES = 1000, 512, 16 << 20
#: Texts are looked up by a broadcast table of up to this many nodes (some 100 MB in a task); beyond it, all texts are shuffled.
MAX_BROADCAST_NODES = 1_000_000


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.array([], np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64))


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(HASH_SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
    return drawn[0] | np.uint64(1), drawn[1]


def band_keys(found: np.ndarray, hashers: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One signed key a band, which differs from band to band; a set without shingles has none."""
    if not len(found):
        return []
    factor, mask = hashers
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[None, at : at + 1024] ^ mask) * factor).min(axis=1))
    held = least.astype("<u8").tobytes()
    return [xxhash.xxh64_intdigest(held[i : i + 8 * ROWS], i) - (1 << 63) for i in range(0, len(held), 8 * ROWS)]


def _nodes(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, content, fp, node, size, keys) for each row; content is a hash of the text as it is, fp its SimHash, size the number of shingles."""
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for batch in batches:
            prints, nodes, sizes, keys = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size)
                prints.append(fingerprint(text.as_py()))
                nodes.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes()) - (1 << 63))
                sizes.append(len(found))
                keys.append(band_keys(found, hashers))
            signed = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            columns = [batch.column("doc_id"), batch.column("content"), signed, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "fp", "node", "size", "keys"])

    return rows.mapInArrow(scan, "doc_id long, content long, fp long, node long, size long, keys array<long>")


def _print_pairs(prints: DataFrame) -> DataFrame:
    """(leader, node): pairs of nodes that connect all whose SimHashes are equal or linked by the pivot table. prints: node, fp."""
    lead = durable(prints.groupBy("fp").agg(F.min("node").alias("leader")))
    same = join_spread(prints, lead, ["fp"]).select("leader", "node")
    edges = durable(fingerprint_links(lead.select("fp")))
    child = join_spread(edges, lead.select(F.col("fp").alias("u"), F.col("leader").alias("node")), ["u"])
    near = join_spread(child, lead.select(F.col("fp").alias("v"), "leader"), ["v"]).select("leader", "node")
    return same.unionByName(near).where("node <> leader").distinct()


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """(node, found): the shingle set of each node of `wanted` (node, content)."""
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.xxhash64(text).alias("content"), text.alias("text"))
    few = wanted.count() <= MAX_BROADCAST_NODES
    rows = rows.join(F.broadcast(wanted), "content") if few else join_spread(rows, wanted, ["content"])
    rows = rows.groupBy("node").agg(F.first("text").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size).astype("<u8").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "found"])

    return rows.mapInArrow(scan, "node long, found binary")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _led(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (leader, node) of `pairs` whose sets have the similarity, as (u, v)."""
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PER_LEADER).cast("int").alias("parts"))
    follow = join_spread(pairs, parts, ["leader"]).select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    lead = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))
    rows = join_spread(follow.unionByName(lead), sets, ["node"]).withColumn("follows", F.col("node") != F.col("leader"))
    dealt = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "follows").select("leader", "node", "found")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array([], np.uint64)
        for batch in batches:
            near = []
            leaders, nodes = batch.column("leader").to_pylist(), batch.column("node").to_pylist()
            for leader, node, found in zip(leaders, nodes, batch.column("found"), strict=True):
                own = np.frombuffer(found.as_py(), "<u8")
                if leader == node:
                    first = own
                near.append(leader != node and _similar(first, own, similarity))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node")], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return dealt.mapInArrow(judge, "u long, v long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share.

    Members of many sets are counted by products of 0/1 matrices, 2048 members at a time; those of few sets by the pairs of sets
    that have them.
    """
    n = len(sets)
    held = np.repeat(np.arange(n), [len(s) for s in sets])
    members, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.int64)
    often = np.flatnonzero(count > max(n // 32, 1))
    column = np.full(len(members), -1)
    column[often] = np.arange(len(often))
    for at in range(0, len(often), 2048):
        inside = (column[code] >= at) & (column[code] < at + 2048)
        matrix = np.zeros((n, min(2048, len(often) - at)), np.float32)
        matrix[held[inside], column[code[inside]] - at] = 1
        shared += np.rint(matrix @ matrix.T).astype(np.int64)
    rare = np.flatnonzero((column[code] < 0) & (count[code] > 1))
    rare = rare[np.argsort(code[rare], kind="stable")]
    owner, member = held[rare], code[rare]
    for lag in range(1, int(count[member].max(initial=1))):
        same = np.flatnonzero(member[lag:] == member[:-lag])
        np.add.at(shared, (owner[same], owner[same + lag]), 1)
        np.add.at(shared, (owner[same + lag], owner[same]), 1)
    return shared


def set_links(sets: list[np.ndarray], groups: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different `groups`."""
    size = np.array([len(s) for s in sets])
    shared = overlaps(sets)
    near = shared >= similarity * (size[:, None] + size[None, :] - shared)
    near &= groups[:, None] != groups[None, :]
    roots = {g: g for g in groups.tolist()}

    def root(g: int) -> int:
        while roots[g] != g:
            roots[g] = roots[roots[g]]
            g = roots[g]
        return g

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
        a, b = root(groups[i].item()), root(groups[j].item())
        if a != b:
            roots[a] = b
            links.append((i, j))
    return links


def _crossed(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect the components of each bucket as its pairs do. named: key, node, size, component."""
    crowd = named.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") * 8 / CHUNK_BYTES), F.lit(1)).cast("int")
    crowd = crowd.select("key", chunks.alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    parts = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda t: t != F.col("own")),
            lambda t: F.least(F.col("own"), t) * F.col("chunks") + F.greatest(F.col("own"), t),
        )
    )
    dealt = join_spread(named, crowd, ["key"]).withColumn("own", own)
    dealt = dealt.select("key", F.explode(parts.cast("array<int>")).alias("part"), "node", "component")
    dealt = join_spread(dealt, sets, ["node"]).repartition("key", "part").sortWithinPartitions("key", "part")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, run in whole_runs(batches, ["key", "part"]):
            node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
            found = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("found")]
            edges = np.append(np.flatnonzero(np.r_[True, np.diff(run) != 0]), len(run)).tolist()
            u, v = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                for i, j in set_links(found[a:b], component[a:b], similarity):
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.select("key", "part", "node", "component", "found").mapInArrow(scan, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of `docs`.

    component_id is the smallest id reachable over links of at least `similarity`, the row's own
    included. A text of fewer words than a shingle is one shingle; null and wordless texts are copies
    of each other. Null ids, repeated rows and empty tables are treated as by simhash.near_duplicates.
    """
    rows = durable(_nodes(docs, id_col, text_col, shingle))
    own = [F.min("doc_id").alias("least"), F.min("content").alias("content"), F.first("size").alias("size"), F.first("keys").alias("keys")]
    nodes = durable(rows.groupBy("node").agg(*own))
    keys = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keys.select("node", "key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    member = durable(join_spread(keys, shared, ["key"]))
    pairs = durable(_print_pairs(rows.select("node", "fp").distinct()))
    paired = pairs.select(F.explode(F.array("leader", "node")).alias("node"))
    wanted = durable(join_spread(nodes.select("node", "content"), member.select("node").unionByName(paired).distinct(), ["node"]))
    sets = durable(_sets(docs, text_col, wanted, shingle))
    alike = durable(_led(pairs, sets, similarity))
    placed = member.join(connected_components(alike), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    placed = durable(placed)
    lead = placed.groupBy("key").agg(F.min(F.struct("node", "component")).alias("lead"))
    led = join_spread(placed, lead, ["key"]).where("component <> lead.component").select(F.col("lead.node").alias("leader"), "node")
    links = durable(alike.unionByName(_led(durable(led.distinct()), sets, similarity)))
    found = connected_components(links)
    named = member.join(found.withColumnRenamed("component", "found"), "node", "left")
    named = named.select("key", "node", "size", F.coalesce("found", "node").alias("component"))
    open_ = named.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key")
    crossed = durable(_crossed(durable(join_spread(named, open_, ["key"])), sets, similarity))
    groups = connected_components(links.unionByName(crossed))
    labelled = nodes.select("node", "least").join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    label = join_spread(labelled, least, ["component"]).select("node", "component_id")
    return rows.select("doc_id", "node").join(label, "node").select("doc_id", "component_id")

"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of 5-word shingles; texts with equal sets are one node. The minima of bands x ROWS hash functions are
banded; nodes that share a band meet in its bucket. Nodes that meet others get signatures of HASHES minima, a byte
each, and pairs are compared a batch of them at a time: they leave when the posterior probability that their
similarity reaches the threshold (uniform prior) falls under MISS. Survivors are verified exactly on their full sets.

Only what decides components is compared. First every node of a bucket meets the bucket's hub, the node that meets
most others in all its buckets. Then, in buckets that still hold two components or more, nodes of different components
meet; a pair counts in the first place it shares. A bucket of more than BLOCK nodes is dealt again by groups of DEEPER
further minima, as many groups as the threshold needs, so that nodes which share only common words do not meet. What
exceeds BLOCK even then (thousands of texts that nearly reach the threshold) is compared in blocks of BLOCK x BLOCK.
That is done twice: once only the likeliest partner of a node in each other component is verified, and then, between
what is still apart, all. So a large group of near copies costs its size, not its square.

Shingles are 64-bit hashes; "exactly" means on the full sets of these.

The threshold is the caller's. A pair at it shares no band with probability under NO_BAND: 24 bands at 85/100, the
contract of op8, where (1 - 0.85**5)**24 < 1e-6, and 35 at 80/100, which the pipeline takes. The same holds for the
groups of a crowded bucket.

Defined results: null text counts as empty; empty sets link with nothing, so such rows stay alone; fewer than 5 words
are one shingle; rows with a null doc_id join components but never name one that has a number; repeated rows are one
node, and all rows tied on the component's smallest doc_id stay; an empty table gives an empty table; columns other
than the two named are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, log, log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplan.operators.graph import components, merged_components
from strataplan.runtime import SHORT_ROWS, forget, save, ship, text_key, without

WORDS = 5
THRESHOLD = (85, 100)
ROWS = 5
NO_BAND = 1e-6
HASHES = 512
BATCH = 64
MISS = 1e-7
BLOCK = 2_048
DEEPER = 6

_NO_ID = -(1 << 63)
SIGNED = "doc_id long, text_key long, n_shingles long, node binary, bands array<long>"


def bands_at(at_least: tuple[int, int], rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` minima of which a pair at the threshold shares none with probability under NO_BAND."""
    return ceil(log(NO_BAND) / log1p(-((at_least[0] / at_least[1]) ** rows)))


@lru_cache
def thresholds(batch: int = BATCH, total: int = HASHES, miss: float = MISS, at_least: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): below, P(similarity >= threshold | matches) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail is a binomial sum. Bytes also agree by
    chance, which only keeps more.
    """
    t = at_least[0] / at_least[1]
    out = []
    for n in range(batch, total + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return out


@lru_cache(maxsize=1)
def _seeds():
    import numpy as np

    from strataplan.llm.shingles import mix

    s = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return s[0::2] | np.uint64(1), s[1::2]


def minima(hashes, functions: int):
    """Top halves of the smallest values that the first hash functions take on a set."""
    import numpy as np

    a, b = (x[:functions] for x in _seeds())
    low = np.full(functions, np.iinfo(np.uint64).max, np.uint64)
    step = 250_000 // functions
    for i in range(0, len(hashes), step):
        low = np.minimum(low, (hashes[i : i + step, None] * a + b).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def signature(hashes) -> bytes:
    """HASHES minima, mixed down to a byte each."""
    import numpy as np

    from strataplan.llm.shingles import mix

    return (mix(minima(hashes, HASHES).astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def band_keys(sig):
    import numpy as np

    from strataplan.llm.shingles import mix

    key = np.arange(1, len(sig) // ROWS + 1, dtype=np.uint64)
    for part in sig.reshape(-1, ROWS).T:
        key = mix(key * np.uint64(0x100000001B3) + part)
    return key.view(np.int64)


def _node(hashes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Set size, node (digest of the set) and band keys of every row; null beyond the size where empty."""
    ship(docs.sparkSession)
    functions = bands_at(at_least) * ROWS

    def run(batches):
        import pyarrow as pa

        from strataplan.llm.shingles import shingle_set

        forget()
        for b in batches:
            n, node, bands = [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py() or b"", WORDS)
                n.append(len(h))
                node.append(_node(h) if len(h) else None)
                bands.append(band_keys(minima(h, functions)) if len(h) else None)
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "node", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col), F.col(text_col).cast("binary").alias("_t")).mapInArrow(run, SIGNED)


def _posterior(a, b, at_least: tuple[int, int]):
    """Which rows of two signature matrices stay after every batch, and their matches."""
    import numpy as np

    alive, done = np.arange(len(a)), 0
    matches = np.zeros(len(a), np.int64)
    for n, least in thresholds(at_least=at_least):
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= least], n
    return alive, matches[alive]


def _signatures(column):
    import numpy as np

    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(len(column), HASHES)


def prune(pairs: DataFrame, sets: DataFrame, at_least: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that the sequential comparison of signatures leaves."""
    left = sets.select(F.col("node").alias("a"), F.col("signature").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("signature").alias("_sb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.take(_as_index(_posterior(_signatures(batch.column(2)), _signatures(batch.column(3)), at_least)[0])).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_sa", "_sb").mapInArrow(run, "a binary, b binary")


def _as_index(rows):
    import pyarrow as pa

    return pa.array(rows, pa.int64())


def _mixed(places: DataFrame) -> DataFrame:
    """Places (key) that hold two components or more, with their nodes counted."""
    size = places.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    return size.filter("_lo != _hi").select("key", "_n")


def across_components(members: DataFrame, described: DataFrame, likeliest: bool, at_least: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs of different components in one bucket that pass the signatures, each in the first place it shares.

    members: key, band, node, root; described: node, bands, signature. ``likeliest``: of a node's partners in one other
    component only the one with most matches, in each place.
    """
    groups = min(bands_at(at_least, DEEPER), HASHES // DEEPER)
    met = members.join(_mixed(members), "key")
    flat = met.filter(F.col("_n") <= block).select("key", "band", F.lit(-1).alias("group"), "node", "root", F.lit(1).alias("_chunks"))
    # Group k of a crowded bucket's node: DEEPER bytes of its signature.
    part = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda k: F.struct(k.alias("group"), F.xxhash64("key", k, F.substring("signature", k * DEEPER + 1, F.lit(DEEPER))).alias("deep")),
    )
    crowded = met.filter(F.col("_n") > block).drop("_n").join(described.select("node", "signature"), "node")
    deep = crowded.select("band", "node", "root", F.explode(part).alias("_p")).select(F.col("_p.deep").alias("key"), "band", F.col("_p.group").alias("group"), "node", "root")
    deep = deep.join(_mixed(deep), "key").select("key", "band", "group", "node", "root", F.ceil(F.col("_n") / block).cast("int").alias("_chunks"))
    dealt = flat.unionByName(deep).withColumn("_chunk", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int"))
    # A node goes to each block (i, j), i <= j, that its chunk is half of.
    halves = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda j: F.struct(F.least("_chunk", j).alias("i"), F.greatest("_chunk", j).alias("j")))
    placed = dealt.withColumn("_block", F.explode(halves)).join(described, "node").select("key", "band", "group", "_block.i", "_block.j", "_chunk", "node", "root", "bands", "signature")

    def compared(table):
        import numpy as np
        import pyarrow as pa

        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        roots = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        nodes, sigs, chunk = table["node"].to_pylist(), _signatures(table["signature"]), table["_chunk"].to_numpy()
        band, group = table["band"][0].as_py(), table["group"][0].as_py()
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        before = sigs[:, : max(0, group) * DEEPER].reshape(len(nodes), -1, DEEPER) if group > 0 else None
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        first, second = [], []
        for k, x in enumerate(left):
            others = right[k + 1 :] if i == j else right
            others = others[roots[others] != roots[x]]
            if not len(others):
                continue
            at, matches = _posterior(np.broadcast_to(sigs[x], (len(others), HASHES)), sigs[others], at_least)
            kept = others[at]
            if len(kept) and (band or before is not None):
                new = ~(keys[kept, :band] == keys[x, :band]).any(1)
                if before is not None:
                    new &= ~(before[kept] == before[x]).all(2).any(1)
                kept, matches = kept[new], matches[new]
            if likeliest and len(kept) > 1:
                order = np.lexsort((-matches, roots[kept]))
                kept = kept[order]
                kept = kept[np.concatenate(([True], roots[kept][1:] != roots[kept][:-1]))]
            first += [nodes[x]] * len(kept)
            second += [nodes[y] for y in kept]
        return pa.table([pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["a", "b"])

    return placed.groupBy("key", "i", "j").applyInArrow(compared, "a binary, b binary")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, signature, packed text of the wanted (node, doc_id)."""
    wanted = wanted.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id")).distinct()
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.col(text_col).alias("_t"))

    def run(batches):
        import pyarrow as pa
        import zstandard

        from strataplan.llm.shingles import shingle_set

        forget()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(0)]
            sets = [shingle_set(t, WORDS) for t in texts]
            cols = [pa.array([_node(h) for h in sets], pa.binary()), pa.array([signature(h) for h in sets], pa.binary()), pa.array([squeeze(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "signature", "packed"])

    found = keyed.join(wanted.hint("shuffle_hash"), "_id", "left_semi").select(F.col("_t").cast("binary").alias("_t"))
    return found.mapInArrow(run, "node binary, signature binary, packed binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, at_least: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Links (u, v): pairs whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("packed").alias("_pa"))
    right = sets.select(F.col("node").alias("b"), F.col("packed").alias("_pb"))

    def run(batches):
        import numpy as np
        import zstandard

        from strataplan.llm.shingles import shingle_set

        unpack = zstandard.ZstdDecompressor().decompress
        last: list = [None, None]
        for batch in batches:
            kept = []
            for k, (a, x, y) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3))):
                if last[0] != (a := a.as_py()):
                    last = [a, shingle_set(unpack(x.as_py()), WORDS)]
                other = shingle_set(unpack(y.as_py()), WORDS)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                if at_least[1] * both >= at_least[0] * (len(last[1]) + len(other) - both):
                    kept.append(k)
            yield batch.take(_as_index(kept)).select(["a", "b"]).rename_columns(["u", "v"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "_pa", "_pb").mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key (hash of the text as it stands)."""
    rows = save(signed(docs, id_col, text_col, at_least), "signatures")
    n = rows.count()
    filled = rows.filter("node is not null")
    classes = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n"))

    banded = filled.select("node", F.posexplode("bands").alias("band", "key")).distinct()
    buckets = banded.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count(F.lit(1)).alias("_meets")).filter("_lo != _hi").drop("_lo", "_hi")
    met = save(banded.join(buckets, "key").select("key", "band", "node", "_meets"), "buckets", n)
    meets = met.groupBy("node").agg(F.sum("_meets").alias("_all"))
    hubs = met.join(meets, "node").groupBy("key").agg(F.max(F.struct("_all", "node"))["node"].alias("hub"))
    stars = met.join(hubs, "key").filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    candidates = classes.join(meets, "node", "left_semi")
    sets = save(sets_of(docs, candidates, id_col, text_col), "candidate-texts", n)
    bands = filled.join(meets, "node", "left_semi").select("node", "bands").dropDuplicates(["node"])
    described = save(bands.join(sets.select("node", "signature"), "node"), "described", n)
    roots = save(components(confirm(prune(stars, sets, at_least), sets, at_least), at_most=n), "roots", n, SHORT_ROWS)
    for likeliest in (True, False):
        members = met.select("key", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = save(across_components(members, described, likeliest, at_least, block), "cross-pairs", n)
        roots = save(merged_components(roots, confirm(pairs, sets, at_least), n), "roots", n, SHORT_ROWS)

    named = roots.join(classes, "node")
    of_root = named.groupBy("root").agg(F.min("doc_id").alias("_c"))
    linked = named.join(of_root, "root").select("node", "_c")
    copies = classes.filter("_n > 1").join(roots.select("node"), "node", "left_anti").select("node", F.col("doc_id").alias("_c"))
    labels = linked.unionByName(copies).withColumn("_in", F.lit(True))
    component = F.when(F.col("_in"), F.col("_c")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_key", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component; all columns as they were."""
    return without(docs, near_duplicates(docs, id_col, text_col, at_least).filter("not kept"), id_col, text_col)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")

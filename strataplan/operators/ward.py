"""Ward clustering of one group's feature vectors, cut where the silhouette is best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplan.runtime import ship


MATRIX_ROWS = 2000  # of the largest group whose distances are held as a matrix


def squares(x):
    """Squared distances of all pairs, a coordinate at a time: n x n, whatever the dimension."""
    import numpy as np

    d = np.zeros((len(x), len(x)))
    for column in x.T:
        d += (column[:, None] - column[None]) ** 2
    return d


def merges(x, d=None):
    """The n - 1 merges (i, j) of Ward's method, by Lance-Williams updates of squared distances; j joins i."""
    import numpy as np

    n = len(x)
    d = squares(x) if d is None else d.copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    out = []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        out.append((i, j))
        s = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / s
        new[[i, j]] = np.inf
        dead = ~np.isfinite(d[i]) & ~np.isfinite(d[j])
        new[dead] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return out


def chain_merges(x):
    """``merges`` without a matrix: chains of nearest neighbours between cluster means, then in order of height. Ward's
    distance never falls when others merge, so mutual neighbours merge in any order; only ties can come out otherwise."""
    import numpy as np

    mean, size, at = x.astype(float), np.ones(len(x)), np.arange(len(x))  # of clusters that are left, and their smallest member
    out, chain = [], []
    while len(at) > 1:
        size_of, live, gone = size.copy(), np.ones(len(at), bool), 0
        chain = [np.searchsorted(at, c) for c in chain]
        while gone * 2 < len(at) and gone < len(at) - 1:
            if not chain:
                chain = [int(live.argmax())]
            a = chain[-1]
            d = ((mean - mean[a]) ** 2).sum(1) * (2 * size_of[a] * size_of / (size_of[a] + size_of))
            d[~live] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                chain = chain[:-2]
                i, j = sorted((a, b))
                out.append((d[b], int(at[i]), int(at[j])))
                both = size_of[i] + size_of[j]
                mean[i] = (size_of[i] * mean[i] + size_of[j] * mean[j]) / both
                size_of[i], live[j], gone = both, False, gone + 1
            else:
                chain.append(b)
        chain = [at[c] for c in chain]
        mean, size, at = mean[live], size_of[live], at[live]
    return [(i, j) for _, i, j in sorted(out, key=lambda m: m[0])]


def cut(pairs, n: int, k: int):
    """Cluster numbers, by smallest member, after all but k - 1 merges."""
    import numpy as np

    root = np.arange(n)
    for i, j in pairs[: n - k]:
        root[root == root[j]] = root[i]
    return np.unique(root, return_inverse=True)[1]


def silhouette(d, labels) -> float:
    """Mean over points of (other - own) / max(other, own), of Euclidean distances; 0 for a cluster of one."""
    import numpy as np

    return silhouette_of(d @ np.eye(labels.max() + 1)[labels], labels)


def cluster_distances(x, labels, cells: int = 1 << 22):
    """[point, cluster]: sums of Euclidean distances, with a block of rows in memory at a time."""
    import numpy as np

    member, out = np.eye(labels.max() + 1)[labels], []
    for rows in np.array_split(x, max(1, len(x) ** 2 // cells)):
        d = np.zeros((len(rows), len(x)))
        for a, b in zip(rows.T, x.T):
            d += (a[:, None] - b[None]) ** 2
        out.append(np.sqrt(d, out=d) @ member)
    return np.vstack(out)


def silhouette_of(sums, labels) -> float:
    """``silhouette`` from each point's sums of distances to the clusters."""
    import numpy as np

    n = np.bincount(labels)
    own = sums[np.arange(len(labels)), labels] / np.maximum(n[labels] - 1, 1)
    mean = sums / n
    mean[np.arange(len(labels)), labels] = np.inf
    other = mean.min(1)
    return float(np.where(n[labels] > 1, (other - own) / np.maximum(np.maximum(other, own), 1e-300), 0).mean())


def best_cut(x, low: int, high: int):
    """(clusters, labels, silhouette): the first best number of clusters in [low, min(high, n - 1)]."""
    import numpy as np

    if len(x) > MATRIX_ROWS:
        # Cuts are nested: the finest one's sums of distances give all others.
        pairs, best = chain_merges(x), None
        finest = cut(pairs, len(x), min(high, len(x) - 1))
        sums, first = cluster_distances(x, finest), np.unique(finest, return_index=True)[1]
        for k in range(low, min(high, len(x) - 1) + 1):
            labels = cut(pairs, len(x), k)
            s = silhouette_of(sums @ np.eye(k)[labels[first]], labels)
            if best is None or s > best[2]:
                best = (k, labels, s)
        return best
    d = squares(x)
    pairs, best = merges(x, d), None
    np.sqrt(d, out=d)
    for k in range(low, min(high, len(x) - 1) + 1):
        labels = cut(pairs, len(x), k)
        s = silhouette(d, labels)
        if best is None or s > best[2]:
            best = (k, labels, s)
    return best


def ward(df: DataFrame, keys: list[str], id_col: str, vector: str, low: int = 6, high: int = 14, at_least: int = 18) -> DataFrame:
    """keys, id, cluster, clusters, silhouette. Groups of ``at_least`` rows or fewer are one cluster.

    One group meets in one task: a group is the objects of one kind on one drawing, 10**2 to 10**3. A larger one takes
    memory for its rows only, but time with their square.
    """
    ship(df.sparkSession)
    keyed = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))

    def solve(table):
        import numpy as np
        import pyarrow as pa

        ids = np.array(table["id"].to_pylist())
        order = np.argsort(ids, kind="stable")
        x = np.array(table["x"].to_pylist(), float)[order]
        n = len(ids)
        k, labels, s = best_cut(x, low, high) if n > at_least else (1, np.zeros(n, int), None)
        cols = [pa.array([table[c][0].as_py()] * n, pa.string()) for c in keys]
        return pa.table([*cols, pa.array(ids[order], pa.int64()), pa.array(labels, pa.int32()), pa.array([k] * n, pa.int32()), pa.array([s] * n, pa.float64())], [*keys, "id", "cluster", "clusters", "silhouette"])

    schema = ", ".join([*(f"{k} string" for k in keys), "id long", "cluster int", "clusters int", "silhouette double"])
    return keyed.groupBy(*keys).applyInArrow(solve, schema)

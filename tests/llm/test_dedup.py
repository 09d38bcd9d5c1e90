"""Exact, near, line and passage deduplication against brute force; sharding by its laws."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataplan.llm import exact_dedup, lines, near_dedup, passages, sharding

BOTH = pytest.mark.parametrize("which", ["odd", "documents"])


def pick(which, request):
    return request.getfixturevalue(which), request.getfixturevalue("odd_rows" if which == "odd" else "document_rows")


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@BOTH
@pytest.mark.parametrize("digest_all", [True, False])
def test_exact(which, digest_all, request):
    docs, rows = pick(which, request)
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = Counter()
    for t, ids in groups.items():
        for d in ids:
            want[d, least(ids), len(ids), d == least(ids)] += 1
    got = exact_dedup.refine(docs, digest_all=digest_all)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    if digest_all:
        assert Counter(r.text_sha256 for r in got.collect()) == Counter(hashlib.sha256(t.encode()).hexdigest() for t, ids in groups.items() for _ in ids)


def test_exact_drops(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 11").count() == 0 and kept.filter("doc_id = 5").count() == 1
    assert exact_dedup.refine(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_stage_digests_survivors_only(documents, monkeypatch):
    """The stage writes no digest of every text in its first scan."""
    written, put = {}, exact_dedup.save
    monkeypatch.setattr(exact_dedup, "save", lambda df, name, *more: written.setdefault(name, put(df, name, *more)))
    kept = exact_dedup.drop_copies(documents)
    assert "_full" not in written["exact-signatures"].columns
    again = written["exact-survivors"].filter("_full is not null").count()
    assert 0 < documents.count() - kept.count() < again < documents.count()


@BOTH
def test_sharding(which, request):
    docs, rows = pick(which, request)
    got = sharding.shard(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    groups, load = defaultdict(set), Counter()
    for r in got:
        load[r.shard] += r.size
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(t or "")
    for r in got:
        if len(text[r.doc_id]) == 1:
            groups[text[r.doc_id][0]].add(r.shard)
            assert r.size == len(text[r.doc_id][0].encode()) + 1
    assert all(len(s) == 1 for s in groups.values())
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    largest = max(sum(len(t.encode()) + 1 for _, t in [(d, t or "") for d, t in rows] if t == g) for g in {t or "" for _, t in rows})
    if which == "documents":
        assert max(load.values()) - min(load.values()) <= largest


def plain_schedule(sizes, shards):
    """Longest first, one group at a time, each to the least-loaded shard: load of each shard, groups by (size, shard)."""
    loads, placed = [0] * shards, Counter()
    for size in sorted(sizes, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        placed[size, s] += 1
    return loads, placed


@BOTH
@pytest.mark.parametrize("shards", [3, 8])
def test_sharding_schedules_every_group(which, shards, request):
    """Every group of the whole table, against one schedule in plain order."""
    docs, rows = pick(which, request)
    total = Counter()
    for _, t in rows:
        total[t or ""] += len((t or "").encode()) + 1
    loads, placed = plain_schedule(total.values(), shards)
    got = sharding.shard(docs, shards).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert [size[s] for s in range(shards)] == loads
    if which == "documents":
        text = {d: t or "" for d, t in rows}
        assert Counter((total[t], s) for t, s in {(text[r.doc_id], r.shard) for r in got}) == placed


def test_sharding_heavy_group(spark, none):
    docs = spark.createDataFrame([(i if i % 3 else None, "copy" if i % 3 else None) for i in range(600)], "doc_id long, text string")
    got = sharding.shard(docs).collect()
    assert len({r.shard for r in got if r.doc_id is not None}) == 1 and len(got) == 600
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none).count() == 0
    assert sharding.schedule([(5, 1), (4, 1), (3, 3)], 2) == [(5, [1, 1]), (4, [0, 1]), (3, [1, 3])]


def test_sharding_long_runs_are_dealt_as_one_by_one():
    """The closed form of a run against the heap, from level and uneven loads."""
    for loads in ([0] * 8, [7, 0, 93, 12, 12, 55, 1, 400], [1000, 0, 0, 3, 3, 3, 2, 1]):
        for size in (1, 7, 50):
            for count in (65, 100, 777):
                level, taken = list(loads), [0] * 8
                for _ in range(count):
                    s = level.index(min(level))
                    level[s] += size
                    taken[s] += 1
                assert sharding.dealt_run(loads, size, count) == taken


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@BOTH
def test_near(which, request):
    docs, rows = pick(which, request)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    want = Counter((d, len(s), least(members[find(i)]), d == least(members[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == want


def test_near_chain(spark, none):
    """A chain whose ends are unlike: only links through other members join it."""
    words = [f"w{i}" for i in range(300)]
    docs = [(k, " ".join(words[6 * k :] + [f"v{i}" for i in range(6 * k)])) for k in range(12)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_family(spark):
    """Copies that are near one text but not each other, far ones among them, and a bucket of several blocks."""
    import random

    rng = random.Random(6)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            words[rng.randrange(140)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = [shingles(t) for _, t in rows], list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))


def test_pipeline_near_stage_links_from_80(spark, documents, document_rows):
    """The stage against brute force at 80/100, with pairs that lie under op8's threshold."""
    import random

    import corpus_pipeline

    rng = random.Random(11)
    rows, n = [(d, t) for d, t in document_rows if t], max(d for d, _ in document_rows) + 1
    for k in range(40):
        words = [f"p{k}w{i}" for i in range(rng.randrange(150, 300))]
        rows.append((n + 2 * k, " ".join(words)))
        for at in rng.sample(range(len(words) // 5 - 1), round(len(words) * rng.uniform(0.012, 0.03))):
            words[at * 5 + 2] = f"x{rng.randrange(10**6)}"
        rows.append((n + 2 * k + 1, " ".join(words)))
    sets, root, between = [shingles(t) for _, t in rows], list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (union := len(a) + len(sets[j]) - both):
                between += 100 * both < 85 * union
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    first = {}
    for i, (d, t) in enumerate(rows):
        first[root[i]] = min(first.get(root[i], d), d)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert between >= 5
    assert Counter(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == Counter(d for i, (d, t) in enumerate(rows) if d == first[root[i]] or not sets[i])


def test_near_crowded_bucket(spark):
    """Texts that share a frame meet in crowded buckets: dealt again by further minima, they give the same components."""
    rng = __import__("random").Random(3)
    frame = " ".join(f"frame{i}" for i in range(60))
    rows = []
    for i in range(60):
        own = [f"own{rng.randrange(10**9)}" for _ in range(40)]
        rows.append((2 * i, frame + " " + " ".join(own)))
        own[rng.randrange(40)] = "changed"
        rows.append((2 * i + 1, frame + " " + " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    dealt = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, block=4).collect()}
    sets = {d: shingles(t) for d, t in rows}
    want = {d: d - d % 2 if 100 * len(sets[d] & sets[d ^ 1]) >= 85 * len(sets[d] | sets[d ^ 1]) else d for d in sets}
    assert plain == dealt == want and any(d != c for d, c in want.items())


def test_bands_of_a_threshold():
    assert near_dedup.bands_at((85, 100)) == 24 and near_dedup.bands_at((80, 100)) == 35
    assert all((1 - (n / d) ** near_dedup.ROWS) ** near_dedup.bands_at((n, d)) < near_dedup.NO_BAND for n, d in ((85, 100), (80, 100)))


def test_posterior_thresholds():
    at = near_dedup.thresholds()
    assert [n for n, _ in at] == list(range(64, 513, 64)) and all(m < 0.85 * n for n, m in at)


@BOTH
def test_lines(which, request):
    docs, rows = pick(which, request)
    seen, later = set(), defaultdict(set)
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)) if which == "odd" else sorted(rows)
    for d, t in order:
        parts = lines.lines_of(t)
        for i in range(len(parts) - 2):
            w = tuple(parts[i : i + 3])
            if w in seen:
                later[d, t].update(range(i, i + 3))
            seen.add(w)
    want = Counter()
    for d, t in rows:
        parts = lines.lines_of(t)
        want[d, len(parts), len(later[d, t]), "\n".join(x for i, x in enumerate(parts) if i not in later[d, t])] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs).collect()) == want


def test_lines_hash_windows_around_shared_fingerprints_only(documents, document_rows):
    """Fewer fingerprints than windows, each place once, and no window hashed that shares no selected line."""
    every = sum(max(0, len(lines.lines_of(t)) - 2) for _, t in document_rows)
    prints = lines.fingerprints(documents).collect()
    assert len(prints) == len({(r._doc, r._text, r._at) for r in prints}) < every
    found = lines.windows(documents, lines.shared_places(lines.fingerprints(documents)))
    at = Counter(r._print for r in prints)
    shared = {(r._doc, r._text, r._at) for r in prints if at[r._print] > 1}
    keys = {r._doc: r._text for r in prints}
    want = {(d, i) for d, t in document_rows for i, x in enumerate(lines.hashed(t, 3)[2]) if (d, keys[d], x) in shared}
    assert {(r._doc, r._start) for r in found.collect()} == want and 0 < len(want) < every


@BOTH
def test_lines_long_runs(which, request):
    """Later runs of three lines, and of one or two lines with 50 bytes or more, against brute force."""
    docs, rows = pick(which, request)
    seen, later = set(), defaultdict(set)
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = lines.lines_of(t)
        for i in range(len(parts)):
            for size in (1, 2, 3):
                w = tuple(parts[i : i + size])
                if len(w) == size and (size == 3 or len("\n".join(w).encode()) >= lines.LONG):
                    if w in seen:
                        later[d, t].update(range(i, i + size))
                    seen.add(w)
    want = Counter()
    for d, t in rows:
        parts = lines.lines_of(t)
        want[d, len(parts), len(later[d, t]), "\n".join(x for i, x in enumerate(parts) if i not in later[d, t])] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs, long_bytes=lines.LONG).collect()) == want


def test_lines_query_deletes_one_line(spark, small, tmp_path):
    """One long line that stands alone in a text goes where it is later; the query equals its SQL."""
    import duckdb

    text = "This work is licensed under the GNU General Public License, version 3."
    spark.createDataFrame([(1, f"a\n{text}\nb"), (2, text), (3, f"c\n{text}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in lines.op9_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert Counter(map(tuple, lines.op9_lines(spark, small).collect())) == Counter(con.sql(lines.OP9_SQL).fetchall())


def passages_by_force(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, d), d)
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < d:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@BOTH
def test_passages(which, request):
    docs, rows = pick(which, request)
    assert Counter(map(tuple, passages.dedup_passages(docs).collect())) == passages_by_force(rows)


def test_passages_hot(spark, none, monkeypatch):
    """A passage in many surroundings, dealt window by window."""
    monkeypatch.setattr(passages, "HOT", 5)
    core = "a sentence that stands in every one of the documents, word for word, at any place"
    rows = [(i, f"{i * 7919 % 1009} some text before {core} and {i * 31 % 17} after it {'pad ' * (i % 5)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, passages.dedup_passages(docs).collect())) == passages_by_force(rows)
    monkeypatch.setattr(passages, "HOT_LEAST", 5)
    assert passages.hot_hashes(docs.withColumn("_key", docs["doc_id"]), 60)
    assert Counter(map(tuple, passages.dedup_passages(docs).collect())) == passages_by_force(rows)
    assert passages.dedup_passages(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_passages_in_groups(spark, monkeypatch):
    """Buckets and cells that meet in a task are settled one by one, and pieces do not grow with the square of the text."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    rows = [(d, " ".join(rng.choice(shared) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60)))) for d in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, size in (("BUCKET_BYTES", 4096), ("PART_BYTES", 4096), ("GROUP_BYTES", 8192), ("FLUSH_BYTES", 4096), ("FLUSH_MARKS", 20), ("CELL_BYTES", 2048)):
        monkeypatch.setattr(passages, name, size)
    assert passages.group_size(sum(len(t) for _, t in rows)) > 2
    assert Counter(map(tuple, passages.dedup_passages(docs).collect())) == passages_by_force(rows)
    monkeypatch.undo()

    def pieces(total):  # of map tasks' flushes for groups, and of groups for parts
        each = passages.group_size(total)
        groups = total / (passages.BUCKET_BYTES * each)
        return groups * (total / passages.FLUSH_BYTES + total / (passages.PART_BYTES * each))

    assert pieces(10 << 30) < 3 * (10 / 0.9) * pieces(int(0.9 * (1 << 30)))


def test_sides_tell_many_contents_apart():
    """Of 2000 contents of one hash whose sides all differ hardly one looks like another."""
    from strataplan.llm.shingles import RangeHash

    rng, found = np.random.default_rng(2), []
    middle = min((b"%016d" % k for k in range(500)), key=lambda b: RangeHash(np.frombuffer(b, np.uint8)).of(np.array([0]), np.array([16]))[0])
    for _ in range(2000):
        text = bytes(rng.integers(97, 123, 34, dtype=np.uint8)) + middle + bytes(rng.integers(97, 123, 34, dtype=np.uint8))
        _, _, m, s, left, right = passages.stretches(np.frombuffer(text, np.uint8))
        found += list(zip(m, s, left, right))
    most = Counter(x[0] for x in found).most_common(1)[0][0]
    m, s, left, right = (np.array(x) for x in zip(*(x for x in found if x[0] == most)))
    alike = passages._told_apart(m, left, s) | passages._told_apart(m, right, s)
    assert len(m) > 200 and alike.sum() < len(m) / 10


def test_run_index_small():
    import numpy as np

    texts = [b"abracadabra", b"cadabracada", b"zzzzabracad"]
    index = passages.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.array([11, 11, 11]), np.array([1, 2, 3]), span=5)
    text, place = index.covered(np.array([1, 2, 3]))
    want = {(k, p) for k, t in enumerate(texts) for p in range(7) if any(t[p : p + 5] in s for s in texts[:k])}
    assert set(zip(text.tolist(), place.tolist())) == want

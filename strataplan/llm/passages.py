"""Suffix-array deduplication with a run-length index: repeated passages of SPAN bytes are removed.

A byte goes if a SPAN-byte string that covers it also starts in a document with a smaller doc_id; strings are judged
on the input.

1. Sampling. The SPAN-byte windows of a text fall into stretches whose windows hold the same smallest K-byte hash. Equal
   windows lie in stretches with equal smallest hash, so stretches meet in buckets by that hash. Stretches with equal
   content are settled there (all but those of the smallest doc_id go); within a map task that is done before the
   shuffle. A hash with one content needs nothing more. A hash that very many texts share (a licence line, say) would
   bring all its surroundings to one task; such hashes are found on a sample, which decides nothing else, and their
   windows are dealt singly, each by its own bytes. Buckets travel in groups, and what a group says of a part of the
   texts leaves as one piece: the more text, the more buckets a group has (``group_size``).
2. Index. Where one hash has several contents that also agree in the REACH bytes left or right of the hashed ones (any
   common window holds one of the two), the bytes of the first occurrences are fetched and meet in cells. A cell
   sorts their suffixes, keeps the run-compressed Burrows-Wheeler transform (runs also end where the SPAN-byte context
   changes) with each run's LF base and the sample taken at run ends, among them the smallest doc_id of the context, and
   drops the suffix array. Every text is then streamed through it from its end, one LF step a byte, all texts of the
   cell at once; once SPAN bytes are matched, the context's sample says whether a smaller doc_id has them.
   A hash with more than HOT contents is dealt by single windows instead, so no cell grows with it.
3. Marks are joined to the texts, which are cut.

Identity of stretches and single windows rests on 96 bits of two independent hashes; cells compare bytes. One task of
step 1 holds, for a passage in n different surroundings, n records of about 20 bytes, where it stands in fewer than
HOT_SHARE of the texts; else one record for each of its windows and FLUSH_BYTES of text.

Defined results: null text counts as empty; a row with a null doc_id keeps all its bytes and removes none elsewhere;
rows that share a doc_id do not remove from each other; texts under SPAN bytes stay; an empty table gives an empty
table; columns other than the two named are ignored.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplan.runtime import release, save, ship, whole

SPAN = 50
K = 16
REACH = (SPAN - K) // 2  # of the bytes around the hashed ones, a window has so many on one side at least
BUCKET_BYTES = 8 << 20  # text per bucket of sampled stretches
PART_BYTES = 4 << 20  # text per part that is cut at once, and so many times more as a group has buckets
GROUP_BYTES = 256 << 20  # of text times the square of the buckets in a group, so that pieces do not grow with the square of the text
GROUP_MOST = 8
FLUSH_BYTES = 8 << 20  # text whose stretches leave a map task together
FLUSH_MARKS = 1 << 20  # marks that do
CELL_BYTES = 1 << 20  # bytes per cell that is indexed
HOT = 20_000  # contents of one hash beyond which windows are dealt singly
HOT_SAMPLE = 4_000  # texts, of each at most HOT_BYTES, that are looked at for hashes which HOT_SHARE of them have
HOT_BYTES = 1 << 16
HOT_SHARE = 0.01
HOT_LEAST = 40  # texts of the sample

_POSITION_BITS, _HASH_BITS = 16, 48
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def stretches(data):
    """``stretches_of`` a text, a number of windows at a time whose places fit the bits they have."""
    import numpy as np

    step = (1 << _POSITION_BITS) - SPAN
    parts = []
    for lo in range(0, max(1, len(data) - SPAN + 1), step):
        starts, ends, *rest = stretches_of(data[lo : lo + step + SPAN - 1])
        parts.append((starts + lo, ends + lo, *rest))
    return [np.concatenate(x) for x in zip(*parts)]


def stretches_of(data):
    """start, end, smallest hash, content hash, and two bytes each for the bytes left and right of the hashed ones (0
    where the stretch does not reach that far), for each stretch of windows with one smallest K-byte hash. A frequent hash
    has the more contents the more text there is, so one byte would tell ever fewer of them apart."""
    import numpy as np

    from strataplan.llm.shingles import RangeHash, mix

    n = len(data)
    if n < SPAN:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint16), none.astype(np.uint16)
    ranges = RangeHash(data)
    at = np.arange(n - K + 1)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    # Hash above, place below: the smallest says where it stands; equal hashes make stretches of their own.
    low, reach, width = (ranges.of(at, at + K) & ~mask) | (at.astype(np.uint64) & mask), 1, SPAN - K + 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    ends = np.append(starts[1:], len(low)) + SPAN - 1
    place = starts + ((low[starts] & mask).astype(np.int64) - starts & int(mask))
    sides = []
    for lo, hi in ((place - REACH, place), (place + K, place + K + REACH)):
        there = (lo >= starts) & (hi <= ends)
        code = ranges.of(np.where(there, lo, 0), np.where(there, hi, 0)) % np.uint64(65535) + np.uint64(1)
        sides.append(np.where(there, code, 0).astype(np.uint16))
    content = mix(ranges.of(starts, ends) + np.uint64(0x5851F42D4C957F2D))
    return starts, ends, low[starts] >> np.uint64(64 - _HASH_BITS), content >> np.uint64(64 - _HASH_BITS), *sides


def _pack(*arrays) -> bytes:
    """Columns of equal length as one binary: a row count, then the columns."""
    import numpy as np

    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blobs, dtypes):
    """Columns of many such binaries, concatenated."""
    import numpy as np

    parts = [[] for _ in dtypes]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for part, t in zip(parts, dtypes):
            t = np.dtype(t)
            part.append(np.frombuffer(blob, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, dtypes)]


_MARK = ("<i8", "<i8", "<i4", "<i4")  # doc_id, row key, start, end
_WANT = ("<i8", "<i8", "<i4", "<i4", "<u8", "<i1")  # the same, smallest hash, hot


@functools.cache
def _zstd():
    """What compresses and what decompresses, made once in a worker."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(*arrays) -> bytes:
    return _zstd()[0].compress(b"".join(a.tobytes() for a in arrays))


def _by_document(doc, key, start):
    """Distinct (doc, key), rows of each, and the rows' order by them and start."""
    import numpy as np

    order = np.lexsort((start, key, doc))
    d, k = doc[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
    return d[new], k[new], np.diff(np.append(new, len(d))), order


def _marks(doc, key, start, end) -> bytes:
    """Intervals in document order, as steps, compressed."""
    import numpy as np

    d, k, counts, order = _by_document(doc, key, start)
    s, e = start[order].astype("<i4"), end[order].astype("<i4")
    head = np.array([len(d), len(s)], "<i8").tobytes()
    return head + _squeeze(np.diff(d, prepend=0).astype("<i8"), k.astype("<i4"), counts.astype("<i4"), np.diff(s, prepend=0).astype("<i4"), (e - s).astype("<i4"))


def _read_marks(blob: bytes):
    import numpy as np

    docs, n = np.frombuffer(blob, "<i8", 2).tolist()
    raw = _unzip(blob[16:])
    d = np.cumsum(np.frombuffer(raw, "<i8", docs))
    k = np.frombuffer(raw, "<i4", docs, 8 * docs).astype(np.int64)
    counts = np.frombuffer(raw, "<i4", docs, 12 * docs)
    s = np.cumsum(np.frombuffer(raw, "<i4", n, 16 * docs), dtype=np.int32)
    return np.repeat(d, counts), np.repeat(k, counts), s, s + np.frombuffer(raw, "<i4", n, 16 * docs + 4 * n)


def _bytes_of(values, size: int):
    import numpy as np

    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].copy()


def _back(raw, size: int):
    import numpy as np

    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _records(m, s, left, right, doc, key, start, size) -> bytes:
    """Records in document order: hashes as they are, the rest as compressed steps."""
    import numpy as np

    d, k, counts, order = _by_document(doc, key, start)
    steps = _squeeze(np.diff(d, prepend=0).astype("<i8"), counts.astype("<i4"), np.diff(start[order], prepend=0).astype("<i4"), size[order].astype("<u1"))
    head = np.array([len(d), len(order), len(steps)], "<i8").tobytes()
    return head + k.astype("<i4").tobytes() + _bytes_of(m[order], 6).tobytes() + _bytes_of(s[order], 6).tobytes() + left[order].astype("<u2").tobytes() + right[order].astype("<u2").tobytes() + steps


def _read_records(blob):
    """m, s, left, right, doc, key, start, size."""
    import numpy as np

    docs, n, _ = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    k = np.frombuffer(blob, "<i4", docs, at).astype(np.int64)
    at += 4 * docs
    m, s = _back(blob[at : at + 6 * n], 6), _back(blob[at + 6 * n : at + 12 * n], 6)
    at += 12 * n
    left, right = np.frombuffer(blob, "<u2", n, at), np.frombuffer(blob, "<u2", n, at + 2 * n)
    raw = _unzip(blob[at + 4 * n :])
    d = np.cumsum(np.frombuffer(raw, "<i8", docs))
    counts = np.frombuffer(raw, "<i4", docs, 8 * docs)
    start = np.cumsum(np.frombuffer(raw, "<i4", n, 12 * docs), dtype=np.int32)
    return m, s, left, right, np.repeat(d, counts), np.repeat(k, counts), start, np.frombuffer(raw, "<u1", n, 12 * docs + 4 * n)


def _told_apart(m, side, content):
    """Rows whose (m, side) is shared by several contents; side 0 is shared with nothing. Rows are sorted by m."""
    import numpy as np

    order = np.lexsort((content, side, m))
    mm, ss, cc = m[order], side[order], content[order]
    new = np.concatenate(([True], (mm[1:] != mm[:-1]) | (ss[1:] != ss[:-1])))
    edges = np.flatnonzero(new)
    several = np.maximum.reduceat(cc, edges) != np.minimum.reduceat(cc, edges)
    out = np.zeros(len(m), bool)
    out[order] = np.repeat(several, np.diff(np.append(edges, len(m)))) & (ss > 0)
    return out


def _settled(m, s, doc):
    """Order by content, then document; and which of those rows hold their content's smallest doc_id."""
    import numpy as np

    order = np.lexsort((doc, s, m))
    m, s, doc = m[order], s[order], doc[order]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (s[1:] != s[:-1]))) if len(m) else np.empty(0, bool)
    first = np.flatnonzero(new)
    lowest = np.repeat(doc[first], np.diff(np.append(first, len(m)))) if len(m) else doc
    return order, new, doc == lowest


def _by(values, *arrays):
    """(value, rows of the arrays with it) for each distinct value."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    values = values[order]
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else [0]
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(values[lo]), [a[order[lo:hi]] for a in arrays]


def _marks_by_part(marks, parts: int):
    """(part, its intervals) of lists of intervals."""
    import numpy as np

    if marks:
        cols = [np.concatenate(x) for x in zip(*marks)]
        for part, cols in _by(cols[1] % parts, *cols):
            yield part, _marks(*cols)


def hot_hashes(docs: DataFrame, n_rows: int) -> list[int]:
    """Smallest hashes that HOT_SHARE of the texts have, found on a sample: they steer records, and no result hangs on them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = [np.unique(stretches(np.frombuffer(t.as_py(), np.uint8))[2]) for t in b.column(0) if t.as_buffer().size >= SPAN]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.uint64)).cast(pa.int64())], ["m"])

    step = max(1, n_rows // HOT_SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "_key", F.lit("hot")), F.lit(step)) == 0).select(F.substring(F.col("text").cast("binary"), 1, HOT_BYTES).alias("t"))
    least = max(HOT_LEAST, int(HOT_SHARE * n_rows / step))
    counts = some.mapInArrow(run, "m long").groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return sorted(r[0] for r in counts.select("m").collect())  # at most the sample's stretches / HOT_LEAST


def single_windows(data, starts, ends):
    """m, content hash, start of every window of the stretches, as stretches of their own."""
    import numpy as np

    from strataplan.llm.shingles import RangeHash, mix

    n = ends - starts - SPAN + 1
    at = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = RangeHash(data).of(at, at + SPAN)
    return mix(h + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - _HASH_BITS), mix(h + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - _HASH_BITS), at


def sampled(docs: DataFrame, groups: int, parts: int, hot: list[int] = ()) -> DataFrame:
    """group, part, data: records of stretches by group of buckets, and marks that a map task could settle alone. Windows of
    stretches whose smallest hash is ``hot`` are records of their own."""

    def flush(held, marks):
        import numpy as np

        m, s, left, right, doc, key, start, size = (np.concatenate(x) for x in zip(*held))
        order, _, first = _settled(m, s, doc)
        gone, kept = order[~first], order[first]
        marks.append((doc[gone], key[gone], start[gone].astype("<i4"), (start[gone] + size[gone]).astype("<i4")))
        m, s, left, right, doc, key, start, size = (x[kept] for x in (m, s, left, right, doc, key, start, size))
        for group, cols in _by((m % np.uint64(groups)).astype(np.int64), m, s, left, right, doc, key, start, size):
            yield group, -1, _records(*cols)

    def settled(marks):
        for part, blob in _marks_by_part(marks, parts):
            yield part % groups, part, blob

    def table(rows):
        import pyarrow as pa

        b, p, d = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(d, pa.binary())], ["group", "part", "data"])

    def run(batches):
        import numpy as np

        held, marks, size, crowded = [], [], 0, np.array(hot, np.uint64)
        for b in batches:
            for doc, key, text in zip(b.column(0), b.column(1), b.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer().size else np.empty(0, np.uint8)
                starts, ends, m, s, left, right = stretches(data)
                if len(starts):
                    apart = np.isin(m, crowded) if len(crowded) else np.zeros(len(m), bool)
                    if apart.any():
                        wm, ws, at = single_windows(data, starts[apart], ends[apart])
                        cold, none = ~apart, np.zeros(len(at), np.uint16)
                        starts, ends = np.concatenate([starts[cold], at]), np.concatenate([ends[cold], at + SPAN])
                        m, s, left, right = (np.concatenate([x[cold], y]) for x, y in ((m, wm), (s, ws), (left, none), (right, none)))
                    held.append((m, s, left, right, np.full(len(starts), doc.as_py()), np.full(len(starts), key.as_py()), starts, ends - starts))
                    size += len(data)
                if size >= FLUSH_BYTES:
                    yield table(list(flush(held, marks)))
                    held, size = [], 0
                    if sum(len(x[0]) for x in marks) >= FLUSH_MARKS:
                        yield table(list(settled(marks)))
                        marks = []
        if held:
            yield table(list(flush(held, marks)))
        if any(len(x[0]) for x in marks):
            yield table(list(settled(marks)))

    known = docs.filter("doc_id is not null")
    return known.select("doc_id", "_key", F.col("text").cast("binary")).mapInArrow(run, "group int, part int, data binary")


def resolve(records: DataFrame, groups: int, each: int, parts: int) -> DataFrame:
    """part, kind (0 marks, 1 contents wanted), n, data. A group's ``each`` buckets are told apart and settled one by one, and
    what they say of a part leaves together."""

    def group(table):
        import numpy as np
        import pyarrow as pa

        out, blobs, marks, wants = [], [], [], []
        for part, data in zip(table["part"].to_pylist(), table["data"]):
            if part >= 0:
                raw = data.as_py()
                out.append((part, 0, int.from_bytes(raw[8:16], "little"), raw))
            else:
                blobs.append(memoryview(data.as_buffer()))
        of = [[] for _ in range(each)]
        while blobs:
            read = _read_records(blobs.pop())
            for bucket, cols in _by((read[0] // np.uint64(groups) % np.uint64(each)).astype(np.int64), *read):
                of[bucket].append(cols)
        for k in range(each):
            if of[k]:
                settle([np.concatenate(x) for x in zip(*of[k])], marks, wants)
                of[k] = []
        for part, blob in _marks_by_part(marks, parts):
            out.append((part, 0, int.from_bytes(blob[8:16], "little"), blob))
        if wants:
            cols = [np.concatenate(x) for x in zip(*wants)]
            for part, cols in _by(cols[1] % parts, *cols):
                out.append((part, 1, len(cols[0]), _pack(*cols)))
        part, kind, n, data = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["part", "kind", "n", "data"])

    def settle(records, marks, wants):
        import numpy as np

        m, s, left, right, doc, key, start, size = records
        order, new, first = _settled(m, s, doc)
        m, left, right, doc, key, start = (x[order] for x in (m, left, right, doc, key, start))
        end = start + size[order]
        marks.append((doc[~first], key[~first], start[~first], end[~first]))
        # Contents of each hash, and whether they begin in more than one document.
        edges = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        contents = np.add.reduceat(new.astype(np.int64), edges)
        lows = np.where(first, doc, np.iinfo(np.int64).min)
        differ = np.maximum.reduceat(lows, edges) > np.minimum.reduceat(doc, edges)
        rows = np.diff(np.append(edges, len(m)))
        content = np.cumsum(new)
        want = np.flatnonzero(np.repeat((contents > 1) & differ, rows) & first)
        want = want[_told_apart(m[want], left[want], content[want]) | _told_apart(m[want], right[want], content[want])] if len(want) else want
        hot = np.repeat(contents > HOT, rows)
        wants.append((doc[want], key[want], start[want], end[want].astype("<i4"), m[want].astype("<u8"), hot[want].astype("<i1")))

    return records.groupBy("group").applyInArrow(group, "part int, kind int, n long, data binary")


def packed_texts(docs: DataFrame, parts: int) -> DataFrame:
    """Texts compressed for the shuffle, by part."""

    def run(batches):
        import pyarrow as pa

        squeeze = _zstd()[0].compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([squeeze(t.as_py()) for t in b.column(3)], pa.binary())], ["part", "doc_id", "_key", "packed"])

    part = F.pmod("_key", F.lit(parts)).cast("int").alias("part")
    return docs.select(part, "doc_id", "_key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, doc_id long, _key long, packed binary")


def _texts(table):
    return {(d, k): _unzip(p.as_py()) for d, k, p in zip(table["doc_id"].to_pylist(), table["_key"].to_pylist(), table["packed"])}


def fetched(docs: DataFrame, wanted: DataFrame, cells: int, parts: int) -> DataFrame:
    """cell, data: wanted contents with their place, by hash, or window by window where the hash is hot."""

    def fetch(left, right):
        import numpy as np
        import pyarrow as pa

        from strataplan.llm.shingles import RangeHash, mix

        out = []
        if right.num_rows and left.num_rows:
            texts = _texts(left)
            doc, key, start, end, m, hot = _unpack((x.as_py() for x in right["data"]), _WANT)
            cell = (mix(m) % np.uint64(cells)).astype(np.int64)
            if hot.any():
                rows = np.flatnonzero(hot)
                windows = (end - start - SPAN + 1)[rows]
                which = np.repeat(rows, windows)
                at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                single = np.empty(len(which), np.int64)
                for d, k in set(zip(doc[rows].tolist(), key[rows].tolist())):
                    mine = (doc[which] == d) & (key[which] == k)
                    a = at[mine]
                    single[mine] = (RangeHash(np.frombuffer(texts[d, k], np.uint8)).of(a, a + SPAN) % np.uint64(cells)).astype(np.int64)
                cold = hot == 0
                doc, key = np.concatenate([doc[cold], doc[which]]), np.concatenate([key[cold], key[which]])
                start, end = np.concatenate([start[cold], at]).astype("<i4"), np.concatenate([end[cold], at + SPAN]).astype("<i4")
                cell = np.concatenate([cell[cold], single])
            for c, cols in _by(cell, doc, key, start, end):
                body = b"".join(texts[d, k][i:j] for d, k, i, j in zip(*(x.tolist() for x in cols)))
                out.append((c, _pack(*cols), body))
        cell, data, body = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(cell, pa.int32()), pa.array(data, pa.binary()), pa.array(body, pa.binary())], ["cell", "data", "body"])

    asked = wanted.filter("kind = 1").select("part", "data")
    return packed_texts(docs, parts).groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(fetch, "cell int, data binary, body binary")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of many short texts, with samples at run ends.

    Texts stand in document order, each closed by an end mark of its own, so sorting ends within the longest text.
    """

    def __init__(self, body, sizes, doc, span: int = SPAN):
        import numpy as np

        count = len(sizes)
        ends = np.cumsum(sizes + 1) - 1  # places of end marks
        symbols = np.zeros(len(body) + count, np.int64)
        plain = np.ones(len(symbols), bool)
        plain[ends] = False
        symbols[plain] = body.astype(np.int64) + 1
        left = np.repeat(ends, sizes + 1) - np.arange(len(symbols))  # bytes from here to the text's end mark
        # Contexts: rows of the sorted suffixes whose first `span` bytes agree.
        order, rank, context = self._sort(symbols, left, int(sizes.max(initial=0)) + 1, span)
        owner = np.repeat(np.arange(count), sizes + 1)

        before = symbols[order - 1]  # of the first text's first place, the last text's end mark
        head = np.concatenate(([True], (before[1:] != before[:-1]) | (context[1:] != context[:-1]) | (before[1:] == 0)))
        self.starts = np.flatnonzero(head)
        self.heads = before[self.starts]
        lengths = np.diff(np.append(self.starts, len(order)))
        # LF base of a run: texts' symbols below its own, and the same symbol in earlier runs.
        by_symbol = np.argsort(self.heads, kind="stable")
        base = np.empty(len(self.starts), np.int64)
        base[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.shift = base - self.starts
        self.run_of = np.repeat(np.arange(len(self.starts), dtype=np.int32), lengths)  # rank over the marks of run heads
        # Samples at run ends: the context, and the smallest document that has it.
        low = np.minimum.reduceat(doc[owner[order]], self.starts)
        self.context = context[self.starts]
        first = np.flatnonzero(np.concatenate(([True], self.context[1:] != self.context[:-1])))
        self.low = np.repeat(np.minimum.reduceat(low, first), np.diff(np.append(first, len(low))))
        self.first_rows = rank[ends]  # where streaming a text begins
        self.sizes, self.span = sizes, span

    @staticmethod
    def _sort(symbols, left, longest: int, span: int):
        """Suffix order by doubling from seven symbols, its inverse, and the number of each row's context; an end mark is
        unlike any other, in text order, so a suffix shorter than the span is a context by itself.

        A group of suffixes that still agree is numbered by its first row, and only such groups are sorted again.
        """
        import numpy as np

        n, width = len(symbols), min(7, span)
        key = np.zeros(n, np.int64)
        for i in range(width):
            key <<= 9
            key[: n - i] |= symbols[i:]
        near = np.flatnonzero(left < width - 1)  # what follows an end mark does not count
        key[near] &= -(np.int64(1) << 9 * (width - 1 - left[near]))
        order = np.argsort(key, kind="stable")
        key = key[order]
        # A window that reaches its end mark is unique.
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (left[order[1:]] < width)))
        rows = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, rows, 0))
        context = np.cumsum(new) - 1 if width == span else None
        while width < longest and (context is None or not new.all()):
            step = min(width, span - width) if width < span else width
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            at = order[tied]
            key = (rank[at] << 32) | rank[at + step]
            some = np.argsort(key)
            order[tied], key = at[some], key[some]
            new[tied] = np.concatenate(([True], key[1:] != key[:-1])) if len(tied) else True
            rank[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0))
            width += step
            if width == span:
                context = np.cumsum(new) - 1
        return order, rank, np.cumsum(new) - 1 if context is None else context

    def covered(self, doc):
        """For each text, which of its places start a span that a smaller document has: (text, place)."""
        import numpy as np

        row, text = self.first_rows.copy(), np.arange(len(self.sizes))
        place = self.sizes.copy()
        out = []
        while len(text):
            run = self.run_of[row]
            on = (self.sizes[text] - place) >= self.span
            hit = on & (self.low[run] < doc[text])
            out.append((text[hit], place[hit]))
            go = place > 0
            row, text, place, run = row[go], text[go], place[go] - 1, run[go]
            row = row + self.shift[run]  # LF: the suffix one byte longer
        return np.concatenate([x[0] for x in out]) if out else np.empty(0, np.int64), np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)


def indexed(contents: DataFrame, each: int, parts: int) -> DataFrame:
    """Marks from the run-length index of every cell: part, data. ``each`` cells meet in a task, are indexed one by one, and
    what they say of a part leaves together."""

    def cells(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        marks = [cell(table.filter(pc.equal(table["cell"], c))) for c in table["cell"].unique()]
        out = list(_marks_by_part(marks, parts))
        part, data = zip(*out) if out else ((), ())
        return pa.table([pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    def cell(table):
        import numpy as np

        doc, key, start, end = _unpack((x.as_py() for x in table["data"]), _MARK)
        body = np.frombuffer(b"".join(x.as_py() for x in table["body"]), np.uint8)
        sizes = (end - start).astype(np.int64)
        offset = np.cumsum(sizes) - sizes
        order = np.argsort(doc, kind="stable")
        moved = np.repeat(offset[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(body))
        doc, key, start, sizes = doc[order], key[order], start[order], sizes[order]
        text, place = RunIndex(body[moved], sizes, doc).covered(doc)
        # Places that follow each other in a text are one interval.
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1))) if len(text) else np.empty(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text))[: len(first)] - 1  # none, where no text of the cell is covered
        text, lo, hi = text[first], place[first], place[last] + SPAN
        return doc[text], key[text], start[text] + lo, start[text] + hi

    return contents.groupBy(F.floor(F.col("cell") / each).alias("cells")).applyInArrow(cells, "part int, data binary")


def cut_texts(docs: DataFrame, marks: DataFrame, parts: int, with_text: bool = False) -> DataFrame:
    """Texts without their marked bytes, with counts; ``kept`` holds the bytes if asked for."""
    schema = RESULT + (", kept binary" if with_text else "")

    def cut(left, right):
        import numpy as np
        import pyarrow as pa

        marks = [_read_marks(x.as_py()) for x in right["data"]]
        doc, key, start, end = (np.concatenate(x) for x in zip(*marks)) if marks else (np.empty(0, np.int64),) * 4
        order = np.lexsort((start, key, doc))
        doc, key, start, end = doc[order], key[order], start[order], end[order]
        edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.empty(0, np.int64)
        at = {(int(doc[lo]), int(key[lo])): (lo, hi) for lo, hi in zip(edges, np.append(edges[1:], len(doc)))}
        rows: list[list] = [[], [], [], [], [], []]
        for d, k, p in zip(left["doc_id"].to_pylist(), left["_key"].to_pylist(), left["packed"]):
            text, removed, spans = _unzip(p.as_py()), 0, 0
            n, kept = len(text), text
            if (d, k) in at:
                lo, hi = at[d, k]
                s, e = start[lo:hi], np.maximum.accumulate(end[lo:hi])
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                s, e = s[new], e[np.append(new[1:] - 1, hi - lo - 1)]
                removed, spans = int((e - s).sum()), len(s)
                kept = b"".join(text[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), n]))
            for col, v in zip(rows, (d, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                col.append(v)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        keep = 6 if with_text else 5
        return pa.table([pa.array(c, t) for c, t in zip(rows[:keep], types)], names[:keep])

    return packed_texts(docs, parts).groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, schema)


def _unzip(packed: bytes) -> bytes:
    return _zstd()[1].decompress(packed)


def group_size(total: int) -> int:
    """Buckets of a group. Map tasks deal a piece to each group, groups one to each part, so that with groups and parts of one
    size the number of pieces would grow with the square of the text."""
    return max(1, min(GROUP_MOST, round((total / GROUP_BYTES) ** 0.5)))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0x7FFFFFFF)))  # tells rows of one doc_id apart
    total, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    each = group_size(total)
    groups, parts = max(1, -(-total // (BUCKET_BYTES * each))), max(1, -(-total // (PART_BYTES * each)))

    hot = hot_hashes(rows.filter("doc_id is not null"), n_rows)
    settled = save(resolve(sampled(rows, groups, parts, hot), groups, each, parts), "passage-records")
    release(spark)
    wanted = settled.filter("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = max(1, -(-wanted * (SPAN + K) // CELL_BYTES))
    more = save(indexed(fetched(rows, settled, cells, parts), each, parts), "passage-marks")
    release(spark)
    marks = settled.filter("kind = 0").select("part", "data").unionByName(more)
    return cut_texts(rows, marks, parts, with_text)


def op5_passages(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))

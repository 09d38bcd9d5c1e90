"""Language, secrets, neighbours, and the pipeline as a whole."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from strataplan.llm import language, neighbours, secrets


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "lang"]).columns)))
    got = language.op2_language(spark, d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and 0.15 < len(held) / len(got) < 0.35
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd(odd, none):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [got[k].lang_pred for k in (5, 6, 7, 8)] == ["und"] * 4 and got[9].lang_pred == "en"
    assert language.identify(none).count() == 0
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns and {5, 6, 7, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_of_long_texts_is_learned(spark):
    """Each labelled text of one language is longer than what the fit takes of a text; one opens with a long table."""
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "kettu juoksee metsassa nopeasti"}
    rows = [(i, " ".join([words["aa"]] * 20), "aa") for i in range(12)]
    rows += [(100 + i, "1 2 3 | " * (4000 if i % 2 else 0) + " ".join([words["bb"]] * 1000), "bb") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > language.SAMPLE_CHARS for _, t, lang in rows if lang == "bb")
    assert all(0 < len(t) <= language.SAMPLE_CHARS and "kettu" in t for lang, t in language.sample(docs, "doc_id", "text", "lang") if lang == "bb")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs).collect()} == {d: lang for d, _, lang in rows}
    assert language.keep_identified(docs.filter("lang = 'bb'")).count() == 12


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    table = np.array([[0.1], [0.2], [0.3], [0.25], [0.15], [0.0], [1e-9]])
    score = np.exp(language.Lattice(pieces).log_scores(["ab"], table))[0, 0]
    assert abs(score - (0.1 * 0.2 * 0.3 + 0.1 * 0.25 + 0.15 * 0.3)) < 1e-12


def test_forward_takes_the_longest_pieces():
    """Every letter piece of the public model is in the vocabulary, and a word that is one piece has its probability in the sum."""
    import sentencepiece

    path = language.public_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = language.vocabulary(path)
    every = {p for p in (model.id_to_piece(i).lower() for i in range(model.get_piece_size())) if p == "▁" or p.lstrip("▁").isalpha()}
    assert set(pieces) == every
    word = max((p for p in every if p.startswith("▁")), key=len)[1:]
    table = np.full((len(pieces) + 2, 1), 1e-30)
    table[pieces["▁" + word]] = 0.25
    assert len(word) > 10 and abs(np.exp(language.Lattice(pieces).log_scores([word], table))[0, 0] - 0.25) < 1e-9


def segmentations(word):
    """All ways to cut a word."""
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in segmentations(word[i:]):
            yield [word[:i], *rest]


def test_long_words_sum_all_segmentations_too(monkeypatch):
    """A word longer than what is fitted: no cut is left out, and the sum does not leave the range of doubles."""
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "aba": 5, "baba": 6}
    table = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.2], [0.25, 0.1], [0.15, 0.1], [0.05, 0.2], [0.1, 0.01], [0.0, 0.0], [1e-9, 1e-9]])
    lattice = language.Lattice(pieces)
    word = "ababcabab"

    def product(cut, col):
        out = 1.0
        for p in cut:
            out *= table[pieces.get(p, lattice.unknown if len(p) == 1 else lattice.none), col]
        return out

    want = [np.log(sum(product(cut, col) for cut in segmentations("▁" + word))) for col in (0, 1)]
    assert np.allclose(lattice.log_scores([word], table)[0], want)
    assert np.allclose(lattice.long_log_score(word, table), want)
    twice = "ab" * 12 + "cab" * 30
    monkeypatch.setattr(language, "FIT_LETTERS", 1000)
    plain = lattice.log_scores([twice], table)[0]
    monkeypatch.undo()
    assert len(twice) > language.FIT_LETTERS and np.allclose(lattice.log_scores([twice], table)[0], plain)
    assert np.isfinite(lattice.long_log_score("c" * 5000, table)).all()
    assert language.words_of("x" * 30 + " 1") == ["x" * 30]


def test_language_query_against_plain_sums(spark, documents, document_rows):
    """Every text's language from the fitted table, segment by segment in plain Python."""
    pieces, languages, table = language.model_of(documents, "doc_id", "text", "lang", None)
    longest = max(map(len, pieces))
    known = {}

    def log_word(word):
        if word not in known:
            w = "▁" + word
            alpha = [np.ones(len(languages))]
            for i in range(1, len(w) + 1):
                alpha.append(sum(alpha[k] * table[pieces.get(w[k:i], len(pieces) + 1 if i - k == 1 else len(pieces))] for k in range(max(0, i - longest), i)))
            known[word] = np.log(alpha[-1])
        return known[word]

    want = {}
    for d, t in document_rows:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        total = sum((log_word(w) for w in words), np.zeros(len(languages)))
        want[d] = languages[int(total.argmax())] if any(c.isalpha() for c in t or "") else "und"
    assert {r.doc_id: r.lang_pred for r in language.identify(documents).collect()} == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(odd, odd_rows, documents, document_rows, none):
    for docs, rows in ((odd, odd_rows), (documents, document_rows)):
        got, _ = secrets.report(docs)
        want = Counter((d, base(t or "")) for d, t in rows)
        assert Counter((r.doc_id, r.spans) for r in got.collect()) == want
        assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.n_assign == r.spans.count("assign") for r in got.collect())
    assert secrets.report(none)[0].count() == 0


def test_ledger_is_incremental(odd, documents):
    _, ledger = secrets.report(odd)
    assert secrets.unseen(odd, ledger, secrets.RULE_VERSION).count() == 0
    assert secrets.unseen(odd, ledger, "another").count() == ledger.count() == odd.select("text").na.fill("").distinct().count()
    out, more = secrets.report(odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text")), ledger)
    assert out.count() == odd.count() + documents.count() and more.select("blob").distinct().count() == more.count()


def test_stored_ledger_is_read_and_appended(spark, odd, small, tmp_path, monkeypatch):
    """A second run of the query, and the pipeline's stage after it, scan nothing; a new text is scanned alone."""
    import corpus_pipeline

    scanned, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda *a, **b: scanned.append(scan(*a, **b)) or scanned[-1])
    monkeypatch.setattr(secrets, "save", lambda df, name, *more, put=secrets.save: scanned.append(put(df, name, *more)) or scanned[-1])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = Counter(map(tuple, secrets.op6_secrets(spark, small).collect()))
    masked = Counter((r.doc_id, r.text) for r in corpus_pipeline.secrets(spark, docs, small).collect())
    spark.conf.set(secrets.STORE, str(tmp_path / "ledger"))
    try:
        counts = []
        for step in (lambda: secrets.op6_secrets(spark, small), lambda: secrets.op6_secrets(spark, small)):
            assert Counter(map(tuple, step().collect())) == want
            counts.append(scanned[-1].count())
        assert Counter((r.doc_id, r.text) for r in corpus_pipeline.secrets(spark, docs, small).collect()) == masked
        counts.append(scanned[-1].count())
        more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a new text, password=abcdefgh")], "doc_id long, text string"))
        assert Counter(r.spans for r in secrets.report(more)[0].filter("doc_id = -1").collect()) == {"assign:12:29": 1}
        counts.append(scanned[-1].count())
        assert counts[0] > 1 and counts[1:] == [0, 0, 1] and secrets.stored(spark).count() == counts[0] + 1
    finally:
        spark.conf.unset(secrets.STORE)


def test_history_of_versions(spark):
    """A secret that comes, goes and comes back in one path and stands in another: one blob, scanned once."""
    leak, clean = "password = hunter2hunter2", "nothing here"
    rows = [("a", 1, clean), ("a", 2, leak), ("a", 3, clean), ("a", 5, leak), ("b", 4, leak), ("c", 1, None)]
    versions = spark.createDataFrame(rows, "path string, version int, text string")
    found, ledger = secrets.history(versions)
    assert sorted((r.path, r.first_version, r.last_version) for r in found.collect()) == [("a", 2, 5), ("b", 4, 4)]
    assert ledger.count() == 3
    later = versions.unionByName(spark.createDataFrame([("d", 9, leak), ("d", 10, "token: abcdefgh")], versions.schema))
    assert secrets.unseen(later, ledger, secrets.RULE_VERSION).count() == 1
    found, more = secrets.history(later, ledger)
    assert more.count() == 4 and {r.path for r in found.collect()} == {"a", "b", "d"}


def test_redaction(odd, none):
    got = {r.doc_id: r for r in secrets.redacted(odd.withColumn("n_chars", odd.doc_id)).collect()}
    assert got[16].text == "[SECRET] [SECRET] [SECRET] secret: x" and got[16].n_chars == len(got[16].text) and got[5].text is None
    assert got[16]._blob == "b" and secrets.redacted(none).count() == 0
    assert secrets.mask("abcdef", "hex:1:3,assign:2:5") == "a[SECRET]f"


def exact_nearest(ids, x, q, k):
    s = (x * x[list(ids).index(q)]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [ids[i] for i in order], s[order]


def test_neighbours_recall(spark):
    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/embeddings.parquet")
    ids, x = np.array(t["vec_id"].to_pylist()), np.array(t["embedding"].to_pylist(), float)
    got = {}
    for r in neighbours.op10_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        want, _ = exact_nearest(ids, x, q, 20)
        hits += len(set(want) & {v for v, _ in found})
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits >= 0.9 * 20 * len(got)


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (400, 4)).astype(np.uint8)
    index = neighbours.MultiIndex(keys)
    q = rng.integers(0, 256, 4).astype(np.uint8)
    apart = np.unpackbits(keys ^ q, axis=1).sum(1)
    for r in range(0, 33):
        assert np.flatnonzero(index.within(np.array([q, keys[5]]), r)[0]).tolist() == np.flatnonzero(apart <= r).tolist()
    wide = index.within(q[None], 0, 10)[0]
    assert wide.sum() >= 10 and apart[wide].max() <= apart[~wide].min()


def test_neighbours_tie_at_the_last_place(spark, monkeypatch):
    """Forty equal vectors and twenty places; one id twice, with different vectors; two chunks of queries, blocks of a few rows."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 8 * 12)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, (vectors[7] + 50).tolist())]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.arange(400)
    vectors[7] = min(rows[7][1], rows[400][1])
    want = {q: exact_nearest(ids, vectors, q, 20) for q in range(0, 400, 20)}
    assert got[100] == list(zip(*[x if isinstance(x, list) else x.tolist() for x in want[100]])) and [v for v, _ in got[100]] == list(range(101, 121))
    assert all(len(x) == 20 for x in got.values()) and sorted(got) == sorted(want)
    assert sum(len({v for v, _ in got[q]} & set(want[q][0])) for q in want) >= 0.9 * 20 * len(want)
    exact = all(abs(s - vectors[q] @ vectors[v]) < 1e-9 for q, found in got.items() for v, s in found)
    assert exact


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [-1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 7, 1.0), (0, 3, 2, 0.5), (0, 4, 9, -1.0)]
    assert neighbours.search(df.limit(0)).count() == 0


def kept_by_force(texts, some, of):
    """The smallest doc_id of each component of documents whose shingle sets share some/of of their union."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    at = {}
    for d, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(d)
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        both = Counter(e for x in s for e in at[x] if e < d)
        for e, n in both.items():
            if of * n >= some * (len(s) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {top(d) for d in texts}


def test_pipeline(spark, small, document_rows):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from strataplan.runtime import save

        docs = save(stage(spark, docs, small), name)
        assert docs.columns == columns
        left = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(left) == {d for d, t in document_rows if any(c.isalpha() for c in t or "")}
            rows = [(d, t) for d, t in document_rows if d in left]
        elif name == "exact":
            first = {}
            for d, t in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
            assert set(left) == set(first.values())
        elif name == "near":
            assert set(left) == kept_by_force(before, *corpus_pipeline.NEAR)
        elif name == "secrets":
            assert all(base(t) == "" for t in left.values()) and set(left) == set(before)
        before = left
    pieces = corpus_pipeline.run(spark, small).collect()
    tokens = Tokenizer.from_file(language.public_path("byte_bpe_50k.json"))
    ids = {d: tokens.encode(t, add_special_tokens=False).ids + [0] for d, t in left.items()}
    starts, used = {}, {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        starts.setdefault(p.doc_id, []).append((p.start, p.length))
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for table, whole in ((starts, {d: len(x) for d, x in ids.items()}), (used, None)):
        for k, spans in table.items():
            spans.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
            assert sum(n for _, n in spans) == whole[k] if whole else sum(n for _, n in spans) <= 1024
    assert set(starts) == set(left) and sorted(used) == list(range(len(used)))


def test_pipeline_of_nothing_and_odd(spark, odd, none, tmp_path):
    import corpus_pipeline

    for given in (none, odd):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            rows = out.collect()
            if given is none:
                assert not rows
            elif name == "language":
                assert {r.doc_id for r in rows} == {None} | {r.doc_id for r in odd.collect() if r.doc_id is not None and any(c.isalpha() for c in r.text or "")}
            elif name == "packing":
                assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            else:
                assert out.columns == odd.columns and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and rows
            docs = spark.createDataFrame(rows, out.schema)

"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. Each language has a probability for each piece, learned by expectation
maximisation over all segmentations of the training words. A word's probability under a language is the sum over all
its segmentations, by the forward algorithm; a text's score is the sum of its words' logarithms, over every word.

Only a bounded sample of labelled rows is fitted: per language the SAMPLE_ROWS first rows in hash order among all that
have a letter, and of a text longer than SAMPLE_CHARS characters a stretch of that length from its first letter on; a run of letters longer than FIT_LETTERS is
fitted in stretches of that length. Scoring reads whole texts, and a run of letters of any length as one word.

Defined results: null text, or text without a letter, is `und` with score 0; without any labelled row all texts are
`und`; ties go to the first language in alphabetical order; rows with a null or repeated doc_id are scored like any
other (a null doc_id counts as the empty text in the split); an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataplan.llm.bpe import public_path
from strataplan.runtime import remembered, ship

SAMPLE_ROWS = 150
SAMPLE_CHARS = 20_000
ROUNDS = 2
FIT_LETTERS = 24  # in a longer run, probabilities of whole segmentations leave the range of doubles
RESCALE = 8  # steps between rescalings in longer runs
SMOOTHING = 0.1
UNKNOWN = 1e-9  # of a character that is no piece
CACHE_WORDS = 300_000
HELD_OUT_REMAINDER = 2
LEAST_SCORE = 0.5

_RUN = re.compile(r"[^\W\d_]+")
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of the public model that hold only letters and the word mark, by number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    kept = sorted(p for p in pieces if p == "▁" or p.lstrip("▁").isalpha())
    return {p: i for i, p in enumerate(kept)}


class Lattice:
    """Forward and backward sums of many words at once; words of one length share their steps."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.none, self.unknown = len(pieces), len(pieces) + 1  # rows of the table: probability 0, UNKNOWN

    def _numbers(self, marked: list[str], n: int):
        import numpy as np

        get, none, unknown = self.pieces.get, self.none, self.unknown
        out = np.empty((n, min(n, self.longest), len(marked)), np.int32)
        longest = out.shape[1]
        out[:] = none
        for i in range(n):
            out[i, 0] = [get(w[i], unknown) for w in marked]
            for size in range(2, min(longest, n - i) + 1):
                end = i + size
                out[i, size - 1] = [get(w[i:end], none) for w in marked]
        return out

    def groups(self, words: list[str]):
        """(indices, piece numbers [start, length, word]) for each word length."""
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for n, ks in by_length.items():
            yield ks, self._numbers(["▁" + words[k] for k in ks], n)

    @staticmethod
    def forward(ids, table):
        """alpha[i]: probability of the first i characters under each language, all segmentations summed."""
        import numpy as np

        n, longest, count = ids.shape
        alpha = np.zeros((n + 1, count, table.shape[1]))
        alpha[0] = 1
        for i in range(1, n + 1):
            for size in range(1, min(longest, i) + 1):
                alpha[i] += alpha[i - size] * table[ids[i - size, size - 1]]
        return alpha

    def log_scores(self, words: list[str], table):
        import numpy as np

        out = np.empty((len(words), table.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= FIT_LETTERS]
        for ks, ids in self.groups([words[k] for k in short]):
            out[[short[k] for k in ks]] = np.log(self.forward(ids, table)[-1])
        for k, w in enumerate(words):
            if len(w) > FIT_LETTERS:
                out[k] = self.long_log_score(w, table)
        return out

    def long_log_score(self, word: str, table):
        """The same sum for a word of any length: only the last ``longest`` values are held, and rescaled as they shrink."""
        import numpy as np

        w, get, none, unknown = "▁" + word, self.pieces.get, self.none, self.unknown
        last, log = np.zeros((self.longest, table.shape[1])), np.zeros(table.shape[1])
        last[0] = 1  # newest first
        for i in range(1, len(w) + 1):
            ids = [get(w[i - 1], unknown), *(get(w[i - size : i], none) for size in range(2, min(self.longest, i) + 1))]
            new = (last[: len(ids)] * table[ids]).sum(0)
            last[1:] = last[:-1]
            last[0] = new
            if i % RESCALE == 0:
                top = last.max(0)
                last /= top
                log += np.log(top)
        return log + np.log(last[0])

    def expected(self, words: list[str], counts, table):
        """Expected piece counts over all segmentations of counted words."""
        import numpy as np

        out = np.zeros_like(table)
        for ks, ids in self.groups(words):
            alpha = self.forward(ids, table)
            n, longest, _ = ids.shape
            beta = np.zeros_like(alpha)
            beta[n] = 1
            weight = counts[ks] / alpha[n]
            for i in range(n - 1, -1, -1):
                for size in range(1, min(longest, n - i) + 1):
                    p = table[ids[i, size - 1]]
                    beta[i] += p * beta[i + size]
                    np.add.at(out, ids[i, size - 1], weight * alpha[i] * p * beta[i + size])
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled (lang, text) a language, from outside the held-out quarter."""
    usable = F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (_remainder(id_col) != HELD_OUT_REMAINDER)
    text = F.when(F.length(text_col) <= SAMPLE_CHARS, F.col(text_col)).otherwise(
        F.substring(F.regexp_replace(text_col, r"^\P{L}+", ""), 1, SAMPLE_CHARS)
    )
    labelled = docs.filter(usable).select(F.col(id_col).alias("_d"), text.alias("_t"), F.col(lang_col).alias("_l"))
    first = Window.partitionBy("_l").orderBy(F.xxhash64("_d"), "_d", "_t")
    top = labelled.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= rows)
    return sorted((r["_l"], r["_t"]) for r in top.select("_l", "_t").collect())


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(labelled: list[tuple[str, str]], pieces: dict[str, int], rounds: int = ROUNDS):
    """Languages in order, and the table of piece probabilities [piece, language]."""
    import numpy as np

    languages = sorted({lang for lang, _ in labelled})
    seen = {lang: Counter() for lang in languages}
    for lang, text in labelled:
        seen[lang].update(w[i : i + FIT_LETTERS] for w in words_of(text) for i in range(0, len(w), FIT_LETTERS))
    words = sorted(set().union(*seen.values())) if languages else []
    counts = np.array([[seen[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
    lattice = Lattice(pieces)
    table = np.full((len(pieces) + 2, len(languages)), 1 / max(1, len(pieces)))
    for k in range(rounds + 1):
        table[lattice.none], table[lattice.unknown] = 0, UNKNOWN
        if k == rounds or not words:
            break
        got = lattice.expected(words, counts, table)[: len(pieces)] + SMOOTHING
        table[: len(pieces)] = got / got.sum(0)
    return languages, table


class Scorer:
    """Scores of words, remembered across a worker's tasks."""

    def __init__(self, pieces, languages, table):
        import numpy as np

        self.lattice, self.languages, self.table = Lattice(pieces), languages, table
        self.at: dict[str, int] = {}
        self.scores = np.empty((0, len(languages) + 1))

    def learn(self, words: set[str]) -> None:
        import numpy as np

        fresh = [w for w in words if w not in self.at]
        if not fresh:
            return
        if len(self.at) + len(fresh) > CACHE_WORDS:
            self.at, self.scores, fresh = {}, self.scores[:0], list(words)
        logs = self.lattice.log_scores(fresh, self.table)
        letters = np.array([[any(c.isalpha() for c in w)] for w in fresh], float)
        self.at.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
        self.scores = np.concatenate([self.scores, np.hstack([logs, letters])])

    def judge(self, words: list[str]) -> tuple[str, float]:
        import numpy as np

        if not words or not self.languages:
            return "und", 0.0
        total = self.scores[[*map(self.at.__getitem__, words)]].sum(0)
        if not total[-1]:
            return "und", 0.0
        logs = total[:-1] - total[:-1].max()
        odds = np.exp(logs)
        return self.languages[int(logs.argmax())], float(odds.max() / odds.sum())


GROUP_CHARS = 3_000_000  # texts whose new words are scored together hold about so many characters


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary_path: str | None = None) -> DataFrame:
    """One row per text: doc_id, held_out, lang_pred, score; columns of ``docs`` itself stay out."""
    return predictions(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), vocabulary_path)


def model_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary_path: str | None):
    pieces = vocabulary(vocabulary_path or public_path("piece_bpe_32k.model"))
    languages, table = fit(sample(docs, id_col, text_col, lang_col), pieces)
    return pieces, languages, table


def judged(model_key: str, sent, texts):
    """(lang_pred, score) of each text, a group at a time; sent: the broadcast model."""
    scorer = remembered(("language", model_key), lambda: Scorer(*sent.value))
    runs, size = [], 0
    for t in texts:
        text = t.as_py() or ""
        runs.append(words_of(text))
        size += len(text)
        if size >= GROUP_CHARS:
            scorer.learn(set().union(*runs))
            yield from map(scorer.judge, runs)
            runs, size = [], 0
    if runs:
        scorer.learn(set().union(*runs))
        yield from map(scorer.judge, runs)


def predictions(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    model = model_of(docs, "doc_id", "text", "lang", vocabulary_path)
    sent = spark.sparkContext.broadcast(model)  # pieces x languages, whatever the corpus
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = list(judged(key, sent, b.column(2)))
            names, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (_remainder("doc_id") == HELD_OUT_REMAINDER).alias("held_out"), "text").mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without texts that have no language or whose best language scores under ``least``; columns as they were."""
    spark = docs.sparkSession
    ship(spark)
    model = model_of(docs, id_col, text_col, lang_col, None)
    sent = spark.sparkContext.broadcast(model)
    key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = [name != "und" and score >= least for name, score in judged(key, sent, b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so every such pair is a certain cut.
A pre-token is cut there, the fragments are encoded independently (and remembered), and their ids concatenated.
Normalisation and pre-tokenisation follow the tokenizer's own file; for text of Latin letters they run as one
regular expression over classes taken from Unicode, for any other text as the tokenizers library's own components.

Defined results: null text counts as empty (no ids, empty decoding); rows with a null or repeated doc_id are encoded
like any other; very long words go through a heap in n log n; an empty table gives an empty table; columns other than
the two named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

from pyspark.sql import DataFrame

from strataplan.runtime import remembered, ship

CACHE_WORDS = 400_000  # remembered words in a worker; all are dropped when full
LONG = 64  # longer fragments merge through a heap
GROUP_CHARS = 2_000_000  # texts whose new words are encoded together hold about so many characters

_ID_BITS = 24
_ID = (1 << _ID_BITS) - 1
_NO_MERGE = 1 << 62

_LATIN_END = 0x180  # below it, letters, digits and blanks are fixed, NFC changes nothing, lower case stays below


def _chars(wanted) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LATIN_END) if wanted(c))


_LETTER = _chars(lambda c: unicodedata.category(chr(c))[0] == "L")
_NUMBER = _chars(lambda c: unicodedata.category(chr(c))[0] == "N")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
# U+0130, whose lower case holds a combining mark, is left to the library.
_LATIN = re.compile("[\\x00-\\u012f\\u0131-\\u017f]*")
_TAILS = "'(?:s|t|re|ve|m|ll|d)"
_PATTERNS = {
    # What each pre-tokenizer's pattern keeps; letters stand first as no other branch can start with one.
    "words": re.compile(f"[{_LETTER}]+|{_TAILS}|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"),
    "bytes": re.compile(f" ?[{_LETTER}]+|{_TAILS}| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next character from U+0100."""
    shown = {b for r in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)) for b in range(*r)}
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token_of_number = {str(i): t for i, t in self.token.items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in self.alphabet.items()}
        # Of a pair of ids: its merge's rank and new id in one number, which sorts by rank.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[self.vocab[a], self.vocab[b]] = rank << _ID_BITS | self.vocab[a + b]
        self.inner = [self.vocab[self.alphabet[b]] for b in range(256)]
        self.final = [self.vocab[self.alphabet[b] + self.suffix] for b in range(256)]
        self.joined = self._joined_pairs()
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}
        self.tables = None
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        kind = "words" if self.suffix else "bytes"
        self._find = _PATTERNS[kind].findall
        self._lower = self.suffix != ""
        self.known = self._fast_path_holds()

    def _joined_pairs(self) -> bytearray:
        """1 at each byte pair that occurs inside some token; 0 is a certain cut."""
        joined = bytearray(1 << 16)
        for t in self.vocab:
            b = [self.byte_of[c] for c in t.removesuffix(self.suffix) if c in self.byte_of]
            for x, y in zip(b, b[1:]):
                joined[x << 8 | y] = 1
        return joined

    def _fast_path_holds(self) -> bool:
        """Does one expression equal the file's own normaliser and pre-tokenizer on a probe of every Latin character?"""
        chars = [chr(c) for c in range(_LATIN_END) if c != 0x130]
        probe = "".join(f"a{c}b{c}{c} {c}1{c} 's{c}" for c in chars) + " x  y\n\n z it's WE'LL "
        return self._quick_words(probe) == self._library_words(probe)

    def _quick_words(self, text: str) -> list[str]:
        return self._find(text.lower() if self._lower else text)

    def _library_words(self, text: str) -> list[str]:
        if self.lib.normalizer is not None:
            text = self.lib.normalizer.normalize_str(text)
        words = self.lib.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.byte_of[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in words]

    def pieces(self, text: str) -> list[tuple[list[str], int | None]]:
        """Stretches of plain text as words, each followed by the special token that ends it, if any."""
        parts = self._split_special.split(text) if self._split_special else [text]
        out = []
        for i in range(0, len(parts), 2):
            quick = self.known and _LATIN.fullmatch(parts[i])
            words = self._quick_words(parts[i]) if quick else self._library_words(parts[i]) if parts[i] else []
            out.append((words, self.special[parts[i + 1]] if i + 1 < len(parts) else None))
        return out

    def encode_word(self, word: str) -> list[int]:
        """Cut at certain boundaries, encode the fragments independently, concatenate."""
        b = word.encode("utf-8", "surrogateescape")
        joined = self.joined
        cuts = [i for i in range(1, len(b)) if not joined[b[i - 1] << 8 | b[i]]]
        if not cuts:
            return self._encode_fragment(b, True) if b else []
        ids: list[int] = []
        start = 0
        for i in cuts:
            ids += self._remembered(b[start:i], False)
            start = i
        return ids + [*self._remembered(b[start:], True)]

    def _remembered(self, b: bytes, last: bool) -> tuple[int, ...]:
        found = self.fragments.get((b, last))
        if found is None:
            found = tuple(self._encode_fragment(b, last))
            if len(b) <= LONG:
                if len(self.fragments) >= CACHE_WORDS:
                    self.fragments.clear()
                self.fragments[b, last] = found
        return found

    def _encode_fragment(self, b: bytes, last: bool) -> list[int]:
        ids = [self.inner[x] for x in b]
        if last:
            ids[-1] = self.final[b[-1]]
        return self._merge_long(ids) if len(ids) > LONG else self._merge(ids)

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until none is left."""
        get = self.merges.get
        order = [get(pair, _NO_MERGE) for pair in zip(ids, ids[1:])]
        while order:
            best = min(order)
            if best == _NO_MERGE:
                break
            i = order.index(best)
            ids[i] = best & _ID
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = get((ids[i - 1], ids[i]), _NO_MERGE)
            if i < len(order):
                order[i] = get((ids[i], ids[i + 1]), _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        get, n = self.merges.get, len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m & _ID, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (m := get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]):
        """Ids of many words at once, end to end, and where each word's ids start (one more at the end).

        All words stand in one buffer, which is cut at word starts and at certain boundaries; fragments of equal length
        merge in step, a row each.
        """
        import numpy as np

        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        if self.tables is None:
            self.tables = self._as_arrays()
        inner, final, joined, pairs, merged = self.tables
        ids = inner[data]
        closing = ends[sizes > 0] - 1
        ids[closing] = final[data[closing]]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = joined[data[:-1].astype(np.int64) << 8 | data[1:]] == 0 if len(data) else False
        cut[ends], cut[0] = True, True
        starts = np.flatnonzero(cut[:-1]) if len(data) else np.empty(0, np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        for n in np.unique(lengths).tolist():
            at = starts[lengths == n]
            if n > LONG:
                for i in at.tolist():
                    got = self._merge_long(ids[i : i + n].tolist())
                    ids[i : i + n] = [*got, *[-1] * (n - len(got))]
            elif n > 1:
                for i in range(0, len(at), 4096):
                    place = at[i : i + 4096, None] + np.arange(n)
                    ids[place] = _merge_in_step(ids[place], pairs, merged)
        kept = ids >= 0
        before = np.concatenate(([0], np.cumsum(kept)))
        return ids[kept], before[np.concatenate(([0], ends))]

    def _as_arrays(self):
        import numpy as np

        keys = np.array([a << _ID_BITS | b for a, b in self.merges], np.int64)
        values = np.array(list(self.merges.values()), np.int64)
        order = np.argsort(keys)
        return np.array(self.inner, np.int64), np.array(self.final, np.int64), np.frombuffer(self.joined, np.uint8), keys[order], values[order]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words, special in self.pieces(text):
            for w in words:
                out += self.encode_word(w)
            if special is not None:
                out.append(special)
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space, or through the byte alphabet where the file has such a decoder."""
        tokens = [self.token[i] for i in ids]
        if not self.byte_decoder:
            return " ".join(tokens)
        out = b"".join(bytes(self.byte_of[c] for c in t) if all(c in self.byte_of for c in t) else t.encode() for t in tokens)
        return out.decode("utf-8", "replace")

    def decode_line(self, line: str) -> str:
        """``decode`` of decimal ids with a blank between."""
        if self.byte_decoder:
            return self.decode(map(int, line.split()))
        return " ".join(map(self.token_of_number.__getitem__, line.split()))


def _merge_in_step(rows, pairs, merged):
    """Each row's ids after all merges, left-aligned, -1 behind. In a round every row makes its lowest merge (the
    leftmost of equals) and so loses one id; rows without a merge are done."""
    import numpy as np

    def order_of(left, right):
        key = left << _ID_BITS | right
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, merged[at], _NO_MERGE)

    out = np.full(rows.shape, -1, np.int64)
    live = np.arange(len(rows))
    order = order_of(rows[:, :-1], rows[:, 1:])
    while len(live):
        n = rows.shape[1]
        best = order.argmin(1) if n > 1 else np.zeros(len(rows), np.int64)
        lowest = order[np.arange(len(rows)), best] if n > 1 else np.full(len(rows), _NO_MERGE)
        done = lowest == _NO_MERGE
        if done.any():
            out[live[done], :n] = rows[done]
            go = ~done
            live, rows, order, best, lowest = live[go], rows[go], order[go], best[go], lowest[go]
            if not len(live):
                break
        k = np.arange(len(live))
        rows[k, best] = lowest & _ID
        keep = np.ones(rows.shape, bool)
        keep[k, best + 1] = False
        rows = rows[keep].reshape(len(live), n - 1)
        keep = np.ones(order.shape, bool)
        keep[k, best] = False
        order = order[keep].reshape(len(live), n - 2)
        left = best > 0
        order[k[left], best[left] - 1] = order_of(rows[k[left], best[left] - 1], rows[k[left], best[left]])
        right = best < n - 2
        order[k[right], best[right]] = order_of(rows[k[right], best[right]], rows[k[right], best[right] + 1])
    return out


class Remembered:
    """word -> made(ids) of one codec, kept across a worker's tasks. Unknown words of many texts are encoded together."""

    def __init__(self, codec: Codec, made):
        self.codec, self.made, self.known = codec, made, {}

    def learn(self, runs: list[list[str]]) -> None:
        words = set().union(*runs)
        fresh = list(words.difference(self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known, fresh = {}, list(words)
        if fresh:
            ids, at = self.codec.encode_words(fresh)
            self.known.update(zip(fresh, self.made(ids, at.tolist())))

    def of(self, words: list[str]) -> list:
        return [*map(self.known.__getitem__, words)]


def in_groups(forms: Remembered, texts):
    """Each text's pieces (forms of its words, special token), texts of GROUP_CHARS at a time."""
    held, size = [], 0

    def flush():
        forms.learn([words for pieces in held for words, _ in pieces])
        for pieces in held:
            yield [(forms.of(words), special) for words, special in pieces]

    for t in texts:
        text = t.as_py() or ""
        held.append(forms.codec.pieces(text))
        size += len(text)
        if size >= GROUP_CHARS:
            yield from flush()
            held, size = [], 0
    yield from flush()


def codec(path: str) -> Codec:
    return remembered(("codec", path), lambda: Codec(path))


def _digest_forms(c: Codec) -> Remembered:
    def made(ids, at):
        ids = ids.tolist()
        for i, j in zip(at, at[1:]):
            yield " ".join(map(str, ids[i:j]))

    return Remembered(c, made)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the operator's own output."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            ids = [c.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ``encode_column``'s rows."""
    ship(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text; token count and digests of ids and decoded text."""
    ship(docs.sparkSession)

    def one(c: Codec, pieces) -> tuple[int, str, str]:
        ids = []
        for forms, special in pieces:
            ids += forms
            if special is not None:
                ids.append(str(special))
        line = " ".join(filter(None, ids))
        decoded = c.decode_line(line)
        n = line.count(" ") + 1 if line else 0
        return n, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def run(batches):
        import pyarrow as pa

        forms = remembered(("digests", path), lambda: _digest_forms(Codec(path)))
        c = forms.codec
        for b in batches:
            rows = [one(c, pieces) for pieces in in_groups(forms, b.column(1))]
            n, i, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, DIGESTS)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("word_bpe_49k.json"))

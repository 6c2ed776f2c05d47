"""BPE encoding and decoding: speculate, verify, merge exactly only where that fails.

A greedy longest match proposes the tokens of a word. A proposal is the true encoding iff
every adjacent pair of its tokens is compatible, that is, undoing the merges on both sides of
the boundary, latest first, never meets a pair that would have merged before either side did.
That test runs on all new pairs of a slice of texts at once in numpy. Words with an
incompatible pair are merged one merge at a time.

Defined results: a null text is an empty one (no tokens, empty decoded text); repeated rows
each get their row; other columns of the input pass through untouched (``encode_texts``) under
their own names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagespan.llm.shared import fresh, sliced

#: White space as Unicode has it; fixed values.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words that a worker remembers before it starts anew.
CACHE = 200_000
_NEVER = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary (lower case, NFC, white space dropped)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{_SPACE}\\p{{L}}\\p{{N}}]+")
        self.letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges], np.int64)
        n = max(self.names) + 1
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        order = np.arange(len(pairs))[::-1]  # the first of several merges that make a token counts
        self.rank[pairs[order, 2]] = order
        self.left[pairs[order, 2]] = pairs[order, 0]
        self.right[pairs[order, 2]] = pairs[order, 1]
        self.merge_of = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(pairs)}
        code = pairs[:, 0] << 20 | pairs[:, 1]
        by = np.argsort(code, kind="stable")
        self.codes, self.code_rank = code[by], by.astype(np.int64)
        made = np.flatnonzero(self.rank >= 0)
        whole = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound = self.rank < 0
        for t in made[np.argsort(self.rank[made])]:
            sound[t] = whole[np.searchsorted(made, t)] and sound[self.left[t]] and sound[self.right[t]]
        self.proposals = {s: i for s, i in self.ids.items() if sound[i]}
        self.longest = max(len(s.removesuffix(self.end)) for s in self.proposals)
        self.pairs_seen: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.failed = 0

    def compatible(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Which of the adjacent tokens stay apart when their joined text is merged."""
        ok = np.ones(len(left), bool)
        at = np.arange(len(left))
        l, r = left.astype(np.int64), right.astype(np.int64)
        until = np.full(len(l), _NEVER) if until is None else until.copy()
        while len(at):
            code = l << 20 | r
            hit = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            clash = (self.codes[hit] == code) & (self.code_rank[hit] < until)
            ok[at[clash]] = False
            go = ~clash & (np.maximum(self.rank[l], self.rank[r]) >= 0)
            at, l, r, until = at[go], l[go], r[go], until[go]
            rl, rr = self.rank[l], self.rank[r]
            undo_left = rl > rr
            until = np.where(undo_left, rl, rr + 1)  # on equal ranks the left pair merges first
            l, r = np.where(undo_left, self.right[l], l), np.where(undo_left, r, self.left[r])
        return ok

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` in letters of bytes, its end implied."""
        out, at, n = [], 0, len(word)
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                token = self.proposals.get(word[at:to] + self.end if to == n else word[at:to])
                if token is not None:
                    break
            out.append(token)
            at = to
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank and then leftmost first."""
        import heapq

        ids = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge_of.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Put the encodings of new words into ``known``."""
        words = [*words]
        letters = ["".join([self.letters[b] for b in w.encode()]) for w in words]
        found = [self.propose(w) for w in letters]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.array([t for f in found for t in f], np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(sizes) - 1] = False
        left = flat[inner]
        right = flat[np.flatnonzero(inner) + 1]
        codes, back = np.unique(left << 20 | right, return_inverse=True)
        seen = self.pairs_seen
        new = np.array([c for c in codes.tolist() if c not in seen], np.int64)
        if len(new):
            if len(seen) > 4 * CACHE:
                seen.clear()
                new = codes
            seen.update(zip(new.tolist(), self.compatible(new >> 20, new & (1 << 20) - 1).tolist(), strict=True))
        good = np.array([seen[c] for c in codes.tolist()], bool)[back] if len(codes) else np.zeros(0, bool)
        owner = np.repeat(np.arange(len(found)), sizes)[inner]
        for k in np.unique(owner[~good]).tolist():
            found[k] = self.merge(letters[k])
            self.failed += 1
        for w, f in zip(words, found, strict=True):
            self.known[w] = np.array(f, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as the vocabulary's own library gives them."""
        split = []
        for text in texts:
            if self.split_special and "<|" in text:
                words = []
                for part in self.split_special.split(text):
                    words += [("", self.special[part])] if part in self.special else self.split(part)
            else:
                words = self.split(text)
            split.append(words)
        if len(self.known) > CACHE:
            self.known.clear()
        new = {w for words in split for w in words if w not in self.known and isinstance(w, str)}
        if new:
            self.learn(new)
        known = self.known
        for words in split:
            for w in words:
                if w.__class__ is tuple:
                    known[w] = np.array([w[1]], "<u4").tobytes()
        return [np.frombuffer(b"".join([known[w] for w in words]), "<u4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by blanks: the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_loaded: dict[int, WordBpe] = {}


def load(spec: bytes) -> WordBpe:
    """The vocabulary of a file's bytes, once a process."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = WordBpe(json.loads(spec))
    return _loaded[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded_text") -> DataFrame:
    """``docs`` with the ids of each text and the text decoded from them (names made fresh on clash)."""
    return _map(docs, path, text, [(n, t) for n, t in zip(fresh(docs, ids, decoded), (T.ArrayType(T.IntegerType()), T.StringType()), strict=True)], _full)


def _full(ids: list[np.ndarray], decoded: list[str]) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())]


def _digests(ids: list[np.ndarray], decoded: list[str]) -> list[pa.Array]:
    return [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]


def _map(docs: DataFrame, path: str, text: str, new: list, form) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in new]])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for part in sliced(batches, text):
            ids = bpe.encode([t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, *form(ids, [bpe.decode(i) for i in ids])], names)

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _map(docs.select("doc_id", "text"), path, "text", new, _digests).drop("text")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoding and its decoding of every document."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())

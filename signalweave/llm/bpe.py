"""BPE encoding with a lexicon of frequent words, and decoding.

The corpus's frequent words are encoded once; a minimal acyclic automaton maps each to its place, and with that to
its ids. Workers memory-map the automaton and look new words up in it, all words of a batch together.
Words that it lacks are merged by the ranks of the vocabulary, exactly as the vocabulary's own library does.

The vocabulary file (JSON; its path is a parameter) is read on the driver: BPE with an end-of-word suffix over bytes, texts
in NFC and lower case, split into letters, single digits and other runs, white space dropped. Its special tokens are
recognised in the texts as they are.

Cases: null and empty texts, and texts of white space, have no ids and decode to the empty text. Repeated rows get equal ids. An empty
table gives no rows, and a lexicon without words. Texts of any length count whole: batches are cut by characters, and one long text is a batch alone. Kept columns may have any
name; only a name that the result itself has is taken from them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton, build
from .common import WORD, checkpointed, count_words, map_texts, most_frequent

#: How the vocabulary splits a text into words.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CHUNKS = re.compile(WORD)
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is one, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]
    first: list[int]  # id of each byte within a word
    last: list[int]  # and at its end
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, id)
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for t, i in chain(ids.items(), special.items()):
            tokens[i] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        letters = byte_letters()
        return cls(tokens, [ids[c] for c in letters], [ids[c + end] for c in letters], {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}, special)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Pairs as sorted numbers with their ranks, the id that each rank makes, and the ids of bytes."""
        keys = np.array([a << 20 | b for a, b in self.merges], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)
        made = np.zeros(len(ranks), dtype=np.int64)
        made[ranks] = [i for _, i in self.merges.values()]
        order = np.argsort(keys)
        return keys[order], ranks[order], made, np.array(self.first), np.array(self.last)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of the lowest rank merges first, of equal ones the leftmost."""
        ids = [*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]]
        merges = self.merges
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(r[0], i, r[1], *p) for i, p in enumerate(pairwise(ids)) if (r := merges.get(p))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := merges.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (r[0], k, r[1], ids[k], ids[after[k]]))
        return tuple(i for i in ids if i >= 0)


def merge_many(words: list[bytes], arrays: tuple[np.ndarray, ...]) -> list[tuple[int, ...]]:
    """Ids of many short words, all merged together: each round makes each word's best merge."""
    keys, ranks, made, first, last = arrays
    none = len(made)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (a >= 0) & (b >= 0), ranks[at], none)

    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(lengths.max(initial=1))
    data = np.frombuffer(b"".join(words), np.uint8)
    ids = np.full((len(words), width + 1), -1, dtype=np.int64)
    ids[np.arange(width + 1) < lengths[:, None]] = first[data]
    ids[np.arange(len(words)), lengths - 1] = last[data[np.cumsum(lengths) - 1]]
    if width > 1 and len(keys):
        rows, work = np.arange(len(words)), ids.copy()
        best = rank(work[:, :-1], work[:, 1:])
        columns = np.arange(width + 1)
        while len(rows):
            at = best.argmin(1)
            lowest = best[np.arange(len(rows)), at]
            going = lowest < none
            ids[rows[~going]] = work[~going]
            rows, work, best, at, lowest = rows[going], work[going], best[going], at[going], lowest[going]
            if not len(rows):
                break
            here = np.arange(len(rows))
            work[here, at] = made[lowest]
            shift = np.minimum(columns + (columns > at[:, None]), width)
            work = np.take_along_axis(work, shift, 1)
            work[:, width] = -1
            best = np.take_along_axis(np.column_stack([best, np.full(len(rows), none)]), shift, 1)[:, :width]
            best[here, at] = rank(work[here, at], work[here, at + 1])
            back = here[at > 0]
            best[back, at[back] - 1] = rank(work[back, at[back] - 1], work[back, at[back]])
    n = (ids >= 0).sum(1)
    flat, ends = ids[ids >= 0].tolist(), np.cumsum(n).tolist()
    return [tuple(flat[e - k : e]) for e, k in zip(ends, n.tolist())]


#: Most stretches are letters that need no normalising, perhaps with a run of punctuation after them: two words at most.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|]*)").fullmatch


def words_of(chunk: str) -> list[bytes]:
    """Words of a stretch without ASCII white space and special tokens."""
    if m := PLAIN(chunk):
        word, rest = m.groups()
        return [word.lower().encode(), rest.encode()] if rest else [word.lower().encode()]
    if not chunk.isascii():
        # Lower case goes letter by letter, so a sigma at a word's end is like any other.
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
    return [w.encode() for w in PIECES.findall(chunk.lower())]


@dataclass
class Encoder:
    vocabulary: Vocabulary
    lexicon: bytes  # an automaton over words
    ids: np.ndarray  # of all its words, one after the other
    ends: np.ndarray
    most_cached: int = 300_000
    _state: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_state": {}}

    def _ready(self) -> dict:
        if not self._state:
            names = sorted(map(re.escape, self.vocabulary.special), key=len, reverse=True)
            self._state.update(automaton=Automaton(self.lexicon), special=re.compile("|".join(names)) if names else None, cache={}, words={}, arrays=self.vocabulary.arrays(), begins=np.append(0, self.ends).tolist(), ids=self.ids.tolist())
        return self._state

    def look_up(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct words: from the lexicon, else by merging."""
        state = self._ready()
        places = state["automaton"].places(words).tolist()
        begins, ids = state["begins"], state["ids"]
        out = [tuple(ids[begins[p] : begins[p + 1]]) if p >= 0 else None for p in places]
        unseen = [i for i, x in enumerate(out) if x is None]
        short = [i for i in unseen if len(words[i]) <= 32]
        for i, x in zip(short, merge_many([words[i] for i in short], state["arrays"])):
            out[i] = x
        return [self.vocabulary.merge(w) if x is None else x for w, x in zip(words, out)]

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks into the cache."""
        state, parts = self._ready(), {}
        for c in chunks:
            if "<|" in c and state["special"]:
                found: list = []
                at = 0
                for m in state["special"].finditer(c):
                    found += [*words_of(c[at : m.start()]), self.vocabulary.special[m[0]]]
                    at = m.end()
                parts[c] = found + words_of(c[at:])
            else:
                parts[c] = words_of(c)
        known = state["words"]
        if len(known) > self.most_cached:
            known.clear()
        new = list({w for p in parts.values() for w in p if w.__class__ is bytes}.difference(known))
        known.update(zip(new, self.look_up(new)))
        cache = state["cache"]
        for c, p in parts.items():
            if len(p) == 1 and p[0].__class__ is bytes:
                cache[c] = known[p[0]]
            else:
                cache[c] = tuple(chain.from_iterable(known[w] if w.__class__ is bytes else (w,) for w in p))

    def encode(self, texts: list[str]) -> list[list[int]]:
        cache = self._ready()["cache"]
        chunked = [CHUNKS.findall(t) for t in texts]
        if len(cache) > self.most_cached:
            cache.clear()
        self.learn({c for chunks in chunked for c in chunks}.difference(cache))
        return [list(chain.from_iterable(map(cache.__getitem__, chunks))) for chunks in chunked]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the vocabulary names no other way of decoding."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


def fit(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", most_words: int = 1 << 17) -> Encoder:
    """An encoder whose lexicon has the words of the ``most_words`` most frequent stretches between white space."""
    top = most_frequent(checkpointed(count_words(docs, text)), most_words).select("word")
    words = sorted({w for r in top.toArrow().column("word").to_pylist() for w in words_of(r.decode("utf-8", "replace"))})
    ids = [vocabulary.merge(w) for w in words]
    return Encoder(vocabulary, build(words), np.array(list(chain.from_iterable(ids)), dtype=np.int32), np.cumsum([len(x) for x in ids], dtype=np.int64))


def encode(docs: DataFrame, encoder: Encoder, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``ids``, an array for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(encoder)  # the vocabulary and at most ``most_words`` words
    return map_texts(docs, text, IDS, lambda texts: [shared.value.encode(texts)], docs.columns if keep is None else keep)


def decode(rows: DataFrame, encoder: Encoder, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the decoded text of an array of ids; null ids decode to null."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder.vocabulary.tokens)

    @F.pandas_udf("string")
    def joined(series):
        return series.map(lambda x: None if x is None else " ".join(map(shared.value.__getitem__, x)))

    return rows.withColumn(out, joined(ids))


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, encoder: Encoder, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes each text and gives the number of ids and hashes of both, without moving them out of the worker."""
    from hashlib import sha256

    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    decimal = [str(i) for i in range(len(encoder.vocabulary.tokens))]

    def run(texts):
        ids = shared.value.encode(texts)
        written = [" ".join(map(decimal.__getitem__, x)) for x in ids]
        return [list(map(len, ids)), [sha256(x.encode()).hexdigest() for x in written], [sha256(shared.value.decode(x).encode()).hexdigest() for x in ids]]

    return map_texts(docs, text, DIGESTS, run, docs.columns if keep is None else keep)

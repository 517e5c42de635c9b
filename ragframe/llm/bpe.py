"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out as one array of symbols, linked to
left and right neighbours inside each word. An index maps each pair (by its
merge rank) to all its positions in the batch. The active ranks are applied in
ascending order: one merge rewrites all positions of its pair at once and only
the lists of the pairs to the left and right of them are updated. Because a
vocabulary forms a token before any merge that uses it (checked on loading), a
merge can only add pairs of a higher rank, so one ascending pass is exact.

Words already encoded by a task are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import id_and_text

CACHE_WORDS = 150_000          # distinct words a task keeps between batches
PIECE_CHARS = 1_000_000        # texts indexed together, unless one is longer
BASE = 1 << 20                 # pair key: left * BASE + right; ids stay below it


def load_vocabulary(path: str) -> dict:
    """Plain arrays of a tokenizers JSON file (byte-level BPE with word ends),
    a few MB, read once by the driver and broadcast."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = {a + b: r for r, (a, b) in enumerate(merges)}
    if len(order) != len(merges) or any(order.get(x, -1) >= r for r, m in enumerate(merges) for x in m):
        raise ValueError("a merge uses a token that a later merge makes: ranks can't be applied in one pass")
    # printable Latin-1 bytes stand for themselves, the others for code points from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    char = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    key = np.array([vocab[a] * BASE + vocab[b] for a, b in merges], dtype=np.int64)
    by = np.argsort(key)
    tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for t, i in vocab.items():
        tokens[i] = t
    for t in spec["added_tokens"]:
        tokens[t["id"]] = t["content"]
    return {"tokens": tokens, "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
            "inner": np.array([vocab[char[b]] for b in range(256)], dtype=np.int64),
            "last": np.array([vocab[char[b] + end] for b in range(256)], dtype=np.int64),
            "key": key[by], "rank_of": by.astype(np.int64),
            "pair": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64)}


def merge_words(v: dict, words: list[str]) -> list[bytes]:
    """Token ids of each word (little-endian unsigned 32-bit) by the pair index."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n = len(data)
    stop = np.cumsum([len(r) for r in raw])
    symbol = v["inner"][data]
    symbol[stop - 1] = v["last"][data[stop - 1]]
    right = np.arange(1, n + 1)
    right[stop - 1] = -1
    left = np.arange(-1, n - 1)
    left[stop[:-1]] = -1
    left[0] = -1
    key, rank_of, pair = v["key"], v["rank_of"], v["pair"]
    waiting: dict[int, list] = {}
    heap: list[int] = []

    def note(at):
        """Adds the pairs that begin at the positions ``at`` to the index."""
        k = symbol[at] * BASE + symbol[right[at]]
        j = np.searchsorted(key, k)
        j[j == len(key)] = 0
        known = key[j] == k
        if not known.any():
            return
        at, rank = at[known], rank_of[j[known]]
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
            if r in waiting:
                waiting[r].append(part)
            else:
                waiting[r] = [part]
                heapq.heappush(heap, r)

    note(np.flatnonzero(right >= 0))
    while heap:
        r = heapq.heappop(heap)
        parts = waiting.pop(r)
        a, b, new = pair[r].tolist()
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        after = right[at]
        good = (symbol[at] == a) & (after >= 0) & (symbol[after] == b)
        at, after = at[good], after[good]
        if a == b and len(at) > 1:  # of overlapping pairs in a run, every other one from the left
            first = np.r_[True, at[1:] != after[:-1]]
            index = np.arange(len(at))
            take = (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
            at, after = at[take], after[take]
        if not len(at):
            continue
        symbol[at], symbol[after] = new, -1
        beyond = right[after]
        right[at] = beyond
        more = beyond >= 0
        left[beyond[more]] = at[more]
        before = left[at]
        note(np.unique(np.concatenate([before[before >= 0], at[more]])))
    alive = symbol >= 0
    ids = symbol[alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive)[stop - 1]).tolist()
    return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes texts; keeps the ids of words it has seen, up to a bound."""

    def __init__(self, v: dict):
        self.v, self.seen = v, {}
        # the pattern by which this kind of tokenizer splits a normalised text: a fixed value
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, v["special"])) + ")")
        self.special_ids = {s: np.array([i], dtype="<u4").tobytes() for s, i in v["special"].items()}

    def split(self, text: str) -> list[str]:
        # a lower-cased sigma is the same at a word's end, which str.lower() has otherwise
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.word.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        docs = []
        for t in texts:
            parts = self.special.split(t) if any(s in t for s in self.special_ids) else [t]
            docs.append([(p, None) if p in self.special_ids else (None, self.split(p)) for p in parts if p])
        new = set().union(*(ws for d in docs for s, ws in d if s is None))
        new.difference_update(self.seen)
        if new:
            new = sorted(new)
            self.seen.update(zip(new, merge_words(self.v, new), strict=True))
        get = self.seen.__getitem__
        out = [b"".join(self.special_ids[s] if s else b"".join(map(get, ws)) for s, ws in d) for d in docs]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        return out


def pieces(sizes: list[int], limit: int = PIECE_CHARS):
    """Slices of consecutive texts of up to ``limit`` characters together (a longer text is one slice)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and ids_sha256 for every document row.

    A null text is empty; an empty one has no ids and the digest of no bytes.
    Strings of special tokens in a text become those tokens. Repeated rows and
    null ids give a row each. No shuffle: a batch of texts is indexed at a time."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                        ("ids_sha256", pa.string())])

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            sizes = pc.utf8_length(batch.column("text")).to_pylist()
            for s, e in pieces(sizes):
                coded = encoder.encode(batch.column("text").slice(s, e - s).to_pylist())
                offsets = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s, e - s), pa.array(np.diff(offsets).astype(np.int64)), ids,
                     pa.array([hashlib.sha256(c).hexdigest() for c in coded])], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string")


def decode_documents(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids",
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``text``: each id's token, special ones too,
    joined by a space (the vocabulary names no decoder). Null or empty ids give
    an empty text; an id outside the vocabulary raises."""
    spark = encoded.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = encoded.select(*keep)
    names, types = list(keep), [f.dataType.simpleString() for f in kept.schema.fields]

    def run(batches):
        token = vocabulary.value["tokens"].__getitem__
        for batch in batches:
            # lengths and values, row by row: an array column holds nulls only as whole rows
            column = batch.column("_ids")
            ends = np.cumsum([0, *(x or 0 for x in column.value_lengths().to_pylist())]).tolist()
            ids = column.flatten().to_numpy(zero_copy_only=False)
            n, s = len(ends) - 1, 0
            while s < n:
                e = s + 1
                while e < n and ends[e + 1] - ends[s] <= PIECE_CHARS:
                    e += 1
                texts = [" ".join(map(token, ids[ends[i]:ends[i + 1]].tolist())) for i in range(s, e)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(s, e - s) for c in names), pa.array(texts, pa.string())],
                    names=[*names, "text"])
                s = e

    fields = ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True))
    return encoded.select(F.col(ids_col).alias("_ids"), *keep).mapInArrow(run, f"{fields}, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the encoded ids and of the text decoded from them."""
    coded = encode_documents(docs, vocabulary_path, id_col, text_col)
    back = decode_documents(coded, vocabulary_path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))

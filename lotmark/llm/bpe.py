"""BPE encoding and decoding for vocabularies with word ends, in batched numpy merge rounds.

The text is split at white space, and each distinct piece between is encoded once per task: a bounded cache
maps it to a slice of one pool of ids. The pieces that a batch brings anew are encoded together: the symbols
of all their words lie in one flat array; each round finds the lowest-ranked pair of every word by binary
search over the sorted pair keys, and merges all its occurrences.

The vocabulary file is read where it lies, on each executor; `path` is its place.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotmark.llm import common

#: Unicode's white space, as the vocabulary's normalizer sees it. Python's str.split() also splits at 1C to 1F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces that a task remembers, and the ids they may have together.
CACHE_PIECES, CACHE_IDS = 300_000, 4_000_000
#: Letters and numbers that the regex module knows and Unicode 16, the library's, does not.
LATE = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 "
    "11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 "
    "1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead "
    "323b0-33479 3d000-3fc3f"
)
#: Capitals that Python's tables don't lower yet, first, last, and what to add.
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Vocabulary:
    """A vocabulary file: byte-level letters, a suffix at word ends, merges in order of rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(*ids.values(), *self.special.values()) + 1
        tokens: list[str | None] = [None] * self.size
        for token, i in [*ids.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.string())
        letters = byte_letters()
        self.inner = np.array([ids[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([ids[letters[b] + self.suffix] for b in range(256)], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], dtype=np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks = keys[by], by.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int32)[by]
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+|[\n\t]")
        late = "".join(f"\\U{int(a, 16):08x}-\\U{int(b or a, 16):08x}" for a, _, b in (r.partition("-") for r in LATE.split()))
        self.late = {chr(c) for a, _, b in (r.partition("-") for r in LATE.split()) for c in range(int(a, 16), int(b or a, 16) + 1)}
        late = f"--[{late}]"
        self.capitals = {c: c + add for a, b, add in CAPITALS for c in range(a, b + 1)}
        self.late |= set(map(chr, self.capitals))
        letter, number = f"[\\p{{L}}{late}]", f"[\\p{{N}}{late}]"
        self.words_late = regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{WHITE}{letter}{number}]+|[\\n\\t]")
        self.special_first = {s[0] for s in self.special}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has. Words are not empty."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1].astype(np.int64) * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(found, self.ranks[at], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbol))))
            ready = best == NO_RANK
            done.append((word[ready], symbol[ready]))
            hit = (rank == best) & ~ready
            # of overlapping occurrences, as in aaa, every other one counts, from the left
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= run % 2 == 0
            symbol = np.where(hit, self.merged[np.append(at, 0)], symbol)
            live = ~ready & ~np.append(False, hit[:-1])
            symbol, word = symbol[live], word[live]
        word = np.concatenate([w for w, _ in done]) if done else np.empty(0, dtype=np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.empty(0, dtype=np.int32)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has. Texts hold no white space."""
        marked, special = [], []
        for text in texts:
            if self.split_special and any(c in text for c in self.special_first):
                # no text holds white space: a tab stands for a special token, a line feed for a text's end
                parts = self.split_special.split(text)
                special += [self.special[p] for p in parts if p in self.special]
                text = "".join("\t" if p in self.special else p for p in parts)
            marked.append(text)
        # letters are lowered one by one, so a sigma at a word's end stays a plain sigma
        joined = unicodedata.normalize("NFC", "\n".join(marked)).replace("Σ", "σ").lower()
        if self.late.isdisjoint(joined):
            found = self.words.findall(joined)
        else:
            found = self.words_late.findall(joined.translate(self.capitals))
        words: list[bytes] = []
        owner: list[int] = []
        forced: list[int] = []
        text = 0
        for w in found:
            if w == "\n":
                text += 1
                continue
            if w == "\t":
                forced.append(len(words))
            words.append(w.encode("utf-8", "surrogatepass"))
            owner.append(text)
        ids, counts = self.merge(words)
        if forced:
            ids[(np.cumsum(counts) - counts)[forced]] = special
        return ids, np.bincount(np.array(owner, dtype=np.int64), weights=counts, minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder(dict):
    """Numbers pieces as they come; encode() gives a batch's ids."""

    odd = regex.compile("[\x1c-\x1f]")
    split = regex.compile(f"[^{WHITE}]+")

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary, self.new = vocabulary(path), []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pool, self.start, self.count = (np.empty(0, dtype=k) for k in (np.int32, np.int64, np.int64))

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets into ids, and the ids of all texts."""
        if len(self) > CACHE_PIECES or len(self.pool) > CACHE_IDS:
            self.forget()
        split = [(self.split.findall(t) if self.odd.search(t) else t.split()) if t else [] for t in texts]
        slots = np.array([self[piece] for pieces in split for piece in pieces], dtype=np.int64)
        if self.new:
            ids, count = self.vocabulary.pieces(self.new)
            self.start = np.append(self.start, len(self.pool) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.pool = np.append(self.pool, ids)
            self.new = []
        count = self.count[slots]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.start[slots] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([0] + [len(p) for p in split])
        return np.append(0, ends)[last], ids


def _attached(part: pa.RecordBatch, column: pa.Array, name: str, drop: str | None = None) -> pa.RecordBatch:
    names = [n for n in part.schema.names if n != drop]
    return pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in names], column], names=[*names, name])


def strings(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The strings of each list's tokens joined by one space; null for a null list."""
    size = len(tokens)
    flat = lists.flatten()
    bad = pc.or_kleene(pc.less(flat, 0), pc.greater_equal(flat, size)).fill_null(True)
    found = tokens.take(pc.if_else(bad, pa.scalar(None, pa.int32()), flat))
    counts = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
    offsets = np.append(0, np.cumsum(counts))
    if found.null_count:
        good = np.asarray(found.is_valid())
        offsets = np.append(0, np.cumsum(good))[offsets]
        found = found.drop_null()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), " ")
    if lists.null_count:
        joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))
    return joined


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Adds `ids` array<int>, the token ids of each whole text, as the tokenizers library encodes it without
    adding special tokens; special tokens' strings in a text become their ids.

    With `decoded`, a column of that name has what decode() gives for the ids, made in the same pass: two passes behind
    each other would keep two Python workers a task. Null texts count as empty and get an empty array. The text column is dropped, and of the others those in
    `keep` stay (all, if None); a column that is named as `ids`, in any case, is replaced. Rows neither move nor merge.
    """
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())] if keep is None else keep
    body = common.free("_text", keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body))
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*source.drop(body).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = Encoder(path), vocabulary(path).tokens
        for batch in batches:
            for part in common.chunks(batch, body):
                offsets, flat = encoder.encode(part.column(body).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                out = _attached(part, lists, ids, body)
                yield _attached(out, strings(lists, tokens), decoded) if decoded else out

    common.small_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Replaces `ids` by `text`: the tokens' strings joined by one space, special tokens too, as the library
    decodes for a vocabulary file that names no decoder.

    Null arrays give null; null ids and ids outside the vocabulary are left out.
    """
    rest = encoded.drop(text) if text != ids else encoded
    schema = T.StructType([*rest.drop(ids).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                joined = strings(part.column(part.schema.get_field_index(ids)), tokens)
                yield _attached(part, joined, text, ids)

    return rest.mapInArrow(run, schema)


def ids_sha256(ids: Column) -> Column:
    """Lowercase hex of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)

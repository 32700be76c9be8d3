"""BPE encoding and decoding (operator 9) with batched numpy merge rounds.

The vocabulary file is a JSON description of a BPE tokenizer whose text pipeline is NFC, white space to
one space, lower case, a split pattern, byte-to-character mapping and an end-of-word suffix. Texts are cut
at white space, so each distinct chunk is encoded once per task and the merge rounds see only new words.

Edge cases: null and empty texts have no tokens and decode to the empty text; control strings of the
vocabulary are single tokens wherever they occur; repeated rows give repeated results; extra columns are
kept by :func:`encode_documents` unless they clash with its output names, which then replace them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import with_computed

#: Distinct chunks a task remembers before it starts afresh.
CACHE_CHUNKS = 200_000
#: Chunks of neighbouring texts that are looked up, and if new merged, together.
GROUP_CHUNKS = 100_000
NO_RANK = np.iinfo(np.int64).max
# str.split() also cuts at these separators, which the vocabulary's white-space class does not hold.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class Codec:
    """Encodes and decodes with one vocabulary; built once per Python worker from the file's JSON text."""

    def __init__(self, description: str):
        spec = json.loads(description)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [""] * self.size
        for token, i in vocab.items():
            self.strings[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.strings[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        letters = byte_characters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each non-empty word: rounds over one flat array, each word's lowest-rank pair at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[flat[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray] = [symbols[:0]] * len(words)
        while len(symbols):
            # the pair that starts at each symbol; the last symbol of a word starts none
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            keys = symbols[inside] * self.size + symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            rank = np.full(len(symbols), NO_RANK)
            rank[inside[known]] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            finished = best == NO_RANK
            for k in np.flatnonzero(finished):
                done[owner[starts[k]]] = symbols[starts[k] : starts[k] + sizes[k]]
            hit = (rank == np.repeat(best, sizes)) & (rank != NO_RANK)
            # equal neighbours overlap: within a run of hits take every second one, from the left
            places = np.flatnonzero(hit)
            if not len(places):
                break
            run_start = np.r_[True, np.diff(places) != 1]
            offset = np.arange(len(places)) - np.maximum.accumulate(np.where(run_start, np.arange(len(places)), 0))
            places = places[offset % 2 == 0]
            key = symbols[places] * self.size + symbols[places + 1]
            symbols[places] = self.made[np.searchsorted(self.keys, key)]
            keep = np.repeat(~finished, sizes)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done

    def normal(self, text: str) -> str:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def chunks(self, text: str) -> list[str]:
        """White-space separated chunks of a text, with control strings as chunks of their own."""
        out: list[str] = []
        last = 0
        for m in [*self.specials.finditer(text), None] if "<|" in text else [None]:
            part = self.normal(text[last : m.start() if m else len(text)])
            out += regex.split(r"\s+", part) if ODD_SPACE.search(part) else part.split()
            if m:
                out.append("\0" + m[0])
                last = m.end()
        return out

    def learn(self, chunks: set[str]) -> None:
        """Adds chunks to the cache."""
        pieces = {c: self.pieces.findall(c) for c in chunks if c[:1] != "\0" or c[1:] not in self.added}
        words = list({p for found in pieces.values() for p in found})
        ids = dict(zip(words, (a.astype("<u4").tobytes() for a in self.merge([w.encode("utf-8", "surrogatepass") for w in words])), strict=True)) if words else {}
        for c, found in pieces.items():
            self.cache[c] = b"".join(ids[p] for p in found)
        for c in chunks - pieces.keys():
            self.cache[c] = np.array([self.added[c[1:]]], "<u4").tobytes()

    def encode(self, texts: list[object]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new chunks of many texts are learned together."""
        group: list[list[str]] = []
        held = 0
        for n, text in enumerate(texts, 1):
            group.append(self.chunks(text) if isinstance(text, str) else [])
            held += len(group[-1])
            if held >= GROUP_CHUNKS or n == len(texts):
                if len(self.cache) > CACHE_CHUNKS:
                    self.cache.clear()
                new = {c for chunks in group for c in chunks if c not in self.cache}
                if new:
                    self.learn(new)
                yield from [b"".join(map(self.cache.__getitem__, chunks)) for chunks in group]
                group, held = [], 0

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces, as a vocabulary without decoder is read back."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[int, Codec] = {}


def codec(description: str) -> Codec:
    key = hash(description)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(description)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, decode: bool = True) -> DataFrame:
    """docs with token_ids array<int> and, with decode, decoded string. vocabulary: path of the tokenizer's JSON file, read once on the driver; its size does not depend on the data."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def start():
        coder = codec(shared.value)

        def compute(texts: list) -> list:
            ids = list(coder.encode(texts))
            return [[np.frombuffer(x, "<u4").astype(np.int32) for x in ids], *([[coder.decode(x) for x in ids]] if decode else [])]

        return compute

    base = docs if decode else docs.drop("decoded")
    return with_computed(base, ["text"], "token_ids array<int>, decoded string" if decode else "token_ids array<int>", start)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encodes, then decodes from the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def start():
        coder = codec(shared.value)

        def compute(texts: list) -> list:
            ids = list(coder.encode(texts))
            decoded = (coder.decode(x).encode("utf-8", "surrogatepass") for x in ids)
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in decoded]]

        return compute

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_computed(slim, ["text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", start, without=("text",))

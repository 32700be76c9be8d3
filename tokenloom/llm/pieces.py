"""SentencePiece encoding and decoding (operator 12) with a merge-type prefix table.

Merging the best-scored neighbours until none is left gives each prefix of a text an encoding whose last token is
unique. The table stores that token for every prefix: an automaton yields the pieces that end at a place, and the one
that fits the last token of the prefix before it is taken. Two pieces fit if merging their joined characters leaves
just these two; the test undoes their merges, the latest first, and looks for a pair across the border that would have
been merged earlier. Ids are recovered backwards through the table, in time linear in the text.

Texts are cut where no piece reaches across (before a space mark that follows another character, and around line ends),
so that a task encodes each distinct chunk once.

Edge cases: null and empty texts have the begin and end ids alone and decode to the empty text; characters outside the
vocabulary become their UTF-8 bytes' pieces; runs of spaces, space marks and control strings in a text are ordinary
text; repeated rows give repeated results; extra columns are kept by :func:`encode_pieces` unless they have the name of
an output, which then replaces them. A model that is no BPE model with byte pieces, or one that normalises characters
or drops spaces, is refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import utf8, with_computed

#: Distinct chunks in each of the two generations that a task remembers, and the longest chunk that it remembers.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 64
#: Compatibility answers a task remembers.
CACHE_PAIRS = 2_000_000
MARK = "▁"
#: Fixed values of the model file: kinds of pieces, kind of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE, BPE = 1, 2, 3, 4, 5, 6, 2
#: In place of a last token: nothing before, a character outside the vocabulary.
NOTHING, STRANGE = -1, -2


class Pieces(NamedTuple):
    """A model: strings and kinds by id, rank of the merge that makes a piece (-1: a character) and that merge's two parts."""

    strings: list[str]
    kinds: list[int]
    ranks: list[int]
    left: list[int]
    right: list[int]
    begin: int
    end: int
    prefix: bool


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: whole numbers and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        total = shift = 0
        while True:
            b = raw[at]
            at += 1
            total |= (b & 127) << shift
            shift += 7
            if b < 128:
                return total

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


def read_model(raw: bytes) -> Pieces:
    """The pieces of a model file, with the merge that makes each of them."""
    strings, scores, kinds = [], [], []
    trainer, normal = {}, {}
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            strings.append(piece[1].decode("utf-8"))
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normal = dict(_fields(value))
    if trainer.get(3) != BPE or kinds.count(BYTE) != 256 or {USER, UNUSED} & set(kinds):
        raise ValueError("not a BPE model with byte pieces, or one with user-defined or unused pieces")
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("the model normalises characters or drops spaces")
    known = {s: i for i, s in enumerate(strings) if kinds[i] == NORMAL}
    order = {s: n for n, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
    ranks = [order[scores[i]] if s in known and len(s) > 1 else -1 for i, s in enumerate(strings)]
    left, right = list(range(len(strings))), list(range(len(strings)))
    for s, i in known.items():
        parts = list(s)
        while len(parts) > 1:
            made = [(ranks[known[a + b]], n) for n, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
            if not made:
                raise ValueError(f"piece {s!r} cannot be merged from its characters")
            n = min(made)[1]
            if len(parts) == 2:
                left[i], right[i] = known[parts[0]], known[parts[1]]
            parts[n : n + 2] = [parts[n] + parts[n + 1]]
        if len(s) > 1 and max(ranks[left[i]], ranks[right[i]]) > ranks[i]:
            raise ValueError(f"piece {s!r} scores above its parts")
    ids = {s: i for i, s in enumerate(strings)}
    begin, end = (ids[trainer.get(n, d).decode() if isinstance(trainer.get(n, d), bytes) else d] for n, d in ((46, "<s>"), (47, "</s>")))
    return Pieces(strings, kinds, ranks, left, right, begin, end, bool(normal.get(3, 1)))


class Coder:
    """Encodes and decodes with one model."""

    def __init__(self, model: Pieces):
        self.model, self.size = model, len(model.strings)
        self.known = {s: i for i, s in enumerate(model.strings) if model.kinds[i] == NORMAL}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.known.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        byte = {int(s[3:5], 16): i for i, s in enumerate(model.strings) if model.kinds[i] == BYTE}
        self.bytes = [byte[b] for b in range(256)]
        self.value = dict(zip(self.bytes, range(256), strict=True))
        self.surface = [bytes([self.value[i]]) if k == BYTE else s.replace(MARK, " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"" for i, (s, k) in enumerate(zip(model.strings, model.kinds, strict=True))]
        self.opens = [s.startswith(MARK) and k == NORMAL for s, k in zip(model.strings, model.kinds, strict=True)]
        crossing = any(a != MARK and b == MARK for s in self.known for a, b in zip(s, s[1:]))
        line = "" if any("\n" in s and len(s) > 1 for s in self.known) else "\\n"
        self.chunks = re.compile("(?s:.+)" if crossing else f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + ("|\\n+" if line else "")).findall
        self.pairs: dict[int, bool] = {}
        self.lengths = [len(x) for x in model.strings]
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b, joined, leaves a and b."""
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        strings, ranks, known = self.model.strings, self.model.ranks, self.known
        before = len(ranks) + 1  # a merge of a rank below this one comes earlier than the merge undone last
        while True:
            across = known.get(strings[a] + strings[b])
            if across is not None and ranks[across] < before:
                return False
            if ranks[a] < 0 and ranks[b] < 0:
                return True
            if ranks[a] > ranks[b]:
                before, a = ranks[a], self.model.right[a]
            else:  # of equal ranks the one further left is merged first, so a pair across the border goes before b's
                before, b = ranks[b] + 1, self.model.left[b]

    def last_tokens(self, chunk: str) -> list[int]:
        """The last token of each prefix of the chunk, the empty one included."""
        last = [NOTHING, *[STRANGE] * len(chunk)]
        find, size, settled = self.pairs.get, self.size, -1
        for end, (length, piece) in self.automaton.iter(chunk):
            if end != settled:
                before = last[end + 1 - length]
                if before >= 0:
                    good = find(before * size + piece)
                    if not (self.fits(before, piece) if good is None else good):
                        continue
                last[end + 1] = piece
                settled = end
        return last

    def encode_chunk(self, chunk: str) -> bytes:
        last, at, ids, lengths = self.last_tokens(chunk), len(chunk), [], self.lengths
        while at:
            piece = last[at]
            if piece == STRANGE:
                ids += [self.bytes[b] for b in reversed(utf8(chunk[at - 1]))]
                at -= 1
            else:
                ids.append(piece)
                at -= lengths[piece]
        return b"".join([self.packed[i] for i in reversed(ids)])

    def encode(self, text: object) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not isinstance(text, str) or not text:
            return b""
        marked = text.replace(" ", MARK)
        chunks = self.chunks(MARK + marked if self.model.prefix else marked)
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        own = {}  # long chunks are not remembered
        for c in set(chunks):
            if c not in cache:
                (cache if len(c) <= CACHE_CHARS else own)[c] = older[c] if c in older else self.encode_chunk(c)
        return b"".join([cache[c] if c in cache else own[c] for c in chunks] if own else map(cache.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text: the first space of a piece at its start goes, stray bytes become U+FFFD."""
        listed = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.surface.__getitem__, listed))
        first = next((i for i in listed if self.model.kinds[i] != CONTROL), None)
        try:
            raw.decode("utf-8")
            whole = not any(self.model.kinds[i] == CONTROL for i in set(listed[1:-1]))  # bytes on both sides of one are apart
        except UnicodeDecodeError:
            whole = False
        raw = raw if whole else self._repaired(listed)
        return raw[1:] if first is not None and self.model.prefix and self.opens[first] else raw

    def _repaired(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.value:
                run.append(self.value[i])
                continue
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _is_character(run[at : at + n])), 0)
                out.append(bytes(run[at : at + size]) if size else "�".encode())
                at += size or 1
            run.clear()
            out.append(self.surface[i] if i is not None else b"")
        return b"".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def _shared(spark: SparkSession, path: str):
    """The model at the driver's path, read once and broadcast; its size does not depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(tuple(read_model(f.read())))


def encode_pieces(docs: DataFrame, model: str, decode: bool = True) -> DataFrame:
    """docs with piece_ids array<int>, begin and end ids included, and, with decode, piece_text string. model: path of the model file."""
    shared = _shared(docs.sparkSession, model)

    def start():
        coder = Coder(Pieces(*shared.value))
        edges = [np.array([i], "<u4").tobytes() for i in (coder.model.begin, coder.model.end)]

        def compute(texts: list) -> list:
            ids = [edges[0] + coder.encode(t) + edges[1] for t in texts]
            return [[np.frombuffer(x, "<u4").astype(np.int32) for x in ids], *([[coder.decode(x).decode("utf-8") for x in ids]] if decode else [])]

        return compute

    base = docs if decode else docs.drop("piece_text")
    return with_computed(base, ["text"], "piece_ids array<int>, piece_text string" if decode else "piece_ids array<int>", start)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encodes with begin and end ids, then decodes from the ids."""
    shared = _shared(docs.sparkSession, model)

    def start():
        coder = Coder(Pieces(*shared.value))
        first, last = (np.array([i], "<u4").tobytes() for i in (coder.model.begin, coder.model.end))

        def compute(texts: list) -> list:
            ids = [first + coder.encode(t) + last for t in texts]
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]]

        return compute

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_computed(slim, ["text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", start, without=("text",))

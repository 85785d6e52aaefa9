"""SentencePiece encoding with byte offsets, and decoding, for BPE models.

Encoding follows the published format. Text is normalised by the longest prefix found in the model's
compiled character map (a double-array trie; no map: text as it is), white space becomes U+2581
and one is put in front; every normalised byte remembers where its source began. Neighbouring
symbols are merged, best score first, leftmost first among equals; symbols outside the vocabulary
become byte pieces. No piece joins a letter to a following U+2581, so each run of U+2581 with the
letters after it is merged by itself and remembered (a bounded memory for each task).

``bounds`` has one number more than ``ids``: piece i covers the source bytes ``bounds[i]`` to
``bounds[i + 1]``. The space put in front covers none.

Defined cases: a null text is empty; an empty text has no ids, ``bounds`` [0] and decodes to "".
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SPACE = "▁"
#: Segments whose ids a task remembers, and the longest that are merged many at once.
REMEMBERED = 200_000
SHORT = 32
NEVER = np.iinfo(np.int32).max
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class CharacterMap:
    """The compiled character map: its longest entry at a place of a text, and what replaces it."""

    def __init__(self, compiled: bytes):
        (size,) = struct.unpack_from("<I", compiled)
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.values = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that starts at ``at`` and its replacement."""

        def children(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        node, found = children(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node ^= children(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.values[found[1] : self.values.index(0, found[1])]


@dataclass
class PieceModel:
    """What encoding and decoding need of a model file. Small: the size of the vocabulary."""

    ids: dict[str, int]
    scores: dict[str, float]
    surfaces: list[bytes]
    byte_ids: list[int]
    kinds: list[int]
    dummy_prefix: bool
    trim: bool
    charsmap: bytes
    unknown: bytes
    lonely: str
    _held: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model of normal, unknown, control and byte pieces is needed")
        if not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model with byte fallback and white space as a prefix is needed")
        texts = [p.piece for p in proto.pieces]
        normal = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in normal):
            raise ValueError("a piece joins a letter to a following space")
        surfaces = [
            t.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(t[3:5], 16)]) if k == BYTE else b""
            for t, k in zip(texts, kinds, strict=True)
        ]
        byte_ids = [i for _, i in sorted((t, i) for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE)]
        # ASCII characters that are in no piece of two or more stand alone and end a segment.
        joined = set("".join(t for t in normal if len(t) > 1))
        lonely = "".join(chr(c) for c in range(128) if chr(c) not in joined and c != 32)
        spec = proto.normalizer_spec
        return cls(
            normal, {t: proto.pieces[i].score for t, i in normal.items()}, surfaces, byte_ids, kinds,
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.precompiled_charsmap,
            proto.trainer_spec.unk_surface.encode(), lonely,
        )

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its bytes and the end, the source byte.

        None stands for the plain case: nothing changed but spaces, U+2581 for each.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.charsmap and not self.trim and SPACE not in text:
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), None
        chars = self._held.setdefault("map", CharacterMap(self.charsmap) if self.charsmap else None)
        raw, out, source, at = text.encode(), [], [], 0
        space = SPACE.encode()

        def step(at: int) -> tuple[int, bytes]:
            found = chars.longest(raw, at) if chars else None
            if found:
                return found
            n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
            return n, raw[at : at + n]

        if self.trim:
            while at < len(raw) and (found := step(at))[1] == b" ":
                at += found[0]
            if at == len(raw):
                return "", np.array([at])
        if self.dummy_prefix:
            out.append(space)
            source += [at] * 3
        blank = self.trim
        while at < len(raw):
            n, new = step(at)
            if blank:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", space)
                out.append(shown)
                source += [at] * len(shown)
                blank = self.trim and new.endswith(b" ")
            at += n
        joined = b"".join(out)
        if self.trim:
            while joined.endswith(space):
                joined = joined[:-3]
                at = source[len(joined)]
                del source[len(joined) :]
        return joined.decode(), np.array([*source, at])

    def segment_ids(self, segment: str) -> bytes:
        """Ids of one segment as packed 32-bit numbers; time n log n in its length."""
        symbols, scores = list(segment), self.scores
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := scores.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(queue, (-score, i, symbols[i] + symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, i, merged = heapq.heappop(queue)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != merged:
                continue
            symbols[i], symbols[j], after[i] = merged, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        ids: list[int] = []
        for symbol in filter(None, symbols):
            known = self.ids.get(symbol)
            ids += [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]
        return np.array(ids, np.int32).tobytes()

    def encoder(self):
        """A function from texts to a pair of ids and bounds for each."""
        alone = re.escape(self.lonely)
        pieces = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        normal_bytes = np.array([len(t) + 2 * t.count(b" ") if k == NORMAL else 1 for t, k in zip(self.surfaces, self.kinds, strict=True)], np.int64)
        plain_bytes = np.array([max(1, len(t)) for t in self.surfaces], np.int64)
        merges = Merges(self)
        memory: dict[str, bytes] = {}

        def bounded(ids: np.ndarray, source: np.ndarray | None) -> np.ndarray:
            bounds = np.zeros(len(ids) + 1, np.int64)
            np.cumsum((plain_bytes if source is None else normal_bytes)[ids], out=bounds[1:])
            if source is not None:
                return source[bounds]
            bounds[1:] -= self.dummy_prefix
            return bounds

        def encode(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
            shown = [self.normalise(t) for t in texts]
            parts = [pieces(t) for t, _ in shown]
            new = set().union(*parts).difference(memory)
            if len(memory) + len(new) > REMEMBERED:
                memory.clear()
                new = set().union(*parts)
            short = [x for x in new if len(x) <= SHORT]
            long = new.difference(short)
            memory.update(merges.segment_ids(short))
            memory.update((x, self.segment_ids(x)) for x in long)
            ids = [np.frombuffer(b"".join(map(memory.__getitem__, p)), np.int32) for p in parts]
            for x in long:
                del memory[x]
            return [(i, bounded(i, source)) for i, (_, source) in zip(ids, shown, strict=True)]

        return encode

    def decoder(self):
        """A function from ids to their text."""
        shown = [self.unknown if k == UNKNOWN else s for s, k in zip(self.surfaces, self.kinds, strict=True)]

        def decode(ids: list[int]) -> str:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            raw = b"".join(map(shown.__getitem__, ids))
            if first is not None and self.dummy_prefix and self.kinds[first] == NORMAL:
                raw = raw.lstrip(b" ") if self.trim else raw[raw.startswith(b" ") :]
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return _one_by_one(raw)

        return decode


class Merges:
    """Merging of many short segments at once, a row of symbols for each.

    In every step each row joins its best pair. A symbol is a piece or another character of some
    piece; pairs that make a piece are found in a hash table of their two symbols.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        size = len(model.kinds)
        symbols = dict(model.ids)
        for char in set("".join(model.ids)):
            symbols.setdefault(char, size + len(symbols))
        self.of_char = np.full(0x110000, -1, np.int32)
        for text, i in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        levels = {score: k for k, score in enumerate(sorted(set(model.scores.values()), reverse=True))}
        pairs = [
            (symbols[t[:k]] << 32 | symbols[t[k:]], levels[model.scores[t]], i)
            for t, i in model.ids.items()
            for k in range(1, len(t))
            if t[:k] in symbols and t[k:] in symbols
        ]
        keys, rank, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bits = (8 * len(keys)).bit_length()
        n = 1 << self.bits
        self.keys, self.rank, self.made = np.full(n, -1, np.int64), np.full(n, NEVER, np.int32), np.zeros(n, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of its keys, the others try the next slot
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]
            here = self.keys[slot[left]] == keys[left]
            done = left[here]
            self.rank[slot[done]], self.made[slot[done]] = rank[done], made[done]
            left = left[~here]
            slot[left] = (slot[left] + 1) & (n - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each joined pair; rank NEVER where there is none."""
        keys = one.astype(np.int64) << 32 | two.astype(np.int64)
        keys[(one < 0) | (two < 0)] = -2
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return self.rank[slot], self.made[slot]

    def segment_ids(self, segments: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each segment and its packed ids. Segments of similar length share a step."""
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(-(-len(s) // 4), []).append(s)
        for quarter, group in by_length.items():
            for k in range(0, len(group), 20_000):
                yield from self._group(group[k : k + 20_000], 4 * quarter)

    def _group(self, group: list[str], width: int) -> Iterator[tuple[str, bytes]]:
        n = len(group)
        length = np.fromiter(map(len, group), np.int64, n)
        chars = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < length[:, None]
        rows = np.full((n, width + 1), -1, np.int32)
        rows[:, :width][inside] = self.of_char[chars]
        strange = ((rows[:, :width] < 0) & inside).any(axis=1)
        rank, made = (x.reshape(n, width) for x in self.look_up(rows[:, :-1].ravel(), rows[:, 1:].ravel()))
        active = np.arange(n)
        step = np.arange(width + 1)
        while len(active):
            best = rank[active].argmin(axis=1)
            go = rank[active, best] != NEVER
            active, best = active[go], best[go]
            if not len(active):
                break
            from_ = np.minimum(step + (step > best[:, None]), width)
            row, each = rows[active], np.arange(len(active))
            row[each, best] = made[active, best]
            # The spare last column is empty, so what moves in from the right is empty as well.
            row = np.take_along_axis(row, from_, axis=1)
            r = np.take_along_axis(rank[active], np.minimum(from_[:, :-1], width - 1), axis=1)
            m = np.take_along_axis(made[active], np.minimum(from_[:, :-1], width - 1), axis=1)
            r[each, best], m[each, best] = self.look_up(row[each, best], row[each, best + 1])
            prior = np.maximum(best - 1, 0)
            new_rank, new_made = self.look_up(row[each, prior], row[each, prior + 1])
            r[each, prior], m[each, prior] = new_rank, new_made
            length[active] -= 1
            rows[active], rank[active], made[active] = row, r, m
        # Characters that are no piece of their own become bytes, one segment at a time.
        strange |= (rows >= len(self.model.kinds)).any(axis=1)
        flat = rows[step < length[:, None]].tobytes()
        ends = (np.cumsum(length) * 4).tolist()
        starts = [0, *ends[:-1]]
        for s, odd, a, b in zip(group, strange.tolist(), starts, ends, strict=True):
            yield s, self.model.segment_ids(s) if odd else flat[a:b]


def _one_by_one(raw: bytes) -> str:
    """Text of possibly broken UTF-8: each byte that starts no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


def encode_texts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids, bounds`` for each document, and with ``decoded`` the text of the ids."""
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))  # a vocabulary, not data
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = model.value.encoder(), model.value.decoder()
        for batch in batches:
            for i, j in W.slices(batch.column(1)):
                found = encode([t or "" for t in batch.column(1)[i:j].to_pylist()])
                ids, bounds = zip(*found, strict=True)
                columns = [batch.column(0)[i:j], _lists(ids), _lists(bounds)]
                if decoded:
                    columns.append(pa.array([decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bounds", "decoded"][: len(columns)])

    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>, bounds array<int>" + ", decoded string" * decoded)


def decode_ids(rows: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` for each row; null ids give an empty text, ids outside the vocabulary fail."""
    model = rows.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model.value.decoder()
        for batch in batches:
            texts = [decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))

"""SentencePiece encoding that keeps source offsets, and decoding.

A model file is read as it is: pieces with scores and kinds, the flags of its normaliser, and the compiled character map, a
double-array trie from byte strings to replacements. Encoding of a text takes three steps.

1. *Normalise*: at every place the longest entry of the map that starts there is replaced, else one character is taken as
   it is; every character of the result remembers the byte of the source at which its entry began. Blanks become U+2581.
2. *Merge*: neighbouring symbols whose union is a piece are merged, the best score first, the leftmost of equal ones. No
   merge crosses a place where no piece has these two characters side by side, so texts are cut there into runs, and the
   pieces of runs met before are remembered by the worker.
3. *Project*: the bounds of every piece are looked up in the remembered places: ``starts`` and ``ends`` are bytes of the
   source. A character without a piece becomes its bytes; the last of them carries the character's span, those before it
   none. The blank set before a text has no width.

Defined cases: a null or empty text has no pieces and decodes to an empty text; a null ``doc_id`` is carried along; repeated
rows are encoded each; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not looked at. A very long
text is handled whole, by itself: a worker holds it with its pieces. Names of control pieces in a text are ordinary text.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import buffers, for_python, slices

BLANK = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Runs whose pieces a worker remembers; only time depends on it.
MEMORY = 750_000
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _fields(raw: bytes):
    """(number, value) of each field of a message: integers, four or eight bytes, or byte strings."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at:at + size]
        at += size


class CharacterMap:
    """The compiled map: longest entries that start at a place, by a walk through the double array."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size:]
        self.known: dict[int, str] = {}

    def longest(self, raw: bytes, at: int) -> tuple[str | None, int]:
        """Replacement of the longest entry at a place and its length, or (None, 0)."""
        units, found, node = self.units, None, 0
        if not units:
            return None, 0
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node ^= step(units[0])
        size = 0
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= step(unit)
            if unit & 256:
                found, size = units[node] & 0x7FFFFFFF, i + 1 - at
        return (None, 0) if found is None else (self.replacement(found), size)

    def replacement(self, place: int) -> str:
        if place not in self.known:
            self.known[place] = self.texts[place:self.texts.index(b"\0", place)].decode()
        return self.known[place]


class _Memory(dict):
    """Pieces of the runs met so far. Marks at the end of a run stand alone where no piece has them behind the character before."""

    def __init__(self, model: PieceModel):
        self.pieces_of, self.pairs = model.pieces_of, None if model.user else model.pairs

    def __missing__(self, run: str) -> bytes:
        end = len(run)
        while self.pairs and end > 1 and run[end - 1] in ".,;:!?)\"'" and run[end - 2:end] not in self.pairs:
            end -= 1
        self[run] = out = self.pieces_of(run) if end == len(run) else self[run[:end]] + b"".join([self[c] for c in run[end:]])
        return out


class PieceModel:
    """A model file with what a worker remembers of it."""

    def __init__(self, raw: bytes):
        pieces, self.unknown_text, self.byte_fallback, self.suffix = [], " ⁇ ", False, False
        self.dummy, self.squeeze, self.escape, charsmap, model_type = True, True, True, b"", 1
        for number, value in _fields(raw):
            if number == 1:
                inner = dict(_fields(value))
                pieces.append((inner.get(1, b"").decode(), struct.unpack("<f", inner.get(2, b"\0\0\0\0"))[0], inner.get(3, NORMAL)))
            elif number == 2:
                inner = dict(_fields(value))
                model_type = inner.get(3, model_type)
                self.byte_fallback = bool(inner.get(35, self.byte_fallback))
                self.suffix = bool(inner.get(24, self.suffix))
                self.unknown_text = inner[44].decode() if 44 in inner else self.unknown_text
            elif number == 3:
                inner = dict(_fields(value))
                charsmap = inner.get(2, charsmap)
                self.dummy, self.squeeze, self.escape = (bool(inner.get(k, v)) for k, v in ((3, self.dummy), (4, self.squeeze), (5, self.escape)))
        if model_type != 2:
            raise ValueError("only models of merged pairs (BPE) are read")
        self.map = CharacterMap(charsmap)
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.scores = {p: s for p, s, k in pieces if k in (NORMAL, USER, UNUSED)}
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)}
        self.unused = {p for p, _, k in pieces if k == UNUSED}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        user = sorted((p for p, _, k in pieces if k == USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        self.cut = self._cuts()
        self.memory = _Memory(self)
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.bytes_of = [b"" if k == CONTROL else self.unknown_text.encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() for p, _, k in pieces]

    def _cuts(self) -> re.Pattern:
        """Runs that no merge leaves: blanks and what follows them up to the next blank; characters of no longer piece."""
        longer = [p for p in self.ids if len(p) > 1]
        self.pairs = {a + b for p in longer for a, b in zip(p, p[1:])}
        if self.user or any(re.search(f"[^{BLANK}]{BLANK}", p) for p in longer):
            return re.compile(r"(?s).+")
        inside = set("".join(longer))
        alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c\xa0" if c not in inside)
        return re.compile((f"[{alone}]|" if alone else "") + f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte of the source."""
        raw = text.encode()
        blank = BLANK if self.escape else " "
        if not raw:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            body = text.replace(" ", blank)
            data = np.frombuffer(raw, np.uint8)
            places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))
            if not self.dummy:
                return body, places
            return (body + blank, np.append(places, len(raw))) if self.suffix else (blank + body, np.concatenate([[0], places]))
        units, at = [], 0
        while at < len(raw):
            new, size = self._user(raw, at) or self.map.longest(raw, at)
            if not size:
                first = raw[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = raw[at:at + size].decode()
            units.append((new, at))
            at += size
        chars, places = [], []
        skip = 0
        while self.squeeze and skip < len(units) and units[skip][0] == " ":
            skip += 1
        if skip == len(units):
            return "", np.zeros(1, np.int64)
        if self.dummy and not self.suffix:
            chars.append(blank)
            places.append(units[skip][1])
        after_blank = self.squeeze
        for new, place in units[skip:]:
            if after_blank:
                new = new.lstrip(" ")
            chars.extend(new.replace(" ", blank))
            places.extend([place] * len(new))
            if new:
                after_blank = self.squeeze and new.endswith(" ")
        end = len(raw)
        while self.squeeze and chars and chars[-1] == blank:
            chars.pop()
            end = places.pop()
        if self.dummy and self.suffix:
            chars.append(blank)
            places.append(end)
        return "".join(chars), np.array([*places, end], np.int64)

    def _user(self, raw: bytes, at: int) -> tuple[str, int] | None:
        """A symbol of the user's own at this place is taken as it stands."""
        if not self.user or raw[at] & 0xC0 == 0x80:
            return None
        hit = self.user.match(raw[at:at + 256].decode(errors="ignore"))
        return (hit.group(), len(hit.group().encode())) if hit else None

    def _symbols(self, run: str) -> tuple[list[str], list[bool]]:
        if not self.user:
            return list(run), [False] * len(run)
        out, fixed, at = [], [], 0
        while at < len(run):
            hit = self.user.match(run, at)
            out.append(hit.group() if hit else run[at])
            fixed.append(bool(hit))
            at += len(out[-1])
        return out, fixed

    def merge(self, run: str) -> list[str]:
        """Pieces of a run: the best pair first, the leftmost of equal ones."""
        if len(run) <= 48 and not self.user and not self.unused:
            return self._merge_short(list(run))
        symbols, fixed = self._symbols(run)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap, parts = [], {}

        def offer(left, right):
            if left < 0 or right < 0 or fixed[left] or fixed[right]:
                return
            union = symbols[left] + symbols[right]
            if union in self.scores:
                heapq.heappush(heap, (-self.scores[union], left, right, len(union)))
                if union in self.unused:
                    parts[union] = (symbols[left], symbols[right])
        for i in range(1, n):
            offer(i - 1, i)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])

        def whole(piece):
            if piece not in parts:
                return [piece]
            return whole(parts[piece][0]) + whole(parts[piece][1])
        return [p for s in symbols if s for p in (whole(s) if s in self.unused else [s])]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        score, none = self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], none)
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], none)
        return symbols

    def pieces_of(self, run: str) -> bytes:
        """Ids of a run, each followed by how many normalised characters it covers."""
        out = []
        for piece in self.merge(run):
            if piece in self.ids:
                out += self.ids[piece], len(piece)
            elif self.byte_fallback:
                for c in piece:
                    out += [x for b in c.encode() for x in (self.byte_ids[b], 0)]
                    out[-1] = 1
            else:
                out += self.unknown, len(piece)
        return array("i", out).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the source bytes at which each piece begins and ends."""
        normalised, places = self.normalise(text)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        both = np.frombuffer(b"".join(map(self.memory.__getitem__, self.cut.findall(normalised))), "<i4")
        ids, bounds = both[::2], np.zeros(len(both) // 2 + 1, np.int64)
        np.cumsum(both[1::2], out=bounds[1:])
        starts, ends = places[bounds[:-1]], places[bounds[1:]]
        if not self.byte_fallback and len(ids):  # unknown characters in a row are one piece
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            first = np.flatnonzero(new)
            ids, starts, ends = ids[first], starts[first], ends[np.append(first[1:], len(ids)) - 1]
        return ids, starts, ends

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are not UTF-8 become U+FFFD each."""
        ids = list(ids)
        if self.dummy and not self.squeeze and not self.suffix and self.controls.isdisjoint(ids):
            try:  # a run of bytes that is no UTF-8 alone is none beside whole pieces either
                text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
                return text[1:] if ids and self.kinds[ids[0]] in (NORMAL, USER, UNUSED) and text.startswith(" ") else text
            except UnicodeDecodeError:
                pass
        out, held = [], bytearray()

        def bytes_text():
            raw, text = bytes(held), ""
            held.clear()
            while raw:
                try:
                    return text + raw.decode()
                except UnicodeDecodeError as e:
                    text += raw[:e.start].decode() + "�"
                    raw = raw[e.start + 1:]
            return text
        first = True
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if held:
                out.append(bytes_text())
            if kind == CONTROL:
                continue
            piece = self.unknown_text if kind == UNKNOWN else self.pieces[i].replace(BLANK, " ")
            if first and (self.dummy or self.squeeze) and not self.suffix and kind != UNKNOWN and piece.startswith(" "):
                piece = piece[1:]
                first = self.squeeze and not piece
            else:
                first = False
            out.append(piece)
        if held:
            out.append(bytes_text())
        text = "".join(out)
        return text[:-1] if self.suffix and self.dummy and text.endswith(" ") else text


def model_path(file: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(file))


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The worker's model, kept between tasks."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts and ends of every document."""
    path = path or model_path()

    def run(batches):
        model = model_of(path)
        for batch in batches:
            text = batch.column("text")
            _, offsets = buffers(text)
            for a, z in slices(offsets):
                got = [model.encode(t or "") for t in text.slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), *(_lists([g[k] for g in got]) for k in range(3))], schema=ENCODED)
    docs = for_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids stand for. A null list of ids is an empty one."""
    path = path or model_path()

    def run(batches):
        model = model_of(path)
        for batch in batches:
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            for a in range(0, batch.num_rows, 256):
                part = ids.slice(a, 256)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 256), part, pa.array([model.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in part], pa.string())], ["doc_id", "ids", "text"])
    rows = for_python(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")

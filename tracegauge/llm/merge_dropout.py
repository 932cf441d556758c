"""Encoding and decoding with a merge-type SentencePiece model, with seeded merge-dropout.

A text is encoded as the library does it: pairs of neighbouring symbols stand in an agenda ordered by the
score of the piece they make, the leftmost first among equals, and are merged until none is left. With a
dropout rate, each candidate merge that comes up is skipped with that chance, independently of all others.
The chances are drawn from a keyed hash of the seed, the document's id and the place of the word in its
text. So one seed gives one result, every occurrence of a word and every copy of a text under another id is
segmented by itself, and every segmentation decodes to the same text.

No piece joins a character to a space behind it, so a run of spaces with the word behind it is encoded by
itself. Draws are taken as the numbers of the candidates that are skipped. Every step of a word takes one candidate,
so short words of many documents are merged side by side, a step of all of them at once. Words that are new are first
merged without skips (long ones by the library), and each worker keeps their ids, up to a bound and from task
to task; only words that skips change are merged again. Words with characters that are no pieces are merged one by one:
their segmentation depends on the word and the numbers alone, so it is kept too, and up to its first skip
a word is merged as without any, so words that come up with further skips do not search those merges again.

Decoding is exact for every text: characters without a piece become byte pieces, and so does U+2581, which
the library would take for a space. With rate 0 the ids are the library's for all texts without U+2581.

Defined results: a null or empty text has no ids and decodes to an empty text. Repeated rows (equal id and
text) are encoded alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.pretokens import Memo

MARK = "▁"
#: Units up to this length keep their agenda in a list instead of a heap.
SHORT = 40
#: Units up to this length are merged side by side, or their segmentations with skips are kept.
KEPT = 16
#: So many units are merged side by side.
SIDE_BY_SIDE = 1 << 13
#: Skips are drawn for so many candidates at once.
AHEAD = 64
#: So many characters of texts are looked through for new units at once.
GROUP = 500_000
#: Stands for a pair that makes no piece.
NONE = float("-inf")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that spreads neighbours (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Skips:
    """Which candidates are skipped at one rate, drawn as gaps: the number of candidates before the next skip."""

    def __init__(self, rate: int) -> None:
        chance = rate / 2**64
        self.bounds = [min(int((1 - (1 - chance) ** (k + 1)) * 2**64), 2**64 - 1) for k in range(AHEAD)]
        self.table = np.array(self.bounds, np.uint64)

    def keys(self, key: int, n: int) -> np.ndarray:
        """Keys of the ``n`` occurrences of a document."""
        return _mixed(np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The first gap of each occurrence; AHEAD stands for none among so many."""
        return np.searchsorted(self.table, keys, "right")

    def following(self, keys: np.ndarray) -> np.ndarray:
        """The keys that draw the gaps after those of ``keys``."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys.astype("<u8").view("V8").tolist()), np.uint64, len(keys))

    def of(self, key: int, unit: str) -> Iterator[int]:
        """The numbers of the skipped candidates of one occurrence, in order. A unit has fewer than three for each character."""
        at, end = bisect_right(self.bounds, key), 3 * len(unit)
        gap = at
        while at < end:
            if gap < AHEAD:
                yield at
                at += 1
            key = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"))
            gap = bisect_right(self.bounds, key)
            at += gap


class Pairs:
    """All pairs of pieces that make a piece, by number, to merge many units at once."""

    def __init__(self, score: dict[str, float], ids: dict[str, int]) -> None:
        #: Stands for no piece.
        self.none = max(ids.values()) + 1
        self.of_char = np.full(sys.maxunicode + 1, self.none, np.int32)
        found = []
        level = {s: i + 1 for i, s in enumerate(sorted({*score.values()}))}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    found.append((self._key(a, b), level[score[piece]], i))
        found.append((self._key(self.none, self.none), 0, self.none))
        self.keys, level, piece = np.array(sorted(found), np.int64).T.copy()
        self.level, self.piece = level.astype(np.int32), piece.astype(np.int32)

    def _key(self, a, b):
        return a * (self.none + 1) + b

    def _joined(self, a: np.ndarray, b: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For neighbours, of which the left ones stand at ``places``, when they come up (the largest number first, 0 for never) and the
        pieces they make."""
        keys = self._key(a.astype(np.int64), b)
        at = np.searchsorted(self.keys, keys)
        at[self.keys[at] != keys] = -1
        level = self.level[at]
        return np.where(level > 0, level * (KEPT + 1) + KEPT - places, 0), self.piece[at]

    def merge(self, units: list[str], keys: np.ndarray | None = None, gaps: np.ndarray | None = None, skips: Skips | None = None) -> Iterator[bytes | None]:
        """The ids of units of at most ``KEPT`` characters; None for units with a character that is no piece. ``keys`` gave
        the numbers ``gaps`` of their first skips."""
        for first in range(0, len(units), SIDE_BY_SIDE):
            part = slice(first, first + SIDE_BY_SIDE)
            yield from self._merge(units[part], *((keys[part].copy(), gaps[part].copy(), skips) if skips else (None, None, None)))

    def _merge(self, units: list[str], keys: np.ndarray | None, skip: np.ndarray | None, skips: Skips | None) -> Iterator[bytes | None]:
        n, lengths = len(units), np.fromiter(map(len, units), np.int64, len(units))
        first, rows = np.cumsum(lengths) - lengths, int(lengths.max()) + 1
        chars = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        own = np.logical_and.reduceat(chars != self.none, first)
        # The symbol that starts at character p of unit u stands at p * n + u. The last row holds no symbols; it is behind
        # every unit and, as the row before row 0, in front of it.
        place, unit = np.arange(len(chars)) - np.repeat(first, lengths), np.repeat(np.arange(n), lengths)
        symbols, agenda = np.full(rows * n, self.none, np.int32), np.zeros(rows * n, np.int32)
        made, behind = np.empty(rows * n, np.int32), np.arange(n, (rows + 1) * n, dtype=np.int32)
        before = behind - 2 * n
        symbols[place * n + unit] = chars
        pair = np.flatnonzero(unit[:-1] == unit[1:])
        at = place[pair] * n + unit[pair]
        agenda[at], made[at] = self._joined(chars[pair], chars[pair + 1], place[pair])
        table, live, number = agenda.reshape(rows, n), np.arange(n), 0
        while True:
            best = table.max(axis=0)[live] if 4 * len(live) > n else table[:, live].max(axis=0)
            found = best > 0
            live, best = live[found], best[found]
            if not len(live):
                break
            place = KEPT - best % (KEPT + 1)
            unit, left = live, place * n + live
            if skips:
                skipped = skip[unit] == number
                here = unit[skipped]
                agenda[left[skipped]] = 0
                keys[here] = skips.following(keys[here])
                # A unit of this length has fewer than AHEAD candidates, so each gap leads to a skip or behind the last.
                skip[here] = number + 1 + skips.first(keys[here])
                unit, left, place = unit[~skipped], left[~skipped], place[~skipped]
            number += 1
            right, piece = behind[left], made[left]
            symbols[left], symbols[right], agenda[right] = piece, self.none, 0
            after, front = behind[right], before[left]
            behind[left], before[after] = after, left
            agenda[left], made[left] = self._joined(piece, symbols[after], place)
            agenda[front], made[front] = self._joined(symbols[front], piece, front // n)
        symbols = symbols.reshape(rows, n).T
        kept = symbols != self.none
        ids, ends = symbols[kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return (ids[a:b] if o else None for a, b, o in zip([0, *ends], ends, own.tolist()))


class Model:
    """Pieces of a model file; in them a space is a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                plain = piece.replace(MARK, " ")
                self.score[plain], self.id[plain] = sp.get_score(i), i
                self.bytes.append(plain.encode())
        if any(re.search("[^ ] ", p) for p in self.id):
            raise ValueError("pieces of this model join a character to a space behind it")
        self.pairs = Pairs(self.score, self.id)
        self.units = re.compile(r" *[^ \n]+| +|\n" if not any("\n" in p for p in self.id) else r" *[^ ]+| +")

    def segment(self, unit: str, rate: int = 0, key: int = 0) -> list[str]:
        """The pieces of one unit; ``rate`` of 2**64 candidate merges is skipped, drawn by ``key``."""
        return self.without(unit, Skips(rate).of(key, unit) if rate else iter(()))[0]

    def without(self, unit: str, skips: Iterator[int]) -> tuple[list[str], int]:
        """The pieces of one unit, without the candidate merges whose numbers, in order, are in ``skips``, and
        how many candidates came up."""
        n, score = len(unit), self.score
        if n == 1:
            return [unit], 0
        if n <= SHORT:
            return self._short(unit, skips)
        number, skip = 0, next(skips, -1)
        symbols, before, after = list(unit), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            s = score.get(unit[i : i + 2])
            if s is not None:
                agenda.append((-s, i, unit[i : i + 2], i + 1))
        heapq.heapify(agenda)
        while agenda:
            _, left, piece, right = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != len(piece):
                continue
            number += 1
            if number - 1 == skip:
                skip = next(skips, -1)
                continue
            symbols[left], symbols[right] = piece, ""
            behind = after[left] = after[right]
            if behind >= 0:
                before[behind] = left
                s = score.get(piece + symbols[behind])
                if s is not None:
                    heapq.heappush(agenda, (-s, left, piece + symbols[behind], behind))
            front = before[left]
            if front >= 0:
                s = score.get(symbols[front] + piece)
                if s is not None:
                    heapq.heappush(agenda, (-s, front, symbols[front] + piece, left))
        return [s for s in symbols if s], number

    def _short(self, unit: str, skips: Iterator[int], trace: list[int] | None = None) -> tuple[list[str], int]:
        """The same for a short unit: the agenda is a list of scores, one for each pair of neighbours. ``trace`` takes
        the places of the candidates, in order."""
        return self._merged(list(unit), 0, -1, skips, trace)

    def after(self, unit: str, trace: bytes, first: int, skips: Iterator[int]) -> tuple[list[str], int]:
        """The same for a short unit whose first skip is number ``first``, by the trace of the unit without skips;
        ``skips`` gives the numbers that follow."""
        symbols = list(unit)
        for i in trace[:first]:
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return self._merged(symbols, first + 1, trace[first], skips)

    def _merged(self, symbols: list[str], number: int, skipped: int, skips: Iterator[int], trace: list[int] | None = None) -> tuple[list[str], int]:
        """Merges ``symbols`` to the end, after ``number`` candidates of which the last was skipped at ``skipped``."""
        get, skip = self.score.get, next(skips, -1)
        agenda = [get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        if skipped >= 0:
            agenda[skipped] = NONE
        while agenda:
            best = max(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            number += 1
            if trace is not None:
                trace.append(i)
            if number - 1 == skip:
                agenda[i], skip = NONE, next(skips, -1)
                continue
            piece = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(piece + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + piece, NONE)
        return symbols, number

    def plain(self, units: list[str]) -> Iterator[tuple[int, bytes]]:
        """For each unit the number of candidates, none of them skipped, and its ids. Short units are merged side by side,
        others by the library. It puts a space before what it encodes; units without one, with U+2581 or with
        byte pieces are merged here."""
        found = [None] * len(units)
        short = [i for i, u in enumerate(units) if len(u) <= KEPT]
        for i, ids in zip(short, self.pairs.merge([units[i] for i in short])):
            found[i] = ids
        is_byte = {*self.byte_ids}
        for unit, ids in zip(units, found):
            if ids:
                yield len(unit) - len(ids) // 4, ids
                continue
            ids = [] if unit[0] != " " or MARK in unit else self.library.encode(unit[1:], out_type=int)
            if not ids or not is_byte.isdisjoint(ids):
                pieces, candidates = self.without(unit, iter(()))
                yield candidates, self.packed(pieces)
            else:
                yield len(unit) - len(ids), array("i", ids).tobytes()

    def packed(self, pieces: list[str]) -> bytes:
        """The ids of pieces as little-endian 32-bit numbers."""
        try:
            return array("i", map(self.id.__getitem__, pieces)).tobytes()
        except KeyError:
            out = []
        for piece in pieces:
            i = self.id.get(piece)
            if i is None:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(i)
        return array("i", out).tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()[1:]


def _make_room(kept: dict, more: int, room: int) -> None:
    """Takes half of a full dictionary away, the newest entries: the common ones come first."""
    if len(kept) + more > room:
        for _ in range(len(kept) - max(0, min(room // 2, room - more))):
            kept.popitem()


class Encoder:
    """Encodes texts."""

    def __init__(self, path: str, dropout: float, seed: int, cache_size: int) -> None:
        self.model, self.seed = Model(path), seed
        self.skips = Skips(int(dropout * 2**64)) if int(dropout * 2**64) else None
        #: Without skips, by unit; and with skips, by unit and the numbers that came up and were skipped: the number of
        #: candidates that come up and the ids.
        self.known = Memo(lambda unit: next(self.model.plain([unit])), cache_size)
        self.varied, self.room = {}, cache_size
        #: Places of the candidates of units that came up with skips more than once; None after the first time.
        self.traces: dict[str, bytes | None] = {}

    def _learn(self, units: set[str]) -> None:
        """Encodes those units that are not known yet, as far as there is room."""
        new = [unit for unit in units if unit not in self.known][: self.room]
        if not new:
            return
        _make_room(self.known, len(new), self.room)
        self.known.update(zip(new, self.model.plain(new)))

    def _varied(self, unit: str, numbers: list[int]) -> tuple[int, bytes]:
        """A short unit, of which the candidates with these numbers are skipped."""
        if unit not in self.traces:
            _make_room(self.traces, 1, self.room)
            self.traces[unit] = None
            pieces, candidates = self.model.without(unit, iter(numbers))
        else:
            if self.traces[unit] is None:
                places: list[int] = []
                self.model._short(unit, iter(()), places)
                self.traces[unit] = bytes(places)
            pieces, candidates = self.model.after(unit, self.traces[unit], numbers[0], iter(numbers[1:]))
        return candidates, self.model.packed(pieces)

    def _with_skips(self, unit: str, key: int, gap: int) -> bytes:
        """The ids of one occurrence, whose key gives ``gap`` as the number of its first skip."""
        if len(unit) > KEPT:
            return self.model.packed(self.model.without(unit, self.skips.of(key, unit))[0])
        made, bounds, held, number = self.known[unit], self.skips.bounds, (unit,), gap
        # A unit that is kept has fewer than AHEAD candidates, so each gap leads to a skip or behind the last.
        while number < made[0]:
            held += (number,)
            made = self.varied.get(held)
            if not made:
                break
            key = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"))
            number += 1 + bisect_right(bounds, key)
        else:
            return made[1]
        numbers = [*held[1:]]
        while number < 3 * len(unit):
            key = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"))
            number += 1 + bisect_right(bounds, key)
            numbers.append(number)
        made = self._varied(unit, numbers)
        _make_room(self.varied, 1, self.room)
        self.varied[(unit, *[x for x in numbers if x < made[0]])] = made
        return made[1]

    def packed(self, text: str | None, document: object) -> bytes:
        """The ids of the text of a document as little-endian 32-bit numbers."""
        return next(self.packed_rows([(document, text)]))

    def packed_rows(self, rows: Iterable[tuple[object, str | None]]) -> Iterator[bytes]:
        """The same for each document and text. New units are learnt for some ``GROUP`` characters of texts at once."""
        held, size = [], 0
        for document, text in rows:
            held.append((document, self.model.units.findall(" " + text) if text else []))
            size += len(text or "")
            if size >= GROUP:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, rows: list[tuple[object, list[str]]]) -> Iterator[bytes]:
        units = [*chain.from_iterable(units for _, units in rows)]
        self._learn(set(units))
        if not self.skips:
            parts = [self.known[unit][1] for unit in units]
        elif units:
            # Units without room count as changed by skips.
            known = [*map(self.known.get, units, repeat((sys.maxsize, b"")))]
            parts = [made[1] for made in known]
            keys = np.concatenate([self.skips.keys(xxhash.xxh3_64_intdigest(f"{self.seed} {document}"), len(own)) for document, own in rows])
            gaps = self.skips.first(keys)
            changed = np.flatnonzero(gaps < np.fromiter((made[0] for made in known), np.int64, len(known)))
            at, short = changed.tolist(), np.fromiter((len(units[i]) <= KEPT for i in changed.tolist()), bool, len(changed))
            beside = changed[short]
            for i, ids in zip(beside.tolist(), self.model.pairs.merge([units[i] for i in beside.tolist()], keys[beside], gaps[beside], self.skips)):
                parts[i] = ids
            for i in at:
                if parts[i] is None or len(units[i]) > KEPT:
                    parts[i] = self._with_skips(units[i], int(keys[i]), int(gaps[i]))
        first = 0
        for _, own in rows:
            yield b"".join(parts[first : first + len(own)]) if own else b""
            first += len(own)


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(*arguments) -> Encoder:
    """The encoder of this worker process: the last one made stays, with what it has kept, for the tasks that follow."""
    if arguments not in _encoders:
        _encoders.clear()
        _encoders[arguments] = Encoder(*arguments)
    return _encoders[arguments]


def _rows(docs: DataFrame, doc_id: str, text: str, dropout: float) -> tuple[DataFrame, str]:
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", dropout: float = 0.1, seed: int = 1, cache_size: int = 500_000) -> DataFrame:
    """doc_id and ``ids`` of every row."""
    rows, id_type = _rows(docs, doc_id, text, dropout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, dropout, seed, cache_size)
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            parts = [*encoder.packed_rows(zip(batch.column(0).to_pylist(), texts))]
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``; its columns must not have that name."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [model.decode(x) if x else "" for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", dropout: float = 0.1, seed: int = 1, cache_size: int = 500_000) -> DataFrame:
    """Every row encoded and decoded in one task: doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids),
    decoded_sha256 and n_chars of the decoded text."""
    rows, id_type = _rows(docs, doc_id, text, dropout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, dropout, seed, cache_size)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts = (t.as_py() for t in batch.column(1))
            for packed in encoder.packed_rows(zip(batch.column(0).to_pylist(), texts)):
                decoded = encoder.model.decode(array("i", packed)) if packed else ""
                for to, x in zip(out, (len(packed) // 4, zlib.crc32(packed), hashlib.sha256(decoded.encode()).hexdigest(), len(decoded))):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "n_chars"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_ids long, ids_crc32 long, decoded_sha256 string, n_chars long")

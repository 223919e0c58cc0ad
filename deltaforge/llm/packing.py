"""Best-fit packing of tokenised documents into sequences, by bin completion.

Only lengths matter to packing, and there are at most as many as a sequence has places. So the driver gets a histogram
of lengths, whose size doesn't grow with the corpus, and works out patterns, each a list of lengths that fill one
sequence and how often it is used. Best fit gives the first solution. Branch and bound then looks for one with fewer
sequences: it completes a sequence around the largest length left, in the undominated fillings, the fullest first; a
branch ends where more room is wasted than a better solution may waste. A filling is used as often as the counts allow,
so a branch is as deep as there are patterns, not sequences. The search ends at a lower bound, which it nearly always
meets at once, or after ``NODES`` nodes; without that limit (``nodes=None``) it is exhaustive over such patterns.
Pieces then find their place by their number among those of their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from deltaforge.llm.hashing import CODES, PIECE, mix, pieces, powers, steady, text_buffer
from deltaforge.llm.work import Scratch

#: Nodes of the search for fewer sequences than best fit needs.
NODES = 100_000
#: What a step of the enumeration of fillings counts of a node.
STEP = 0.05
#: Words whose ids a task keeps.
CACHE = 300_000


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of lengths, largest first, as patterns: bins that are filled alike stay one entry."""
    plan: list[tuple[tuple[int, ...], int]] = []
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    open_: list[int] = []

    def put(bins: tuple[int, ...], room: int, n: int) -> None:
        if room not in rooms:
            bisect.insort(open_, room)
        own = rooms.setdefault(room, {})
        own[bins] = own.get(bins, 0) + n

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(open_, x)
            if at == len(open_):
                k = capacity // x  # a new bin takes as many as fit
                if left >= k:
                    put((x,) * k, capacity - k * x, left // k)
                    left %= k
                if left:
                    put((x,) * left, capacity - left * x, 1)
                break
            room = open_[at]
            bins, n = next(iter(rooms[room].items()))
            k = min(room // x, left)
            times = min(n, left // k)
            if n == times:
                del rooms[room][bins]
                if not rooms[room]:
                    del rooms[room]
                    open_.pop(at)
            else:
                rooms[room][bins] = n - times
            put(bins + (x,) * k, room - k * x, times)
            left -= k * times
    for own in rooms.values():
        plan += own.items()
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by room, and by the pieces over half a sequence, which are all apart."""
    best, half = 0, capacity // 2
    large = [(x, n) for x, n in counts.items() if x > half]
    for k in {0, *(x for x in counts if x <= half)}:
        alone = sum(n for x, n in large if x > capacity - k)
        shared = [(x, n) for x, n in large if x <= capacity - k]
        spare = sum((capacity - x) * n for x, n in shared)
        rest = sum(x * n for x, n in counts.items() if k <= x <= half)
        best = max(best, alone + sum(n for _, n in shared) + max(0, -(-(rest - spare) // capacity)))
    return best


def dominated(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``one`` fit into places as large as those of ``other``: then ``other`` is no worse."""
    rooms = sorted(other)
    for x in sorted(one, reverse=True):
        at = bisect.bisect_left(rooms, x)
        if at == len(rooms):
            return False
        room = rooms.pop(at)
        if room > x:
            bisect.insort(rooms, room - x)
    return True


class Sums:
    """By each of some rising lengths, the sums that it and shorter ones can make, as bits of a number."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.lengths, self.bits = capacity, (1 << capacity + 1) - 1, [], [1]

    def of(self, lengths: list[int]) -> list[int]:
        """bits[i]: sums of the first i lengths. What didn't change since the last call is kept."""
        same = 0
        for x, y in zip(lengths, self.lengths, strict=False):
            if x != y:
                break
            same += 1
        del self.bits[same + 1 :]
        for x in lengths[same:]:
            r, step = self.bits[-1], x
            while step <= self.capacity:
                r, step = r | (r << step) & self.mask, 2 * step
            self.bits.append(r)
        self.lengths = list(lengths)
        return self.bits


def fillings(room: int, lengths: list[int], counts: dict[int, int], waste: int, sums: list[int], budget: list[float]):
    """Undominated fillings of ``room`` that leave at most ``waste``, fullest first, then those of larger pieces.

    ``lengths`` are the keys of ``counts``, rising; ``sums`` is what ``Sums`` gives for them. A filling that could hold
    another piece is left out; so is one whose pieces fit into those of a filling that came before.
    """
    top, kept = bisect.bisect_right(lengths, room), []
    for total in range(room, max(-1, room - waste - 1), -1):
        if not sums[top] >> total & 1:
            continue
        stack = [(total, top - 1, ())]
        while stack and budget[0] > 0:
            rest, i, taken = stack.pop()
            budget[0] -= STEP
            if not rest:
                used = Counter(taken)
                if not any(counts[x] > used[x] for x in lengths[: bisect.bisect_right(lengths, room - total)]) and not any(dominated(taken, k) for k in kept):
                    kept.append(taken)
                    yield taken
                continue
            i = min(i, bisect.bisect_right(lengths, rest) - 1)
            if i < 0 or not sums[i + 1] >> rest & 1:
                continue
            x = lengths[i]
            if sums[i] >> rest & 1:
                stack.append((rest, i - 1, taken))
            for k in range(1, min(counts[x], rest // x) + 1):
                if sums[i] >> rest - k * x & 1:
                    stack.append((rest - k * x, i - 1, taken + (x,) * k))


def complete(histogram: dict[int, int], capacity: int, target: int, budget: list[float]) -> list[tuple[tuple[int, ...], int]] | None:
    """Patterns of at most ``target`` sequences, if the search finds some before ``budget`` nodes are used up."""
    counts, sums = dict(histogram), Sums(capacity)
    lengths = sorted(counts)
    waste = target * capacity - sum(x * n for x, n in counts.items())
    frames: list[list] = []  # choices left, pattern, times, waste of a sequence

    def move(pattern: tuple[int, ...], by: int) -> None:
        for x in pattern:
            counts[x] = counts.get(x, 0) + by
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect.bisect_left(lengths, x))
            elif counts[x] == by and by > 0:
                bisect.insort(lengths, x)

    while counts:
        if budget[0] <= 0 or waste < 0:
            return None
        first = lengths[-1]
        own = dict(counts)
        own[first] -= 1
        known = lengths if own[first] else lengths[:-1]
        frames.append([fillings(capacity - first, list(known), own, min(waste, capacity), list(sums.of(known)), budget), None, 0, 0, first])
        while frames:
            frame = frames[-1]
            if frame[1] is not None:  # the choice made before has failed
                move(frame[1], frame[2])
                waste += frame[2] * frame[3]
            budget[0] -= 1
            chosen = next(frame[0], None) if budget[0] > 0 else None
            if chosen is None:
                if budget[0] <= 0:
                    return None
                frames.pop()
                continue
            pattern = (frame[4], *chosen)
            lost = capacity - sum(pattern)
            times = min(counts[x] // k for x, k in Counter(pattern).items())
            if lost:
                times = min(times, waste // lost)
            frame[1:4] = pattern, times, lost
            move(pattern, -times)
            waste -= times * lost
            break
        if not frames:
            return None
    return [(frame[1], frame[2]) for frame in frames]


def patterns(histogram: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[tuple[list[int], int]]:
    """Lengths that share a sequence, and how many sequences hold them.

    First a solution that wastes no more than the lower bound allows is sought, then ever better ones than the last.
    """
    counts = {x: n for x, n in histogram.items() if n}
    best = best_fit(counts, capacity)
    least, size = lower_bound(counts, capacity), lambda plan: sum(n for _, n in plan)
    every = float("inf") if nodes is None else nodes
    if size(best) > least and (found := complete(counts, capacity, least, [every / 2])):
        best = found
    budget = [every / 2]
    while size(best) > least and (found := complete(counts, capacity, size(best) - 1, budget)):
        best = found
    return [(list(p), n) for p, n in best]


def runs(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """By length and rank of a piece, where it goes: rows of (length, first rank, first sequence, offset)."""
    taken, sequence, rows = Counter(), 0, []
    for pattern, times in plan:
        offset = 0
        for x in pattern:
            rows.append((x, taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


#: Texts of these characters only are split here, with the ids of known words; all others go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-įı-ňŊ-ſ]*")
_ASCII = re.compile(r"[\t\n\r -~]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")


class WordIds(dict):
    """Little-endian ids by word, from a tokenizer whose words end in a marked piece."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.ends = {k for w, k in tokenizer.get_vocab().items() if w.endswith("</w>")}

    def learn(self, words: list[str]) -> None:
        """Ids of many words in one call."""
        for at in range(0, len(words), 1000):
            part, own, k = words[at : at + 1000], [], 0
            for i in self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids:
                own.append(i)
                if i in self.ends:
                    self[part[k]] = np.array(own, "<u4").tobytes()
                    own, k = [], k + 1
            if k != len(part) or own:  # not the words it was given; each by itself
                for w in part:
                    self[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            if "<|" in t or not (_ASCII if t.isascii() else _PLAIN).fullmatch(t):
                split.append(None)
            else:
                split.append(_WORD.findall(t.lower()))
        used = set().union(*filter(None, split))
        unknown = used - self.keys()
        if len(self) + len(unknown) > CACHE and len(self):
            self.clear()
            unknown = used
        if unknown:
            self.learn(sorted(unknown))
        get = self.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]


#: Bytes of texts that are split in bulk: as above but without the apostrophe, of whose suffixes the tokenizer makes words.
_BULK = np.zeros(256, bool)
_BULK[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
_BULK[39] = False
#: 0 white space, 1 letters, 2 digits, each a word, 3 all else.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_SLOTS = 1 << 21


class BulkIds:
    """Ids of texts by looking up all words of about a megabyte at once in an open table of word hashes."""

    def __init__(self, tokenizer):
        self.one_by_one = WordIds(tokenizer)
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.used, self.flat, self.n = 0, np.zeros(1 << 16, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of known hashes; -1 for others."""
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        at = self.keys[slot]
        out = np.where(at == h, slot, -1)
        open_ = np.flatnonzero((at != h) & (at != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)
            at = self.keys[slot[open_]]
            hit = at == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (at != 0)]
        return out

    def learn(self, hashes: list[int], words: list[str]) -> None:
        known = self.one_by_one
        known.learn(sorted(set(words) - known.keys()))
        for h, w in zip(hashes, words, strict=True):
            ids = np.frombuffer(known[w], "<u4")
            slot = h & (_SLOTS - 1)
            while self.keys[slot]:
                slot = (slot + 1) & (_SLOTS - 1)
            while self.n + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.keys[slot], self.starts[slot], self.sizes[slot] = h, self.n, len(ids)
            self.flat[self.n : self.n + len(ids)] = ids
            self.n += len(ids)
            self.used += 1
        if len(known) > 10_000:  # those words are in the table now
            known.clear()

    def run(self, d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie side by side, and where each text's begin."""
        n = len(d)
        kind = _KIND[d]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        new = np.empty(n + 1, bool)
        new[0] = new[n] = True
        new[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | edge[1:n]
        bounds = np.flatnonzero(new)
        word = kind[bounds[:-1]] != 0
        s, e = bounds[:-1][word], bounds[1:][word]
        pw, inv = powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(CODES[d] * pw[:n], out=total[1:])
        h = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        slot = self.find(h)
        if (missing := np.flatnonzero(slot < 0)).size:
            new_h, first = np.unique(h[missing], return_index=True)
            if self.used + len(new_h) > _SLOTS // 2:
                self.clear()
                new_h, first = np.unique(h, return_index=True)
                missing = np.arange(len(h))
            at = missing[first]
            self.learn(new_h.tolist(), [d[a:b].tobytes().decode().lower() for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            slot[missing] = self.find(h[missing])
        size = self.sizes[slot].astype(np.int64)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.flat[np.repeat(self.starts[slot] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(s, starts)]

    def encode(self, column: pa.Array):
        """By row its ids, as an array of little-endian 32-bit numbers; null counts as empty."""
        data, offs = text_buffer(column)
        for lo, hi in pieces(offs):
            base, end = int(offs[lo]), int(offs[hi])
            d, starts = data[base:end], offs[lo : hi + 1] - base
            odd = np.concatenate(([0], np.cumsum(~_BULK[d] | _marked(d))))
            plain = odd[starts[1:]] == odd[starts[:-1]]
            if plain.all() and end - base <= 4 * PIECE:
                ids, first = self.run(d, starts)
                for k in range(hi - lo):
                    yield ids[first[k] : first[k + 1]]
                continue
            for k in range(hi - lo):
                own = d[starts[k] : starts[k + 1]]
                if plain[k]:
                    yield np.concatenate([np.zeros(0, np.uint32), *(self.run(part, np.array([0, len(part)]))[0] for part in _parts(own))])
                else:
                    yield np.frombuffer(self.one_by_one.encode([own.tobytes().decode()])[0], "<u4")


def _marked(d: np.ndarray) -> np.ndarray:
    """Characters that the bulk split leaves to the tokenizer: times, divided by, dotted capital I, n with apostrophe; marks of special tokens."""
    out = np.zeros(len(d), bool)
    out[1:] = ((d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))) | ((d[:-1] == 0xC4) & (d[1:] == 0xB0)) | ((d[:-1] == 0xC5) & (d[1:] == 0x89)) | ((d[:-1] == 60) & (d[1:] == 124))
    return out


def _parts(d: np.ndarray):
    """A text in parts of about a megabyte, cut at white space."""
    a = 0
    while a < len(d):
        b = min(len(d), a + PIECE)
        while b < len(d) and _KIND[d[b]]:
            b += 1
        yield d[a:b]
        a = b


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", numbered: bool = False) -> DataFrame:
    """Cut each document's ids into pieces of at most ``capacity``.

    A document is its tokens' ids and then ``end_id``; a null or empty text is ``end_id`` alone.

    :param tokenizer: path of a BPE vocabulary file with ``</w>`` word ends; the public 49k one by default.
    :param with_ids: add the ids as ``ids array<int>``.
    :param numbered: add ``part`` and ``nth long``, the piece's number among those of its length in its part (see ``pack``).
    :returns: ``id_col``, piece int, start long, length long, ids_crc32 long. Rows that repeat are cut each, a null id stays
        null, other columns are ignored. A text of any length is tokenised whole, in parts that end at white space.
    """
    fields = [(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids + [("part", pa.int64()), ("nth", pa.int64())] * numbered
    schema = pa.schema(fields)

    def run(batches):
        import public_tokenizers
        from tokenizers import Tokenizer

        known = BulkIds(Tokenizer.from_file(tokenizer or public_tokenizers.path("word_bpe_49k.json")))
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            docs_, rows = batch.column(0).to_pylist(), []
            for doc, ids in zip(docs_, known.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for k, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    rows.append((doc, k, a, len(own), zlib.crc32(own), *([own.astype(np.int32)] * with_ids), *((part, seen[len(own)]) if numbered else ())))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    sql = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", part long, nth long" * numbered
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(steady(run), sql)


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with part and nth, by task."""
    names = pieces.columns

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            nth = []
            for x in batch.column("length").to_pylist():
                nth.append(seen[x])
                seen[x] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())], names=[*names, "part", "nth"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{fields}, part long, nth long")


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 2048) -> DataFrame:
    """Give each piece its sequence and its offset there.

    ``pieces`` has length (1 to ``capacity``) and is read more than once: write it before. Rows that repeat are packed
    each. Adds sequence_id long and offset long; offsets are gapless from 0. Columns ``part`` and ``nth``, if there, tell
    pieces of a length apart, by number from 0 in each part; else they are made by task. They are left out of the result.
    """
    spark = pieces.sparkSession
    if "nth" not in pieces.columns:
        pieces = scratch.write(_numbered(pieces), "numbered")
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    sizes = pieces.groupBy("part", "length").count()
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}
    if not histogram:
        return pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = runs(patterns(histogram, capacity))
    shared = spark.sparkContext.broadcast(((table[:, 0] << 44) | table[:, 1], table[:, 1:]))
    # a piece's rank is its number in its part after those of the parts before: nothing is sorted
    ahead = sizes.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("ahead"))
    ranked = pieces.join(ahead, ["part", "length"]).select(*names, (F.col("nth") + F.col("ahead")).alias("rank"))
    last = len(names)

    def place(batches):
        keys, to = shared.value
        for batch in batches:
            rank = batch.column(last).to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) | rank, "right") - 1
            sequence, offset = to[at, 1] + rank - to[at, 0], to[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:last], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece, with ``id_col``, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is one piece, ``end_id``. Rows that repeat are packed each; a null id stays null; texts of any
    length are cut whole; among pieces of a length it doesn't matter which goes where. Other columns are ignored. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer, capacity, end_id, False, id_col, text_col, numbered=True), "pieces")
    return pack(pieces, scratch, capacity)

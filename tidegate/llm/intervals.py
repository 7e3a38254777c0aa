"""Byte-level substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A string of ``LENGTH`` bytes goes where it also starts earlier. What can repeat is brought together by
anchors and compared on an index:

* *Anchors.* A window of ``LENGTH`` bytes is known by the least of its hashed ``PHRASE``-byte phrases.
  Windows side by side mostly share it, so a document is a row of pieces, each with one anchor. Equal
  windows have equal anchors: a window can only repeat if its anchor is met twice.
* *Blocks.* Documents are dealt into blocks by a hash of the whole row, so that copies and a hot key
  are spread. Blocks exchange their anchors packed and learn which are repeated; pieces under those are
  sent on to the index that their anchor belongs to, equal ones once for each block.
* *Index.* The distinct pieces of an index are sorted into a Burrows-Wheeler transform. Its longest
  common prefixes (LCPs) are found in increasing order of their value: from the borders between
  intervals of suffixes with LCP l, backward extension by one byte gives those with LCP l + 1,
  breadth first, until the minimum length is reached. Suffixes that no border parts by then share
  ``LENGTH`` bytes. Of each such interval the earliest window stays, all others go.
* *Hot anchors.* The pieces of an anchor met more than ``HOT`` times would be too much for an index.
  They are cut into single windows, dealt by a hash of the whole window: equal ones still meet.

Cases: null, empty and short texts have nothing to remove; rows that share a key are one document whose
strings are compared by their start, so none removes one at the same start in another; rows with a
null key keep all their bytes and are no reference; texts are read whole, long ones in overlapping
segments; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidegate.llm.common import raw, start, written

LENGTH = 100
PHRASE = 32
BLOCK_BYTES = 8_000_000  # text of a block
SEGMENT = 1_000_000  # windows of a text looked at in one go
ANCHORS_PER_BUCKET = 1_500_000
INDEX_BYTES = 16_000_000  # pieces that meet in one task
PART_BYTES = 1 << 18  # text of one transform; up to 2^21 a sort key holds two ranks and a place
SEED = 14  # bytes, at most, whose intervals the sort finds
LONGEST_PIECE = 2_000  # windows
HOT = 8_000  # pieces of an anchor

_PLACE = np.uint64((1 << 24) - 1)  # low bits that hold a place in a chunk
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


# --- anchors and pieces --------------------------------------------------------------------------


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _C3
    x ^= x >> np.uint64(29)
    return x


def phrase_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of the ``PHRASE`` (32) bytes from each place on, by doubling from 8."""
    words = np.empty(len(text) - 7, dtype=np.uint64)
    for o in range(8):
        words[o::8] = np.frombuffer(text, dtype="<u8", count=(len(text) - o) // 8, offset=o)
    h = _stir(words * _C1)
    h = _stir(h[:-8] * _C2 + h[8:])
    return _stir(h[:-16] * _C1 + h[16:])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Pieces:
    """Pieces of the texts of a chunk: anchor, text number, start in the text, windows, place in the chunk."""

    def __init__(self, chunk: bytes, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        offsets = ends - sizes
        hashes = phrase_hashes(chunk)
        keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        # The phrase that each window is known by: the least, the first of equal ones.
        at = (_sliding_least(keyed, LENGTH - PHRASE + 1) & _PLACE).astype(np.int64)
        # Windows of one segment lie side by side; those across two are none.
        new = np.empty(len(at), dtype=bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        new[offsets] = True
        borders = ends[:-1] - LENGTH + 1  # first window across a border, up to the next segment
        new[borders] = True
        place = np.flatnonzero(new)
        n = np.diff(np.append(place, len(at)))
        segment = np.searchsorted(offsets, place, side="right") - 1
        real = place + LENGTH <= ends[segment]
        place, n, segment = place[real], n[real], segment[real]
        self.chunk = chunk
        self.anchor, self.place, self.n = hashes[at[place]], place, n
        self.row, self.start = rows[segment], starts[segment] + place - offsets[segment]

    def _set(self, **columns: np.ndarray) -> None:
        vars(self).update(columns)

    def keep(self, these: np.ndarray) -> None:
        self._set(**{name: getattr(self, name)[these] for name in ("anchor", "row", "start", "place", "n")})

    def _split(self, n: np.ndarray, windows: int | np.ndarray) -> None:
        """Cut pieces of ``n`` windows into such of at most ``windows``."""
        cuts = -(-n // windows)
        off = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * np.repeat(np.broadcast_to(windows, n.shape), cuts)
        self.keep(np.repeat(np.arange(len(n)), cuts))
        self._set(start=self.start + off, place=self.place + off)
        self.n = np.minimum(np.repeat(n, cuts) - off, np.repeat(np.broadcast_to(windows, n.shape), cuts))

    def merge(self) -> None:
        """Put neighbours with one anchor together, as in text that repeats itself, up to ``LONGEST_PIECE`` windows."""
        joins = np.zeros(len(self.n), dtype=bool)
        joins[1:] = (
            (self.anchor[1:] == self.anchor[:-1])
            & (self.row[1:] == self.row[:-1])
            & (self.place[1:] == self.place[:-1] + self.n[:-1])
        )
        if joins.any():
            first = np.flatnonzero(~joins)
            n = np.add.reduceat(self.n, first)
            self.keep(first)
            self._split(n, LONGEST_PIECE)

    def part(self, hot: np.ndarray) -> None:
        """Cut hot pieces into windows, each with a hash of its own for an anchor."""
        if hot.any():
            was_hot = np.repeat(hot, np.where(hot, self.n, 1))
            self._split(self.n, np.where(hot, 1, self.n))
            for i in np.flatnonzero(was_hot).tolist():
                self.anchor[i] = xxh3_64_intdigest(self.chunk[self.place[i] : self.place[i] + LENGTH])


def pieces(texts: list[bytes | None]) -> Iterator[Pieces]:
    """The pieces of all texts, some segments at a time."""
    held, size = [], 0

    def chunk() -> Pieces:
        sizes = np.array([len(part) for _, _, part in held])
        return Pieces(b"".join(part for _, _, part in held), *(np.array([h[i] for h in held]) for i in (0, 1)), sizes)

    for row, text in enumerate(texts):
        windows = len(text or b"") - LENGTH + 1
        for at in range(0, windows, SEGMENT):
            part = text if windows <= SEGMENT else text[at : at + SEGMENT + LENGTH - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield chunk()
                held, size = [], 0
    if held:
        yield chunk()


# --- the index -----------------------------------------------------------------------------------


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places by their next ``depth`` bytes (the text is a circle), equal ones in any order.

    Also, for each row of that order, whether its first ``seed`` bytes differ from the row's before,
    and ``seed``. Ranks by h bytes give those by up to 2 h; places that nothing else equals are left
    out of the later sorts.
    """
    n = len(text)
    bits = max(1, int(n - 1).bit_length())
    codes = np.zeros(256, dtype=np.uint64)
    met = np.flatnonzero(np.bincount(text, minlength=256))
    codes[met] = np.arange(len(met))
    wide = max(1, int(len(met) - 1).bit_length())
    h = max(1, min(depth, n, (63 - bits) // wide))
    code = codes[text]
    circle = np.concatenate([code, code[:h]])
    key = circle[:n].copy()
    for k in range(1, h):
        key <<= np.uint64(wide)
        key |= circle[k : k + n]
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    suffixes = (packed & low).astype(np.int32)
    top = packed >> np.uint64(bits)
    head = np.ones(n, dtype=bool)
    np.not_equal(top[1:], top[:-1], out=head[1:])
    rows = np.flatnonzero(head)
    size = np.diff(np.append(rows, n))
    rank = np.empty(n, dtype=np.int32)  # of a place: the first row of its equals
    rank[suffixes] = np.repeat(rows, size)
    seed, seeded = h, head.copy()
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # rows
    while h < depth and len(open_):
        step = min(h, depth - h)
        places = suffixes[open_]
        after = places + step
        after[after >= n] %= n
        first, second = rank[places], rank[after]
        if 3 * bits <= 64:
            packed = (first.astype(np.uint64) << np.uint64(2 * bits)) | (second.astype(np.uint64) << np.uint64(bits))
            packed |= places.astype(np.uint64)
            packed.sort()
            places = (packed & low).astype(np.int32)
            pair = packed >> np.uint64(bits)
        else:
            pair = first.astype(np.int64) * n + second
            order = np.argsort(pair)
            places, pair = places[order], pair[order]
        suffixes[open_] = places
        differs = np.ones(len(open_), dtype=bool)
        np.not_equal(pair[1:], pair[:-1], out=differs[1:])
        head[open_] = differs
        local = np.flatnonzero(differs)
        size = np.diff(np.append(local, len(open_)))
        rank[places] = np.repeat(open_[local], size)
        open_ = open_[np.repeat(size > 1, size)]
        h += step
        if h <= SEED:
            seed, seeded = h, head.copy()
    return suffixes, seeded, seed


def intervals(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each whether an interval of ``depth`` common bytes begins there.

    ``head[i]`` says that rows i - 1 and i share less than the length reached. The borders of the seed
    length come from its sort; from then on each length's are found from the last one's. A border at
    row p, found last, parts the interval left of it from what follows. Extended backward by a byte c of
    that interval, the two sides are rows of the c-bucket, and they are neighbours there: the row that
    the last c left of p leads to, and the one after it. That one is the new border.
    """
    n = len(text)
    suffixes, seeded, length = sorted_suffixes(text, depth)
    transform = text[suffixes - 1]  # place -1 is the last, of a circle
    order = np.argsort(transform, kind="stable").astype(np.int32)
    leads = np.empty(n, dtype=np.int32)  # row i -> row of the suffix that begins a byte before
    leads[order] = np.arange(n, dtype=np.int32)
    head = np.append(seeded, True)
    # A bucket of one byte ends where the next begins: borders from length 1 on.
    edges = np.flatnonzero(head)
    fresh, late = edges[1:], np.zeros(0, dtype=np.int64)  # borders found last; those not yet among the edges
    while length < depth and len(fresh):
        left = edges[np.searchsorted(edges, fresh) - 1]
        if len(late):
            near = np.searchsorted(late, fresh) - 1
            left = np.maximum(left, np.where(near >= 0, late[near], 0))
        # All rows of the intervals left of the borders; where they lead, the row after parts two sides
        # if it comes from beyond the border.
        size = fresh - left
        upto = np.cumsum(size)
        rows = np.arange(upto[-1], dtype=np.int32) + np.repeat((left - upto + size).astype(np.int32), size)
        after = leads[rows] + 1
        inside = ~head[after]
        after, border = after[inside], np.repeat(fresh.astype(np.int32), size)[inside]
        found = np.sort(after[order[after] >= border])
        fresh = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
        head[fresh] = True
        late = np.sort(np.concatenate([late, fresh]))
        if len(late) > len(edges) // 16:
            edges, late = np.flatnonzero(head), late[:0]
        length += 1
    return suffixes, head[:n]


def repeated(texts: list[bytes], keys: np.ndarray, places: np.ndarray, least: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts of windows that are elsewhere, in any of them, at a smaller (key, place).

    ``places`` are those of the texts' first bytes.
    """
    sizes = np.array([len(t) for t in texts])
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    suffixes, head = intervals(text, least)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    group = np.cumsum(head)
    shared = np.bincount(group)[group] > 1
    suffixes, group = suffixes[shared], group[shared]
    whole = suffixes + least <= ends[owner[suffixes]]
    suffixes, group = suffixes[whole], group[whole]
    owner = owner[suffixes]
    offset = suffixes - (ends - sizes)[owner]
    key, place = keys[owner], places[owner] + offset
    order = np.lexsort((place, key, group))
    group, key, place = group[order], key[order], place[order]
    begins = np.ones(len(group), dtype=bool)
    begins[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(group) else np.zeros(0, dtype=np.int64)
    later = (key > key[first]) | (place > place[first])
    owner, offset = owner[order][later], offset[order][later]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    return np.split(offset, np.searchsorted(owner, np.arange(1, len(texts))))


# --- blocks and buckets --------------------------------------------------------------------------


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Anchors to numbers below ``n``."""
    return ((x * _C2) >> np.uint64(33)) % np.uint64(n)


def _cut(values: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The different values of ``by``, each with the places that have it."""
    order = np.argsort(by, kind="stable")
    ordered = by[order]
    begins = np.append(np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1)), len(order))
    for lo, hi in zip(begins[:-1], begins[1:], strict=True):
        yield int(ordered[lo]), values[order[lo:hi]]


_MET = "bucket long, blocks binary, anchors binary, counts binary"


def _anchors_met(buckets: int):
    """(bucket, block, anchor, count) of a task's texts, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = np.array(batch.column(0).to_pylist(), dtype=np.int32)
            for found in pieces(raw(batch, "text")):
                order = np.lexsort((blocks[found.row], found.anchor))
                anchor, block = found.anchor[order], blocks[found.row][order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(order))).astype(np.int32)
                anchor, block = anchor[first], block[first]
                for bucket, at in _cut(np.arange(len(first)), _spread(anchor, buckets)):
                    row = [[bucket], [block[at].tobytes()], [anchor[at].tobytes()], [counts[at].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["bucket", "blocks", "anchors", "counts"])

    return run


def _unpacked(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


_REPEATED = "block long, anchors binary, hot binary, n long"


def _anchors_repeated(table: pa.Table) -> pa.Table:
    """For each block the anchors of a bucket that it shares, or holds repeatedly, and which of them are hot."""
    blocks, anchors, counts = (_unpacked(table, n, k) for n, k in (("blocks", "<i4"), ("anchors", "<u8"), ("counts", "<i4")))
    order = np.lexsort((blocks, anchors))
    blocks, anchors, counts = blocks[order], anchors[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(order) else order
    held = np.diff(np.append(first, len(order)))
    total = np.repeat(np.add.reduceat(counts, first), held) if len(order) else counts
    rows = []
    for block, at in _cut(np.flatnonzero(total > 1), blocks[total > 1]):
        mine, n = np.unique(anchors[at], return_index=True)
        hot = total[at][n] > HOT
        rows.append((block, mine.tobytes(), hot.tobytes(), int(counts[at].sum())))
    return _arrow(rows, _REPEATED)


_PACKED = "block long, docs binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, text) rows packed by block: whole texts go through two shuffles, and small."""
    deflate = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blocks = np.array(batch.column(0).to_pylist(), dtype=np.int64)
        keys = np.array(batch.column(1).to_pylist(), dtype="<i8")
        texts = [text or b"" for text in raw(batch, "text")]
        lengths = np.array([len(text) for text in texts], dtype="<i8")
        cells = []
        for block, at in _cut(np.arange(len(blocks)), blocks):
            head = np.array([len(at)], dtype="<i8").tobytes() + keys[at].tobytes() + lengths[at].tobytes()
            cells.append((block, deflate.compress(head + b"".join([texts[i] for i in at.tolist()]))))
        yield from _arrow(cells, _PACKED).to_batches()


def _in_order(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Keys and texts of a block's rows in an order that no shuffle changes: a row is known by its number.

    Equal rows come out alike, so it does not matter which of them has which number.
    """
    rows = []
    for cell in table.column("docs").to_pylist():
        cell = zstandard.decompress(cell)
        n = int.from_bytes(cell[:8], "little")
        keys, lengths = (np.frombuffer(cell, dtype="<i8", count=n, offset=8 + 8 * n * k).tolist() for k in (0, 1))
        at = 8 + 16 * n
        for key, length in zip(keys, lengths, strict=True):
            rows.append((key, cell[at : at + length]))
            at += length
    rows.sort()
    return [key for key, _ in rows], [text for _, text in rows]


_SENT = "bucket long, block long, anchors binary, keys binary, rows binary, starts binary, ns binary, bytes binary"
_SENT_KINDS = {"anchors": "<u8", "keys": "<i8", "rows": "<i4", "starts": "<i8", "ns": "<i4"}
_GONE = "block long, rows binary, starts binary, ns binary"


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _runs(rows: np.ndarray, starts: np.ndarray, ns: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return rows.astype("<i4").tobytes(), starts.astype("<i8").tobytes(), ns.astype("<i4").tobytes()


def _pieces_sent(buckets: int):
    """A block's pieces with repeated anchors, packed by the index that they go to.

    Windows of pieces that the block holds at a smaller place as well all go: they are no part of an
    index, whose task (a null ``bytes``) passes them on.
    """

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        anchors, hot = _unpacked(shared, "anchors", "<u8"), _unpacked(shared, "hot", "?")
        if not len(anchors):
            return _arrow([], _SENT)
        block = shared.column("block")[0].as_py()
        order = np.argsort(anchors)
        anchors, hot = anchors[order], hot[order]
        keys, texts = _in_order(docs)
        keys = np.array(keys, dtype=np.int64)
        seen: dict[bytes, tuple[int, int]] = {}
        out: list[tuple] = []
        for found in pieces(texts):
            at = np.minimum(np.searchsorted(anchors, found.anchor), len(anchors) - 1)
            found.keep(anchors[at] == found.anchor)
            found.merge()
            found.part(hot[np.searchsorted(anchors, found.anchor)])
            key = keys[found.row]
            bodies = [found.chunk[p : p + n + LENGTH - 1] for p, n in zip(found.place.tolist(), found.n.tolist(), strict=True)]
            # Rows are in order of their keys, so what was met before has a smaller place, or the same.
            places = zip(bodies, key.tolist(), found.start.tolist(), strict=True)
            late = np.array([seen.setdefault(body, (k, s)) < (k, s) for body, k, s in places], dtype=bool)
            if late.any():
                runs = _runs(found.row[late], found.start[late], found.n[late])
                out.append((block % buckets, block, None, None, *runs, None))
            here = np.flatnonzero(~late)
            for bucket, at in _cut(here, _spread(found.anchor[here], buckets)):
                runs = _runs(found.row[at], found.start[at], found.n[at])
                text = b"".join([bodies[i] for i in at.tolist()])
                out.append((bucket, block, found.anchor[at].astype("<u8").tobytes(), key[at].astype("<i8").tobytes(), *runs, text))
        return _arrow(out, _SENT)

    return run


def _index(table: pa.Table) -> pa.Table:
    """The windows that go, as runs (row, start, number) for each block, of the pieces that meet in one index."""
    passed = table.filter(pa.compute.is_null(table.column("bytes")))
    out = list(zip(*(passed.column(n).to_pylist() for n in ("block", "rows", "starts", "ns")), strict=True))
    table = table.filter(pa.compute.is_valid(table.column("bytes")))
    cells = {n: _unpacked(table, n, k) for n, k in _SENT_KINDS.items()}
    blocks = np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in table.column("anchors").to_pylist()])
    ns, row, key, place = (cells[n].astype(np.int64) for n in ("ns", "rows", "keys", "starts"))
    if not len(ns):
        return _arrow(out, _GONE)
    text = b"".join(table.column("bytes").to_pylist())
    sizes = ns + LENGTH - 1
    ends = np.cumsum(sizes)
    # Equal pieces are one string of the index, at the smallest of their places.
    number: dict[bytes, int] = {}
    cut = zip((ends - sizes).tolist(), ends.tolist(), strict=True)
    which = np.array([number.setdefault(text[b:e], len(number)) for b, e in cut])
    bodies = list(number)
    order = np.lexsort((place, key, which))
    first = order[np.concatenate([[True], np.diff(which[order]) != 0])]
    least_key, least_place, anchor = key[first], place[first], cells["anchors"][first]
    at_least = (key == least_key[which]) & (place == least_place[which])
    # All strings of an anchor lie in one part.
    order = np.argsort(anchor, kind="stable")
    gone: dict[int, np.ndarray] = {}
    part: list[int] = []
    held = 0
    for i, j in enumerate(order.tolist()):
        part.append(j)
        held += len(bodies[j])
        if i + 1 == len(order) or (held >= PART_BYTES and anchor[order[i + 1]] != anchor[j]):
            found = repeated([bodies[k] for k in part], least_key[part], least_place[part])
            gone.update((k, f) for k, f in zip(part, found, strict=True) if len(f))
            part, held = [], 0
    # Whole pieces whose string has a smaller place, and the runs of windows that the index found.
    whole = ~at_least
    runs = [(blocks[whole], row[whole], place[whole], ns[whole])]
    for j in np.flatnonzero(at_least).tolist():
        offsets = gone.get(int(which[j]))
        if offsets is not None:
            new = np.flatnonzero(np.concatenate([[True], np.diff(offsets) != 1]))
            n = np.diff(np.append(new, len(offsets)))
            runs.append((np.full(len(n), blocks[j]), np.full(len(n), row[j]), place[j] + offsets[new], n))
    blocks, row, place, ns = (np.concatenate(c) for c in zip(*runs, strict=True))
    out += [(b, *_runs(row[at], place[at], ns[at])) for b, at in _cut(np.arange(len(blocks)), blocks)]
    return _arrow(out, _GONE)


_KEPT = "key long, kept binary, n_bytes long, n_removed long, n_spans long"


def _kept(docs: pa.Table, gone: pa.Table) -> pa.Table:
    """A block's rows without the bytes that a window which goes covers."""
    keys, texts = _in_order(docs)
    rows, begins, ns = (_unpacked(gone, n, k) for n, k in (("rows", "<i4"), ("starts", "<i8"), ("ns", "<i4")))
    by_row = dict(_cut(np.arange(len(rows)), rows))
    out = []
    for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
        spans: list[list[int]] = []
        at = by_row.get(i, np.zeros(0, dtype=np.int64))
        for begin, end in sorted(zip(begins[at].tolist(), (begins[at] + ns[at] + LENGTH - 1).tolist(), strict=True)):
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])
        borders = [0, *(x for span in spans for x in span), len(text)]
        kept = b"".join(text[borders[j] : borders[j + 1]] for j in range(0, len(borders), 2))
        out.append((key, kept, len(text), sum(e - b for b, e in spans), len(spans)))
    return _arrow(out, _KEPT)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_bytes, n_removed, n_spans) of every row; ``kept`` is the bytes that stay, in order."""
    start(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    keyed = rows.where(F.col("key").isNotNull())
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, buckets = 1 + size // BLOCK_BYTES, 1 + size // 30 // ANCHORS_PER_BUCKET
    dealt = keyed.select(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).alias("block"), "key", "text")
    met = dealt.select("block", "text").mapInArrow(_anchors_met(buckets), _MET)
    shared = written(met.groupBy("bucket").applyInArrow(_anchors_repeated, _REPEATED), "shared-anchors")
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    indexes = 1 + n * (LENGTH + 35) // INDEX_BYTES
    packed = dealt.mapInArrow(_packed, _PACKED)
    sent = packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_pieces_sent(indexes), _SENT)
    gone = written(sent.groupBy("bucket").applyInArrow(_index, _GONE), "windows-gone")
    kept = packed.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_kept, _KEPT)
    none = F.lit(0).cast("long")
    keyless = rows.where(F.col("key").isNull()).select(
        "key",
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
    )
    return kept.unionByName(keyless).withColumnRenamed("key", key)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    kept = deduplicated(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Token ids as compressed files: an adaptive context-mixing range coder in independent blocks.

Every id is coded by one mixture of three distributions over ids. Order 2 bets on the id that last followed
the two ids before it, order 1 on the id that last followed the one before it, order 0 knows how frequent
each id is. The mixture's weights are the learned probabilities, per lane and state of confidence, that
order 2 and order 1 are right; order 0 has the rest. An id's interval is its share of order 0 and whatever
the other orders bet on it, in the order of ids, so all three orders add up on one id.

Order 0 is counted over a segment and stands at its head; a block starts with that table, empty contexts and
fresh weights, and adapts as it goes. Blocks of BLOCK_IDS ids carry a CRC-32 each; any block can be read with
its segment's head alone. Many blocks are coded side by side, one numpy lane each.

The mixture drives a range coder of 62 bits that puts out 32 bits at a time; carries are added to the words
already put out when a block is complete.

File format: Parquet rows, one a segment of consecutive documents, in ascending (part, seq): ``docs`` and
``sizes`` little-endian 64-bit integers, ``unnamed`` (how many of the first documents have no id), ``n_ids``,
``head`` (CRC-32 of docs, sizes and table, then the table: zlib of the gaps between ids and of their
frequencies, 16 bits each), and ``blocks``: records of header (magic "WTID", version, number of ids, CRC-32 of
the ids as little-endian 32-bit integers and of the payload, payload bytes) and payload (big-endian 32-bit words).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytebpe
from .common import materialize, partitions

BLOCK_IDS = 2048
SEGMENT_IDS = 1 << 23
LANES = 4096  # blocks coded side by side
_MAGIC = b"WTID"
_HEADER = struct.Struct("<4sBIII")
_NONE = 0xFFFF  # no id
_SLOTS = 10  # bits of a context's place
_WEIGHT, _FREQ = 10, 16  # bits of the weights' sum and of order 0's sum
_SUM = _WEIGHT + _FREQ
_SPAN, _LEAST = 62, 30  # bits of the coder's low end, and of the least span that is not shifted
_TAIL = (1 << _LEAST) - 1
_FADE, _RISE = 0x07FF07FF, 2046


class _Table:
    """Order 0: each id's frequency, 65536 in sum."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(freq)]).astype(np.int32)
        self.id_at = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    @classmethod
    def of(cls, ids: np.ndarray) -> _Table:
        count = np.bincount(ids, minlength=_NONE + 1)
        seen = count > 0
        freq = np.where(seen, 1 + count * ((1 << _FREQ) - seen.sum()) // max(len(ids), 1), 0)
        rest = (1 << _FREQ) - freq.sum()  # less than one for each id seen
        freq[np.argsort(-count, kind="stable")[:rest]] += 1
        return cls(freq)

    def pack(self) -> bytes:
        at = np.flatnonzero(self.freq)
        both = np.stack([np.diff(at, prepend=0), self.freq[at] - 1])
        return zlib.compress(both.astype("<u2").tobytes(), 9)

    @classmethod
    def unpack(cls, data: bytes) -> _Table:
        gap, less = np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64).reshape(2, -1)
        freq = np.zeros(_NONE + 1, np.int64)
        freq[np.cumsum(gap)] = less + 1
        return cls(freq)


def _contexts(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the order-1 and order-2 contexts. Both arrays are unsigned, 32 bits."""
    h = last * np.uint32(0x9E3779B1)
    g = before * np.uint32(0x85EBCA77)
    g += h
    g *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - _SLOTS)
    g >>= np.uint32(32 - _SLOTS)
    return h, g


class _Mixer:
    """What the lanes have learned: entries (id, confidence 0 to 3) by context, and two probabilities a state.

    The probabilities, that order 2 is right and that only order 1 is, are 15 bits each in one number; both sink
    by a sixteenth at every id and one of them rises by _RISE if it holds, so they stay below 2^15 in sum.
    """

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) << _SLOTS
        self.state_base = np.arange(lanes, dtype=np.int64) << 5
        self.one, self.two = (np.full(lanes << _SLOTS, _NONE << 2, np.int32) for _ in range(2))
        self.right = np.full(lanes << 5, (10000 << 16) | 4000, np.int32)

    def look(self, at1: np.ndarray, at2: np.ndarray) -> None:
        """at1, at2: the contexts' places, from base on."""
        self.at1, self.at2 = at1, at2
        self.e1, self.e2 = e1, e2 = self.one.take(at1), self.two.take(at2)
        self.id1, self.id2 = e1 >> 2, e2 >> 2
        state = e2 & 3
        state <<= 2
        state |= e1 & 3
        state <<= 1
        state += self.id1 == self.id2
        self.state = self.state_base[: len(at1)] + state
        self.p = p = self.right.take(self.state)
        self.w2 = p >> 21
        p1 = p >> 5
        p1 &= (1 << _WEIGHT) - 1
        self.w1 = p1
        self.w0 = (1 << _WEIGHT) - self.w2
        self.w0 -= p1

    def learn(self, fresh: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """fresh: entries of the ids that came; hit1: order 1 was right, whether or not order 2 was."""
        for table, at, e, hit in ((self.two, self.at2, self.e2, hit2), (self.one, self.at1, self.e1, hit1)):
            up = e | 3
            np.minimum(e + 1, up, out=up)
            table[at] = np.where(hit, up, fresh)
        p = self.p
        sunk = p >> 4
        sunk &= _FADE
        p -= sunk
        p += hit2 * np.int32(_RISE << 16)
        p += (hit1 > hit2) * np.int32(_RISE)
        self.right[self.state] = p


def _encode_lanes(grid: np.ndarray, short: int, table: _Table) -> list[np.ndarray]:
    """Payload words of each column of ``grid``; the last one has ``short`` ids, the others fill theirs."""
    steps, lanes = grid.shape
    start, freq = table.start, table.freq
    mixer = _Mixer(lanes)
    base = mixer.base
    last = before = np.zeros(lanes, np.uint32)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, (1 << _SPAN) - 1, np.int64)
    width = steps * _SUM // 32 + 3  # an id takes at most _SUM bits and a little
    words = np.zeros(lanes * width, np.int64)
    first = np.arange(lanes, dtype=np.int64) * width
    at = first.copy()
    for t in range(steps):
        if t == short:  # the short lane ends here; one word tells a number inside its span
            words[at[lanes - 1]] = (low[-1] + _TAIL) >> _LEAST
            at[lanes - 1] += 1
            lanes -= 1
            if not lanes:
                break
            low, span, last, before, base = low[:-1], span[:-1], last[:-1], before[:-1], base[:-1]
        x = grid[t, :lanes]
        at1, at2 = _contexts(last, before)
        mixer.look(base + at1, base + at2)
        id1, id2, w0, w1, w2 = mixer.id1, mixer.id2, mixer.w0, mixer.w1, mixer.w2
        hit2, hit1 = id2 == x, id1 == x
        cum = (id2 < x) * w2
        cum += (id1 < x) * w1
        cum <<= _FREQ
        cum += w0 * start.take(x)
        own = hit2 * w2
        own += hit1 * w1
        own <<= _FREQ
        own += w0 * freq.take(x)
        r = span >> _SUM
        low += r * cum
        np.multiply(r, own, out=span)
        full = np.flatnonzero(span <= _TAIL)
        top, to = low[full], at[full]
        words[to] = top >> _LEAST
        at[full] = to + 1
        low[full] = (top & _TAIL) << 32
        span[full] <<= 32
        mixer.learn((x << 2) | 1, hit2, hit1)
        last, before = x.astype(np.uint32), last
    if lanes:
        words[at[:lanes]] = (low + _TAIL) >> _LEAST
        at[:lanes] += 1
    size = at - first
    flat = words.reshape(-1, width)[np.arange(width) < size[:, None]]
    while (over := flat >> 32).any():
        flat &= 0xFFFFFFFF
        flat[:-1] += over[1:]  # a lane's first word has no carry: its number is below one
    return np.split(flat.astype(">u4"), np.cumsum(size)[:-1])


def encode_ids(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[_Table, bytes]:
    """(order 0, block records) of ``ids``, each below 65535."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < _NONE:
        raise ValueError("an id is out of range")
    table, records = _Table.of(ids), []
    for lo in range(0, len(ids), LANES * block):
        part = np.asarray(ids[lo : lo + LANES * block], np.int32)
        lanes = -(-len(part) // block)
        short = len(part) - (lanes - 1) * block
        grid = np.zeros(lanes * block, np.int32)
        grid[: len(part)] = part
        payloads = _encode_lanes(np.ascontiguousarray(grid.reshape(lanes, block).T), short, table)
        crcs = part.astype("<u4")
        for k, words in enumerate(payloads):
            own = crcs[k * block : (k + 1) * block]
            crc = zlib.crc32(words, zlib.crc32(own))
            records += [_HEADER.pack(_MAGIC, 2, len(own), crc, words.nbytes), words.tobytes()]
    return table, b"".join(records)


def _decode_lanes(payloads: list[np.ndarray], sizes: np.ndarray, table: _Table) -> np.ndarray:
    """Ids by (step, lane); sizes descend."""
    lanes, steps = len(payloads), int(sizes[0])
    width = max(map(len, payloads)) + 3
    grid = np.zeros((lanes, width), np.int64)
    for row, p in enumerate(payloads):
        grid[row, : len(p)] = p
    code = (grid[:, 0] << _LEAST) | (grid[:, 1] >> 2)
    ahead = (((grid[:, 1:-1] & 3) << _LEAST) | (grid[:, 2:] >> 2)).ravel()  # the 32 bits behind those read, word by word
    at = np.arange(lanes, dtype=np.int64) * (width - 2)
    span = np.full(lanes, (1 << _SPAN) - 1, np.int64)
    mixer = _Mixer(lanes)
    base = mixer.base
    got = np.zeros((steps + 2, lanes), np.uint32)
    start, freq, id_at = table.start, table.freq, table.id_at
    end = start[1:]
    live = lanes
    for t in range(steps):
        if sizes[live - 1] <= t:
            live = int(np.searchsorted(-sizes, -t, side="left"))
            code, span, at, base = code[:live], span[:live], at[:live], base[:live]
        at1, at2 = _contexts(got[t + 1, :live], got[t, :live])
        mixer.look(base + at1, base + at2)
        id2, id1, w0 = mixer.id2, mixer.id1, mixer.w0
        b2, b1 = mixer.w2 << _FREQ, mixer.w1 << _FREQ
        r = span >> _SUM
        v = (code.view(np.uint64) // r.view(np.uint64)).astype(np.int32)
        # a bet stands behind the id's share of order 0: how far v is past the bets' beginnings
        past2 = v - w0 * end.take(id2)
        first = id1 < id2
        past2 -= first * b1
        past1 = v - w0 * end.take(id1)
        past1 -= ~first * b2
        v -= (past2 >= b2) * b2
        v -= (past1 >= b1) * b1
        x = id_at.take((v / w0).astype(np.int32), mode="clip")
        # unsigned, what is before a bet is past its end
        np.copyto(x, id1, where=past1.view(np.uint32) < b1.view(np.uint32))
        np.copyto(x, id2, where=past2.view(np.uint32) < b2.view(np.uint32))
        got[t + 2, :live] = x
        hit2, hit1 = id2 == x, id1 == x
        cum = (id2 < x) * b2
        cum += (id1 < x) * b1
        cum += w0 * start.take(x)
        own = hit2 * b2
        own += hit1 * b1
        own += w0 * freq.take(x)
        code -= r * cum
        np.multiply(r, own, out=span)
        full = np.flatnonzero(span <= _TAIL)
        to = at[full]
        code[full] = (code[full] << 32) | ahead.take(to, mode="clip")  # a damaged block may run over its end
        span[full] <<= 32
        at[full] = to + 1
        x <<= 2
        x |= 1
        mixer.learn(x, hit2, hit1)
    return got[2:]


def decode_ids(table: _Table, data: bytes) -> np.ndarray:
    """All ids of a run of block records, little-endian 32 bits each. Raises ValueError on a damaged record."""
    heads, payloads, at = [], [], 0
    while at < len(data):
        if at + _HEADER.size > len(data):
            raise ValueError("not a block record")
        magic, version, n, crc, size = _HEADER.unpack_from(data, at)
        at += _HEADER.size
        if magic != _MAGIC or version != 2 or at + size > len(data) or not n or size % 4:
            raise ValueError("not a block record")
        heads.append((n, crc))
        payloads.append(np.frombuffer(data, ">u4", size // 4, at))
        at += size
    out = []
    for lo in range(0, len(heads), LANES):
        part = heads[lo : lo + LANES]
        order = sorted(range(len(part)), key=lambda k: -part[k][0])
        with np.errstate(divide="ignore"):  # damaged blocks again; their checksum tells
            got = _decode_lanes([payloads[lo + k] for k in order], np.array([part[k][0] for k in order], np.int64), table).T
        rows = [b""] * len(part)
        for row, k in enumerate(order):
            rows[k] = np.ascontiguousarray(got[row, : part[k][0]], "<u4")
            if zlib.crc32(payloads[lo + k], zlib.crc32(rows[k])) != part[k][1]:
                raise ValueError(f"checksum of block {lo + k} is wrong")
        out += rows
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# ---------------------------------------------------------------- files
_FILE = "part int, seq int, docs binary, sizes binary, unnamed int, n_ids long, head binary, blocks binary"
_NAMES = [c.split()[0] for c in _FILE.split(", ")]
_HEAD = struct.Struct("<I")


def _segment(part: int, seq: int, docs: np.ndarray, unnamed: int, sizes: np.ndarray, ids: np.ndarray) -> tuple:
    table, blocks = encode_ids(ids)
    d, s, t = docs.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), table.pack()
    return part, seq, d, s, unnamed, len(ids), _HEAD.pack(zlib.crc32(d + s + t)) + t, blocks


def read_segment(docs: bytes, sizes: bytes, head: bytes, blocks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, sizes, ids) of a stored segment. Raises ValueError if any part of it is damaged."""
    table = head[_HEAD.size :]
    if _HEAD.unpack_from(head)[0] != zlib.crc32(docs + sizes + table):
        raise ValueError("checksum of a segment's head is wrong")
    d, s = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8")
    ids = decode_ids(_Table.unpack(table), blocks)
    if s.sum() != len(ids):
        raise ValueError("segment and index differ")
    return d, s, ids


def encode_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of all documents in ascending id order, END_ID after each document. One task makes the segments of one id range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, n = bytebpe.load(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []

        def segment() -> pa.RecordBatch:
            docs, unnamed, sizes, ids = zip(*held)
            row = _segment(part, seq, np.concatenate(docs), sum(unnamed), np.concatenate(sizes), np.concatenate(ids))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], _NAMES)

        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            names, at = batch.column(0), 0
            for sizes, ids in enc.encode(batch.column(1)):
                own = names.slice(at, len(sizes))
                held.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.null_count, sizes, ids))
                at, n = at + len(sizes), n + len(ids)
                if n >= SEGMENT_IDS:
                    yield segment()
                    seq, n = seq + 1, 0
        if held:
            yield segment()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # repeated ids: by hash, so that one id's rows are no single range
    src = src.withColumn("h", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return src.select("doc_id", "text").mapInArrow(run, _FILE)


def read_files(files: DataFrame) -> DataFrame:
    """Documents read back from segments: doc_id, start (ids of all documents before it), ids binary (little-endian 32-bit integers)."""
    return _read(files, lambda ids: ids.tobytes(), "ids binary")


def read_digests(files: DataFrame) -> DataFrame:
    """read_files() reduced where it is read: doc_id, start, n_tokens, ids_crc32."""
    return _read(files, zlib.crc32, "ids_crc32 long")


def _read(files: DataFrame, value, column: str) -> DataFrame:
    name, kind = column.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes, ids = read_segment(row["docs"], row["sizes"], row["head"], row["blocks"])
                if len(ids) != row["n_ids"]:
                    raise ValueError("segment and index differ")
                ends = np.cumsum(sizes)
                unnamed = np.arange(len(docs)) < row["unnamed"]
                for lo in range(0, len(docs), 1024):
                    cut = slice(lo, lo + 1024)
                    values = [value(ids[e - s : e]) for s, e in zip(sizes[cut].tolist(), ends[cut].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[cut], pa.int64(), mask=unnamed[cut]), pa.array(row["start"] + ends[cut] - sizes[cut]), pa.array(sizes[cut]), pa.array(values, pa.binary() if kind == "binary" else pa.int64())],
                        ["doc_id", "start", "n_tokens", name],
                    )

    # offsets: of parts among parts (one row a part), then of segments within their part
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    index = files.select("part", "seq", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    index = index.join(totals, F.col("part") == F.col("p")).select(F.col("part").alias("ip"), F.col("seq").alias("iq"), (F.col("before") + F.col("within")).alias("start"))
    placed = files.join(index, (F.col("part") == F.col("ip")) & (F.col("seq") == F.col("iq"))).drop("ip", "iq")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def write_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write the files to the shared folder, and digest what is read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are END_ID alone. Rows with a null id come first. Repeated ids stand next to each
    other, by text hash; repeated rows have a place each. Very long texts are coded whole, in a segment as
    large as they need. Ties of id and text hash go by the rows' place in their task, which changes no value.
    Other columns of ``docs`` don't matter, whatever their names. An empty table gives an empty table.
    """
    return read_digests(materialize(encode_files(docs, path, id_col, text_col), "ids"))

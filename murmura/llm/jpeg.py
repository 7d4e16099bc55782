"""Baseline JPEG in numpy: marker parsing, Huffman scans, thumbnails of the DC values; and a lossless store.

Reading. Entropy-coded segments (the stretches between restart markers) of all images of a batch are
decoded in lockstep, one Huffman symbol of every segment at each step, so that numpy works on whole
columns. The DC value of a luminance block gives the mean of its 8 x 8 pixels; these means are the
thumbnail. Grey, colour, subsampled, interleaved and separate scans are read; anything that isn't
sequential 8-bit Huffman coding, and damaged data, gives an error text and null fields instead.

Storing. A payload of 64 n bytes becomes the quantised coefficients of n blocks, one byte to one
coefficient in zigzag order: byte b is stored as b - 112, or b - 111 from 112 on, so never as 0, and
text mostly as small numbers. Each block is a restart interval. The image has about as many blocks in a
row as rows; blocks beyond the payload hold byte 0. An APP4 segment holds the payload's length.

Defined results: a null or empty text has a payload of 64 zero bytes; equal texts have equal images;
null or empty media give the error 'no start of image'; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH = 4 << 20
_TAG = b"PAYL"
#: Code lengths of the stored images' tables, by symbol.
_AC_LENGTHS = {0x03: 2, 0x04: 2, 0x02: 3, 0x07: 3, 0x01: 4, 0x05: 5, 0x08: 5, 0x06: 6, 0x00: 7, 0xF0: 8}
_DC_LENGTHS = {0x03: 2, 0x04: 2, 0x02: 3, 0x07: 3, 0x01: 4, 0x05: 5, 0x08: 5, 0x06: 6, 0x00: 7}


class BadImage(Exception):
    """Something that can't be read as baseline JPEG."""


# -- Huffman tables


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes counted up by length and then symbol order given."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def look_up_table(codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """length * 256 + symbol for each 16 bits to come; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, n) in codes.items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == i for _, n in order) for i in range(1, 17))
    return bytes([kind]) + counts + bytes(s for s, _ in order)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


# -- storing


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _grid(payload_bytes: int) -> tuple[int, int]:
    blocks = payload_bytes // 64
    wide = math.isqrt(blocks - 1) + 1
    return wide, -(-blocks // wide)


class _Writer:
    def __init__(self):
        c = np.arange(256)
        coefficient = np.where(c < 112, c - 112, c - 111)
        size = np.array([int(abs(x)).bit_length() for x in coefficient])
        extra = np.where(coefficient < 0, coefficient + (1 << size) - 1, coefficient)
        self.length = np.empty((2, 256), np.int64)
        self.bits = np.empty((2, 256), np.uint16)
        for i, lengths in enumerate((_DC_LENGTHS, _AC_LENGTHS)):
            codes = canonical(lengths)
            n = np.array([codes[s][1] for s in size])
            self.length[i] = n + size
            self.bits[i] = (np.array([codes[s][0] for s in size]) << size | extra) << (16 - self.length[i])

    def scans(self, blocks: np.ndarray, firsts: np.ndarray) -> list[bytes]:
        """The scan of each image; blocks: uint8[n, 64]; firsts: the first block of each image, and n."""
        n = len(blocks)
        length = np.empty((n, 65), np.uint8)
        bits = np.empty((n, 65), ">u2")
        length[:, 0], bits[:, 0] = self.length[0][blocks[:, 0]], self.bits[0][blocks[:, 0]]
        length[:, 1:64], bits[:, 1:64] = self.length[1][blocks[:, 1:]], self.bits[1][blocks[:, 1:]]
        total = length[:, :64].sum(1, dtype=np.int64)
        length[:, 64], bits[:, 64] = -total % 8, 0xFFFF
        wanted = np.arange(16, dtype=np.uint8) < length.reshape(-1, 1)
        packed = np.packbits(np.unpackbits(bits.reshape(-1).view(np.uint8)).reshape(-1, 16)[wanted])
        own = (total + 7) // 8
        stuffed = packed == 0xFF
        extra = np.cumsum(stuffed) - stuffed
        block = np.repeat(np.arange(n), own)
        at = np.arange(len(packed)) + extra + 2 * block
        out = np.zeros(len(packed) + int(stuffed.sum()) + 2 * n, np.uint8)
        out[at] = packed
        ends = np.cumsum(own) - 1
        close = at[ends] + 1 + stuffed[ends]
        out[close] = 0xFF
        out[close + 1] = 0xD0 + (np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))) % 8
        stops = close[firsts[1:] - 1]  # the last block of an image is followed by no restart marker
        starts = np.concatenate([[0], stops[:-1] + 2])
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]


_WRITER: list[_Writer] = []


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload (each a positive multiple of 64 bytes)."""
    if not payloads:
        return []
    if not _WRITER:
        _WRITER.append(_Writer())
    grids = [_grid(len(p)) for p in payloads]
    full = [p + bytes(64 * w * h - len(p)) for p, (w, h) in zip(payloads, grids)]
    firsts = np.concatenate([[0], np.cumsum([len(p) // 64 for p in full])])
    scans = _WRITER[0].scans(np.frombuffer(b"".join(full), np.uint8).reshape(-1, 64), firsts)
    tables = _segment(0xDB, bytes([0]) + bytes([1] * 64))
    huffman = _segment(0xC4, _dht(0x00, _DC_LENGTHS)) + _segment(0xC4, _dht(0x10, _AC_LENGTHS))
    out = []
    for p, (w, h), scan in zip(payloads, grids, scans):
        frame = bytes([8]) + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
        out.append(
            b"\xff\xd8" + _segment(0xE4, _TAG + len(p).to_bytes(8, "big")) + tables + _segment(0xC0, frame) + huffman
            + _segment(0xDD, b"\x00\x01") + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + scan + b"\xff\xd9"
        )
    return out


# -- reading


@dataclass
class Component:
    ident: int
    across: int
    down: int
    table: int


@dataclass
class Scan:
    members: list[tuple[int, int, int]]  # component's place, DC table, AC table
    start: int
    end: int
    restart: int
    tables: dict[int, bytes]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, list[int]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    payload_bytes: int | None = None

    @property
    def most(self) -> tuple[int, int]:
        return max(c.across for c in self.components), max(c.down for c in self.components)

    def blocks(self, i: int) -> tuple[int, int]:
        """Rows and columns of blocks that hold a component's own pixels."""
        c, (across, down) = self.components[i], self.most
        return -(-(-(-self.height * c.down // down)) // 8), -(-(-(-self.width * c.across // across)) // 8)


def parse(data: bytes) -> Image:
    """What the markers say."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    image, at, restart, tables = Image(), 2, 0, {}
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise BadImage("marker expected")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise BadImage("segment cut short")
        at += 2 + size
        if marker == 0xDB:
            _quantisation(image, body)
        elif marker == 0xC4:
            _huffman(tables, body)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            _frame(image, body)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise BadImage("not sequential Huffman coding")
        elif marker == 0xE4 and body[:4] == _TAG:
            image.payload_bytes = int.from_bytes(body[4:12], "big")
        elif marker == 0xDA:
            end = _scan_end(data, at)
            image.scans.append(Scan(_members(image, body), at, end, restart, dict(tables)))
            at = end
    if not image.scans:
        raise BadImage("no scan")
    return image


def _quantisation(image: Image, body: bytes) -> None:
    at = 0
    while at < len(body):
        wide, n = body[at] >> 4, 128 if body[at] >> 4 else 64
        values = body[at + 1 : at + 1 + n]
        if len(values) != n:
            raise BadImage("quantisation table cut short")
        image.quant[body[at] & 15] = list(np.frombuffer(values, ">u2" if wide else np.uint8))
        at += 1 + n


def _huffman(tables: dict[int, bytes], body: bytes) -> None:
    at = 0
    while at < len(body):
        n = sum(body[at + 1 : at + 17])
        if at + 17 + n > len(body):
            raise BadImage("Huffman table cut short")
        tables[body[at]] = body[at + 1 : at + 17 + n]
        at += 17 + n


def _frame(image: Image, body: bytes) -> None:
    if len(body) < 6 or body[0] != 8 or len(body) != 6 + 3 * body[5] or not body[5]:
        raise BadImage("frame not understood")
    image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
    if not (image.height and image.width and all(0 < c.across < 5 and 0 < c.down < 5 for c in image.components)):
        raise BadImage("frame without size")


def _members(image: Image, body: bytes) -> list[tuple[int, int, int]]:
    places = {c.ident: i for i, c in enumerate(image.components)}
    n = body[0] if body else 0
    if not n or len(body) < 1 + 2 * n or any(body[1 + 2 * i] not in places for i in range(n)):
        raise BadImage("scan header not understood")
    return [(places[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]


def _scan_end(data: bytes, at: int) -> int:
    """Where the next marker but a restart stands."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 1 if data[at + 1] == 0xFF else 2
    raise BadImage("scan without end")


class _Lanes:
    """Segments of many scans, to be decoded in lockstep."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.tables: dict[bytes, int] = {}
        self.luts: list[np.ndarray] = []
        self.patterns: dict[tuple, int] = {}
        self.lanes: list[tuple[np.ndarray, np.ndarray, int]] = []  # sizes, blocks, pattern

    def table(self, spec: bytes) -> int:
        if spec not in self.tables:
            lengths, i = {}, 16
            for n in range(1, 17):
                for _ in range(spec[n - 1]):
                    lengths[spec[i]] = n
                    i += 1
            codes = canonical(lengths)
            if any(c >> n for c, n in codes.values()):
                raise BadImage("Huffman table too full")
            self.tables[spec] = len(self.luts)
            self.luts.append(look_up_table(codes))
        return self.tables[spec]

    def add(self, data: bytes, scan: Scan, pattern: list[tuple[int, int, int]], n_blocks: int) -> None:
        """pattern: (component's place in the scan, DC table, AC table) of each block of an MCU."""
        body = np.frombuffer(data, np.uint8, scan.end - scan.start, scan.start)
        before = np.concatenate([[np.uint8(0)], body[:-1]])
        after = np.concatenate([body[1:], [np.uint8(0)]])
        marks = np.flatnonzero((body == 0xFF) & (after >= 0xD0) & (after <= 0xD7))
        keep = ~((before == 0xFF) & (body == 0))
        keep[marks] = False
        keep[marks + 1] = False
        if 2 * n_blocks > 8 * int(keep.sum()):  # a block has two codes at least; checked before anything of its size is made
            raise BadImage("scan too short for the size")
        edges = np.cumsum(np.concatenate([[0], keep]))
        bounds = edges[np.concatenate([[0], marks, [len(body)]])]
        per = scan.restart * len(pattern) if scan.restart else n_blocks
        blocks = np.minimum(per, n_blocks - per * np.arange(-(-n_blocks // per)))
        if len(blocks) != len(bounds) - 1:
            raise BadImage("restart markers don't fit the size")
        key = tuple(pattern)
        number = self.patterns.setdefault(key, len(self.patterns))
        self.raw.append(body[keep])
        self.lanes.append((np.diff(bounds), blocks, number))

    def run(self) -> tuple[list[np.ndarray], list[bool]]:
        """For each scan added: int16[blocks, 64], differences of DC undone; and whether it was sound."""
        if not self.lanes:
            return [], []
        buffer = np.concatenate([*self.raw, np.full(16, 0xFF, np.uint8)])
        words = np.ndarray((len(buffer) - 7,), ">u8", buffer, 0, (1,))
        luts = np.stack(self.luts)
        longest = max(len(p) for p in self.patterns)
        members = np.zeros((len(self.patterns), longest), np.int64)
        table = np.zeros((len(self.patterns), longest, 2), np.int64)
        period = np.zeros(len(self.patterns), np.int64)
        for p, i in self.patterns.items():
            period[i] = len(p)
            for k, (m, dc, ac) in enumerate(p):
                members[i, k], table[i, k] = m, (dc, ac)
        sizes = np.concatenate([x[0] for x in self.lanes])
        blocks = np.concatenate([x[1] for x in self.lanes])
        kind = np.repeat([x[2] for x in self.lanes], [len(x[0]) for x in self.lanes])
        n = len(sizes)
        limit = np.cumsum(sizes) * 8
        pos = limit - sizes * 8
        first = np.cumsum(blocks) - blocks
        out = np.zeros((int(blocks.sum()), 64), np.int16)
        flat = out.reshape(-1)
        bad = np.zeros(n, bool)
        lane = np.arange(n)
        block, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
        predictor = np.zeros((n, max(1, int(members.max()) + 1)), np.int64)
        simple = longest == 1
        while len(lane):
            own = kind[lane]
            place = 0 if simple else block % period[own]
            is_ac = (k > 0).astype(np.int64)
            which = table[own, place, is_ac]
            window = words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
            found = luts[which, (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            symbol, used = found & 255, found >> 8
            size, run = symbol & 15, np.where(is_ac == 1, symbol >> 4, 0)
            extra = ((window << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
            pos = pos + used + size
            to = k + run
            wrong = (used == 0) | (pos > limit[lane]) | ((to > 63) & (size > 0))
            end = (is_ac == 1) & (size == 0)
            put = ~wrong & ~end
            dc = put & (is_ac == 0)
            if dc.any():
                m = members[own, place] if simple else members[own, place]
                rows = lane[dc]
                predictor[rows, m[dc]] += value[dc]
                value[dc] = predictor[rows, m[dc]]
            index = (first[lane] + block) * 64 + to
            if put.all():
                flat[index] = value
            else:
                flat[index[put]] = value[put]
            k = np.where(end, np.where(run == 15, k + 16, 64), to + 1)
            done = k >= 64
            if done.any():
                block = block + done
                k[done] = 0
            leave = wrong | (block >= blocks[lane])
            if leave.any():
                bad[lane[wrong]] = True
                stay = ~leave
                lane, pos, block, k = lane[stay], pos[stay], block[stay], k[stay]
        results, sound, at, b = [], [], 0, 0
        for s, blk, _ in self.lanes:
            results.append(out[b : b + int(blk.sum())])
            sound.append(not bad[at : at + len(s)].any())
            at, b = at + len(s), b + int(blk.sum())
        return results, sound


def _plan(image: Image, scan: Scan, lanes: _Lanes) -> tuple[list[tuple[int, int, int]], int]:
    """The blocks of an MCU and the number of all blocks of a scan."""
    def tables(dc: int, ac: int) -> tuple[int, int]:
        if dc not in scan.tables or 16 + ac not in scan.tables:
            raise BadImage("Huffman table missing")
        return lanes.table(scan.tables[dc]), lanes.table(scan.tables[16 + ac])

    if len(scan.members) == 1:
        i, dc, ac = scan.members[0]
        rows, columns = image.blocks(i)
        return [(0, *tables(dc, ac))], rows * columns
    across, down = image.most
    mcus = -(-image.width // (8 * across)) * -(-image.height // (8 * down))
    pattern = [(m, *tables(dc, ac)) for m, (i, dc, ac) in enumerate(scan.members) for _ in range(image.components[i].across * image.components[i].down)]
    return pattern, mcus * len(pattern)


def _luminance(image: Image, scan: Scan, coefficients: np.ndarray) -> np.ndarray:
    """The DC values of the first component, as rows and columns."""
    rows, columns = image.blocks(0)
    if len(scan.members) == 1:
        return coefficients[:, 0].reshape(rows, columns)
    across, down = image.most
    wide = -(-image.width // (8 * across))
    place = 0
    for i, _, _ in scan.members:
        c = image.components[i]
        if i == 0:
            break
        place += c.across * c.down
    c = image.components[0]
    per = sum(image.components[i].across * image.components[i].down for i, _, _ in scan.members)
    dc = coefficients[:, 0].reshape(-1, per)[:, place : place + c.across * c.down]
    tall = len(dc) // wide
    grid = dc.reshape(tall, wide, c.down, c.across).transpose(0, 2, 1, 3).reshape(tall * c.down, wide * c.across)
    return grid[:rows, :columns]


@dataclass
class Decoded:
    error: str | None = None
    width: int | None = None
    height: int | None = None
    thumbnail: np.ndarray | None = None
    payload: bytes | None = None


def decode(files: list[bytes | None]) -> list[Decoded]:
    """Size, thumbnail and (of files made by store()) payload of each file."""
    out, lanes, waiting = [Decoded() for _ in files], _Lanes(), []
    for d, data in zip(out, files):
        try:
            image = parse(data or b"")
            mine = [(s, *_plan(image, s, lanes)) for s in image.scans]
            for scan, pattern, n in mine:
                lanes.add(data, scan, pattern, n)
                waiting.append((d, image, scan))
            d.width, d.height = image.width, image.height
        except BadImage as e:
            d.error = str(e)
    for (d, image, scan), coefficients, sound in zip(waiting, *lanes.run()):
        if d.error or not sound:
            d.error, d.width, d.height, d.thumbnail, d.payload = d.error or "damaged scan", None, None, None, None
            continue
        if any(i == 0 for i, _, _ in scan.members):
            step = int(image.quant.get(image.components[0].table, [1])[0])
            dc = _luminance(image, scan, coefficients).astype(np.int64)
            d.thumbnail = np.clip((dc * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
            if image.payload_bytes is not None:
                stored = np.where(coefficients < 0, coefficients + 112, coefficients + 111).astype(np.uint8)
                d.payload = stored.tobytes()[: image.payload_bytes]
    return out


def average_hash(thumbnail: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 x 8 reduction of the thumbnail lie above their mean."""
    rows = np.arange(8) * thumbnail.shape[0] // 8
    columns = np.arange(8) * thumbnail.shape[1] // 8
    cells = thumbnail[np.ix_(rows, columns)].astype(np.int64)
    return np.packbits(cells.reshape(-1) * 64 > cells.sum()).tobytes().hex()


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    return hashlib.sha256(b"%dx%d:" % thumbnail.shape[::-1] + thumbnail.tobytes()).hexdigest()


# -- columns


def _slices(sizes: list[int]) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > _BATCH:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's UTF-8 bytes, padded and stored as a JPEG file."""
    kind = df.schema[id_col].dataType
    fields = [T.StructField(id_col, T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raws = [(t or "").encode() for t in frame["text"]]
            for part in _slices([len(r) for r in raws]):
                media = store([pad(r) for r in raws[part]])
                yield pd.DataFrame({id_col: frame[id_col].iloc[part].to_numpy(), "n_bytes": [len(r) for r in raws[part]], "media": media})

    # ids travel as text, so that pandas keeps long integers beside nulls exact
    chosen = df.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, T.StructType(fields)).withColumn(id_col, F.col(id_col).cast(kind))


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """What each JPEG file holds: size, thumbnail and hashes, and digests of a stored payload."""
    held = (id_col, *keep)
    fields = [T.StructField(c, T.StringType()) for c in held]
    texts, numbers = ("error", "thumb_sha256", "average_hash", "payload_sha256", "media_sha256"), ("width", "height", "payload_bytes", "tail_crc32", "media_bytes")
    fields += [T.StructField(c, T.StringType()) for c in texts] + [T.StructField(c, T.LongType()) for c in numbers] + [T.StructField("thumbnail", T.BinaryType())]
    names = [*texts, *numbers, "thumbnail"]

    def row(data: bytes | None, d: Decoded) -> tuple:
        thumb, p = d.thumbnail, d.payload
        return (
            d.error, None if thumb is None else thumbnail_hash(thumb), None if thumb is None else average_hash(thumb),
            None if p is None else hashlib.sha256(p).hexdigest(), None if data is None else hashlib.sha256(data).hexdigest(),
            d.width, d.height, None if p is None else len(p), None if p is None else zlib.crc32(p[-64:]), None if data is None else len(data),
            None if thumb is None else thumb.tobytes(),
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            files = frame["media"].tolist()
            for part in _slices([len(f or b"") for f in files]):
                rows = [row(f, d) for f, d in zip(files[part], decode(files[part]))]
                out = pd.DataFrame(rows, columns=names, dtype=object).astype({c: "Int64" for c in numbers})
                for i, c in enumerate(held):
                    out.insert(i, c, frame[c].iloc[part].to_numpy())
                yield out

    chosen = df.select(*[F.col(c).cast("string").alias(c) for c in held], F.col(media_col).cast("binary").alias("media"))
    return chosen.mapInPandas(run, T.StructType(fields)).withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in held})

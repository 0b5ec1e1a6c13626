"""Progressive JPEG columns: scans accumulated into coefficients, inverse transform in numpy, RGB tensors.

write_payload() stores bytes losslessly as quantised coefficients: 192 bytes are the six blocks of a 4:2:0 unit,
32 AC coefficients of each. A byte is sent in five scans of spectral selection and successive
approximation: its upper six bits in two bands, then a bit more in each of two refinements.
decode() reads any progressive (or baseline) Huffman-coded image of 8 bits; runs of scans that are all
of one code length, as those written here, are decoded by numpy, all others bit by bit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Payload bytes of a unit and of a block; units of a frame (its height is 16 bits); bands of the first AC scans.
UNIT, BLOCK, FRAME_UNITS, BANDS = 192, 32, 4095, ((1, 12), (13, 32))


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.asarray([8 * r + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


ZIGZAG = _zigzag()


def _inverse() -> np.ndarray:
    """The 64 x 64 matrix from coefficients in zigzag order to samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG]


INVERSE = _inverse().astype(np.float32)


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table of a single symbol, whose code is a 0 bit."""
    return _marker(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low])
    return _marker(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _frame(payload: np.ndarray) -> bytes:
    units = len(payload) // UNIT
    parts = payload.reshape(units, 6, BLOCK)
    blocks = {1: parts[:, :4].reshape(-1, BLOCK), 2: parts[:, 4], 3: parts[:, 5]}
    out = [b"\xff\xd8", _marker(0xDB, bytes([0, *[1] * 64]))]
    out.append(_marker(0xC2, bytes([8]) + (16 * units).to_bytes(2, "big") + (16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    bits = 6 * units
    out += [_one_code(0, 0), _scan((1, 2, 3), 0, 0, 0, 0, np.packbits(np.concatenate([np.zeros(bits, np.uint8), np.ones(-bits % 8, np.uint8)])).tobytes())]
    out.append(_one_code(1, 7))  # a coefficient of 256 to 511, less its last two bits, has seven: with its code, a byte
    for c, b in blocks.items():
        for first, last in BANDS:
            out.append(_scan((c,), first, last, 0, 2, (b[:, first - 1 : last] >> 2 | 0x40).tobytes()))
    for low in (1, 0):
        for c, b in blocks.items():
            run = len(b).bit_length() - 1  # one run over all blocks: only corrections follow
            head = [0, *((len(b) - (1 << run)) >> k & 1 for k in range(run - 1, -1, -1))]
            bits = np.concatenate([np.asarray(head, np.uint8), (b.reshape(-1) >> low) & 1])
            bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
            out += [_one_code(1, run << 4), _scan((c,), 1, BLOCK, low + 1, low, np.packbits(bits).tobytes())]
    return b"".join(out) + b"\xff\xd9"


def padded(text: bytes) -> bytes:
    """The bytes and spaces up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def write_payload(payload: bytes) -> bytes:
    """The payload, a multiple of UNIT bytes, as one image or, where too long for one, several that follow each other."""
    raw, step = np.frombuffer(payload, np.uint8), FRAME_UNITS * UNIT
    return b"".join(_frame(raw[i : i + step]) for i in range(0, len(raw), step))


class _Bits:
    """Bits of an entropy-coded segment, one by one; ones after its end."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 1)
            self.at += 1
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _huffman(body: bytes) -> Iterator[tuple[int, dict]]:
    at = 0
    while at < len(body):
        kind, counts, at, code, table = body[at], body[at + 1 : at + 17], at + 17, 0, {}
        for n, count in enumerate(counts, 1):
            for symbol in body[at : at + count]:
                table[n, code] = symbol
                code += 1
            at, code = at + count, code << 1
        yield kind, table


class _Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.id, self.h, self.v, self.quant = ident, h, v, quant

    def allot(self, width: int, height: int, h_most: int, v_most: int) -> None:
        across, down = -(-width // (8 * h_most)), -(-height // (8 * v_most))
        self.stride, self.rows = across * self.h, down * self.v
        # blocks that a scan of this component alone has
        self.own = -(-(-(-width * self.h // h_most)) // 8), -(-(-(-height * self.v // v_most)) // 8)
        self.coefficients = np.zeros((self.rows * self.stride, 64), np.int32)


class Image:
    """The coefficients of one image, and its samples."""

    def __init__(self, width: int, height: int, components: list[_Component], progressive: bool):
        self.width, self.height, self.components, self.progressive = width, height, components, progressive
        self.h_most, self.v_most = max(c.h for c in components), max(c.v for c in components)
        for c in components:
            c.allot(width, height, self.h_most, self.v_most)

    def rgb(self, quants: dict[int, np.ndarray]) -> np.ndarray:
        """The full-resolution tensor, height x width x 3, uint8; chroma samples are repeated."""
        planes = []
        for c in self.components:
            samples = (c.coefficients * quants[c.quant]).astype(np.float32) @ INVERSE + np.float32(128)
            plane = samples.reshape(c.rows, c.stride, 8, 8).swapaxes(1, 2).reshape(8 * c.rows, 8 * c.stride)
            plane = plane.repeat(self.v_most // c.v, 0).repeat(self.h_most // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) < 3:
            out = np.stack([planes[0]] * 3, 2)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], 2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _blocks(c: _Component) -> np.ndarray:
    """Places of the blocks of a scan of one component, in order."""
    across, down = c.own
    return (np.arange(down)[:, None] * c.stride + np.arange(across)).reshape(-1)


def _interleaved(components: list[_Component]) -> Iterator[tuple[int, int]]:
    """(component, place of block) of a scan of several components, in order."""
    units = [(y, x) for y in range(components[0].rows // components[0].v) for x in range(components[0].stride // components[0].h)]
    for y, x in units:
        for k, c in enumerate(components):
            for v in range(c.v):
                for h in range(c.h):
                    yield k, (y * c.v + v) * c.stride + x * c.h + h


def _decode_scan(image: Image, scan: list[tuple[_Component, dict, dict]], first: int, last: int, high: int, low: int, data: bytes) -> None:
    bits, parts = _Bits(data), [c for c, _, _ in scan]
    if first == 0:
        order = ((0, int(b)) for b in _blocks(parts[0])) if len(parts) == 1 else _interleaved(parts)
        if image.progressive and high == 0 and all(list(dc.values()) == [0] for _, dc, _ in scan):
            return  # every difference is none
        before = [0] * len(parts)
        for k, block in order:
            c, dc, ac = scan[k]
            if image.progressive and high:
                c.coefficients[block, 0] |= bits.take(1) << low
                continue
            before[k] += bits.signed(bits.symbol(dc))
            c.coefficients[block, 0] = before[k] << low
            if not image.progressive:
                _first_pass(c.coefficients[block], bits, ac, 1, 63, 0, 0)
        return
    (c, _, table), blocks = scan[0], _blocks(parts[0])
    if high == 0 and len(table) == 1:
        (length, _), symbol = next(iter(table.items()))
        size, band = symbol & 15, last - first + 1
        if length == 1 and 0 < symbol < 16 and len(bits.bits) >= len(blocks) * band * (1 + size):
            got = bits.bits[: len(blocks) * band * (1 + size)].reshape(-1, 1 + size)[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
            got = np.where(got >> (size - 1), got, got - (1 << size) + 1)
            c.coefficients[blocks, first : last + 1] = got.reshape(len(blocks), band) << low
            return
    run = 0
    for i, block in enumerate(blocks):
        row = c.coefficients[block]
        if high == 0:
            run = run - 1 if run else _first_pass(row, bits, table, first, last, low, 0)
            continue
        if not run:
            run, k = _refined(row, bits, table, first, last, low)
            if not run:
                continue
        else:
            k = first
        if k == first and run >= len(blocks) - i:
            rest = c.coefficients[blocks[i:], first : last + 1]
            if rest.all():  # nothing but a correction of each coefficient is left
                fix = bits.bits[bits.at : bits.at + rest.size].astype(np.int32).reshape(rest.shape)
                c.coefficients[blocks[i:], first : last + 1] = rest + np.sign(rest) * (fix << low)
                return
        for j in range(k, last + 1):
            if row[j] and bits.take(1):
                row[j] += (1 if row[j] > 0 else -1) << low
        run -= 1


def _first_pass(row: np.ndarray, bits: _Bits, table: dict, first: int, last: int, low: int, _: int) -> int:
    """Coefficients of a block in a first scan; returns of how many further blocks nothing comes."""
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            row[k] = bits.signed(size) << low
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refined(row: np.ndarray, bits: _Bits, table: dict, first: int, last: int, low: int) -> tuple[int, int]:
    """New coefficients and corrections of a block in a refinement; returns the run of ends of block begun, this one
    included, and the place from which only corrections follow."""
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros < 15:
            return (1 << zeros) + bits.take(zeros), k
        value = (1 if bits.take(1) else -1) << low if size else 0
        while k <= last:
            if row[k]:
                if bits.take(1):
                    row[k] += (1 if row[k] > 0 else -1) << low
            elif zeros:
                zeros -= 1
            else:
                row[k] = value
                k += 1
                break
            k += 1
    return 0, k


def decode(data: bytes) -> Iterator[tuple[Image, dict[int, np.ndarray]]]:
    """Each image of the bytes and its quantisation tables; ValueError for what isn't such an image."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        at, image, quants, tables = at + 2, None, {}, {}
        while data[at : at + 2] != b"\xff\xd9":
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("a JPEG image breaks off")
            code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if code == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif code == 0xC4:
                tables |= dict(_huffman(body))
            elif code in (0xC0, 0xC1, 0xC2):
                parts = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
                image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts, code == 0xC2)
            elif code == 0xDD and any(body):
                raise ValueError("restart intervals aren't supported")
            elif code == 0xDA:
                by_id = {c.id: c for c in image.components}
                scan = [(by_id[body[1 + 2 * k]], tables.get(body[2 + 2 * k] >> 4, {}), tables.get(16 | body[2 + 2 * k] & 15, {})) for k in range(body[0])]
                first, last, shifts = body[-3:]
                end = data.find(b"\xff", at)
                while data[end + 1] == 0:
                    end = data.find(b"\xff", end + 2)
                _decode_scan(image, scan, first, last, shifts >> 4, shifts & 15, data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end
        at += 2
        yield image, quants


def read_payload(image: Image) -> bytes:
    """The payload bytes that an image of write_payload() holds."""
    y, cb, cr = (c.coefficients[:, 1 : BLOCK + 1] for c in image.components)
    units = len(cb)
    return np.concatenate([y.reshape(units, 4, BLOCK), cb[:, None], cr[:, None]], 1).astype(np.uint8).tobytes()


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the image) of every document, stored; a null text is an empty one, of one unit of spaces."""
    common.bounded_batches(docs.sparkSession)

    def rows(batches):
        for b in batches:
            raw = [t.encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([*map(len, raw)], pa.int64()), pa.array([write_payload(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.stored(common.id_text(docs).mapInArrow(rows, "doc_id long, n_bytes long, media binary"))


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, frame, height, width and rgb (rows of uint8 triples) of each image in a column named media; null media have none."""

    def rows(batches):
        for b in batches:
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                for k, (image, quants) in enumerate(decode(data or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([k], pa.int32()), pa.array([image.height], pa.int32()), pa.array([image.width], pa.int32()), pa.array([image.rgb(quants).tobytes()], pa.binary())], names=["doc_id", "frame", "height", "width", "rgb"])

    return stored.select("doc_id", "media").mapInArrow(rows, "doc_id long, frame int, height int, width int, rgb binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from the images of media(): digests of payload and image, and a feature of the RGB tensor:
    its sides, the mean of each channel and its checksum. Rows with equal or null doc_id give a row each."""

    def one(doc_id, n_bytes, data):
        payload, sums, height, crc = b"", np.zeros(3), 0, 0
        for image, quants in decode(data):
            payload += read_payload(image)
            rgb = image.rgb(quants)
            sums, height, crc = sums + rgb.sum((0, 1), dtype=np.int64), height + image.height, zlib.crc32(rgb, crc)
        means = ",".join(f"{m:.4f}" for m in sums / (16 * height))
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{height}x16;{means};{crc:08x}"

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split(" ")[0] for x in DIGESTS.split(", ")]

    def rows(batches):
        for b in batches:
            got = [one(*x) for x in zip(*(b.column(n).to_pylist() for n in ("doc_id", "n_bytes", "media")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*got)) or [[]] * 8, kinds)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(rows, DIGESTS)


def op8_progressive_jpeg(spark, sf_dir) -> DataFrame:
    return digests(media(common.table(spark, sf_dir, "documents")))

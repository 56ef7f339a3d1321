"""Motion-JPEG in AVI: RIFF indexes, baseline JPEG frames, and shots by adaptive histogram differences.

``with_avi`` stores bytes as a grey film, one flat 8 x 8 block for each byte: a flat block has only its first coefficient,
so eight-bit values come back exactly. ``read_avi`` reads any baseline motion-JPEG AVI: it takes the frames from the index,
decodes all restart intervals of many frames side by side, and gives the luma of every block, timed clips, and the stored
bytes. Values marked as fixed are those of the public formats (ITU T.81, RIFF / AVI).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.common import table

UNIT = 64
FRAME_ROWS = 16
FPS = 25
BATCH = 1 << 20
BINS, SPAN, SPREAD, FLOOR = 16, 8, 3.0, 0.10

# fixed values: the zigzag order and the Huffman tables that motion-JPEG frames without tables use (T.81, annex K)
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )),
)
AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    list(bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
        "c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    )),
)
END_ONLY = ([1] + [0] * 15, [0])


class Damaged(ValueError):
    """A file that can't be read."""


@lru_cache(maxsize=256)
def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol of a Huffman table given by the number of codes of each length."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if k >= len(symbols) or code >= 1 << length:
                raise Damaged("Huffman table")
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """256 x length + symbol for each 16 bits that begin with a code, 0 for others."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in _codes(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


@lru_cache(maxsize=16)
def _flat_blocks(dc: tuple, ac: tuple) -> np.ndarray:
    """256 x (difference + 4096) + length for each 16 bits that begin with a whole flat block: a first value and the end."""
    out = np.zeros(1 << 16, np.int32)
    end, m = _codes(*ac).get(0, (0, 17))
    for size, (code, length) in _codes(*dc).items():
        total = length + size + m
        if size > 11 or total > 16:
            continue
        bits = np.arange(1 << size)
        value = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits) if size else bits
        begin = ((code << size | bits) << m | end) << (16 - total)
        out[begin[:, None] + np.arange(1 << (16 - total))] = ((value + 4096) << 8 | total)[:, None]
    return out


def _table(kind: int, table_: tuple[list[int], list[int]]) -> bytes:
    return bytes([kind, *table_[0], *table_[1]])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@lru_cache(maxsize=64)
def _frame_head(rows: int, columns: int) -> bytes:
    """What stands before the data of a grey frame of flat blocks, one restart interval for each row of blocks."""
    size = struct.pack(">BHHB3B", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0] + [8] * 64)), _segment(0xC0, size), _segment(0xC4, _table(0, DC_LUMA)),
        _segment(0xC4, _table(0x10, END_ONLY)), _segment(0xDD, struct.pack(">H", columns)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


@lru_cache(maxsize=1)
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each difference from -255 to 255: its class, its bits, and the end of the block."""
    code, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    codes = _codes(tuple(DC_LUMA[0]), tuple(DC_LUMA[1]))
    for d in range(-255, 256):
        n = abs(d).bit_length()
        c, m = codes[n]
        code[d + 255], length[d + 255] = (c << n | (d if d >= 0 else d + (1 << n) - 1)) << 1, m + n + 1
    return code, length


def jpeg_rows(rows: np.ndarray, markers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(data of all rows, end of each) of ``rows`` (n, columns) of bytes, each followed by the marker given for it."""
    code, length = _steps()
    n_rows, columns = rows.shape
    diff = np.empty((columns, n_rows), np.int64)  # column by column: a bit string grows for each row
    diff[0] = rows[:, 0].astype(np.int64) - 128
    diff[1:] = rows.T[1:].astype(np.int64) - rows.T[:-1]
    words = np.zeros((n_rows, columns * 15 // 32 + 2), np.uint32)
    held, n, count = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    for d in diff:
        d += 255
        bits = length[d]
        held = held << bits.view(np.uint64) | code[d]
        n += bits
        out = np.flatnonzero(n >= 32)
        n[out] -= 32
        words[out, count[out]] = (held[out] >> n[out].view(np.uint64)).astype(np.uint32)
        count[out] += 1
    size = count * 4 + ((n + 7) >> 3)
    left = (-n) & 7
    tail = (held << left.view(np.uint64) | ((np.uint64(1) << left.view(np.uint64)) - np.uint64(1))) << (32 - n - left).view(np.uint64)  # ends in ones
    words[np.arange(n_rows), count] = tail.astype(np.uint32)
    flat = words.astype(">u4").view(np.uint8).reshape(n_rows, -1)
    data = flat[np.arange(flat.shape[1]) < size[:, None]]
    first = np.concatenate([[0], np.cumsum(size)])
    full = data == 255
    stuffed = np.cumsum(full)
    out = np.zeros(len(data) + int(stuffed[-1]) + 2 * len(rows), np.uint8)
    out[np.arange(len(data)) + stuffed - full + 2 * np.repeat(np.arange(len(rows)), size)] = data
    last = first[1:] + stuffed[first[1:] - 1] + 2 * np.arange(len(rows))
    out[last] = 255
    out[last + 1] = markers
    return out.tobytes(), last + 2


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def avi_file(frames: list[bytes], width: int, height: int, stored: int) -> bytes:
    """An AVI file of JPEG frames; ``stored`` (bytes that the film holds) is kept in the stream's data chunk."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 10_000, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form) + _chunk(b"strd", struct.pack("<Q", stored))))
    at, index = 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movie = _list(b"movi", b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + movie + _chunk(b"idx1", b"".join(index)))


def films(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each of ``payloads``, whose lengths are positive multiples of UNIT."""
    rows = [len(p) // UNIT for p in payloads]
    high = [min(n, FRAME_ROWS) for n in rows]
    parts, markers, frames = [], [], []
    for p, n, h in zip(payloads, rows, high, strict=True):
        k = -(-n // h)
        parts += [p, bytes((k * h - n) * UNIT)]
        markers.append(np.tile(np.append(0xD0 + np.arange(h - 1) % 8, 0xD9), k))
        frames.append(k)
    grid = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, UNIT)
    data, ends = jpeg_rows(grid, np.concatenate(markers))
    out, row, at = [], 0, 0
    for p, h, k in zip(payloads, high, frames, strict=True):
        head, own = _frame_head(h, UNIT), []
        for end in ends[row + h - 1 : row + k * h : h].tolist():
            own.append(head + data[at:end])
            at = end
        row += k * h
        out.append(avi_file(own, UNIT * 8, h * 8, len(p)))
    return out


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the RIFF chunks between two places."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise Damaged("chunk beyond the end")
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> dict:
    """fps, stored (or None) and frames [(begin, end)] of the first video stream, from the index or, without one, the movie list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Damaged("no AVI file")
    out: dict = {"fps": 0.0, "stored": None, "frames": []}
    number, movie, index, streams = None, None, None, 0
    for name, a, b in chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for sub, c, d in chunks(data, a + 4, b):
                if sub == b"LIST" and data[c : c + 4] == b"strl":
                    here = False
                    for leaf, e, f in chunks(data, c + 4, d):
                        if leaf == b"strh" and data[e : e + 4] == b"vids" and number is None:
                            number, here = streams, True
                            scale, rate = struct.unpack_from("<II", data, e + 20)
                            out["fps"] = rate / scale if scale else 0.0
                        elif leaf == b"strd" and here and f - e == 8:
                            out["stored"] = int.from_bytes(data[e:f], "little")
                    streams += 1
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movie = a, b
        elif name == b"idx1":
            index = a, b
    if number is None or movie is None or not out["fps"]:
        raise Damaged("no video stream")
    tags = {b"%02ddc" % number, b"%02ddb" % number}
    if index:
        entries = np.frombuffer(data, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
        base = movie[0]
        for tag, _, at, size in entries.tolist():
            if tag.to_bytes(4, "little") in tags:
                if not out["frames"] and data[base + at : base + at + 4] not in tags:
                    base = 0  # some writers count from the begin of the file
                begin = base + at + 8
                if data[begin - 8 : begin - 4] not in tags or begin + size > len(data):
                    raise Damaged("index")
                out["frames"].append((begin, begin + size))
    else:
        walk = [(movie[0] + 4, movie[1])]
        for a, b in walk:
            for name, c, d in chunks(data, a, b):
                if name == b"LIST":
                    walk.append((c + 4, d))
                elif name in tags:
                    out["frames"].append((c, d))
    return out


def parse_frame(frame: bytes) -> tuple[tuple, int]:
    """(tables and layout of a baseline JPEG frame, where its data begins)."""
    if frame[:2] != b"\xff\xd8":
        raise Damaged("no JPEG frame")
    quant: dict[int, tuple] = {}
    huff = {0: DC_LUMA, 1: DC_CHROMA, 16: AC_LUMA, 17: AC_CHROMA}
    parts, size, restart, at = {}, None, 0, 2
    while at + 4 <= len(frame):
        marker, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + n]
        if frame[at] != 255 or n < 2 or len(body) != n - 2:
            raise Damaged("segment")
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = tuple(int.from_bytes(body[1 + k : 1 + k + wide], "big") for k in range(0, 64 * wide, wide))
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                m = sum(body[1:17])
                huff[body[0]] = (list(body[1:17]), list(body[17 : 17 + m]))
                body = body[17 + m :]
        elif marker in (0xC0, 0xC1) and body[0] == 8:
            size = struct.unpack(">HH", body[1:5])
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise Damaged("only baseline frames of 8 bits are read")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            try:
                blocks = []
                for k in range(body[0]):
                    h, v, q = parts[body[1 + 2 * k]]
                    dc, ac = huff[body[2 + 2 * k] >> 4], huff[16 + (body[2 + 2 * k] & 15)]
                    one = k, tuple(map(tuple, dc)), tuple(map(tuple, ac)), quant[q]
                    blocks += [one] * (h * v if len(parts) > 1 else 1)
                wide, high = (8 * max(p[k] for p in parts.values()) if len(parts) > 1 else 8 for k in (0, 1))
            except (KeyError, ValueError) as e:
                raise Damaged("tables") from e
            if body[0] != len(parts) or not size or not all(size):
                raise Damaged("layout")
            return (tuple(blocks), -(-size[0] // high) * -(-size[1] // wide), restart), at
    raise Damaged("no data")


def decode(scans: list[bytes], blocks: tuple, units: list[int], restarts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame of each luma block, its 64 samples' mean as the flat value, 16-bin histogram of each frame) of frames with like tables.

    ``units``: coded units of each frame, ``restarts``: units of a restart interval (0: the whole frame). All intervals of all
    frames go forward together, a symbol at a step. Raises Damaged if a frame's data don't fit.
    """
    joined = np.frombuffer(b"".join(scans), np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    full = np.flatnonzero(joined[:-1] == 255)
    after = joined[full + 1]
    stop = full[(after >= 0xD0) & (after <= 0xD9)]
    gone = np.zeros(len(joined) + 1, np.int64)
    gone[full[after == 0] + 1] = 1
    shift = np.cumsum(gone)
    data = joined[gone[:-1] == 0]
    frame_of = np.searchsorted(ends, stop, "right")
    resume = stop[joined[stop + 1] < 0xD8] + 2
    begin = np.sort(np.concatenate([ends - [len(s) for s in scans], resume]))
    owner = np.searchsorted(ends, begin, "right")
    want = np.array([-(-u // r) if r else 1 for u, r in zip(units, restarts, strict=True)])
    if len(np.setdiff1d(np.arange(len(scans)), frame_of)) or (np.bincount(owner, minlength=len(scans)) != want).any():
        raise Damaged("restart intervals")
    step = np.array([r or u for u, r in zip(units, restarts, strict=True)])
    nth = np.arange(len(begin)) - np.searchsorted(owner, owner, "left")
    left = np.minimum(step[owner], np.array(units)[owner] - nth * step[owner])
    per = len(blocks)
    total = left * per
    base = np.concatenate([[0], np.cumsum(total)])
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data) + 3
    window = pad[:n] << np.uint64(32) | pad[1 : n + 1] << np.uint64(24) | pad[2 : n + 2] << np.uint64(16) | pad[3 : n + 3] << np.uint64(8) | pad[4 : n + 4]
    tables = list(dict.fromkeys([t for b in blocks for t in b[1:3]]))
    lut = np.concatenate([_lookup(*t) for t in tables]).astype(np.int64)
    kinds = np.array([[tables.index(b[1]) << 16, tables.index(b[2]) << 16] for b in blocks])
    color = np.array([b[0] for b in blocks])
    pos = (begin - shift[begin]) * 8
    done, k, pred = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), np.zeros((len(pos), color.max() + 1), np.int64)
    dc = np.zeros(base[-1], np.int64)
    rest: list[tuple] = []
    live = np.arange(len(pos))
    limit = n * 8 - 40
    fast = _flat_blocks(blocks[0][1], blocks[0][2]) if per == 1 else None
    while len(live):
        if fast is not None and not k[live].any():
            # all stand before a block: flat blocks go by in one step each, until some other block comes
            p, at, value, stop_at = pos[live], (base[:-1] + done)[live], pred[live, 0], (base[:-1] + total)[live]
            went, most = 0, int((stop_at - at).min())
            while went < most and p.max() <= limit:
                e = fast[((window[p >> 3] >> (24 - (p & 7)).view(np.uint64)) & np.uint64(0xFFFF)).view(np.int64)]
                if not e.all():
                    break
                value += (e >> 8) - 4096
                p += e & 255
                dc[at + went] = value
                went += 1
            pos[live], pred[live, 0] = p, value
            done[live] += went
            live = live[done[live] < total[live]]
            if went and went == most:
                continue
            if not len(live):
                break
        p, kk = pos[live], k[live]
        if (p > limit).any():
            raise Damaged("data end early")
        slot = done[live] % per if per > 1 else np.zeros(len(live), np.int64)
        first = kk == 0
        found = lut[kinds[slot, np.where(first, 0, 1)] + ((window[p >> 3] >> (24 - (p & 7)).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)]
        if not found.all():
            raise Damaged("code")
        p = p + (found >> 8)
        bits = found & 15
        value = ((window[p >> 3] >> (40 - bits - (p & 7)).astype(np.uint64)).astype(np.int64)) & ((1 << bits) - 1)
        value -= np.where((bits > 0) & (value < (1 << np.maximum(bits - 1, 0))), (1 << bits) - 1, 0)
        pos[live] = p + bits
        at = base[live] + done[live]
        f = live[first]
        if len(f):
            pred[f, color[slot[first]]] += value[first]
            dc[at[first]] = pred[f, color[slot[first]]]
        run = (found >> 4) & 15
        ac = ~first & (bits > 0)
        if ac.any():
            where = kk[ac] + run[ac]
            if (where > 63).any():
                raise Damaged("run")
            rest.append((at[ac], where, value[ac]))
        kk = np.where(first, 1, np.where(bits > 0, kk + run + 1, np.where(run == 15, kk + 16, 64)))
        over = kk >= 64
        k[live] = np.where(over, 0, kk)
        done[live] += over
        if over.any():
            live = live[done[live] < total[live]]
    luma = np.flatnonzero(color[(np.arange(base[-1]) - np.repeat(base[:-1], total)) % per] == 0) if per > 1 else np.arange(base[-1])
    frame = np.repeat(owner, total)[luma]
    quant = np.array(blocks[0][3])
    flat = np.clip(np.rint(dc[luma] * quant[0] / 8).astype(np.int64) + 128, 0, 255)
    weight = np.full(len(luma), 64)
    hist = np.zeros((len(scans), BINS), np.int64)
    if rest:
        at, where, value = (np.concatenate(x) for x in zip(*rest, strict=True))
        rough, inverse = np.unique(at, return_inverse=True)
        mine = np.searchsorted(luma, rough)
        ok = (mine < len(luma)) & (luma[np.minimum(mine, len(luma) - 1)] == rough)
        grid = np.zeros((len(rough), 64))
        grid[inverse, np.array(ZIGZAG)[where]] = value * quant[where]
        grid[:, 0] = dc[rough] * quant[0]
        u, x = np.arange(8)[:, None], np.arange(8)[None]
        wave = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
        pixels = np.clip(np.rint(np.einsum("ux,nuv,vy->nxy", wave, grid[ok].reshape(-1, 8, 8), wave)) + 128, 0, 255).astype(np.int64)
        mine = mine[ok]
        flat[mine] = np.rint(pixels.mean((1, 2)))
        weight[mine] = 0
        np.add.at(hist, (frame[mine][:, None], pixels.reshape(-1, 64) * BINS // 256), 1)
    hist += np.bincount(frame * BINS + flat * BINS // 256, weights=weight, minlength=hist.size).astype(np.int64).reshape(hist.shape)
    return frame, flat, hist


def shots(hist: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, end, difference that begins it) of each shot, from the histograms of a film's frames.

    A frame begins a shot when its histogram differs from the one before by more than FLOOR and more than the mean and SPREAD
    deviations of the other differences within SPAN frames.
    """
    n = len(hist)
    d = np.zeros(n)
    if n > 1:
        share = hist / np.maximum(hist.sum(1, keepdims=True), 1)
        d[1:] = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts = [0]
    for t in (np.flatnonzero(d[1:] > FLOOR) + 1).tolist():
        near = np.concatenate([d[max(1, t - SPAN) : t], d[t + 1 : t + 1 + SPAN]])
        if not len(near) or d[t] > near.mean() + SPREAD * near.std():
            cuts.append(t)
    return [(a, b, float(d[a])) for a, b in zip(cuts, [*cuts[1:], n], strict=True)] if n else []


CLIP = "struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double,difference:double,luma:double>"


def read_films(media: list[bytes | None]) -> list[dict | None]:
    """payload (None where the file stores none), n_frames, clips, feature and error of each file; None for None."""
    out: list[dict | None] = [None if m is None else {"error": None} for m in media]
    groups: dict[tuple, list[tuple[int, int, bytes, int, int]]] = {}
    known: dict[bytes, tuple[tuple, int]] = {}
    for i, m in enumerate(media):
        if m is None:
            continue
        try:
            out[i] |= parse_avi(m)
            for k, (a, b) in enumerate(out[i]["frames"]):
                frame = m[a:b]
                begin = frame.find(b"\xff\xda")
                head = frame[: begin + 14]
                if head not in known:
                    known[head] = parse_frame(frame)
                (blocks, units, restart), at = known[head]
                groups.setdefault(blocks, []).append((i, k, frame[at:], units, restart))
        except (Damaged, struct.error, IndexError) as e:
            out[i] = {"error": str(e) or "damaged"}
    for blocks, frames in groups.items():
        frames = [f for f in frames if not out[f[0]]["error"]]
        try:
            done = [(frames, decode([f[2] for f in frames], blocks, [f[3] for f in frames], [f[4] for f in frames]))] if frames else []
        except (Damaged, IndexError):
            done = []
            for i in dict.fromkeys(f[0] for f in frames):  # one damaged film doesn't hurt the others
                own = [f for f in frames if f[0] == i]
                try:
                    done.append((own, decode([f[2] for f in own], blocks, [f[3] for f in own], [f[4] for f in own])))
                except (Damaged, IndexError) as e:
                    out[i] = {"error": str(e) or "damaged"}
        for some, (frame, flat, hist) in done:
            flat = flat.astype(np.uint8)
            edge = np.searchsorted(frame, np.arange(len(some) + 1)) if (np.diff(frame) >= 0).all() else None
            for j, (i, k, *_) in enumerate(some):
                own = flat[edge[j] : edge[j + 1]] if edge is not None else flat[frame == j]
                out[i].setdefault("blocks", {})[k] = own, hist[j]
    for r in out:
        if r is None or r["error"]:
            continue
        found = [r.get("blocks", {})[k] for k in range(len(r["frames"]))]
        hist = np.array([h for _, h in found]).reshape(-1, BINS)
        parts = shots(hist)
        r["clips"] = [
            {"clip": k, "first_frame": a, "end_frame": b, "start_s": a / r["fps"], "end_s": b / r["fps"], "difference": d,
             "luma": float(np.concatenate([x for x, _ in found[a:b]]).mean())}
            for k, (a, b, d) in enumerate(parts)
        ]
        r["n_frames"] = len(found)
        r["payload"] = None if r["stored"] is None else b"".join([x.tobytes() for x, _ in found])[: r["stored"]]
        r["feature"] = f"frames={len(found)};shots={','.join(f'{a}-{b}' for a, b, _ in parts)};luma={zlib.crc32(hist.astype('<i8').tobytes()):08x}"
    return out


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH bytes."""
    a, size = 0, 0
    for k, n in enumerate(sizes):
        if k > a and size + n > BATCH:
            yield a, k
            a, size = k, 0
        size += n
    if a < len(sizes):
        yield a, len(sizes)


def with_avi(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text): the UTF-8 text, zeros up to a positive multiple of UNIT, as an AVI file.

    Null counts as empty; an empty text is UNIT zeros. n_bytes: without the zeros. A file must stay below 2 GB.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).fill_null("").cast(pa.binary())
            sizes = pa.compute.binary_length(texts).to_pylist()
            for i, j in _batches(sizes):
                own = [t + bytes(-len(t) % UNIT if t else UNIT) for t in texts[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(sizes[i:j], pa.int64()), pa.array(films(own), pa.binary())], ["doc_id", "n_bytes", "media"])

    import pyarrow.compute  # noqa: F401

    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def read_avi(files: DataFrame) -> DataFrame:
    """Adds payload, n_frames, clips, feature and error to ``files`` (media and any others but those).

    clips: the timed shots. payload: the bytes that ``with_avi`` stored, null in other files. A null file gives nulls, a
    damaged one (or one that isn't baseline motion-JPEG) gives ``error`` and nulls. ``clip_rows`` has a row for each clip.
    """
    kept = files.columns
    at = kept.index("media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    types = [pa.binary(), pa.int32(), pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("difference", pa.float64()), ("luma", pa.float64())])), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(m.as_buffer()) if m.is_valid else 0 for m in b.column(at)]
            for i, j in _batches(sizes):
                got = [r or {} for r in read_films(b.column(at)[i:j].to_pylist())]
                names = ["payload", "n_frames", "clips", "feature", "error"]
                cols = [pa.array([r.get(n) if n == "error" or not r.get("error") else None for r in got], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in b.columns], *cols], [*kept, *names])

    return files.mapInArrow(read, f"{schema}, payload binary, n_frames int, clips array<{CLIP}>, feature string, error string")


def clip_rows(read: DataFrame) -> DataFrame:
    """A row for each clip of ``read_avi``'s result: its other columns but media and payload, and the clip's."""
    others = [c for c in read.columns if c not in ("media", "payload", "clips")]
    return read.select(*others, F.inline("clips"))


def op1_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_avi(with_avi(table(spark, sf_dir, "documents", "doc_id", "text")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_frames",
        F.size("clips").alias("n_clips"),
        "error",
    )

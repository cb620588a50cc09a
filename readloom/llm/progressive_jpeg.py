"""Progressive JPEG in numpy, many images at a time.

Decoding accumulates the scans (spectral selection and successive approximation) of all images of a batch into
coefficient arrays. Huffman codes are read in lockstep: every restart interval of every image is a stream with
its own bit position, and one numpy step reads the next symbol of all streams whose scan has the same
parameters and tables. The coefficients are then dequantised, inverse-transformed by one matrix product in
exact whole numbers, chroma is upsampled by repetition and turned into RGB.

Encoding writes given coefficients (no forward transform, so nothing is lost) as three components with halved
chroma in eleven scans: DC and AC to half precision in two spectral bands, then their last bits.

Decoding reads 8-bit Huffman-coded progressive files of one or three components with sampling factors of 1 or
2, with or without restart intervals, and raises ValueError for others.
"""

from __future__ import annotations

import bisect
import functools
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: order of coefficients within a block, colour conversion (16-bit fixed point).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_CR_R, _CB_G, _CR_G, _CB_B = 91881, 22554, 46802, 116130
#: Bits after the point in the inverse transform.
_POINT = 13
#: Blocks (or MCUs) of a restart interval that the encoder writes.
RESTART = 4
#: Scans that the encoder writes: components, first and last coefficient, high and low bit.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *[((c,), 1, 5, 0, 1) for c in range(3)], *[((c,), 6, 63, 0, 1) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)]]


@dataclass
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    dc: tuple[bytes, ...]
    ac: bytes
    restart: int
    begin: int
    end: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: of each component: id, sampling factors, quantisation table
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    def shape(self) -> tuple:
        return self.width, self.height, tuple(self.components)

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Blocks of a component: rows and columns that its own scans hold, rows and columns that whole MCUs hold."""
        h_most, v_most = max(x[1] for x in self.components), max(x[2] for x in self.components)
        _, h, v, _ = self.components[c]
        across, down = -(-self.width // (8 * h_most)), -(-self.height // (8 * v_most))
        return -(-(-(-self.height * v // v_most)) // 8), -(-(-(-self.width * h // h_most)) // 8), down * v, across * h


# ---------------------------------------------------------------- Huffman tables


def canonical(table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, codes and lengths of a table as it stands in a file (16 counts, then symbols)."""
    lengths = np.repeat(np.arange(1, 17), list(table[:16]))
    codes, code, before = [], 0, 0
    for n in lengths:
        code <<= int(n) - before
        before = int(n)
        codes.append(code)
        code += 1
    return np.frombuffer(table[16 : 16 + len(lengths)], np.uint8), np.array(codes, np.uint64), lengths


@functools.lru_cache(64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come: length of the code << 8 | symbol; 0 where none matches."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, code, n in zip(*canonical(table), strict=True):
        low = int(code) << 16 - n
        out[low : low + (1 << 16 - n)] = n << 8 | symbol
    return out


def _table(lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes(counts) + bytes(order)


#: The encoder's tables: short codes for what text gives, the same length for all else.
_DC_TABLE = _table({s: 3 if s < 7 else 5 if s < 9 else 8 for s in range(12)})
_AC_TABLE = _table({r << 4 | s: 12 for r in range(16) for s in range(1, 11)} | {n << 4: 12 for n in range(1, 15)} | {0xF0: 9, 0x08: 8, 0x07: 7, 0x00: 6, 0x01: 6, 0x05: 5, 0x02: 4, 0x06: 3, 0x03: 2, 0x04: 2})
_REFINE_TABLE = _table({0x00: 1, **{r << 4 | 1: 5 if r < 8 else 7 for r in range(16)}, 0xF0: 7, **{n << 4: 9 for n in range(1, 15)}})


@functools.lru_cache(8)
def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    symbols, codes, lengths = canonical(table)
    code[symbols], length[symbols] = codes, lengths
    return code, length


# ---------------------------------------------------------------- reading the files


@functools.lru_cache(64)
def _quantisation(body: bytes) -> dict[int, np.ndarray]:
    tables = {}
    while body:
        wide, k = body[0] >> 4, body[0] & 15
        tables[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
        body = body[65 + 64 * wide :]
    return tables


@functools.lru_cache(64)
def _huffman(body: bytes) -> dict[int, bytes]:
    tables = {}
    while body:
        n = 17 + sum(body[1:17])
        tables[body[0]] = body[1:n]
        body = body[n:]
    return tables


def parse(file: bytes, ff: list[int], at: int) -> Image:
    """Headers and scans of one file. ff: places in the batch's bytes where a marker may stand; at: where the file begins there."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, huffman, restart, i = Image(), {}, 0, 2
    while True:
        if i + 2 > len(file) or file[i] != 0xFF:
            raise ValueError("a marker is missing")
        marker = file[i + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(file[i + 2 : i + 4], "big")
        body = file[i + 4 : i + 2 + size]
        i += 2 + size
        if marker == 0xDB:
            image.tables |= _quantisation(body)
        elif marker == 0xC4:
            huffman |= _huffman(body)
        elif marker == 0xC2:
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)]
            if bits != 8 or n not in (1, 3) or not image.width or not image.height or any(x not in (1, 2) for c in image.components for x in c[1:3]):
                raise ValueError("an unsupported frame")
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = bytes(body)
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            chosen = [(ids.index(body[1 + 2 * j]), body[2 + 2 * j]) for j in range(body[0])]
            first, last, bits = body[-3:]
            j = bisect.bisect_left(ff, at + i)
            end = ff[j] - at if j < len(ff) else len(file)
            if end > len(file):
                raise ValueError("the file ends within a scan")
            dc = tuple(huffman.get(t >> 4, b"") for _, t in chosen) if not first and not bits >> 4 else ()
            image.scans.append(Scan(tuple(c for c, _ in chosen), first, last, bits >> 4, bits & 15, dc, huffman.get(16 | chosen[0][1] & 15, b"") if first else b"", restart, at + i, at + end))
            i = end
    if not image.components:
        raise ValueError("no frame")
    return image


class _Bits:
    """Reads bits at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
        n = len(data) + 4
        self.window = padded[:n] << np.uint64(32)
        for j, shift in ((1, 24), (2, 16), (3, 8), (4, 0)):
            self.window |= padded[j : n + j] << np.uint64(shift)
        self.window = self.window.view(np.int64)
        self.most = 8 * (n - 1)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n (up to 32) bits at each place."""
        at = np.minimum(at, self.most)
        return self.window[at >> 3] >> (40 - n - (at & 7)) & ((1 << n) - 1 if isinstance(n, int) else (np.int64(1) << n) - 1)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value of `size` bits as the format writes differences and coefficients."""
    return np.where(bits < np.int64(1) << np.maximum(size - 1, 0), bits - (np.int64(1) << size) + 1, bits)


def _dc_first(bits: _Bits, at: np.ndarray, begin: np.ndarray, count: np.ndarray, rows: np.ndarray, component: np.ndarray, scan: Scan, out: np.ndarray) -> None:
    tables = [_lookup(t) for t in scan.dc]
    slot = np.zeros(max(scan.components) + 1, np.int64)
    slot[list(scan.components)] = np.arange(len(scan.components))
    last = np.zeros((len(at), len(tables)), np.int64)
    for step in range(int(count.max())):
        live = np.flatnonzero(count > step)
        unit = begin[live] + step
        c = slot[component[unit]]
        seen = bits.peek(at[live], 16)
        found = tables[0][seen]
        for k in range(1, len(tables)):
            if scan.dc[k] != scan.dc[0]:
                found = np.where(c == k, tables[k][seen], found)
        if not found.all():
            raise ValueError("a code that no table holds")
        size = found & 255
        place = at[live] + (found >> 8)
        last[live, c] += _signed(bits.peek(place, size), size)
        at[live] = place + size
        out[rows[unit], 0] = last[live, c] << scan.low


def _ac_first(bits: _Bits, at: np.ndarray, begin: np.ndarray, count: np.ndarray, rows: np.ndarray, scan: Scan, out: np.ndarray) -> None:
    table = _lookup(scan.ac)
    unit, end = begin.copy(), begin + count
    k = np.full(len(at), scan.first)
    live = np.flatnonzero(unit < end)
    while len(live):
        found = table[bits.peek(at[live], 16)]
        if not found.all():
            raise ValueError("a code that no table holds")
        size, run = found & 15, found >> 4 & 15
        place = at[live] + (found >> 8)
        ends = (size == 0) & (run < 15)
        extra = np.where(ends, run, size)
        value = bits.peek(place, extra)
        at[live] = place + extra
        here = k[live] + run
        some = np.flatnonzero(size)
        out[rows[unit[live[some]]], np.minimum(here[some], 63)] = _signed(value[some], size[some]) << scan.low
        over = ends | (here >= scan.last)
        k[live] = np.where(over, scan.first, here + 1)
        unit[live] += np.where(ends, (np.int64(1) << run) + value, over)
        live = live[unit[live] < end[live]]


def _ac_refine(bits: _Bits, at: np.ndarray, begin: np.ndarray, count: np.ndarray, rows: np.ndarray, scan: Scan, out: np.ndarray) -> None:
    table = _lookup(scan.ac)
    unit, end = begin.copy(), begin + count
    k, skipping = np.full(len(at), scan.first), np.zeros(len(at), np.int64)
    live = np.flatnonzero(unit < end)
    places = np.arange(scan.first, scan.last + 1)
    while len(live):
        symbol = np.flatnonzero(skipping[live] == 0)
        which = live[symbol]
        found = table[bits.peek(at[which], 16)]
        if not found.all():
            raise ValueError("a code that no table holds")
        size, run = found & 15, found >> 4 & 15
        place = at[which] + (found >> 8)
        ends = (size == 0) & (run < 15)
        extra = np.where(ends, run, size)
        value = bits.peek(place, extra)
        at[which] = place + extra
        skipping[which] = np.where(ends, (np.int64(1) << run) + value, 0)
        wanted, sign = np.full(len(live), 99), np.zeros(len(live), np.int64)
        wanted[symbol] = np.where(ends, 99, run + 1)
        sign[symbol] = np.where(size > 0, 2 * value - 1, 0)
        # of each stream's block: coefficients known, and those passed before the wanted zero
        row = rows[unit[live]]
        block = out[row, scan.first : scan.last + 1]
        known = block != 0
        ahead = places >= k[live][:, None]
        zeros = np.cumsum(ahead & ~known, 1)
        target = (zeros < wanted[:, None]).sum(1)  # relative place of the wanted zero, or behind the last
        passed = known & ahead & (np.arange(len(places)) < target[:, None])
        number = np.cumsum(passed, 1)
        n = number[:, -1]
        high = np.minimum(n, 32)
        first_bits, more_bits = bits.peek(at[live], high), bits.peek(at[live] + high, n - high)
        corrections = first_bits << (n - high) | more_bits
        at[live] += n
        on = passed & (corrections[:, None] >> np.maximum(n[:, None] - number, 0) & 1).astype(bool)
        block = block + np.where(on, np.sign(block) << scan.low, 0)
        new = np.flatnonzero((sign != 0) & (target < len(places)))
        block[new, target[new]] = sign[new] << scan.low
        out[row, scan.first : scan.last + 1] = block
        over = target + 1 >= len(places)
        k[live] = np.where(over, scan.first, scan.first + target + 1)
        unit[live] += over
        skipping[live] -= (skipping[live] > 0) & over
        live = live[unit[live] < end[live]]


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray, list[int]]:
    """Images, all their coefficients (block, 64) in zigzag order, and where each image's blocks begin; components follow each other in rows of whole MCUs."""
    starts = np.cumsum([0, *map(len, files)])
    data = np.frombuffer(b"".join(files), np.uint8)
    follows = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    ff = np.flatnonzero((data == 0xFF) & (follows != 0) & ((follows < 0xD0) | (follows > 0xD7))).tolist()
    images = [parse(f, ff, int(a)) for f, a in zip(files, starts[:-1], strict=True)]
    origin, blocks = [], 0
    for image in images:
        origin.append(blocks)
        for c in range(len(image.components)):
            _, _, down, across = image.grid(c)
            blocks += down * across
    out = np.zeros((blocks, 64), np.int64)
    # entropy-coded bytes without stuffing, and where restart intervals begin
    edge = np.zeros(len(data) + 1, np.int8)
    for image in images:
        for s in image.scans:
            edge[s.begin] += 1
            edge[s.end] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    keep = ~(inside & (before == 0xFF) & (data == 0))
    moved = np.concatenate([[0], np.cumsum(keep)])
    marks = np.flatnonzero(inside & (data == 0xFF) & (follows >= 0xD0) & (follows <= 0xD7))
    bits = _Bits(data[keep])
    # scans of one component depend on each other in order; those of different components are read together
    groups: dict[tuple, list[tuple[Image, Scan, int]]] = {}
    for image, base in zip(images, origin, strict=True):
        reached = [0] * len(image.components)
        for s in image.scans:
            turn = 1 + max(reached[c] for c in s.components)
            for c in s.components:
                reached[c] = turn
            groups.setdefault((turn, s.first, s.last, s.high, s.low, s.dc, s.ac, s.components if s.dc else ()), []).append((image, s, base))
    for key in sorted(groups):
        _scan(bits, groups[key], moved, marks, out)
    return images, out, origin


def _units(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order, relative to the image's first, the component of each, and blocks of an MCU."""
    offsets = np.cumsum([0, *(np.prod(image.grid(c)[2:]) for c in range(len(image.components)))])
    if len(scan.components) == 1:
        c = scan.components[0]
        down, across, _, stride = image.grid(c)
        rows = (np.arange(down)[:, None] * stride + np.arange(across)).reshape(-1) + offsets[c]
        return rows, np.full(len(rows), c), 1
    parts, owner = [], []
    for c in scan.components:
        _, h, v, _ = image.components[c]
        _, _, down, across = image.grid(c)
        grid = np.arange(down * across).reshape(down // v, v, across // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h)
        parts.append(grid + offsets[c])
        owner += [c] * (v * h)
    rows = np.hstack(parts)
    return rows.reshape(-1), np.tile(owner, len(rows)), rows.shape[1]


def _scan(bits: _Bits, members: list[tuple[Image, Scan, int]], moved: np.ndarray, marks: np.ndarray, out: np.ndarray) -> None:
    rows, owners, at, begin, count, total = [], [], [], [], [], 0
    shapes: dict[tuple, list[tuple[Image, Scan, int]]] = {}
    for member in members:
        shapes.setdefault((*member[0].shape(), member[1].restart, member[1].components), []).append(member)
    for same in shapes.values():
        image, s, _ = same[0]
        unit, owner, per_mcu = _units(image, s)
        length = s.restart * per_mcu or max(1, len(unit))
        n = -(-len(unit) // length)
        starts, ends, bases = (np.array(x) for x in zip(*((m[1].begin, m[1].end, m[2]) for m in same), strict=True))
        places = np.empty((len(same), n), np.int64)
        places[:, 0] = starts
        if n > 1:
            chosen = np.searchsorted(marks, starts)[:, None] + np.arange(n - 1)
            if chosen.max() >= len(marks) or (marks[chosen[:, -1]] >= ends).any():
                raise ValueError("restart markers are missing")
            places[:, 1:] = marks[chosen] + 2
        rows.append((unit + bases[:, None]).reshape(-1))
        owners.append(np.tile(owner, len(same)))
        at.append(moved[places].reshape(-1) * 8)
        steps = np.arange(n) * length
        begin.append((total + np.arange(len(same))[:, None] * len(unit) + steps).reshape(-1))
        count.append(np.tile(np.minimum(length, len(unit) - steps), len(same)))
        total += len(unit) * len(same)
    at, begin, count, rows, owners = (np.concatenate(x) for x in (at, begin, count, rows, owners))
    s = members[0][1]
    if s.first == 0 and s.high:
        step = np.arange(len(rows)) - np.repeat(begin, count)
        out[rows, 0] |= bits.peek(np.repeat(at, count) + step, 1) << s.low
    elif s.first == 0:
        _dc_first(bits, at, begin, count, rows, owners, s, out)
    elif s.high:
        _ac_refine(bits, at, begin, count, rows, s, out)
    else:
        _ac_first(bits, at, begin, count, rows, s, out)


# ---------------------------------------------------------------- samples


@functools.lru_cache(1)
def _inverse() -> np.ndarray:
    """Inverse transform of a block in zigzag order to its 64 samples, in whole numbers of 2^-13."""
    x, u = np.arange(8)[:, None], np.arange(8)
    one = np.cos((2 * x + 1) * u * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1)
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.round(both[ZIGZAG] * (1 << _POINT))


def _pixels(image: Image, blocks: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """RGB (n, MCUs down, across, rows, columns, 3) of images of one shape that begin at these blocks."""
    h_most, v_most = max(x[1] for x in image.components), max(x[2] for x in image.components)
    planes, at = [], origin
    for c, (_, h, v, _) in enumerate(image.components):
        _, _, down, across = image.grid(c)
        part = blocks[at[:, None] + np.arange(down * across)].reshape(len(at), down // v, v, across // h, h, 8, 8)
        part = part.transpose(0, 1, 3, 2, 5, 4, 6).reshape(len(at), down // v, across // h, 8 * v, 8 * h)
        if v_most > v:
            part = part.repeat(2, 3)
        if h_most > h:
            part = part.repeat(2, 4)
        planes.append(part)
        at = at + down * across
    out = np.empty((*planes[0].shape, 3), np.uint8)
    if len(planes) == 1:
        out[...] = planes[0][..., None]
        return out
    y, cb, cr = (x.astype(np.int32) for x in planes)
    cb -= 128
    cr -= 128
    for k, change in enumerate((_CR_R * cr, -(_CB_G * cb + _CR_G * cr), _CB_B * cb)):
        change += 32768
        change >>= 16
        change += y
        out[..., k] = np.clip(change, 0, 255, out=change)
    return out


def tensors(images: list[Image], values: np.ndarray, origin: list[int]) -> list[np.ndarray]:
    """The RGB tensor (height, width, 3) of each image at full resolution."""
    samples = values.astype(np.float64)
    at = 0
    for image in images:
        for c, (_, _, _, table) in enumerate(image.components):
            _, _, down, across = image.grid(c)
            if (image.tables[table] != 1).any():
                samples[at : at + down * across] *= image.tables[table]
            at += down * across
    samples = samples @ _inverse()  # whole numbers below 2^53: exact in any order
    samples += (1 << _POINT - 1) + (128 << _POINT)
    samples *= 2.0**-_POINT
    np.floor(samples, out=samples)
    blocks = np.clip(samples, 0, 255, out=samples).astype(np.uint8)
    shapes: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        shapes.setdefault(image.shape(), []).append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(images)
    for same in shapes.values():
        image = images[same[0]]
        pixels = _pixels(image, blocks, np.array([origin[i] for i in same]))
        _, down, across, tall, wide, _ = pixels.shape
        whole = pixels.transpose(0, 1, 3, 2, 4, 5).reshape(len(same), down * tall, across * wide, 3)
        for i, rgb in zip(same, whole, strict=True):
            out[i] = rgb[: image.height, : image.width]
    return out


# ---------------------------------------------------------------- writing


def _pack(code: np.ndarray, length: np.ndarray, interval: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of codes (up to 64 each, right-aligned) one after the other, each interval from a byte of its own, filled with ones: bytes and where intervals begin. interval: of each code, ascending."""
    total = np.bincount(interval, length, n).astype(np.int64)
    size = -(-total // 8)
    begin = np.concatenate([[0], np.cumsum(size)])
    some = np.flatnonzero(length)
    code, length, interval = code[some], length[some], interval[some]
    ends = np.cumsum(length)
    head = np.concatenate([[0], np.cumsum(total)])
    at = ends - length - head[interval] + 8 * begin[interval]
    words = np.zeros((int(begin[-1]) + 7) // 8 + 2, np.uint64)
    if len(code):
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        top = code << (64 - length).astype(np.uint64)
        new = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[new]] |= np.bitwise_or.reduceat(top >> shift, new)
        over = np.flatnonzero((at & 63) + length > 64)
        words[word[over] + 1] |= top[over] << (np.uint64(64) - shift[over])
    data = words.byteswap().view(np.uint8)[: begin[-1]].copy()
    spare = size * 8 - total
    cut = np.flatnonzero(spare)
    data[begin[1:][cut] - 1] |= ((1 << spare[cut]) - 1).astype(np.uint8)
    return data, begin


def _bit_size(x: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.searchsorted(1 << np.arange(12), x, "right")


@functools.lru_cache(1)
def _sizes() -> np.ndarray:
    return _bit_size(np.arange(2048))


def _ac_first_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (block, coefficient) of a band of shifted coefficients; lengths of 0 where nothing is written. ZRL codes precede, and the end of block follows, in one code."""
    code, length = _codes(_AC_TABLE)
    magnitude = np.abs(v)
    size = _sizes()[magnitude]
    place = np.arange(v.shape[1])
    filled = np.where(v != 0, place, -1)
    before = np.full_like(filled, -1)
    before[:, 1:] = np.maximum.accumulate(filled, 1)[:, :-1]
    run = place - before - 1
    symbol = (run & 15) << 4 | size
    bits = np.where(v < 0, v + (np.int64(1) << size) - 1, v).astype(np.uint64)
    out = code[symbol] << size.astype(np.uint64) | bits
    n = length[symbol] + size
    far = np.nonzero((run > 15) & (v != 0))
    for _ in range(3):
        if not len(far[0]):
            break
        out[far] |= code[0xF0] << n[far].astype(np.uint64)
        n[far] += length[0xF0]
        run[far] -= 16
        again = run[far] > 15
        far = far[0][again], far[1][again]
    n[v == 0] = 0
    last = filled.max(1)
    short = np.flatnonzero(last < v.shape[1] - 1)
    at = np.maximum(last[short], 0)
    out[short, at] = np.where(last[short] < 0, 0, out[short, at]) << np.uint64(length[0]) | code[0]
    n[short, at] += length[0]
    return out, n


def _ac_refine_codes(v: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and blocks, in order, of the last bits of the coefficients 1 to 63."""
    code, length = _codes(_REFINE_TABLE)
    magnitude = np.abs(v) >> low
    known = magnitude > 1
    new = magnitude == 1
    plain = ~new.any(1)
    bit = (magnitude & 1).astype(np.uint64)
    # without new coefficients: the end of block, then a bit for each known one
    number = np.cumsum(known, 1)
    n = number[:, -1]
    tail = np.bitwise_or.reduce(np.where(known, bit << (n[:, None] - number).astype(np.uint64), np.uint64(0)), 1)
    blocks = np.arange(len(v))
    p = np.flatnonzero(plain)
    codes = [np.full(len(p), code[0]), tail[p]]
    lengths = [np.full(len(p), length[0]), n[p]]
    owners, keys = [p, p], [np.zeros(len(p), np.int64), np.ones(len(p), np.int64)]
    w = np.flatnonzero(~plain)
    if len(w):
        known, new, bit, value, owner = known[w], new[w], bit[w], v[w], blocks[w]
        place = np.arange(v.shape[1])
        segment = np.cumsum(new, 1) - new  # events before each coefficient
        still = (~known & ~new).astype(np.int64)
        zeros_before = np.cumsum(still, 1) - still
        # zeros at the start of each coefficient's segment
        event_zeros = np.where(new, zeros_before, 0)
        start = np.maximum.accumulate(event_zeros, 1)
        base = np.zeros_like(start)
        base[:, 1:] = start[:, :-1]
        zeros = zeros_before - base
        final = segment == new.sum(1)[:, None]
        sub = np.where(final, 0, zeros >> 4)
        order = segment * 8 + sub  # symbols and bits of a part of a segment stand together, the symbol first
        i, j = np.nonzero(known)
        codes.append(bit[i, j])
        lengths.append(np.ones(len(i), np.int64))
        owners.append(owner[i])
        keys.append(order[i, j] * 128 + 1 + place[j])
        i, j = np.nonzero(new)
        symbol = (zeros[i, j] & 15) << 4 | 1
        codes.append(code[symbol] << np.uint64(1) | (value[i, j] > 0).astype(np.uint64))
        lengths.append(length[symbol] + 1)
        owners.append(owner[i])
        keys.append(order[i, j] * 128)
        for k in range(3):
            i, j = np.nonzero(new & (zeros >> 4 > k))
            codes.append(np.full(len(i), code[0xF0]))
            lengths.append(np.full(len(i), length[0xF0]))
            owners.append(owner[i])
            keys.append((segment[i, j] * 8 + k) * 128)
        i = np.flatnonzero((final & ~new).any(1))
        codes.append(np.full(len(i), code[0]))
        lengths.append(np.full(len(i), length[0]))
        owners.append(owner[i])
        keys.append(new[i].sum(1) * 8 * 128)
    codes, lengths, owners, keys = (np.concatenate(x) for x in (codes, lengths, owners, keys))
    order = np.lexsort((keys, owners))
    return codes[order], lengths[order], owners[order]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def write(values: list[np.ndarray], shapes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Files of given coefficients. values: of each image (6 * MCUs, 64) in zigzag order: luma in rows, then the two chromas; shapes: MCUs across and down."""
    order = sorted(range(len(values)), key=lambda i: shapes[i])  # images of one shape follow each other
    n_images = len(values)
    blocks = np.concatenate([values[i] for i in order]).astype(np.int64)
    base = np.cumsum([0, *(len(values[i]) for i in order)])
    frames = [Image(16 * shapes[i][0], 16 * shapes[i][1], [(1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0)]) for i in order]
    edges_of = [i for i in range(n_images) if not i or shapes[order[i]] != shapes[order[i - 1]]] + [n_images]
    pieces: list[list[bytes]] = [[] for _ in range(n_images)]
    for components, first, last, high, low in SCANS:
        scan = Scan(components, first, last, high, low, (), b"", RESTART, 0, 0)
        rows, intervals, counts, resets = [], [], [], []
        n_intervals = 0
        for a, b in zip(edges_of[:-1], edges_of[1:], strict=True):
            unit, owner, per_mcu = _units(frames[a], scan)
            interval = np.arange(len(unit)) // (RESTART * per_mcu)
            n = int(interval[-1]) + 1
            rows.append((unit + base[a:b, None]).reshape(-1))
            intervals.append((interval + n * np.arange(b - a)[:, None] + n_intervals).reshape(-1))
            resets.append(np.tile(owner, b - a))
            counts += [n] * (b - a)
            n_intervals += n * (b - a)
        rows, intervals, owner = np.concatenate(rows), np.concatenate(intervals), np.concatenate(resets)
        if first == 0 and not high:
            v = blocks[rows, 0] >> low
            code, length = _codes(_DC_TABLE)
            # the difference to the component's last block in the interval
            ranked = np.lexsort((np.arange(len(rows)), owner, intervals))
            v_sorted = v[ranked]
            difference = v_sorted.copy()
            same = (owner[ranked][1:] == owner[ranked][:-1]) & (intervals[ranked][1:] == intervals[ranked][:-1])
            difference[1:] -= np.where(same, v_sorted[:-1], 0)
            d = np.empty_like(difference)
            d[ranked] = difference
            size = _sizes()[np.abs(d)]
            c = code[size] << size.astype(np.uint64) | np.where(d < 0, d + (np.int64(1) << size) - 1, d).astype(np.uint64)
            data, begin = _pack(c, length[size] + size, intervals, n_intervals)
        elif first == 0:
            data, begin = _pack((blocks[rows, 0] >> low & 1).astype(np.uint64), np.ones(len(rows), np.int64), intervals, n_intervals)
        elif not high:
            v = blocks[rows, first : last + 1]
            c, n = _ac_first_codes(np.sign(v) * (np.abs(v) >> low))
            data, begin = _pack(c.reshape(-1), n.reshape(-1), np.repeat(intervals, v.shape[1]), n_intervals)
        else:
            c, n, block = _ac_refine_codes(blocks[rows, first : last + 1], low)
            data, begin = _pack(c, n, intervals[block], n_intervals)
        # stuffing behind 0xFF, and restart markers between the intervals of a scan
        counts = np.array(counts)
        starts = np.cumsum(counts) - counts
        number = np.arange(n_intervals) - np.repeat(starts, counts)
        inner = np.flatnonzero(number > 0)
        stuffed = np.flatnonzero(data == 0xFF) + 1
        where = np.concatenate([stuffed, np.repeat(begin[inner], 2)])
        what = np.concatenate([np.zeros(len(stuffed), np.uint8), np.stack([np.full(len(inner), 0xFF), 0xD0 + (number[inner] - 1) % 8], 1).reshape(-1).astype(np.uint8)])
        raw = np.insert(data, where, what).tobytes()
        edges = np.append(begin[starts], begin[-1])
        shifted = edges + np.searchsorted(stuffed, edges, "right") + 2 * np.append(np.cumsum(counts - 1) - (counts - 1), (counts - 1).sum())
        head = _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0x00 if first == 0 else 0x01 if high else 0x00]) for c in components) + bytes([first, last, high << 4 | low]))
        for i in range(n_images):
            pieces[i] += (head, raw[shifted[i] : shifted[i + 1]])
    common = _segment(0xDB, b"\0" + b"\1" * 64)
    tables = _segment(0xC4, b"\x00" + _DC_TABLE) + _segment(0xC4, b"\x10" + _AC_TABLE) + _segment(0xC4, b"\x11" + _REFINE_TABLE)
    restart = _segment(0xDD, RESTART.to_bytes(2, "big"))
    out = [b""] * n_images
    for i, image, parts in zip(order, frames, pieces, strict=True):
        frame = struct.pack(">BHHB", 8, image.height, image.width, 3) + b"".join(bytes([c, h << 4 | v, q]) for c, h, v, q in image.components)
        out[i] = b"".join([b"\xff\xd8", _segment(0xFE, comments[i]), common, _segment(0xC2, frame), tables, restart, *parts, b"\xff\xd9"])
    return out

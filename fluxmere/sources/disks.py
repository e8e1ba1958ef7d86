"""Sector-order disk images and two file systems on them, as plain functions over bytes.

A 5.25 inch image of 35 tracks holds 16 sectors of 256 bytes a track, in one of two orders: by
logical sector (``do``) or as 512-byte blocks (``po``). The track-linked file system has a
volume table on track 17, catalog sectors linked from there, and a list of (track, sector)
pairs for each file. The block file system has linked directory blocks, and files of one
block, of an index block with its blocks, or of an index of indices; a pointer 0 is a hole.
An image is no larger than 32 MB, so one row is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

TRACKS, SECTORS, SECTOR, BLOCK = 35, 16, 256, 512
FLOPPY = TRACKS * SECTORS * SECTOR
VTOC_TRACK, PAIRS, SLOTS = 17, 122, 7
WRAP = 64
#: Fixed: file types of the track-linked file system by bit.
KINDS = {0x00: "T", 0x01: "I", 0x02: "A", 0x04: "B", 0x08: "S", 0x10: "R"}
#: Fixed: some type codes of the block file system.
TYPES = {"TXT": 0x04, "BIN": 0x06, "DIR": 0x0F, "BAS": 0xFC, "SYS": 0xFF}
_NAMES = {code: name for name, code in TYPES.items()}
DIRECTORY, VOLUME = 0xD, 0xF
ENTRY, PER_BLOCK = 39, 13


@dataclass(frozen=True)
class File:
    """A file of either file system; ``size`` counts sectors or blocks, ``kind`` is a type's name."""

    path: str
    kind: str
    size: int
    data: bytes
    aux: int = 0
    locked: bool = False
    storage: int = 0


def _sector_of(half: int) -> int:
    """Logical sector of a half block of a track: 0, 14, 13, 12 and so on down, and 15 last."""
    return half if half in (0, 15) else 15 - half


def reordered(data: bytes, to_blocks: bool) -> bytes:
    """Sectors from logical into block order, or back."""
    out = bytearray(len(data))
    for track in range(len(data) // (SECTORS * SECTOR)):
        for half in range(SECTORS):
            a, b = ((track * SECTORS + x) * SECTOR for x in (half, _sector_of(half)))
            to, of = (a, b) if to_blocks else (b, a)
            out[to : to + SECTOR] = data[of : of + SECTOR]
    return bytes(out)


def wrap(data: bytes, blocks: bool, creator: bytes = b"FLUX") -> bytes:
    """The image behind a 64-byte header that tells its order and length."""
    head = b"2IMG" + creator + WRAP.to_bytes(2, "little") + (1).to_bytes(2, "little") + int(blocks).to_bytes(4, "little")
    head += (0).to_bytes(4, "little") + (len(data) // BLOCK if blocks else 0).to_bytes(4, "little") + WRAP.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return head.ljust(WRAP, b"\0") + data


def unwrap(data: bytes) -> tuple[bytes, int]:
    """Image and format number (0 logical sectors, 1 blocks, 2 nibbles) of a wrapped image."""
    at, n = (int.from_bytes(data[k : k + 4], "little") for k in (24, 28))
    return data[at : at + n], int.from_bytes(data[12:16], "little")


# --- track-linked file system


def _at(track: int, sector: int) -> int:
    return (track * SECTORS + sector) * SECTOR


def is_linked(data: bytes) -> bool:
    """Whether logical sectors hold the track-linked file system: its volume table says so."""
    v = data[_at(VTOC_TRACK, 0) : _at(VTOC_TRACK, 0) + SECTOR]
    return len(data) == FLOPPY and v[1] == VTOC_TRACK and v[2] < SECTORS and v[0x27] == PAIRS and (v[0x34], v[0x35]) == (TRACKS, SECTORS) and 0 < v[6] < 255


def linked_format(volume: int = 254, reserved: int = 3) -> bytes:
    """An empty image; the first ``reserved`` tracks and the catalog's are in use."""
    data = bytearray(FLOPPY)
    v = _at(VTOC_TRACK, 0)
    data[v + 1 : v + 4] = bytes([VTOC_TRACK, SECTORS - 1, 3])
    data[v + 6], data[v + 0x27] = volume, PAIRS
    data[v + 0x30 : v + 0x38] = bytes([VTOC_TRACK, 1, 0, 0, TRACKS, SECTORS, 0, 1])
    for track in range(reserved, TRACKS):
        if track != VTOC_TRACK:
            data[v + 0x38 + 4 * track : v + 0x3A + 4 * track] = b"\xff\xff"
    for sector in range(SECTORS - 1, 1, -1):
        data[_at(VTOC_TRACK, sector) + 1 : _at(VTOC_TRACK, sector) + 3] = bytes([VTOC_TRACK, sector - 1])
    return bytes(data)


def linked_free(data: bytes) -> int:
    """Free sectors by the bit map."""
    v = _at(VTOC_TRACK, 0) + 0x38
    return sum(int.from_bytes(data[v + 4 * t : v + 4 * t + 2], "big").bit_count() for t in range(TRACKS))


def _take(data: bytearray) -> tuple[int, int]:
    """The next free sector: tracks outward from the catalog's, first above it, then below."""
    v = _at(VTOC_TRACK, 0) + 0x38
    for track in [*range(VTOC_TRACK + 1, TRACKS), *range(VTOC_TRACK - 1, -1, -1)]:
        bits = int.from_bytes(data[v + 4 * track : v + 4 * track + 2], "big")
        if bits:
            sector = bits.bit_length() - 1
            data[v + 4 * track : v + 4 * track + 2] = (bits & ~(1 << sector)).to_bytes(2, "big")
            return track, sector
    raise ValueError("disk full")


def _linked_slots(data: bytes) -> Iterator[int]:
    """Places of directory entries in order; a link that leads back ends the catalog."""
    v = _at(VTOC_TRACK, 0)
    track, sector, seen = data[v + 1], data[v + 2], set()
    while (track or sector) and (track, sector) not in seen and track < TRACKS and sector < SECTORS:
        seen.add((track, sector))
        at = _at(track, sector)
        yield from (at + 0x0B + 35 * k for k in range(SLOTS))
        track, sector = data[at + 1], data[at + 2]


def linked_put(image: bytes, name: str, kind: str, content: bytes) -> bytes:
    """The image with one more file. All or nothing: ValueError for a name in use, a full directory or disk."""
    data, code = bytearray(image), next(k for k, v in KINDS.items() if v == kind)
    label = bytes(c | 0x80 for c in name.ljust(30).encode("ascii"))
    if len(name) > 30 or not name or any(data[at] not in (0, 255) and data[at + 3 : at + 33] == label for at in _linked_slots(data)):
        raise ValueError(f"bad or duplicate name {name!r}")
    slot = next((at for at in _linked_slots(data) if data[at] in (0, 255)), None)
    if slot is None:
        raise ValueError("directory full")
    parts = [content[k : k + SECTOR].ljust(SECTOR, b"\0") for k in range(0, len(content), SECTOR)]
    lists = [parts[k : k + PAIRS] for k in range(0, len(parts), PAIRS)] or [[]]
    first = here = _take(data)
    for n, part in enumerate(lists):
        at = _at(*here)
        data[at : at + SECTOR] = bytes(SECTOR)
        data[at + 5 : at + 7] = (n * PAIRS).to_bytes(2, "little")
        for k, piece in enumerate(part):
            track, sector = _take(data)
            data[at + 12 + 2 * k : at + 14 + 2 * k] = bytes([track, sector])
            data[_at(track, sector) : _at(track, sector) + SECTOR] = piece
        if n + 1 < len(lists):
            here = _take(data)
            data[at + 1 : at + 3] = bytes(here)
    data[slot : slot + 35] = bytes([*first, code]) + label + (len(parts) + len(lists)).to_bytes(2, "little")
    return bytes(data)


def linked_delete(image: bytes, name: str) -> bytes:
    """The image without a file: its first track moves to the end of its name, its sectors are free."""
    data = bytearray(image)
    label = bytes(c | 0x80 for c in name.ljust(30).encode("ascii"))
    slot = next((at for at in _linked_slots(data) if data[at] not in (0, 255) and data[at + 3 : at + 33] == label), None)
    if slot is None:
        raise ValueError(f"no file {name!r}")
    v = _at(VTOC_TRACK, 0) + 0x38
    for track, sector in [*_lists(data, slot), *(p for p in _pairs(data, slot) if p != (0, 0))]:
        bits = int.from_bytes(data[v + 4 * track : v + 4 * track + 2], "big") | 1 << sector
        data[v + 4 * track : v + 4 * track + 2] = bits.to_bytes(2, "big")
    data[slot + 32], data[slot] = data[slot], 255
    return bytes(data)


def _lists(data: bytes, slot: int) -> Iterator[tuple[int, int]]:
    track, sector, seen = data[slot], data[slot + 1], set()
    while (track or sector) and (track, sector) not in seen and track < TRACKS and sector < SECTORS:
        seen.add((track, sector))
        yield track, sector
        at = _at(track, sector)
        track, sector = data[at + 1], data[at + 2]


def _pairs(data: bytes, slot: int) -> Iterator[tuple[int, int]]:
    """(track, sector) of a file's data in order; (0, 0) is a hole."""
    for place in _lists(data, slot):
        at = _at(*place) + 12
        yield from ((data[at + 2 * k], data[at + 2 * k + 1]) for k in range(PAIRS))


def linked_files(data: bytes) -> list[File]:
    """Files in the catalog's order. Data are the sectors up to the last; text ends at its first 0."""
    out = []
    for slot in _linked_slots(data):
        if data[slot] in (0, 255):
            continue
        name = "".join(chr(c & 0x7F) for c in data[slot + 3 : slot + 33]).rstrip()
        pairs = list(_pairs(data, slot))
        while pairs and pairs[-1] == (0, 0):
            pairs.pop()
        content = b"".join(data[_at(*p) : _at(*p) + SECTOR] if p != (0, 0) else bytes(SECTOR) for p in pairs)
        kind = KINDS.get(data[slot + 2] & 0x7F, "$")
        if kind == "T":
            content = content.split(b"\0", 1)[0]
        out.append(File(name, kind, int.from_bytes(data[slot + 33 : slot + 35], "little"), content, 0, bool(data[slot + 2] & 0x80)))
    return out


# --- block file system


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def is_blocked(data: bytes) -> bool:
    """Whether blocks hold the block file system: its volume header says so."""
    h = data[2 * BLOCK + 4 : 2 * BLOCK + 4 + ENTRY]
    return len(data) >= 280 * BLOCK and h[0] >> 4 == VOLUME and _word(data, 2 * BLOCK) == 0 and (h[0x1F], h[0x20]) == (ENTRY, PER_BLOCK) and _word(h, 0x25) == len(data) // BLOCK


def _map_blocks(total: int) -> int:
    return -(-total // (8 * BLOCK))


def blocked_format(name: str, total: int = 280) -> bytes:
    """An empty volume of ``total`` blocks: two boot blocks, four directory blocks, the bit map."""
    data = bytearray(total * BLOCK)
    for k in range(4):
        at = (2 + k) * BLOCK
        data[at : at + 4] = (k + 1 if k else 0).to_bytes(2, "little") + (k + 3 if k < 3 else 0).to_bytes(2, "little")
    at = 2 * BLOCK + 4
    label = name.upper().encode("ascii")
    data[at : at + 1 + len(label)] = bytes([VOLUME << 4 | len(label)]) + label
    data[at + 0x1E : at + 0x21] = bytes([0xC3, ENTRY, PER_BLOCK])
    data[at + 0x23 : at + 0x27] = (6).to_bytes(2, "little") + total.to_bytes(2, "little")
    for block in range(6 + _map_blocks(total), total):
        data[6 * BLOCK + block // 8] |= 0x80 >> block % 8
    return bytes(data)


def blocked_free(data: bytes) -> int:
    at = _word(data, 2 * BLOCK + 4 + 0x23) * BLOCK
    return sum(x.bit_count() for x in data[at : at + _map_blocks(len(data) // BLOCK) * BLOCK])


class _Volume:
    """A volume that files are put on; blocks are taken from the lowest free."""

    def __init__(self, image: bytes):
        self.data = bytearray(image)
        self.map = _word(image, 2 * BLOCK + 4 + 0x23) * BLOCK
        self.low = 0

    def take(self) -> int:
        for block in range(self.low, len(self.data) // BLOCK):
            if self.data[self.map + block // 8] & 0x80 >> block % 8:
                self.data[self.map + block // 8] &= ~(0x80 >> block % 8) & 255
                self.low = block + 1
                self.data[block * BLOCK : (block + 1) * BLOCK] = bytes(BLOCK)
                return block
        raise ValueError("disk full")

    def index(self, pointers: list[int]) -> int:
        block = self.take()
        for k, p in enumerate(pointers):
            self.data[block * BLOCK + k], self.data[block * BLOCK + 256 + k] = p & 255, p >> 8
        return block

    def store(self, content: bytes) -> tuple[int, int, int]:
        """Storage type, key block and blocks in use; all-zero blocks of longer files become holes."""
        parts = [content[k : k + BLOCK] for k in range(0, len(content), BLOCK)] or [b""]
        used, pointers = 0, []
        for k, part in enumerate(parts):
            if k and not any(part):
                pointers.append(0)
                continue
            block = self.take()
            used += 1
            self.data[block * BLOCK : block * BLOCK + len(part)] = part
            pointers.append(block)
        if len(parts) == 1:
            return 1, pointers[0], used
        indices = []
        for k in range(0, len(pointers), 256):
            some = any(pointers[k : k + 256])
            indices.append(self.index(pointers[k : k + 256]) if some else 0)
            used += some
        if len(indices) == 1:
            return 2, indices[0], used
        return 3, self.index(indices), used + 1

    def directory(self, key: int) -> Iterator[int]:
        seen = set()
        while key and key not in seen:
            seen.add(key)
            first = 4 + ENTRY * (len(seen) == 1)
            yield from range(key * BLOCK + first, key * BLOCK + 4 + ENTRY * PER_BLOCK, ENTRY)
            key = _word(self.data, key * BLOCK + 2)

    def slot(self, key: int, name: bytes) -> int:
        free = None
        for at in self.directory(key):
            if not self.data[at] >> 4:
                free = at if free is None else free
            elif self.data[at + 1 : at + 1 + (self.data[at] & 15)] == name:
                raise ValueError(f"duplicate name {name!r}")
        if free is not None:
            return free
        if key == 2:
            raise ValueError("directory full")
        last = key
        while _word(self.data, last * BLOCK + 2):
            last = _word(self.data, last * BLOCK + 2)
        block = self.take()
        self.data[last * BLOCK + 2 : last * BLOCK + 4] = block.to_bytes(2, "little")
        self.data[block * BLOCK : block * BLOCK + 2] = last.to_bytes(2, "little")
        parent = key * BLOCK + 4
        owner = _word(self.data, parent + 0x23) * BLOCK + 4 + ENTRY * (self.data[parent + 0x25] - 1)
        self.data[owner + 0x13 : owner + 0x15] = (_word(self.data, owner + 0x13) + 1).to_bytes(2, "little")
        self.data[owner + 0x15 : owner + 0x18] = (int.from_bytes(self.data[owner + 0x15 : owner + 0x18], "little") + BLOCK).to_bytes(3, "little")
        return block * BLOCK + 4

    def enter(self, key: int, name: str, code: int, storage: int, block: int, used: int, eof: int, aux: int) -> int:
        label = name.upper().encode("ascii")
        at = self.slot(key, label)
        entry = bytes([storage << 4 | len(label)]) + label.ljust(15, b"\0") + bytes([code]) + block.to_bytes(2, "little") + used.to_bytes(2, "little") + eof.to_bytes(3, "little")
        entry += bytes(6) + bytes([0xC3]) + aux.to_bytes(2, "little") + bytes(4) + key.to_bytes(2, "little")
        self.data[at : at + ENTRY] = entry
        count = key * BLOCK + 4 + 0x21
        self.data[count : count + 2] = (_word(self.data, count) + 1).to_bytes(2, "little")
        return at


def blocked_put(image: bytes, files: list[tuple[str, str, int, bytes]]) -> bytes:
    """The volume with more files (path, type, aux, content); directories on the way are made. All or nothing."""
    v, known = _Volume(image), {(): 2}

    def folder(path: tuple[str, ...]) -> int:
        if path not in known:
            parent = folder(path[:-1])
            key = v.take()
            at = v.enter(parent, path[-1], TYPES["DIR"], DIRECTORY, key, 1, BLOCK, 0)
            label = path[-1].upper().encode("ascii")
            head = key * BLOCK + 4
            v.data[head : head + 1 + len(label)] = bytes([0xE0 | len(label)]) + label
            v.data[head + 0x10] = 0x75
            v.data[head + 0x1E : head + 0x21] = bytes([0xC3, ENTRY, PER_BLOCK])
            v.data[head + 0x23 : head + 0x27] = (at // BLOCK).to_bytes(2, "little") + bytes([(at % BLOCK - 4) // ENTRY + 1, ENTRY])
            known[path] = key
        return known[path]

    for path, kind, aux, content in files:
        *above, name = [x for x in path.split("/") if x]
        key = folder(tuple(above))
        storage, block, used = v.store(content)
        v.enter(key, name, TYPES[kind], storage, block, used, len(content), aux)
    return bytes(v.data)


def _content(data: bytes, storage: int, block: int, eof: int) -> bytes:
    pointers = lambda b: [data[b * BLOCK + k] | data[b * BLOCK + 256 + k] << 8 for k in range(256)] if b else [0] * 256
    if storage == 1:
        blocks = [block]
    elif storage == 2:
        blocks = pointers(block)
    else:
        blocks = [p for index in pointers(block)[: -(-eof // (256 * BLOCK))] for p in pointers(index)]
    return b"".join(data[b * BLOCK : (b + 1) * BLOCK] if b else bytes(BLOCK) for b in blocks[: max(1, -(-eof // BLOCK))])[:eof]


def blocked_files(data: bytes) -> list[File]:
    """Files and directories, depth first; paths begin with the volume's name."""
    v, out, seen = _Volume(data), [], set()

    def walk(key: int, above: str) -> None:
        if key in seen:
            return
        seen.add(key)
        for at in v.directory(key):
            storage, n = v.data[at] >> 4, v.data[at] & 15
            if not storage:
                continue
            path = f"{above}/{bytes(v.data[at + 1 : at + 1 + n]).decode('ascii', 'replace')}"
            block, used, eof = _word(v.data, at + 0x11), _word(v.data, at + 0x13), int.from_bytes(v.data[at + 0x15 : at + 0x18], "little")
            content = _content(v.data, storage, block, eof) if storage < 4 else b""
            kind = _NAMES.get(v.data[at + 0x10], f"${v.data[at + 0x10]:02X}")
            out.append(File(path, kind, used, content, _word(v.data, at + 0x1F), v.data[at + 0x1E] & 0xC2 == 0, storage))
            if storage == DIRECTORY:
                walk(block, path)

    h = v.data[2 * BLOCK + 4]
    walk(2, "/" + bytes(v.data[2 * BLOCK + 5 : 2 * BLOCK + 5 + (h & 15)]).decode("ascii", "replace"))
    return out


# --- any of them


@dataclass(frozen=True)
class Volume:
    """What an image is: container, file system (empty if none is known), free sectors or blocks."""

    container: str
    system: str
    free: int
    data: bytes


def identify(data: bytes) -> Volume | None:
    """Container and file system by trial, in a fixed order; None if nothing fits. Of two orders of a floppy that fits whose file system is there."""
    if data[:4] == b"2IMG":
        inner, order = unwrap(data)
        found = [_tried(inner, c) for c in (("do",), ("po",))[order : order + 1] for c in c] if order < 2 else []
        return next((Volume("2mg", x.system, x.free, x.data) for x in found if x), Volume("2mg", "", 0, inner))
    for magic, name in ((b"IMD ", "imd"), (b"WOZ1", "woz1"), (b"WOZ2", "woz2"), (b"TD\0", "td0"), (b"td\0", "td0")):
        if data.startswith(magic):
            return Volume(name, "", 0, data)
    if len(data) == TRACKS * 6656:
        return Volume("nib", "", 0, data)
    if len(data) == TRACKS * 13 * SECTOR:
        return Volume("d13", "", 0, data)
    found = [x for c in ("do", "po") if (x := _tried(data, c))]
    # the volume table lies at the same place in both orders, but its catalog breaks off in the wrong one
    return max(found, key=lambda x: (x.system != "", sum(1 for _ in _linked_slots(x.data)) if x.system == "dos" else 0), default=None)


def _tried(data: bytes, container: str) -> Volume | None:
    if container == "do" and len(data) != FLOPPY or len(data) % BLOCK or not 280 * BLOCK <= len(data) <= 65535 * BLOCK:
        return None
    sectors, blocks = (data, reordered(data, True)) if container == "do" else (reordered(data, False) if len(data) == FLOPPY else b"", data)
    if is_linked(sectors):
        return Volume(container, "dos", linked_free(sectors), sectors)
    if is_blocked(blocks):
        return Volume(container, "prodos", blocked_free(blocks), blocks)
    return Volume(container, "", 0, data)


def files(volume: Volume) -> list[File]:
    return linked_files(volume.data) if volume.system == "dos" else blocked_files(volume.data) if volume.system == "prodos" else []

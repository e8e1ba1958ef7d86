"""Images built and read back, their structure byte by byte, and what is refused."""

import random

import pytest

from fluxmere.operators import disks as ops
from fluxmere.sources import disks


def contents(seed, sizes):
    rng = random.Random(seed)
    return [bytes(rng.randrange(1, 256) for _ in range(n)) for n in sizes]


def test_track_linked_round_trip():
    image = disks.linked_format(200)
    assert disks.linked_free(image) == (35 - 3 - 1) * 16
    data = contents(1, [0, 1, 256, 257, 122 * 256, 122 * 256 + 1])
    for k, x in enumerate(data):
        image = disks.linked_put(image, f"FILE {k}", "T" if k < 4 else "B", x)
    got = disks.linked_files(image)
    assert [(f.path, f.kind, f.size) for f in got] == [("FILE 0", "T", 1), ("FILE 1", "T", 2), ("FILE 2", "T", 2), ("FILE 3", "T", 3), ("FILE 4", "B", 123), ("FILE 5", "B", 125)]
    assert [f.data for f in got[:4]] == data[:4] and [f.data.rstrip(b"\0") for f in got[4:]] == [x.rstrip(b"\0") for x in data[4:]]
    assert disks.linked_free(image) == 496 - sum(f.size for f in got)
    v = 17 * 4096
    assert image[v + 1 : v + 4] == b"\x11\x0f\x03" and image[v + 6] == 200 and image[v + 0x27] == 122
    first = 17 * 4096 + 15 * 256 + 0x0B
    assert image[first : first + 3] == bytes([18, 15, 0]) and image[first + 3 : first + 9] == bytes(c | 0x80 for c in b"FILE 0")
    gone = disks.linked_delete(image, "FILE 4")
    assert [f.path[-1] for f in disks.linked_files(gone)] == ["0", "1", "2", "3", "5"] and disks.linked_free(gone) == disks.linked_free(image) + 123


def test_track_linked_refusals():
    image = disks.linked_put(disks.linked_format(), "A", "T", b"x")
    with pytest.raises(ValueError, match="duplicate"):
        disks.linked_put(image, "A", "T", b"")
    with pytest.raises(ValueError, match="full"):
        disks.linked_put(image, "B", "B", bytes(496 * 256))
    for k in range(104):
        image = disks.linked_put(image, f"N{k}", "T", b"")
    with pytest.raises(ValueError, match="directory full"):
        disks.linked_put(image, "ONE MORE", "T", b"")
    loop = bytearray(image)
    loop[17 * 4096 + 256 + 1 : 17 * 4096 + 256 + 3] = bytes([17, 15])  # the last catalog sector leads back
    assert len(disks.linked_files(bytes(loop))) == 105


def test_blocks_round_trip():
    data = contents(2, [0, 1, 512, 513, 256 * 512, 256 * 512 + 1])
    data.append(b"x" + bytes(600 * 512) + b"y")
    files = [(f"SUB/DEEP/F{k}" if k % 2 else f"F{k}", "BIN", k, x) for k, x in enumerate(data)]
    files += [(f"MANY/N{k}", "TXT", 0, b"n") for k in range(40)]
    image = disks.blocked_put(disks.blocked_format("VOL", 1600), files)
    got = {f.path: f for f in disks.blocked_files(image)}
    assert {p: f.data for p, f in got.items() if f.kind != "DIR"} == {"/VOL/" + p: x for p, _, _, x in files}
    assert {p for p, f in got.items() if f.kind == "DIR"} == {"/VOL/SUB", "/VOL/SUB/DEEP", "/VOL/MANY"}
    assert [got[f"/VOL/{p}"].storage for p, *_ in files[:7]] == [1, 1, 1, 2, 2, 3, 3]
    assert [got[f"/VOL/{p}"].size for p, *_ in files[:7]] == [1, 1, 1, 3, 257, 260, 5]
    assert got["/VOL/MANY"].size == 4 and got["/VOL/SUB/DEEP/F3"].aux == 3
    assert disks.blocked_free(image) == 1600 - 7 - sum(f.size for f in got.values())
    with pytest.raises(ValueError, match="duplicate"):
        disks.blocked_put(image, [("F0", "TXT", 0, b"")])
    with pytest.raises(ValueError, match="full"):
        disks.blocked_put(disks.blocked_format("V", 280), [("BIG", "BIN", 0, b"z" * 300 * 512)])


def test_identify():
    dos = disks.linked_put(disks.linked_format(), "A", "T", b"hello")
    pro = disks.blocked_put(disks.blocked_format("V"), [("A", "TXT", 0, b"hello")])
    cases = {("do", "dos"): dos, ("po", "dos"): disks.reordered(dos, True), ("po", "prodos"): pro, ("do", "prodos"): disks.reordered(pro, False), ("2mg", "dos"): disks.wrap(dos, False), ("2mg", "prodos"): disks.wrap(pro, True)}
    for want, image in cases.items():
        found = disks.identify(image)
        assert (found.container, found.system) == want and [f.data for f in disks.files(found)] == [b"hello"]
    assert disks.reordered(disks.reordered(dos, True), False) == dos
    kinds = {b"WOZ2...": "woz2", b"IMD 1.18": "imd", bytes(232960): "nib", bytes(116480): "d13", bytes(143360): "do", bytes(819200): "po"}
    assert {x: disks.identify(x).container for x in kinds} == kinds
    assert disks.identify(b"") is disks.identify(bytes(1000)) is None


def test_rows(spark):
    images = spark.createDataFrame([(1, bytearray(disks.linked_put(disks.linked_format(), "A", "T", b"hi"))), (2, None), (3, bytearray(b"junk"))], "image_id long, image binary")
    assert sorted(map(tuple, ops.identified(images).fillna("").collect())) == [(1, "do", "dos", 494), (2, "", "", None), (3, "", "", None)]
    assert [(r.image_id, r.path, bytes(r.data)) for r in ops.files(images).collect()] == [(1, "A", b"hi")]
    assert ops.files(images.limit(0)).count() == 0

"""HDF5: where a data set's bytes lie, from the file's own index, so that chunks can be read apart.

Read: superblocks 0, 1, 2 and 3; groups by symbol tables or links in the header; object headers of versions 1 and 2; fixed and
floating-point numbers; contiguous data and chunks under version-1 B-trees; deflate and shuffle. What else the format knows
(dense groups, newer chunk indices, other filters) raises an error."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

NONE = (1 << 64) - 1


@dataclass
class Dataset:
    shape: tuple[int, ...] = ()
    kind: str = ""
    at: int = 0
    chunk: tuple[int, ...] | None = None
    chunks: list[tuple[tuple[int, ...], int, int]] = field(default_factory=list)
    packs: tuple[str, ...] = ()


def _at(f, place: int, n: int) -> bytes:
    f.seek(place)
    return f.read(n)


def _root(f) -> int:
    """The address of the root group's object header. Addresses and lengths take eight bytes."""
    head = _at(f, 0, 96)
    version = head[8]
    sizes = head[13:15] if version < 2 else head[9:11]
    if version > 3 or tuple(sizes) != (8, 8):
        raise ValueError("HDF5: superblock or address size isn't read")
    if version >= 2:
        return struct.unpack_from("<Q", head, 36)[0]
    return struct.unpack_from("<Q", head, (24 if version == 0 else 28) + 32 + 8)[0]


def _messages(f, at: int) -> list[tuple[int, bytes]]:
    """(type, content) of an object header and its continuations."""
    start, out = _at(f, at, 16), []
    if start[:4] != b"OHDR":
        if start[0] != 1:
            raise ValueError("HDF5: object header isn't read")
        count, _, size = struct.unpack_from("<HII", start, 2)
        todo = [(at + 16, size)]
        while todo and len(out) < count:
            place, n = todo.pop(0)
            raw, k = _at(f, place, n), 0
            while k + 8 <= n and len(out) < count:
                kind, length = struct.unpack_from("<HH", raw, k)
                body = raw[k + 8 : k + 8 + length]
                out.append((kind, body))
                if kind == 16:
                    todo.append(struct.unpack("<QQ", body[:16]))
                k += 8 + length
        return out
    flags, place = start[5], at + 6
    place += 16 * (flags >> 5 & 1) + 4 * (flags >> 4 & 1)
    width = 1 << (flags & 3)
    size = int.from_bytes(_at(f, place, width), "little")
    todo, head = [(place + width, size)], 4 + 2 * (flags >> 2 & 1)
    while todo:
        place, n = todo.pop(0)
        raw, k = _at(f, place, n), 0
        while k + head <= n:
            kind, length = raw[k], struct.unpack_from("<H", raw, k + 1)[0]
            body = raw[k + head : k + head + length]
            out.append((kind, body))
            if kind == 16:
                where, length_on = struct.unpack("<QQ", body[:16])
                todo.append((where + 4, length_on - 8))  # between a mark and a checksum
            k += head + length
    return out


def _linked(f, tree: int, heap: int, name: str) -> int | None:
    """The object header that a group's symbol table gives for a name."""
    data = struct.unpack_from("<Q", _at(f, heap, 32), 24)[0]
    todo = [tree]
    while todo:
        node = todo.pop()
        head = _at(f, node, 24)
        if head[:4] == b"TREE":
            used = struct.unpack_from("<H", head, 6)[0]
            raw = _at(f, node + 24, 16 * used + 8)
            todo += [struct.unpack_from("<Q", raw, 8 + 16 * k)[0] for k in range(used)]
        elif head[:4] == b"SNOD":
            n = struct.unpack_from("<H", head, 6)[0]
            raw = _at(f, node + 8, 40 * n)
            for k in range(n):
                offset, where = struct.unpack_from("<QQ", raw, 40 * k)
                if _at(f, data + offset, len(name) + 1) == name.encode() + b"\0":
                    return where
        else:
            raise ValueError("HDF5: group index isn't read")
    return None


def _link(body: bytes) -> tuple[str, int] | None:
    """Name and address of a hard link message."""
    flags, k, kind = body[1], 2, 0
    if flags & 8:
        kind, k = body[k], k + 1
    k += 8 * (flags >> 2 & 1) + (flags >> 4 & 1)
    width = 1 << (flags & 3)
    n = int.from_bytes(body[k : k + width], "little")
    k += width
    return (body[k : k + n].decode(), struct.unpack_from("<Q", body, k + n)[0]) if kind == 0 else None


def _chunks(f, tree: int, rank: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(first place, address, bytes) of all chunks under a version-1 B-tree."""
    out, todo, key = [], [tree] if tree != NONE else [], 8 + 8 * (rank + 1)
    while todo:
        node = todo.pop()
        head = _at(f, node, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("HDF5: chunk index isn't read")
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        raw = _at(f, node + 24, used * (key + 8) + key)
        for k in range(used):
            length, masked, *low = struct.unpack_from(f"<II{rank + 1}Q", raw, k * (key + 8))
            where = struct.unpack_from("<Q", raw, k * (key + 8) + key)[0]
            if level:
                todo.append(where)
            elif masked:
                raise ValueError("HDF5: a chunk without its filters isn't read")
            else:
                out.append((tuple(low[:rank]), where, length))
    return sorted(out)


def dataset(f, name: str) -> Dataset:
    """A data set of the root group."""
    where = None
    for kind, body in _messages(f, _root(f)):
        if kind == 17:
            where = _linked(f, *struct.unpack("<QQ", body[:16]), name)
        elif kind == 6 and (link := _link(body)) and link[0] == name:
            where = link[1]
    if where is None:
        raise ValueError(f"HDF5: no {name} in the root group")
    d, layout, packs = Dataset(), None, []
    for kind, body in _messages(f, where):
        if kind == 1:
            d.shape = struct.unpack_from(f"<{body[1]}Q", body, 8 if body[0] == 1 else 4)
        elif kind == 3:
            what, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
            if what > 1:
                raise ValueError("HDF5: only numbers are read")
            d.kind = (">" if bits & 1 else "<") + ("f" if what else "i" if bits & 8 else "u") + str(size)
        elif kind == 8:
            layout = body
        elif kind == 11:
            packs = _filters(body)
    if layout is None or layout[0] not in (3, 4) or layout[1] not in (1, 2) or (layout[0] == 4 and layout[1] == 2):
        raise ValueError("HDF5: data layout isn't read")
    if layout[1] == 1:
        d.at = struct.unpack_from("<Q", layout, 2)[0]
        return d
    rank = layout[2] - 1
    tree, *chunk = struct.unpack_from(f"<Q{rank}I", layout, 3)
    d.chunk, d.chunks, d.packs = tuple(chunk), _chunks(f, tree, rank), tuple(reversed(packs))
    return d


def _filters(body: bytes) -> list[str]:
    """Names of a pipeline's filters, in the order in which they were applied."""
    version, n, k, out = body[0], body[1], 8 if body[0] == 1 else 2, []
    names = {1: "zlib", 2: "shuffle"}  # fixed values: the format's numbers of these
    for _ in range(n):
        (number,) = struct.unpack_from("<H", body, k)
        if version == 1 or number >= 256:
            length, _, values = struct.unpack_from("<HHH", body, k + 2)
            k += 8 + (-(-length // 8) * 8 if version == 1 else length)
        else:
            _, values = struct.unpack_from("<HH", body, k + 2)
            k += 6
        k += 4 * values + (4 if version == 1 and values % 2 else 0)
        if number not in names:
            raise ValueError(f"HDF5: filter {number} isn't read")
        out.append(names[number])
    return out


def _message(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def _header(*messages: bytes) -> bytes:
    whole = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(whole)) + whole


#: Entries of an index node, twice the format's default rank of chunk indices.
_FAN = 64


def head(shape: tuple[int, ...], chunk: tuple[int, ...], kind: str, lengths: list[int], zlib: bool, name: str = "Data") -> bytes:
    """The bytes ahead of the chunks of one chunked data set, which follow in the order of their places, the last axis
    fastest, `lengths` bytes each; chunks are whole at the edges too."""
    import numpy as np

    rank, item = len(shape), np.dtype(kind).itemsize
    counts = [-(-s // c) for s, c in zip(shape, chunk, strict=True)]
    if kind[0] == "f":
        exponent, mantissa = (8, 23) if item == 4 else (11, 52)
        what = struct.pack("<BBBBIHHBBBBI", 17, 32, 8 * item - 1, 0, item, 0, 8 * item, mantissa, exponent, 0, mantissa, (1 << (exponent - 1)) - 1)
    else:
        what = struct.pack("<BBBBIHH", 16, 8 if kind[0] == "i" else 0, 0, 0, item, 0, 8 * item)
    messages = lambda tree: [
        _message(1, struct.pack(f"<BBB5x{rank}Q", 1, rank, 0, *shape)), _message(3, what), _message(5, bytes([2, 3, 2, 0])),
        *([_message(11, struct.pack("<BB6xHHHHI4x", 1, 1, 1, 0, 1, 1, 6))] if zlib else []),
        _message(8, struct.pack(f"<BBBQ{rank}II", 3, 2, rank + 1, tree, *chunk, item))]
    labels = b"\0" * 8 + name.encode() + b"\0" * (8 - len(name) % 8)
    group, heap = 96 + 16 + 24, 96 + 40 + 544
    table = heap + 32 + len(labels)
    data = table + 328
    tree = data + len(_header(*messages(0)))
    node = 24 + (_FAN + 1) * (16 + 8 * rank) + 8 * _FAN
    places = [tuple(int(i) * c for i, c in zip(np.unravel_index(k, counts), chunk, strict=True)) for k in range(len(lengths))]
    levels, n = [], len(lengths)
    while True:
        n = -(-n // _FAN)
        levels.append(n)
        if n <= 1:
            break
    start, starts = tree, []
    for n in reversed(levels):  # the root first
        starts.insert(0, start)
        start += n * node
    ends = np.cumsum([start, *lengths]).tolist()
    key = lambda length, low: struct.pack(f"<II{rank + 1}Q", length, 0, *low, 0)
    beyond = key(0, [c * n for c, n in zip(chunk, counts, strict=True)])
    below = [(key(length, low), at) for length, low, at in zip(lengths, places, ends, strict=False)]
    nodes = {}
    for level, (n, first) in enumerate(zip(levels, starts, strict=True)):
        above = []
        for k in range(n):
            own = below[k * _FAN : (k + 1) * _FAN]
            after = below[(k + 1) * _FAN][0] if k + 1 < n else beyond
            sides = [first + j * node if 0 <= j < n else NONE for j in (k - 1, k + 1)]
            raw = b"TREE" + struct.pack("<BBHQQ", 1, level, len(own), *sides) + b"".join(a + struct.pack("<Q", b) for a, b in own) + after
            nodes[first + k * node] = raw.ljust(node, b"\0")
            above.append((own[0][0] if own else beyond, first + k * node))
        below = above
    out = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBxBBBxHHIQQQQ", 0, 0, 0, 0, 8, 8, 4, 16, 0, 0, NONE, ends[-1], NONE)
    out += struct.pack("<QQIIQQ", 0, 96, 1, 0, group, heap)
    out += _header(_message(17, struct.pack("<QQ", group, heap)))
    out += (b"TREE" + struct.pack("<BBHQQQQQ", 0, 0, 1, NONE, NONE, 0, table, 8)).ljust(544, b"\0")
    out += b"HEAP" + struct.pack("<B3xQQQ", 0, len(labels), 1, heap + 32) + labels
    out += (b"SNOD" + struct.pack("<BxHQQII16x", 1, 1, 8, data, 0, 0)).ljust(328, b"\0")
    return out + _header(*messages(tree)) + b"".join(nodes[k] for k in sorted(nodes))

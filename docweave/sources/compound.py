"""Compound files: a small file system of streams in one file (the public [MS-CFB] layout), read only."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST = 0xFFFFFFFA  # from here on sector numbers have other meanings


class NotCompound(ValueError):
    pass


class CompoundFile:
    """streams: by path, the names joined with slashes, the bytes."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise NotCompound("not a compound file")
        self.data = data
        self.sector, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<IIIII", data, 56)
        fat_sectors = list(struct.unpack_from("<109I", data, 76))
        at = first_more
        for _ in range(n_more):
            if at >= _LAST:
                break
            entries = struct.unpack(f"<{self.sector // 4}I", self._sector(at))
            fat_sectors += entries[:-1]
            at = entries[-1]
        fat = b"".join(self._sector(s) for s in fat_sectors[:n_fat] if s < _LAST)
        self.fat = struct.unpack(f"<{len(fat) // 4}I", fat)
        mini = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)
        self.entries = [self._entry(x) for x in self._split(self._chain(first_dir), 128)]
        root = self.entries[0]
        self.mini_data = self._chain(root[3])[: root[4]]
        self.streams: dict[str, bytes] = {}
        self._walk(root[5], "", set())

    @staticmethod
    def _split(data: bytes, size: int) -> list[bytes]:
        return [data[i : i + size] for i in range(0, len(data) - size + 1, size)]

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.sector : (n + 2) * self.sector].ljust(self.sector, b"\0")

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < _LAST and at not in seen and at < len(self.fat):
            seen.add(at)
            out.append(self._sector(at))
            at = self.fat[at]
        return b"".join(out)

    def _mini_chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < _LAST and at not in seen and at < len(self.mini_fat):
            seen.add(at)
            out.append(self.mini_data[at * self.mini : (at + 1) * self.mini])
            at = self.mini_fat[at]
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes) -> tuple:
        """name, kind, siblings, first sector, size, first child"""
        n = struct.unpack_from("<H", raw, 64)[0]
        name = raw[: max(0, n - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<III", raw, 68)
        return name, raw[66], (left, right), struct.unpack_from("<I", raw, 116)[0], struct.unpack_from("<Q", raw, 120)[0] & 0xFFFFFFFF, child

    def _walk(self, at: int, prefix: str, seen: set[int]) -> None:
        pending = [(at, prefix)]
        while pending:
            at, prefix = pending.pop()
            if at >= len(self.entries) or at in seen:
                continue
            seen.add(at)
            name, kind, siblings, first, size, child = self.entries[at]
            pending += [(s, prefix) for s in siblings]
            if kind == 1:
                pending.append((child, f"{prefix}{name}/"))
            elif kind == 2:
                body = self._mini_chain(first) if size < self.cutoff else self._chain(first)
                self.streams[prefix + name] = body[:size]


def build(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, one folder deep at most; what tests and synthetic inputs are made of.

    Short streams are filled with zeros up to where small ones would be kept elsewhere.
    """
    sector, cutoff = 512, 4096
    names: list[tuple[str, int, bytes | None]] = []  # name, parent, body
    folders: dict[str, int] = {}
    for path, body in streams.items():
        folder, _, name = path.rpartition("/")
        if folder and folder not in folders:
            names.append((folder, 0, None))
            folders[folder] = len(names)
        names.append((name, folders.get(folder, 0), body.ljust(cutoff, b"\0") if len(body) < cutoff else body))
    fat: list[int] = []
    blocks: list[bytes] = []

    def put(body: bytes) -> int:
        n = max(1, -(-len(body) // sector))
        first = len(blocks)
        for i in range(n):
            blocks.append(body[i * sector : (i + 1) * sector].ljust(sector, b"\0"))
            fat.append(first + i + 1 if i < n - 1 else 0xFFFFFFFE)
        return first

    children: dict[int, list[int]] = {}
    for i, (_, parent, _) in enumerate(names, 1):
        children.setdefault(parent, []).append(i)
    link = {a: b for own in children.values() for a, b in zip(own, [*own[1:], 0xFFFFFFFF])}
    none = 0xFFFFFFFF

    def entry(name: str, kind: int, right: int, child: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, none, right, child) + b"\0" * 36 + struct.pack("<IQ", first, size)

    rows = [entry("Root Entry", 5, none, children.get(0, [none])[0], 0xFFFFFFFE, 0)]
    for i, (name, _, body) in enumerate(names, 1):
        if body is None:
            rows.append(entry(name, 1, link[i], children[i][0], 0, 0))
        else:
            rows.append(entry(name, 2, link[i], none, put(body), len(body)))
    first_dir = put(b"".join(rows))
    n_fat = 1
    while n_fat * (sector // 4) < len(fat) + n_fat:
        n_fat += 1
    fat_at = len(blocks)
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * sector, b"\xff")
    blocks += [table[i * sector : (i + 1) * sector] for i in range(n_fat)]
    where = [fat_at + i for i in range(n_fat)]
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<III", n_fat, first_dir, 0)
    head += struct.pack("<IIIII", cutoff, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", *where, *[none] * (109 - n_fat))
    return head + b"".join(blocks)

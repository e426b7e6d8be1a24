"""Plain single-machine versions of the corpus operators, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def lines_left(texts: list[str], min_lines: int, min_words: int) -> list[str]:
    """Every run of lines, long enough, that also starts earlier loses its lines."""
    seen: dict[tuple, tuple[int, int]] = {}
    kept = []
    docs = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    gone: list[set[int]] = [set() for _ in docs]
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            for e in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:e])
                if len(run) >= min_lines or sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[d].update(range(a, e))
                    else:
                        seen[run] = (d, a)
    for d, t in enumerate(texts):
        out, n = [], -1
        for line in t.split("\n"):
            if line.strip():
                n += 1
                if n in gone[d]:
                    continue
            out.append(line)
        kept.append("\n".join(out))
    return kept


def simhash(text: str, words: int = 4) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def shingles(text: str, words: int) -> set[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similar(ids: list[int], texts: list[str], words: int, least: float) -> list[int]:
    """Smallest id that links of this Jaccard similarity reach, per text."""
    sets = [shingles(t, words) for t in texts]
    return _classes(ids, lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9)


def components(ids: list[int], prints: list[int], within: int) -> list[int]:
    return _classes(ids, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= within)


def _classes(ids: list[int], linked) -> list[int]:
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def repeats_removed(texts: list[bytes], width: int, keep: str = "none") -> list[tuple[int, int, bytes]]:
    """(removed bytes, removed runs, bytes left) per text."""
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            places[t[i : i + width]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for d, i in where if keep == "none" else where[1:]:
                gone[d][i : i + width] = b"\1" * width
    out = []
    for t, g in zip(texts, gone, strict=True):
        out.append((sum(g), len(re.findall(rb"\x01+", bytes(g))), bytes(c for c, x in zip(t, g, strict=True) if not x)))
    return out


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text: str) -> tuple[int, int, int, str]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())


def edit_distance_inside(item: str, text: str) -> int:
    """Least edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0

"""Vectorised 64-bit hashes of words and word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

CHUNK_BYTES = 1 << 20


def mixed(x):
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def names_of(words: list[bytes]):
    """64 bits of XXH3 of each word. Links are confirmed on the words themselves, so a collision adds a candidate only."""
    import numpy as np
    from xxhash import xxh3_64_digest

    return np.frombuffer(b"".join(map(xxh3_64_digest, words)), ">u8").astype(np.uint64)


def segments(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end at a blank or line end, so that a long one is never cut into words at once."""
    at = 0
    while at < len(data):
        stops = [x for x in (data.find(b" ", at + size), data.find(b"\n", at + size)) if x >= 0]
        stop = min(stops, default=len(data))
        yield data[at:stop]
        at = stop


def shingles_of(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of `width` words themselves; fewer words are one shingle, without words there is none."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII blanks alone
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator:
    """Per text, the sorted distinct hashes of its shingles of `width` words.

    Words are runs of other bytes than blank and 0x09-0x0D, A-Z lower-cased. Fewer words than the width are one
    shingle; without words the set is empty. Texts are taken whole; a chunk of them is hashed at once.
    """
    codes, size = [], 0
    for t in texts:
        codes.append(_codes((t or "").encode().lower()))
        size += len(codes[-1])
        if size >= CHUNK_BYTES // 8:
            yield from _sets(codes, width)
            codes, size = [], 0
    if codes:
        yield from _sets(codes, width)


def _codes(data: bytes):
    import numpy as np

    if len(data) <= CHUNK_BYTES:
        return names_of(data.split())
    return np.concatenate([names_of(part.split()) for part in segments(data)])


def _sets(codes: list, width: int) -> Iterator:
    import numpy as np

    w, ends = np.concatenate(codes), np.cumsum([len(c) for c in codes])
    factors = [np.uint64(x) for x in mixed(np.arange(1, width + 1, dtype=np.uint64)).tolist()]
    n = max(0, len(w) - width + 1)
    all_of = np.zeros(n, np.uint64)
    for k, f in enumerate(factors):
        all_of += w[k : k + n] * f
    all_of, begin = mixed(all_of), 0
    for end in ends.tolist():
        if end - begin >= width:
            yield np.unique(all_of[begin : end - width + 1])
        elif end > begin:
            yield mixed(np.array([sum(int(x) * int(f) for x, f in zip(w[begin:end], factors, strict=False)) + end - begin & (1 << 64) - 1], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        begin = end

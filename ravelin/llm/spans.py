"""Byte spans of texts, and what is left of a text without them."""

from __future__ import annotations

REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept_bytes binary"


def text_hash(data: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of spans that touch or overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))

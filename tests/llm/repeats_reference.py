"""Repeated 100-byte strings by the plain definition: a set of all that came before."""

import hashlib

WINDOW = 100


def without_repeats(rows):
    """(n_bytes, n_removed, n_spans, kept_sha256) by id; rows are (id, text)."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            w = b[p : p + WINDOW]
            if w in seen:
                gone[p : p + WINDOW] = b"\1" * WINDOW
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out

"""Plain versions of operators that SQL cannot express, for small inputs."""

import hashlib


def without_repeats(texts, size):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - size + 1):
            seen[d[i:i + size]] = seen.get(d[i:i + size], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out

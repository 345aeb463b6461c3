"""Periodic runs of words: maximal repetitions found octave by octave in tiles.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal), at least max(MIN_LENGTH, 2q) words long, that no neighbouring word extends
keeping period q. For a period p, the positions i with word i = word i+p form
stretches [s, e); a stretch with e - s >= p is a repetition [s, e + p) of period p.

Periods are taken by octave [B, 2B). A repetition of period p in that octave has at
least p >= B matching positions, so it holds a multiple of B. Each octave cuts the
document into tiles: TILE anchor positions (at least B) and a window around them. In
a tile, every anchor i (a multiple of B) is compared with i + p for all periods of the
octave at once; for matching pairs, the boundary Z-values forward (longest common
extension of i and i + p) and backward are computed within the window, in blocks
that grow fourfold, for chain heads only (an anchor already inside a fragment of the
same period is not extended again). A tile's result is fragments (p, s, e), cut at the
window; fragments of the same period that touch or overlap are stitched, since
touching fragments lie in one stretch.

A pair (i, p) is skipped when words i..i+p lie inside a repetition already found
whose period divides p: its stretch is that repetition, whose smallest period is
smaller. Stitched repetitions with equal start and length keep their smallest period.

All tiles of a row are solved and stitched in the task that reads the row: a row
never spans tasks, and moving its tiles would shuffle the text once per octave.

Handled cases: a null text has no words (n = 0); a null doc_id is not perturbed;
empty, one-word and very long texts; repeated rows give repeated rows; columns
with the names of new ones are replaced.
"""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import types as T

from docpipe.llm.common import add_columns

TILE = 4096        # anchor positions of one tile at small periods
MIN_LENGTH = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")

FIELDS = [T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
          T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()),
          T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]


def perturbed(words, doc_id):
    """The planted repetition: with h = crc32(decimal doc_id) and h % 10 = 0, the tail repeats."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def extension(ids, x, y, cap):
    """Longest common extension of ids[x:] and ids[y:], at most cap, per pair (vectorised)."""
    n = len(ids)
    out = np.zeros(len(x), np.int64)
    active = np.flatnonzero(cap > 0)
    width = 4
    while active.size:
        t = out[active, None] + np.arange(width)[None, :]
        valid = t < cap[active, None]
        xs = np.minimum(x[active, None] + t, n - 1)
        ys = np.minimum(y[active, None] + t, n - 1)
        equal = (ids[xs] == ids[ys]) & valid
        whole = equal.all(axis=1)
        out[active] += np.where(whole, width, np.argmin(equal, axis=1))
        active = active[whole & (out[active] < cap[active])]
        width = min(width * 4, 1 << 16)
    return out


def _heads(i, p, B):
    """Pairs (sorted by p, i) whose previous anchor of the same period is not among them."""
    head = np.ones(len(i), bool)
    head[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + B)
    return head


def tile_fragments(ids, rev, B, ps, a0, a1, cover_q, cover_end):
    """Fragments (p, s, e) of matching stretches through the anchors of [a0, a1), within its window."""
    n = len(ids)
    lo, hi = max(0, a0 - (a1 - a0)), min(n, a1 + 2 * B + (a1 - a0))
    anchors = np.arange(-(-a0 // B) * B, min(a1, n), B)
    if not anchors.size:
        return []
    j = anchors[:, None] + ps[None, :]
    match = (j < hi) & (ids[anchors][:, None] == ids[np.minimum(j, n - 1)])
    q, end = cover_q[anchors][:, None], cover_end[anchors][:, None]
    match &= ~((q > 0) & (ps[None, :] % np.maximum(q, 1) == 0) & (end >= j + 1))
    k, m = np.nonzero(match)
    if not k.size:
        return []
    order = np.lexsort((anchors[k], ps[m]))
    i, p = anchors[k][order], ps[m][order]
    found = []
    while i.size:
        head = _heads(i, p, B)
        hi_, hp = i[head], p[head]
        forward = extension(ids, hi_, hi_ + hp, hi - hp - hi_)
        backward = extension(rev, n - hi_, n - hi_ - hp, hi_ - lo)
        s, e = hi_ - backward, hi_ + forward
        found.append(np.stack([hp, s, e], axis=1))
        # anchors not inside the fragment of their chain head are extended next
        chain = np.cumsum(head) - 1
        keep = ~head & (i >= e[chain])
        i, p = i[keep], p[keep]
    return found


def stitch(fragments):
    """Stretches (p, s, e) from fragments: same p, touching or overlapping, merged."""
    if not fragments:
        return np.zeros((0, 3), np.int64)
    f = np.concatenate(fragments)
    f = f[np.lexsort((f[:, 1], f[:, 0]))]
    out = []
    cp, cs, ce = f[0]
    for p, s, e in f[1:].tolist():
        if p == cp and s <= ce:
            ce = max(ce, e)
        else:
            out.append((cp, cs, ce))
            cp, cs, ce = p, s, e
    out.append((cp, cs, ce))
    return np.array(out, np.int64)


def runs_of(ids, tile=TILE, min_length=MIN_LENGTH):
    """Runs (start, length, period) of an integer sequence, sorted by start, then period."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    rev = ids[::-1].copy()
    cover_q, cover_end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found = {}
    B = 1
    while B <= n // 2:
        ps = np.arange(B, min(2 * B - 1, n // 2) + 1)
        A = B * max(1, tile // B)
        fragments = []
        for a0 in range(0, n, A):
            fragments += tile_fragments(ids, rev, B, ps, a0, a0 + A, cover_q, cover_end)
        for p, s, e in stitch(fragments).tolist():
            if e - s < p:
                continue
            stop = e + p
            better = cover_end[s:stop] < stop
            cover_q[s:stop][better], cover_end[s:stop][better] = p, stop
            length = stop - s
            if length >= min_length and found.get((s, length), p + 1) > p:
                found[(s, length)] = p
        B *= 2
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def describe(doc_id, text, tile=TILE, min_length=MIN_LENGTH):
    """The output fields of one document."""
    words = perturbed(WORD.findall(text or ""), doc_id)
    if words:
        _, ids = np.unique(np.array(words, dtype=object), return_inverse=True)
    else:
        ids = np.zeros(0, np.int64)
    runs = runs_of(ids, tile, min_length)
    dropped = np.zeros(len(words), bool)
    for s, length, p in runs:
        dropped[s + p:s + length] = True
    digest = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
    kept = " ".join(w for w, d in zip(words, dropped.tolist(), strict=True) if not d)
    collapsed = hashlib.sha256(kept.encode()).hexdigest()
    if not runs:
        return len(runs), None, None, None, None, digest, collapsed
    s, length, p = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return len(runs), s, length, p, 1000 * length // p, digest, collapsed


def periodic_runs(docs, tile=TILE, min_length=MIN_LENGTH):
    """Columns of `docs` (doc_id, text, ...) with the fields of FIELDS added."""

    def make():
        import pyarrow as pa

        def function(ids, texts):
            rows = [describe(d, t, tile, min_length) for d, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            return [pa.array(list(c), type=pa.int64() if f.dataType == T.LongType() else pa.string())
                    for c, f in zip(columns, FIELDS, strict=True)]

        return function

    return add_columns(docs, make, ["doc_id", "text"], FIELDS)


def brute_force_runs(ids, min_length=MIN_LENGTH):
    """Runs by comparing every period at every position (quadratic; for tests)."""
    ids = np.asarray(ids)
    n, found = len(ids), {}
    for p in range(1, n // 2 + 1):
        eq = np.concatenate([[False], ids[:-p] == ids[p:], [False]])
        edges = np.flatnonzero(eq[1:] != eq[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = e - s + p
            if e - s >= p and length >= min_length and found.get((s, length), p + 1) > p:
                found[(s, length)] = p
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))

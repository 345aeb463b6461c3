"""Removal of repeated byte strings across documents, with enhanced suffix arrays.

Every byte covered by a string of `LENGTH` bytes that also starts in a document with a
smaller doc_id goes. Suffix arrays of a whole corpus would be many times its size, so
they are built only where repeats begin and end:

1. Anchors. Each window of LENGTH bytes names as its anchor the gram of `GRAM` bytes
   with the smallest hash. Equal windows have equal anchors, so anchors (about one in
   16 bytes) carry the search. An anchor's context is what its windows can cover: up to
   30 bytes on the left and 50 from its start on.
2. Anchors with equal hash and context: all windows in the context are repeats of the one
   in the smallest document. A task settles what it can itself and posts, packed
   by bucket of the hash, one entry per hash and context (its smallest document).
3. Where one anchor hash has several contexts that agree on the 15 bytes before or behind it, a repeat
   begins or ends nearby. These contexts are fetched from the texts, and tasks build an enhanced suffix array over them. One
   stack scan of its common-prefix intervals, with the test that the symbols before
   the occurrences differ, gives all maximal repeats with all their occurrences. Strings
   that stay open are posted once per task, by hash, and settled by bucket.
4. The removed spans of each document are merged and cut out.

Common strings never gather in one task: a task posts each at most once, however many
of its documents hold it. Windows are
compared by 64-bit hashes, contexts by 32 bits each of anchor and context and 16 each of both sides.

Handled cases: a null text is empty; texts below LENGTH bytes lose nothing; a row without
doc_id neither removes nor loses anything; rows with the same doc_id do not
remove from each other; repeated strings within one document stay; long texts are used
whole. Other columns are not carried.
"""

import hashlib

from pyspark.sql import functions as F

from docpipe.llm.common import pieces, possibly_in, store

LENGTH = 50
GRAM = 20
SIDE = (LENGTH - GRAM) // 2  # equal windows with equal anchors also agree on that many bytes before or behind it
BUCKET_BYTES = 16 << 20      # text whose anchors share a bucket
SETTLE_BYTES = 4 << 20       # entries of a bucket settled at a time
FLUSH_BYTES = 8 << 20        # text a task settles at a time
PIECE_BYTES = 2 << 20        # Arrow data made Python strings at a time
CHUNK = 1 << 16              # bytes hashed at a time
CONTEXTS = 64                # contexts of one anchor that a task posts; with more, the anchor is known to be open
SUFFIX_BYTES = 1 << 19       # context bytes per suffix array


def _pair(x, y):
    """A 64-bit hash of two 64-bit hashes, elementwise."""
    import numpy as np

    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def _gram_hashes(data):
    """Hashes of the strings of GRAM, LENGTH and SIDE bytes at every position of a uint8 array
    (shorter by the string's length)."""
    import numpy as np

    one = _pair(np.arange(256, dtype=np.uint64), np.uint64(7))[data]
    two = _pair(one[:-1], one[1:])
    four = _pair(two[:-2], two[2:])
    eight = _pair(four[:-4], four[4:])
    sixteen = _pair(eight[:-8], eight[8:])
    twenty = _pair(sixteen[:-4], four[16:])
    thirty_two = _pair(sixteen[:-16], sixteen[16:])
    n = len(data) - LENGTH + 1
    fifty = _pair(_pair(thirty_two[:n], sixteen[32:32 + n]), two[48:48 + n])
    n = len(data) - SIDE + 1
    fifteen = _pair(_pair(eight[:n], four[8:8 + n]), _pair(two[12:12 + n], one[14:14 + n]))
    return twenty, fifty, fifteen


def _windows(data):
    """For each window of a uint8 array the position of its anchor; and the hashes of `_gram_hashes`."""
    import numpy as np

    grams, whole, sides = _gram_hashes(data)
    n = len(whole)
    span = LENGTH - GRAM + 1
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    step, least = 1, key
    while 2 * step <= span:  # minima of 2, 4, 8, ... keys, then of `span`
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:n], least[span - step:span - step + n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int32), grams, whole, sides


def _anchors(data, starts, ends):
    """Anchors of the documents in one buffer: document, position in it, hash, context, and the
    hashes of the bytes just before and behind.

    starts, ends: document limits in `data`, each of LENGTH bytes or more.
    """
    import numpy as np

    at, grams, whole, sides = _windows(data)
    n = len(whole)
    sizes = ends - starts
    doc = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)[:n]
    good = np.ones(n, dtype=bool)
    for end in ends[:-1]:  # windows across a border belong to no document
        good[end - LENGTH + 1:end] = False
    fresh = good
    fresh[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1]
    pick = np.flatnonzero(fresh)
    at, doc = at[pick].astype(np.int64), doc[pick]
    low, high = starts[doc], ends[doc]
    first = np.maximum(low, at - (LENGTH - GRAM))
    last = np.minimum(high - LENGTH, at)
    shape = ((at - first) * 64 + (at - last)).astype(np.uint64)
    left = np.where(at - SIDE >= low, sides[np.maximum(0, at - SIDE)], shape)
    right = np.where(at + GRAM + SIDE <= high, sides[np.minimum(len(sides) - 1, at + GRAM)], shape)
    return doc, at - low, grams[at], _pair(_pair(whole[first], whole[last]), shape), left, right


class _Batch:
    """Documents of a task until they are settled together."""

    def __init__(self):
        self.ids, self.marks, self.texts, self.bytes = [], [], [], 0

    def add(self, doc_id, mark, text):
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) >= LENGTH:
            self.ids.append(doc_id)
            self.marks.append(mark)
            self.texts.append(raw)
            self.bytes += len(raw)

    def buffers(self):
        """(first document, data, starts, ends, offsets): buffers of about CHUNK bytes.

        A text longer than a buffer comes in parts; parts overlap so that each window
        is in one part, with what its context needs on both sides.
        """
        import numpy as np

        i = 0
        while i < len(self.texts):
            j, size = i, 0
            while j < len(self.texts) and (j == i or size + len(self.texts[j]) <= CHUNK):
                size += len(self.texts[j])
                j += 1
            data = np.frombuffer(b"".join(self.texts[i:j]), dtype=np.uint8)
            ends = np.cumsum([len(t) for t in self.texts[i:j]])
            yield i, data, np.concatenate([[0], ends[:-1]]), ends
            i = j

    def anchors(self):
        """Structured rows: hash, context, bytes before and behind, document, position."""
        import numpy as np

        kind = [("hash", "<u8"), ("ctx", "<u4"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i4"), ("pos", "<i4")]
        out = []
        for first, data, starts, ends in self.buffers():
            parts = [(0, len(data))]
            if len(data) > 16 * CHUNK:  # one long text
                parts = [(a, min(len(data), a + 16 * CHUNK)) for a in range(0, len(data), 16 * CHUNK)]
            for a, b in parts:
                if len(parts) == 1:
                    columns = _anchors(data, starts, ends)
                else:
                    low, high = max(0, a - 2 * LENGTH), min(len(data), b + 3 * LENGTH)
                    columns = _anchors(data[low:high], np.array([0]), np.array([high - low]))
                    pos = columns[1] + low
                    # Anchors near a cut are those of the next part, where their context is whole.
                    own = (pos >= (a + LENGTH if a else 0)) & (pos < (b + LENGTH if b < len(data) else b))
                    columns = [columns[0][own], pos[own], *[c[own] for c in columns[2:]]]
                doc, pos, code, ctx, left, right = columns
                rows = np.empty(len(pos), dtype=kind)
                rows["hash"], rows["doc"], rows["pos"] = code, doc + first, pos
                rows["ctx"] = (ctx & np.uint64(0xFFFFFFFF)) | np.uint64(1)  # 0 is kept for marks
                rows["left"], rows["right"] = left & np.uint64(0xFFFF), right & np.uint64(0xFFFF)
                out.append(rows)
        return np.concatenate(out) if out else np.empty(0, dtype=kind)


def _pack(ids, marks, columns):
    """One blob: table of the documents used, then the columns; `columns` ends with document numbers."""
    import numpy as np

    used, own = np.unique(columns[-1], return_inverse=True)
    head = np.array([len(own), len(used)], dtype="<u4").tobytes()
    parts = [head, ids[used].astype("<i8").tobytes(), marks[used].astype("<i8").tobytes()]
    parts += [np.ascontiguousarray(c).tobytes() for c in columns[:-1]]
    return b"".join([*parts, own.astype("<u2" if len(used) <= 65536 else "<u4").tobytes()])


def _unpack(blob, kinds, part=0, parts=1):
    """The columns of a blob; of `parts` shares by hash (the first column) only one."""
    import numpy as np

    n, used = np.frombuffer(blob, dtype="<u4", count=2)
    at = 8
    ids = np.frombuffer(blob, "<i8", used, at)
    marks = np.frombuffer(blob, "<i8", used, at + 8 * used)
    at += 16 * int(used)
    out = []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    own = np.frombuffer(blob, "<u2" if used <= 65536 else "<u4", n, at)
    if parts > 1:
        take = np.flatnonzero(out[0] % out[0].dtype.type(parts) == part)
        own, out = own[take], [c[take] for c in out]
    return [ids[own], marks[own], *out]


_ENTRY = ("<u4", "<u4", "<u2", "<u2", "<i4")  # hash, context, bytes before, bytes behind, position


def _runs(*columns):
    """Mask of the rows at which a run of equal values begins, in sorted columns."""
    import numpy as np

    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh):
        fresh[1:] = False
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _per_run(fresh, values, how):
    """`how`.reduceat over the runs, spread over their rows."""
    import numpy as np

    starts = np.flatnonzero(fresh)
    if not len(starts):
        return values
    return how.reduceat(values, starts)[np.cumsum(fresh) - 1]


def _found(rows):
    """(doc_id, mark, kind, blob) rows grouped by document, from [(doc_id, mark, kind, numbers)] arrays."""
    import numpy as np
    import pyarrow as pa

    out = [[], [], [], []]
    for ids, marks, kind, numbers in rows:
        if not len(ids):
            continue
        order = np.lexsort((marks, ids))
        ids, marks, numbers = ids[order], marks[order], numbers[order]
        cuts = [*np.flatnonzero(_runs(ids, marks)).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for column, value in zip(out, (int(ids[a]), int(marks[a]), kind, numbers[a:b].astype("<i4").tobytes()), strict=True):
                column.append(value)
    return pa.table({
        "doc_id": pa.array(out[0], pa.int64()), "mark": pa.array(out[1], pa.int64()), "kind": pa.array(out[2], pa.int32()),
        "blob": pa.array(out[3], pa.binary()),
    })


def _partners(code, number, left, right):
    """Rows whose anchor has another context (number) with the same bytes before or behind it,
    and the first row of each such group."""
    import numpy as np

    is_open, is_first = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
    for side in (left, right):
        order = np.lexsort((number, side, code))
        group = _runs(code[order], side[order])
        fresh = _runs(code[order], side[order], number[order])
        several = _per_run(group, fresh.astype(np.int64), np.add) > 1
        is_open[order[several]] = True
        is_first[order[several & group]] = True
    return is_open, is_first


FOUND = "doc_id bigint, mark bigint, kind int, blob binary"
REMOVED, OPEN, WINDOW = 1, 2, 3  # numbers: anchor positions, anchor positions, (start, end) pairs


def _posted(task, settle, kinds):
    """A task's own findings and bucket blobs -> findings of all buckets."""
    def close(key, table):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        own = table.filter(pa.compute.is_valid(table["doc_id"])).select(["doc_id", "mark", "kind", "blob"])
        # Buffers of the table itself, and one share of the hashes after another: equal ones share it.
        blobs = [b.as_buffer() for b in table.filter(pa.compute.is_null(table["doc_id"]))["blob"]]
        if not blobs:
            return own
        import numpy as np

        parts = 1 + sum(b.size for b in blobs) // SETTLE_BYTES
        found = [own]
        for part in range(parts):
            columns = [np.concatenate(c) for c in zip(*(_unpack(b, kinds, part, parts) for b in blobs), strict=True)]
            found.append(_found(settle(*columns)))
        return pa.concat_tables(found)

    return task.groupBy("bucket").applyInArrow(close, FOUND)


def _emit(own, bucket_rows):
    """Arrow batch of findings (spread over buckets by document) and of bucket blobs."""
    import pyarrow as pa

    n = own.num_rows
    buckets, blobs = [b for b, _ in bucket_rows], [x for _, x in bucket_rows]
    if n:
        # Findings only pass through: negative bucket numbers, by document.
        spread = pa.array([-1 - d % 997 for d in own["doc_id"].to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([spread, *[own[c].combine_chunks() for c in ("doc_id", "mark", "kind", "blob")]],
                                         names=["bucket", "doc_id", "mark", "kind", "blob"])
    if blobs:
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), none, none, pa.nulls(len(blobs), pa.int32()), pa.array(blobs, pa.binary())],
                                         names=["bucket", "doc_id", "mark", "kind", "blob"])


TASK = "bucket int, doc_id bigint, mark bigint, kind int, blob binary"


def _find_anchors(docs, buckets):
    """Findings (doc_id, mark, kind, blob): anchors whose whole context goes, and open ones."""
    def settle_task(batch):
        import numpy as np

        rows = batch.anchors()
        ids, marks = np.array(batch.ids, dtype=np.int64), np.array(batch.marks, dtype=np.int64)
        code = (rows["hash"] >> np.uint64(32) << np.uint64(32)) | rows["ctx"]
        order = np.argsort(code)
        rows, code = rows[order], code[order]
        doc = ids[rows["doc"]]
        run = _runs(code, rows["left"], rows["right"])
        gone = doc > _per_run(run, doc, np.minimum)
        kept, first = rows[~gone], run.copy()
        # An anchor with many contexts here is open where this task can tell; one mark per group goes on.
        anchor = _runs(code >> np.uint64(32))
        many = (_per_run(anchor, first.astype(np.int64), np.add) > CONTEXTS)[~gone]
        number = np.cumsum(run)[~gone]
        known, mark = np.zeros(len(kept), dtype=bool), np.zeros(len(kept), dtype=bool)
        if many.any():
            at = np.flatnonzero(many)
            is_open, is_first = _partners(kept["hash"][at] >> np.uint64(32), number[at], kept["left"][at], kept["right"][at])
            known[at], mark[at] = is_open, is_first
        own = _found([
            (doc[gone], marks[rows["doc"][gone]], REMOVED, rows["pos"][gone]),
            (ids[kept["doc"][known]], marks[kept["doc"][known]], OPEN, kept["pos"][known]),
        ])
        post = ~known | mark
        ctx = np.where(known, np.uint32(0), kept["ctx"])[post]
        kept = kept[post]
        bucket = ((kept["hash"] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kept, ctx, bucket = kept[order], ctx[order], bucket[order]
        cuts = [*np.flatnonzero(_runs(bucket)).tolist(), len(kept)]
        blobs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = kept[a:b]
            blobs.append((int(bucket[a]), _pack(ids, marks, [
                (part["hash"] >> np.uint64(32)).astype("<u4"), ctx[a:b], part["left"], part["right"], part["pos"], part["doc"]])))
        return _emit(own, blobs)

    def settle_bucket(ids, marks, code, ctx, left, right, pos):
        import numpy as np

        order = np.argsort((code.astype(np.uint64) << np.uint64(32)) | ctx)
        ids, marks, code, ctx, left, right, pos = (c[order] for c in (ids, marks, code, ctx, left, right, pos))
        run = _runs(code, ctx, left, right)
        gone = (ids > _per_run(run, ids, np.minimum)) & (ctx != 0)
        found = [(ids[gone], marks[gone], REMOVED, pos[gone])]
        number = np.cumsum(run)
        # Only anchors that occur again need a look.
        anchor = _runs(code)
        at = np.flatnonzero(~gone & (_per_run(anchor, run.astype(np.int64), np.add) > 1))
        is_open, _ = _partners(code[at], number[at], left[at], right[at])
        at = at[is_open & (ctx[at] != 0)]
        return [*found, (ids[at], marks[at], OPEN, pos[at])]

    def run(batches):
        batch = _Batch()
        for arrow in batches:
            for piece in pieces(arrow, PIECE_BYTES):
                for doc_id, mark, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    batch.add(doc_id, mark, text)
                if batch.bytes > FLUSH_BYTES:
                    yield from settle_task(batch)
                    batch = _Batch()
        if batch.texts:
            yield from settle_task(batch)

    task = docs.select("doc_id", "mark", "text").mapInArrow(run, TASK)
    return _posted(task, settle_bucket, _ENTRY)


def _settle_contexts(rows, buckets):
    """Findings for the open anchors of (doc_id, mark, text, open array<binary>)."""
    def segments(raw, blobs):
        """The merged byte ranges that the open anchors' windows cover: (start, end, anchors)."""
        import numpy as np

        pos = np.unique(np.frombuffer(b"".join(blobs), dtype="<i4").astype(np.int64))
        first = np.maximum(0, pos - (LENGTH - GRAM))
        last = np.minimum(len(raw), pos + LENGTH)
        cuts = [0, *(np.flatnonzero(first[1:] > last[:-1]) + 1).tolist(), len(pos)]
        return [(int(first[a]), int(last[b - 1]), pos[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def settle_task(parts):
        """parts: [(doc_id, mark, offset in the text, bytes, positions of open anchors)]"""
        import numpy as np

        from docpipe.llm.suffix_array import maximal_repeats

        sizes = np.array([len(p[3]) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(p[3] for p in parts), dtype=np.uint8)
        owner = np.repeat(np.arange(len(parts)), sizes)
        ids, marks = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int64)
        offset = np.array([p[2] for p in parts], dtype=np.int64) - starts
        is_open = np.zeros(len(data), dtype=bool)
        is_open[np.concatenate([p[4] for p in parts]) - np.repeat(offset, [len(p[4]) for p in parts])] = True
        anchor, whole = [], []
        for a in range(0, len(data) - LENGTH + 1, CHUNK):
            at, _, codes, _ = _windows(data[a:a + CHUNK + LENGTH - 1])
            anchor.append(at.astype(np.int64) + a)
            whole.append(codes)
        anchor, whole = np.concatenate(anchor), np.concatenate(whole)
        # A window is looked for under its own anchor, so only those of open anchors count.
        window = np.flatnonzero((np.arange(len(whole)) + LENGTH <= (starts + sizes)[owner[:len(whole)]]) & is_open[anchor])

        # Only what occurs again here can be part of a repeat: the suffix array holds these stretches.
        order = window[np.argsort(whole[window])]
        again = _runs(whole[order])
        again = order[~(again & np.concatenate([again[1:], [True]]))]
        again.sort()
        fresh = np.ones(len(again), dtype=bool)
        fresh[1:] = (again[1:] != again[:-1] + 1) | (owner[again[1:]] != owner[again[:-1]])
        first = again[fresh]
        last = again[np.concatenate([fresh[1:], [True]])] + LENGTH if len(again) else first
        lengths = last - first
        shift = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(first) else first
        stretch = np.repeat(np.arange(len(first)), lengths + 1)
        place = np.arange(len(stretch)) - shift[stretch] + first[stretch] if len(first) else first
        symbols = 256 + stretch  # borders that match nothing, one behind each stretch
        inside = place < last[stretch] if len(first) else np.zeros(0, dtype=bool)
        symbols[inside] = data[place[inside]]

        edge = np.zeros(len(data) + 1, dtype=np.int64)  # windows that a smaller document holds
        removed = []
        for length, found in maximal_repeats(symbols, LENGTH):
            at = place[found]
            doc = ids[owner[at]]
            later = at[doc > doc.min()]
            if len(later):
                removed.append(np.stack([later, later + length], axis=1))
        pairs = np.concatenate(removed) if removed else np.empty((0, 2), dtype=np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1] - LENGTH + 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        own = _found([(
            ids[owner[pairs[:, 0]]], marks[owner[pairs[:, 0]]], WINDOW,
            pairs + offset[owner[pairs[:, 0]]][:, None])])
        # Open windows, each string once, go to the bucket of their hash.
        window = window[~gone[window]]
        code, doc = whole[window], owner[window]
        bucket = ((code >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        code, doc, window, bucket = code[order], doc[order], window[order], bucket[order]
        cuts = [*np.flatnonzero(_runs(bucket)).tolist(), len(window)]
        blobs = [(int(bucket[a]), _pack(ids, marks, [code[a:b], (window + offset[doc])[a:b].astype("<i4"), doc[a:b]]))
                 for a, b in zip(cuts, cuts[1:], strict=False)]
        return _emit(own, blobs)

    def settle_bucket(ids, marks, code, pos):
        import numpy as np

        order = np.lexsort((ids, code))
        ids, marks, code, pos = ids[order], marks[order], code[order], pos[order]
        gone = ids > _per_run(_runs(code), ids, np.minimum)
        return [(ids[gone], marks[gone], WINDOW, np.stack([pos[gone], pos[gone] + LENGTH], axis=1))]

    def run(batches):
        parts, size = [], 0
        for arrow in batches:
            for piece in pieces(arrow, PIECE_BYTES):
                for doc_id, mark, text, blobs in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for a, b, pos in segments(raw, blobs):
                        parts.append((doc_id, mark, a, raw[a:b], pos))
                        size += b - a
                    if size > SUFFIX_BYTES:
                        yield from settle_task(parts)
                        parts, size = [], 0
        if parts:
            yield from settle_task(parts)

    task = rows.select("doc_id", "mark", "text", "open").mapInArrow(run, TASK)
    return _posted(task, settle_bucket, ("<u8", "<i4"))


def _cut(rows):
    """(doc_id, text, anchors array<binary>, windows array<binary>) -> the result and the remaining text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for arrow in batches:
            for piece in pieces(arrow, PIECE_BYTES):
                out = []
                for text, anchors, windows in zip(*(piece.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    pos = np.frombuffer(b"".join(anchors or []), dtype="<i4").astype(np.int64)
                    pairs = np.frombuffer(b"".join(windows or []), dtype="<i4").astype(np.int64).reshape(-1, 2)
                    starts = np.concatenate([np.maximum(0, pos - (LENGTH - GRAM)), pairs[:, 0]])
                    ends = np.concatenate([np.minimum(len(raw), pos + LENGTH), pairs[:, 1]])
                    edge = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, ends, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string()),
                ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "anchors", "windows").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(documents):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    named = docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = 8 + int(size) // BUCKET_BYTES

    anchors = store(_find_anchors(named, buckets), "anchors")
    key = ["doc_id", "mark"]
    opened = anchors.where(F.col("kind") == OPEN).groupBy(*key).agg(F.collect_list("blob").alias("open"))
    texts = possibly_in(named, anchors.where(F.col("kind") == OPEN).select("doc_id"), "doc_id").dropDuplicates(key)
    windows = store(_settle_contexts(texts.join(opened, key), buckets), "windows")

    found = anchors.where(F.col("kind") == REMOVED).union(windows)
    lists = found.groupBy(*key).agg(
        F.collect_list(F.when(F.col("kind") == REMOVED, F.col("blob"))).alias("anchors"),
        F.collect_list(F.when(F.col("kind") == WINDOW, F.col("blob"))).alias("windows"))
    lists = store(lists, "spans")
    whole = docs.select(
        "doc_id", "mark", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha"))
    cut = _cut(possibly_in(named, lists.select("doc_id"), "doc_id").join(lists, key))
    rest = whole.join(lists.select(*key), key, "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return rest.union(cut)

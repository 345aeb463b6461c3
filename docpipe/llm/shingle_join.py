"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

1. Documents with equal shingle sets form a class; only classes go on. A class is named by
   its smallest doc_id.
2. Similar classes are put into groups: classes that share min-hash keys are
   compared with the smallest and largest class of the key's bucket, and connected
   by the links found. A group of near copies thus needs a few comparisons per
   member, never one per pair.
3. The token-group matrix lists, for every token of a class's prefix, the groups that
   hold it. (Tokens are ordered by how often their hash bucket occurs in the
   corpus, rarest first. Two sets with a Jaccard similarity of `SHARE` or more
   share a token among the first n - ceil(share * n) + 1 of each.) A class
   queries only groups larger than its own, so every pair of groups is looked at once.
4. A group is stored in blocks of members with the union of their tokens. Where the
   union shares too few tokens with the query, the block stays closed; members of
   open blocks are compared exactly.

Every link between two different groups is found, so components are exact. Tokens are
64-bit hashes of shingles; two shingles of one document collide with a probability of
about n * n / 2 ** 65.

Scale: texts are read four times; only those of compared documents are shuffled.
Postings travel packed, one blob per task and bucket. Copies
inside a task are posted once. Frequent tokens skip the buckets and are joined by Spark,
which splits skewed joins. The only data on the driver are the `SKETCH` counters, of fixed size.

Handled cases: a null or empty text, or one of white space, has no shingles and links
with nothing; fewer words than a shingle count as one shingle; a row without
doc_id gets n_shingles and a null component; rows with the same doc_id belong
together; long texts are used whole. Other columns are not carried.
"""

import hashlib
from itertools import chain

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.llm.common import connected_components, pieces, possibly_in, store

WORDS = 5
SHARE = (3, 4)            # links from a Jaccard similarity of 3/4 on
SKETCH = 1 << 18          # counters of token frequency
TABLES, ROWS = 8, 3       # min-hash keys, and hashes per key
BLOCK = 32                # members per block of a group
POSTINGS = 500_000        # postings per bucket
WORD_CACHE = 100_000
PIECE_BYTES = 1 << 20     # Arrow data split into words at a time
POST_ROWS = 200_000       # postings a task gathers before it deals them to buckets


class _WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_sets(texts):
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    import numpy as np

    if len(_words) > WORD_CACHE:
        _words.clear()
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in split]
    codes = np.fromiter(map(_words.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=sum(sizes))
    whole = _combined(codes, WORDS)
    out, at = [], 0
    for n in sizes:
        if n >= WORDS:
            own = np.sort(whole[at:at + n - WORDS + 1])
            fresh = np.empty(len(own), dtype=bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        else:
            out.append(_combined(codes[at:at + n], n) if n else codes[:0])
        at += n
    return out


def _combined(codes, width):
    """Hashes of all runs of `width` word hashes."""
    import numpy as np

    n = max(0, len(codes) - width + 1)
    # Odd multipliers from a rule: powers of one odd constant.
    total = np.full(n, width, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(width):
        total += codes[j:j + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
    return _mixed(total)


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def need(n):
    """Tokens that a partner of a set of n tokens must share at least: ceil(share * n)."""
    a, b = SHARE
    return -(-n * a // b)


def _summaries(docs):
    """doc_id, n, fp, keys per document; a row with n = -1 per task holds token counters."""
    schema = "doc_id bigint, n bigint, fp binary, keys array<bigint>, counts binary"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seeds = _mixed(np.arange(1, TABLES * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        counts = np.zeros(SKETCH, dtype=np.int64)
        shift = np.uint64(64 - SKETCH.bit_length() + 1)
        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                sets = shingle_sets(piece.column(1).to_pylist())
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [None] * len(sets)
                if len(full):
                    tokens = np.concatenate(sets)
                    counts += np.bincount((tokens >> shift).astype(np.int64), minlength=SKETCH)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    least = np.stack([np.minimum.reduceat(tokens * seed, starts) for seed in seeds], axis=1).reshape(-1, TABLES, ROWS)
                    mixed = _mixed(least[:, :, 0] ^ _mixed(least[:, :, 1] ^ _mixed(least[:, :, 2] + np.arange(TABLES, dtype=np.uint64))))
                    for at, k in zip(full, mixed.view(np.int64), strict=True):
                        keys[at] = k
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(sizes), pa.array(prints, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.nulls(len(sets), pa.binary()),
                ], names=["doc_id", "n", "fp", "keys", "counts"])
        _words.clear()
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())),
            pa.array([np.minimum(counts, 2**31 - 1).astype("<u4").tobytes()], pa.binary()),
        ], names=["doc_id", "n", "fp", "keys", "counts"])

    return docs.mapInArrow(run, schema)


def _total_counts(rows):
    """Sum of the tasks' counters: by many tasks, then by one, then one row for the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(blob, dtype="<i8" if len(blob) == 8 * SKETCH else "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])

    some = rows.mapInArrow(run, "counts binary")
    (row,) = some.repartition(1).mapInArrow(run, "counts binary").collect()
    return np.frombuffer(row.counts, dtype="<i8")


def _postings(docs, counts, buckets, hot):
    """(token, cls, pos) of prefix tokens that more than one class holds; cls: 8 bytes of fp.

    A token whose counter is above `hot` is passed on without being counted.
    """
    def post(batches):
        import numpy as np
        import pyarrow as pa

        seen, parts, size = set(), [], 0
        shift = np.uint64(64 - SKETCH.bit_length() + 1)
        turn = 0

        def dealt():
            rows = np.concatenate([p for p, _ in parts])
            frequent = np.concatenate([f for _, f in parts])
            bucket = (rows["token"] % np.uint64(buckets)).astype(np.int32)
            bucket[frequent] = -1 - (hash((int(rows["cls"][0]), turn)) % buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(rows)]
            return pa.RecordBatch.from_arrays([
                pa.array([bucket[a] for a in cuts[:-1]], pa.int32()),
                pa.array([rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            ], names=["bucket", "blob"])

        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                for s in shingle_sets(piece.column(0).to_pylist()):
                    if not len(s):
                        continue
                    cls = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "big", signed=True)
                    if cls in seen:
                        continue
                    seen.add(cls)
                    often = counts[(s >> shift).astype(np.int64)]
                    # By frequency, then hash; the sort is stable and s is sorted.
                    rank = (np.minimum(often, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
                    take = np.argsort(rank, kind="stable")[:len(s) - need(len(s)) + 1]
                    part = np.empty(len(take), dtype=[("token", "<u8"), ("cls", "<i8"), ("pos", "<i4")])
                    part["token"], part["cls"], part["pos"] = s[take], cls, np.arange(len(take))
                    parts.append((part, often[take] > hot))
                    size += len(take)
                if size > POST_ROWS:
                    turn += 1
                    yield dealt()
                    parts, size = [], 0
        if parts:
            turn += 1
            yield dealt()
        _words.clear()

    def shared(key, table):
        import numpy as np
        import pyarrow as pa

        kind = [("token", "<u8"), ("cls", "<i8"), ("pos", "<i4")]
        rows = np.concatenate([np.frombuffer(b.as_buffer(), dtype=kind) for b in table["blob"]])
        if key[0].as_py() >= 0:
            rows = rows[np.lexsort((rows["cls"], rows["token"]))]
            token, cls = rows["token"], rows["cls"]
            same = token[1:] == token[:-1]
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = ~(same & (cls[1:] == cls[:-1]))
            rows = rows[fresh]
            token = rows["token"]
            near = np.zeros(len(rows), dtype=bool)
            same = token[1:] == token[:-1]
            near[1:] |= same
            near[:-1] |= same
            rows = rows[near]
        return pa.table({
            "token": pa.array(rows["token"].astype(np.uint64).view(np.int64)), "cls": pa.array(rows["cls"].copy()),
            "pos": pa.array(rows["pos"].copy()),
        })

    return docs.select("text").mapInArrow(post, "bucket int, blob binary").groupBy("bucket").applyInArrow(
        shared, "token bigint, cls bigint, pos int")


def _token_sets(docs):
    """(doc_id, tokens): the shingle hashes of each text as a blob."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                blobs = [s.tobytes() for s in shingle_sets(piece.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(blobs, pa.binary())], names=["doc_id", "tokens"])
        _words.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens binary")


def _sets_of(docs, ids):
    """The token sets of some documents, stored. A doc_id on several texts brings several sets."""
    ids = ids.distinct()
    # Not a semi join: that the optimizer would move below the filter, and shuffle all texts.
    return store(_token_sets(possibly_in(docs, ids, "doc_id").join(ids, "doc_id")), "sets")


def _linked(pairs):
    """The pairs (a, b, left, right) of token blobs that are similar enough."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        share, of = SHARE
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = _common(x, y)
                keep.append(of * common >= share * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _common(x, y):
    import numpy as np

    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _opened(rows):
    """(query, tokens, ids, members) with a block's members -> links (a, b)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        share, of = SHARE
        union_of, unions = None, None
        for batch in batches:
            out_a, out_b = [], []
            for q, tokens, block, ids, members in zip(*(batch.column(i) for i in range(5)), strict=True):
                mine = np.frombuffer(tokens.as_buffer(), dtype=np.uint64)
                if union_of != (name := block.as_py()):
                    sets = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in members]
                    union_of, unions = name, np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
                if of * _common(mine, unions) < share * len(mine):
                    continue
                for c, theirs in zip(ids.as_py(), sets, strict=True):
                    common = _common(mine, theirs)
                    if of * common >= share * (len(mine) + len(theirs) - common):
                        out_a.append(q.as_py())
                        out_b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.select("query", "tokens", "block", "ids", "members").mapInArrow(run, "a bigint, b bigint")


def similarity_classes(documents):
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    told = store(_summaries(docs), "shingles")
    counts = _total_counts(told.where("n = -1").select("counts")).astype("int64")
    total = int(counts.sum())
    buckets = 16 + total // (3 * POSTINGS)
    hot = 16 * (total // SKETCH) + 4096

    summary = told.where("n >= 0")
    classes = (
        summary.where("n > 0 and doc_id is not null").groupBy("fp")
        .agg(F.min("doc_id").alias("c"), F.first("n").cast("int").alias("n"), F.first("keys").alias("keys"))
        .withColumn("cls", F.conv(F.substring(F.hex("fp"), 1, 16), 16, -10).cast("bigint"))
    )
    classes = store(classes, "classes")

    posted = store(_postings(docs.where("doc_id is not null"), counts, buckets, hot), "postings")
    posted = store(posted.join(classes.select("cls", "c", "n"), "cls").select("token", "c", "n", "pos"), "postings")
    wanted = posted.select(F.col("c").alias("doc_id")).distinct()

    # Groups: links to the first and last class of each min-hash bucket.
    keyed = classes.join(wanted.withColumnRenamed("doc_id", "c"), "c", "left_semi").select("c", "n", F.posexplode("keys").alias("place", "key"))
    ends = keyed.groupBy("place", "key").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first <> last")
    tries = keyed.join(ends, ["place", "key"]).select("c", F.explode(F.array("first", "last")).alias("b"))
    tries = tries.where("c <> b").select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()
    tries = store(tries, "tries")
    sets = _sets_of(docs, tries.select(F.explode(F.array("a", "b")).alias("doc_id")))
    with_sets = (
        tries.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right")), "b")
    )
    near = store(_linked(with_sets), "links")
    groups = store(connected_components(near), "groups")

    # The matrix: which groups hold a token. Single classes are groups of their own.
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    named = groups.join(sizes, "component").select(F.col("id").alias("c"), F.col("component").alias("g"), "size")
    rows = posted.join(named, "c", "left").select(
        "token", "c", "n", "pos", F.coalesce("g", "c").alias("g"), F.coalesce("size", F.lit(1)).alias("size"))
    rows = store(rows, "tokens")
    matrix = rows.groupBy("token", "g").agg(
        F.first("size").alias("size"), F.min("pos").alias("pos"), F.min("n").alias("least"), F.max("n").alias("most"))
    largest = matrix.groupBy("token").agg(F.max(F.struct("size", "g")).alias("top"), F.count("*").alias("held")).where("held > 1")
    queries = (
        rows.join(largest, "token")
        .where(F.struct("size", "g") < F.col("top")).select("token", "c", "n", "pos", "size", "g")
    )
    share, of = SHARE
    met = (
        queries.alias("q").join(matrix.alias("m"), "token")
        .where(F.expr(f"struct(q.size, q.g) < struct(m.size, m.g) and {of} * m.most >= {share} * q.n and {of} * q.n >= {share} * m.least"))
        .groupBy(F.col("q.c").alias("query"), F.col("m.g").alias("g"))
        .agg(F.first("q.n").alias("n"), F.first("m.size").alias("size"), F.max("m.most").alias("other"), F.min("m.least").alias("least"), F.count("*").alias("shared"),
             F.max("q.pos").alias("pos"), F.max("m.pos").alias("other_pos"))
    )
    # Of the set whose prefix ends first all shared tokens of the prefix are known, so at most
    # `shared` and what follows that prefix can be common. With a single class, what follows
    # the last shared token bounds the overlap too.
    rest = F.ceil(F.greatest("n", "other") * share / of) - 1
    after = F.least(F.col("n") - 1 - F.col("pos"), F.col("other") - 1 - F.col("other_pos"))
    bound = F.col("shared") + F.when(F.col("size") > 1, rest).otherwise(F.least(rest, after))
    open_to = met.where((share + of) * bound >= share * (F.col("n") + F.col("least"))).select("query", "g")
    open_to = store(open_to, "candidates")

    members = (
        open_to.select("g").distinct().join(named.select("g", "c", "size"), "g", "left")
        .select("g", F.coalesce("c", "g").alias("doc_id"), F.coalesce("size", F.lit(1)).alias("size"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK)))
    )
    members = store(members, "members")
    sets = _sets_of(docs, open_to.select(F.col("query").alias("doc_id")).union(members.select("doc_id")))
    blocks = members.join(sets, "doc_id").groupBy("g", "block").agg(F.collect_list(F.struct("doc_id", "tokens")).alias("m")).select(
        "g", F.concat_ws(":", "g", "block").alias("block"), F.col("m.doc_id").alias("ids"), F.col("m.tokens").alias("members"))
    opened = open_to.join(sets.select(F.col("doc_id").alias("query"), "tokens"), "query").join(blocks, "g")
    links = near.union(_opened(opened))

    parts = connected_components(links)
    by_class = classes.join(parts, F.col("c") == F.col("id"), "left").select("fp", "c", F.coalesce("component", "c").alias("part"))
    found = summary.select("doc_id", "n", "fp").join(by_class, "fp", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"))

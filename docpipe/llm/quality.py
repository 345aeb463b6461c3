"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A document is a sparse vector: hashed words (square roots of their counts, scaled to
unit length), and standardised statistics of its structure and size. The machine
scores w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j; the pairs are summed in linear
time as half the difference of the square of sums and the sum of squares. Whole
texts count.

It is trained here, on at most `SAMPLE` labelled documents, chosen by a hash of doc_id;
of rows with the same doc_id the one with the smallest text hash is learned. That bound is the only sampling. Scoring is a narrow pass over all documents.

Handled cases: a null or empty text has no words and neutral statistics, and gets a
score; without labels every score is the prior 0.5; with one label only the scores lean to
it; documents labelled twice count once, with the higher label. Extra columns stay,
columns with the names of new ones are replaced.
"""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.llm.common import add_columns
from docpipe.llm.language_id import held_out

SAMPLE = 8000        # labelled documents used for training
BITS = 13            # hashed words fall into 2 ** BITS features
FACTORS = 4
THRESHOLD = 0.3
CACHE_WORDS = 200_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

STATISTICS = (
    "log_words", "log_chars", "word_length", "upper", "digit", "mark", "exclaim", "symbol", "distinct_words", "top_word",
    "distinct_lines", "log_line_length", "bare_words", "repeated_letters",
)


class Features:
    """Text -> (word features, their values, statistics)."""

    def __init__(self, bits=BITS):
        self.mask = (1 << bits) - 1
        self.cache = {}

    def _slot(self, word):
        import xxhash

        slot = self.cache.get(word)
        if slot is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            slot = self.cache[word] = xxhash.xxh3_64_intdigest(_EDGES.sub("", word.lower())) & self.mask
        return slot

    def __call__(self, text):
        import numpy as np

        words = text.split()
        slots = np.fromiter(map(self._slot, words), dtype=np.int64, count=len(words))
        index, counts = np.unique(slots, return_counts=True)
        values = np.sqrt(counts)
        values = values / (np.sqrt(counts.sum()) or 1.0)

        raw = text.encode("utf-8", "replace")
        codes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256, dtype=np.int64)
        n = max(1, len(raw))
        lines = text.split("\n")
        n_words = max(1, len(words))
        marks = codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum()
        upper = codes[65:91].sum()
        stats = np.array([
            np.log1p(len(words)), np.log1p(len(text)), len(text) / n_words,
            upper / n, codes[48:58].sum() / n, marks / n, codes[33] / n,
            codes[[124, 123, 125, 60, 62, 59, 61, 95, 35, 36, 37, 38, 42, 64]].sum() / n,
            len(index) / n_words, counts.max(initial=0) / n_words,
            len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
            upper / max(1, upper + codes[97:123].sum()),
            len(set(words)) / n_words,
        ])
        return index, values, stats


class Machine:
    """Parameters of a trained factorisation machine."""

    def __init__(self, size, stats, factors, seed=7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weights = np.zeros(size + stats)
        self.factors = rng.normal(0, 0.03, (size + stats, factors))
        self.size = size
        self.centre, self.scale = np.zeros(stats), np.ones(stats)

    def inputs(self, index, values, stats):
        import numpy as np

        z = np.clip((stats - self.centre) / self.scale, -4, 4) * 0.5
        return np.concatenate([index, np.arange(self.size, self.size + len(stats))]), np.concatenate([values, z])

    def margin(self, index, x):
        v = self.factors[index] * x[:, None]
        sums = v.sum(axis=0)
        return self.bias + self.weights[index] @ x + 0.5 * float(sums @ sums - (v * v).sum()), v, sums

    def probability(self, features):
        import numpy as np

        score, _, _ = self.margin(*self.inputs(*features))
        return float(1 / (1 + np.exp(-np.clip(score, -30, 30))))


def train(examples, size, factors=FACTORS, epochs=8, rate=0.08, decay=1e-4, seed=7):
    """A machine from [(features, label)], by adaptive gradient steps on the logistic loss."""
    import numpy as np

    machine = Machine(size, len(STATISTICS), factors, seed)
    if not examples:
        return machine
    table = np.stack([f[2] for f, _ in examples])
    machine.centre, machine.scale = table.mean(axis=0), table.std(axis=0) + 1e-6
    rows = [(*machine.inputs(*f), float(y)) for f, y in examples]
    share = np.clip(np.mean([y for _, _, y in rows]), 0.02, 0.98)
    machine.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v = np.full(len(machine.weights), 1e-2), np.full(machine.factors.shape, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, x, y = rows[i]
            score, v, sums = machine.margin(index, x)
            slope = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
            step = slope * x + decay * machine.weights[index]
            seen_w[index] += step * step
            machine.weights[index] -= rate * step / np.sqrt(seen_w[index])
            step = slope * x[:, None] * (sums - v) + decay * machine.factors[index]
            seen_v[index] += step * step
            machine.factors[index] -= rate * step / np.sqrt(seen_v[index])
            machine.bias -= 0.02 * slope
    return machine


def extract(df, text="text", bits=BITS):
    """`df` with word_index, word_value and statistics of `text`."""
    def make():
        import pyarrow as pa

        features = Features(bits)

        def run(texts):
            found = [features(t or "") for t in texts.to_pylist()]
            return [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64()))]

        return run

    return add_columns(df, make, [text], [
        T.StructField("word_index", T.ArrayType(T.LongType())), T.StructField("word_value", T.ArrayType(T.DoubleType())),
        T.StructField("statistics", T.ArrayType(T.DoubleType())),
    ])


def _arrays(lists):
    """An Arrow list column as numpy arrays that share its memory."""
    import numpy as np

    lists = lists.combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) if len(lists) else []
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(lists) else []


def fit(documents, labels, text="text", label="quality", sample=SAMPLE, bits=BITS):
    """A machine from documents (doc_id, text) and labels (doc_id, <label>), by `sample` of them at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    # `sample` rows of two numbers: small by that parameter.
    rows = documents.select("doc_id", text).join(F.broadcast(chosen), "doc_id")
    # One row per document, combined on the map side: no more than `sample` rows reach the driver.
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(text), F.col(text).alias("text"))).alias("first"))
    rows = rows.select("doc_id", "y", F.col("first.text").alias(text))
    table = extract(rows, text, bits).select("doc_id", "word_index", "word_value", "statistics", "y").toArrow().sort_by("doc_id")
    columns = [_arrays(table[c]) for c in ("word_index", "word_value", "statistics")]
    examples = list(zip(zip(*columns, strict=True), table["y"].to_pylist(), strict=True))
    return train(examples, 1 << bits)


def score(df, machine, text="text", bits=BITS, threshold=THRESHOLD):
    """`df` with score (0 to 1, higher: better) and predicted (1 if score >= threshold)."""
    def make():
        import numpy as np
        import pyarrow as pa

        features = Features(bits)

        def run(texts):
            found = np.array([machine.probability(features(t or "")) for t in texts.to_pylist()], dtype=float)
            return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

        return run

    return add_columns(df, make, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def graded(documents, labels):
    """doc_id, held_out, score, predicted of every document; learns from rows that are not held out.
    Rows without doc_id are held out."""
    rows = documents.select("doc_id", "text", F.coalesce(held_out(5, 0), F.lit(True)).alias("held_out"))
    machine = fit(rows.where("not held_out"), labels.where(~held_out(5, 0)))
    return score(rows, machine).drop("text")

"""Phrase collocations mined by Toivonen's method: a sample proposes, full passes decide.

Texts are lower-cased in A-Z, cut into pieces at [.,;:!?\\x0A-\\x0D] and pieces into
words [^\\x20\\x09]+; a phrase is 2 or 3 consecutive words of a piece. Everything is per
lang (null: `und`). A candidate is a phrase with a = f(phrase) >= MIN_COUNT.

Toivonen: bigrams frequent in a sample of the pieces (SAMPLE_RATE, by a hash of the
piece; support lowered to LOWERED of its share of MIN_COUNT) form S. Words are
counted exactly (their counts enter every score), so the frequent words are known.
The full pass counts, exactly, every bigram of two frequent words (S and its negative
border) and every trigram whose two bigrams are in S (S's trigrams and their border).
A frequent bigram outside S is a failure of the sample; it joins S, and a further pass
counts the trigrams that became border through it, until no failure is left. Then
every frequent phrase has been counted, whatever the sample held. Membership is tested on the map side with a
bitmap of hashed phrases of fixed size before the counts are combined, and exactly
by a join after.

A cut of a candidate after its first k words gives l = f(first part), r = f(rest) and
score floor(1e6 a^2 / (l r)), in decimal arithmetic; the lowest cut counts, ties to
smallest k. A bigram is dropped if a frequent trigram holds it with 100 f(trigram) >=
50 a. Each lang's best TOP (score, a descending, phrase ascending) are taken in two
steps, by lang and a hash of the phrase first, so no lang is ranked in one task.

Handled cases: null texts are empty; null lang is `und`; empty and very long texts;
repeated rows count as often as they occur; an empty table gives no rows; only the
columns text and lang are read, so names cannot clash.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docpipe.llm.common import store

MIN_COUNT = 10
TOP = 2000
SAMPLE_RATE = 0.1      # share of pieces in the sample
LOWERED = 0.5          # sample support: LOWERED * MIN_COUNT * SAMPLE_RATE occurrences, at least 1
FILTER_BITS = 1 << 24  # map-side membership bitmap (fixed size)
SALTS = 64             # parts of a lang ranked apart before the final top TOP
PIECE = r"[.,;:!?\x{0A}-\x{0D}]"
SPACE = r"[\x{20}\x{09}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_pieces(docs):
    """(lang, pick, words, w): one row per distinct piece with a word and its number w of
    occurrences; pick in [0, 1) chooses the sample. Copies of a piece are counted once, with
    their weight, in every later pass."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                      F.explode(F.split(text, PIECE, -1)).alias("piece"))
    distinct = cut.groupBy("lang", "piece").agg(F.count("*").alias("w"))
    words = F.filter(F.split("piece", SPACE, -1), lambda w: w != "")
    pick = (F.pmod(F.xxhash64("lang", "piece"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return distinct.select("lang", pick.alias("pick"), words.alias("words"), "w").where(F.size("words") > 0)


def grams(pieces, k):
    """(lang, phrase, left, right, w): every k-word phrase, with its first and last k-1 words,
    and the weight of its piece."""
    w = F.col("words")
    shifted = [F.slice(w, i + 1, F.size(w) - k + 1) for i in range(k)]
    g = pieces.where(F.size("words") >= k).select(
        "lang", "w", F.explode(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])).alias("g"))
    parts = [F.col(f"g.w{i}") for i in range(k)]
    if k == 1:
        return g.select("lang", parts[0].alias("phrase"), parts[0].alias("left"), parts[0].alias("right"), "w")
    return g.select("lang", F.concat_ws(" ", *parts).alias("phrase"), F.concat_ws(" ", *parts[:-1]).alias("left"),
                    F.concat_ws(" ", *parts[1:]).alias("right"), "w")


def _slot(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def bitmap(keys):
    """Words of a bitmap over (lang, phrase) of `keys`: at most FILTER_BITS / 64 rows."""
    s = _slot("lang", "phrase")
    return keys.select(s.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("_b"))


def flagged(df, bits, key, name):
    """`df` with boolean `name`: whether (lang, key) may be in the bitmap."""
    s = _slot("lang", key)
    held = df.withColumn("_s", s).join(F.broadcast(bits), F.floor(F.col("_s") / 64) == F.col("_w"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(_b, cast(_s % 64 as int)) & 1L) = 1"), F.lit(False))
    return held.withColumn(name, hit).drop("_s", "_w", "_b")


def _sides(counts, k):
    """(lang, phrase, f) with its first and last k-1 words, taken from the phrase."""
    words = F.split("phrase", " ")
    return counts.select("lang", "phrase", F.array_join(F.slice(words, 1, k - 1), " ").alias("left"),
                         F.array_join(F.slice(words, 2, k - 1), " ").alias("right"), "f")


def count_border(pieces, k, inside, new=None, min_count=MIN_COUNT):
    """Exact counts (lang, phrase, left, right, f), f >= min_count, of k-word phrases whose
    two (k-1)-word parts are in `inside` (lang, phrase) and, if `new` is given, one of them in `new`.

    Occurrences are counted by (lang, phrase) alone, combined on the map side; the parts
    are taken from the phrase again afterwards.
    """
    occ = grams(pieces, k)
    bits = bitmap(inside)
    occ = flagged(flagged(occ, bits, "left", "_l"), bits, "right", "_r").where("_l and _r")
    if new is not None:
        fresh = bitmap(new)
        occ = flagged(flagged(occ, fresh, "left", "_nl"), fresh, "right", "_nr").where("_nl or _nr")
    counts = _sides(occ.groupBy("lang", "phrase").agg(F.sum("w").alias("f")).where(F.col("f") >= min_count), k)
    sides = inside.select("lang", "phrase")
    counts = counts.join(sides.withColumnRenamed("phrase", "left"), ["lang", "left"], "left_semi")
    counts = counts.join(sides.withColumnRenamed("phrase", "right"), ["lang", "right"], "left_semi")
    if new is not None:
        fresh = new.select("lang", "phrase")
        either = counts.join(fresh.withColumnRenamed("phrase", "left"), ["lang", "left"], "left_semi").unionByName(
            counts.join(fresh.withColumnRenamed("phrase", "right"), ["lang", "right"], "left_semi"))
        counts = either.distinct()
    return counts.select("lang", "phrase", "left", "right", "f")


def frequent_phrases(pieces, min_count=MIN_COUNT, rate=SAMPLE_RATE, lowered=LOWERED):
    """(words, bigrams, trigrams, totals, passes): exact counts of every word, bigram and
    trigram with f >= min_count, n per lang, and the number of full passes for trigrams.

    Words are counted exactly in one pass (their counts enter every score), so the
    frequent words are known and a bigram's border needs no sample. The sample proposes
    bigrams; trigrams whose two bigrams it proposed are counted with the bigrams.
    A frequent bigram the sample missed is a failure: it joins the proposals and the
    trigrams that became border through it are counted in a further pass.
    """
    support = max(1, int(lowered * min_count * rate))
    sample = pieces.where(F.col("pick") < rate)
    counted = grams(pieces, 1).groupBy("lang", "phrase").agg(F.sum("w").alias("f"))
    words = store(counted, "colloc-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= min_count)
    frequent = words.select("lang", "phrase")
    s2 = store(grams(sample, 2).groupBy("lang", "phrase").agg(F.sum("w").alias("count")).where(F.col("count") >= support)
               .select("lang", "phrase"), "colloc-s2")
    bigrams = store(count_border(pieces, 2, frequent, min_count=min_count), "colloc-bigrams")
    trigrams = store(count_border(pieces, 3, s2, min_count=min_count), "colloc-trigrams")
    passes = 1
    while True:
        new2 = store(bigrams.select("lang", "phrase").join(s2, ["lang", "phrase"], "left_anti"), "colloc-new2")
        if new2.isEmpty():
            break
        passes += 1
        s2 = store(s2.unionByName(new2), "colloc-s2")
        trigrams = store(trigrams.unionByName(count_border(pieces, 3, s2, new2, min_count)).dropDuplicates(["lang", "phrase"]), "colloc-trigrams")
    return words, bigrams, trigrams, totals, passes


def _score(a, l, r):
    big = "decimal(38,0)"
    return F.expr(f"(cast({a} as {big}) * cast({a} as {big}) * 1000000) div (cast({l} as {big}) * cast({r} as {big}))").cast("bigint")


def collocations(docs, min_count=MIN_COUNT, top=TOP, rate=SAMPLE_RATE, lowered=LOWERED):
    """lang, rank, phrase, a, l, r, n, score (and k, the cut) of each lang's best `top` candidates."""
    pieces = store(word_pieces(docs), "colloc-pieces")
    words, bigrams, trigrams, totals, _ = frequent_phrases(pieces, min_count, rate, lowered)
    one = words.select("lang", F.col("phrase").alias("_p"), F.col("f").alias("_f"))
    two = bigrams.select("lang", F.col("phrase").alias("_p"), F.col("f").alias("_f"))
    tri = trigrams

    def counted(df, table, key, name):
        return df.join(table.withColumnRenamed("_p", key).withColumnRenamed("_f", name), ["lang", key])

    bi = bigrams.select("lang", "phrase", F.col("f").alias("a"), "left", "right")
    bi = counted(counted(bi, one, "left", "l"), one, "right", "r").withColumn("k", F.lit(1))
    cover = tri.select("lang", F.col("f").alias("_t"), F.explode(F.array("left", "right")).alias("phrase"))
    covered = bi.join(cover, ["lang", "phrase"]).where(100 * F.col("_t") >= 50 * F.col("a")).select("lang", "phrase").distinct()
    bi = bi.join(covered, ["lang", "phrase"], "left_anti").withColumn("score", _score("a", "l", "r"))

    t = tri.select("lang", "phrase", F.col("f").alias("a"), "left", "right",
                   F.element_at(F.split("phrase", " "), 1).alias("w1"), F.element_at(F.split("phrase", " "), 3).alias("w3"))
    t = counted(counted(counted(counted(t, one, "w1", "l1"), two, "right", "r1"), two, "left", "l2"), one, "w3", "r2")
    s1, s2 = _score("a", "l1", "r1"), _score("a", "l2", "r2")
    first = s1 <= s2
    t = t.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                 F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.when(first, 1).otherwise(2).alias("k"),
                 F.least(s1, s2).alias("score"))
    cands = bi.select("lang", "phrase", "a", "l", "r", "k", "score").unionByName(t.select("lang", "phrase", "a", "l", "r", "k", "score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = cands.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_n") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("a").cast("bigint").alias("a"), F.col("l").cast("bigint").alias("l"),
                                              F.col("r").cast("bigint").alias("r"), F.col("n").cast("bigint").alias("n"), "score", "k")

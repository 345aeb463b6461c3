r"""Secret scan with a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. A Boolean trigram query is derived from it: the
literal strings that every match must contain, as an AND of clauses, each an OR of
alternatives, each an AND of trigrams. The index lists, for every trigram of the queries, the
texts (by hash) that hold it in lower case; intersecting its postings gives the
candidate texts of each rule, and only those are searched with the expression. A
rule without mandatory trigrams (such as plain hex runs) is run on every text.

Spans are code points, end exclusive, leftmost and non-overlapping per rule; matches
that fail a rule's length test are dropped, and still consume their characters.

Handled cases: a null text is empty and has no spans; texts of any length are
searched whole; repeated rows give repeated rows (equal texts share one index entry);
spans of different rules may overlap; columns with the names of new ones are replaced.
"""

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import functions as F

_MANY = 64  # literal strings followed at a time; beyond that a clause is cut there


@dataclass(frozen=True)
class Rule:
    """`pattern` in Java syntax; the characters of `group` must be at least `least`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def trigram_query(pattern):
    """AND of clauses; a clause is a set of alternatives; an alternative a set of trigrams.

    An empty list means that nothing is mandatory.
    """
    clauses = []

    def flush(strings):
        if all(len(s) >= 3 for s in strings):
            found = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
            found = frozenset(a for a in found if not any(b < a for b in found))  # the weaker one decides
            if found not in clauses:
                clauses.append(found)

    def exact(items):
        """The strings that a node sequence can match, or None if they are too many."""
        strings = {""}
        for kind, value in items:
            if kind is op.LITERAL:
                more = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                more = {chr(v).lower() for _, v in value}
            elif kind is op.SUBPATTERN:
                more = exact(value[3])
            elif kind is op.BRANCH:
                parts = [exact(v) for v in value[1]]
                more = None if None in parts else set().union(*parts)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1:
                inner = exact(value[2])
                more = None if inner is None else (inner | {""} if value[0] == 0 else inner)
            else:
                more = None
            if more is None or len(strings) * len(more) > _MANY:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    def walk(items):
        strings = {""}
        for item in items:
            more = exact([item])
            if more is not None and len(strings) * len(more) <= _MANY:
                strings = {a + b for a in strings for b in more}
                continue
            flush(strings)
            strings = {""}
            kind, value = item
            if more is not None:
                strings = more
            elif kind is op.SUBPATTERN:
                walk(value[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                walk(value[2])
        flush(strings)

    walk(parser.parse(pattern))
    return clauses


def build_index(texts, rules=RULES):
    """(trigram, key) of the texts (key, text): one row per text and trigram of the rules' queries."""
    wanted = sorted({g for r in rules for c in trigram_query(r.pattern) for a in c for g in a})
    lower = texts.select("key", F.lower("text").alias("lower"))
    held = F.filter(F.array(*[F.when(F.contains("lower", F.lit(g)), F.lit(g)) for g in wanted]), lambda g: g.isNotNull())
    return lower.select("key", F.explode(held).alias("trigram"))


def candidates(index, rules=RULES):
    """(key, kinds): for each text the rules whose trigram queries it satisfies."""
    spark = index.sparkSession
    queries = [
        (r.kind, c, a, g, len(alternative), len(clauses))
        for r in rules if (clauses := trigram_query(r.pattern))
        for c, clause in enumerate(clauses)
        for a, alternative in enumerate(sorted(clause, key=sorted)) for g in sorted(alternative)
    ]
    # One row per rule, alternative and trigram: its size is that of the rule set.
    table = spark.createDataFrame(queries, "kind string, clause int, alternative int, trigram string, trigrams int, clauses int")
    met = (
        index.join(F.broadcast(table), "trigram")
        .groupBy("key", "kind", "clause", "clauses", "alternative", "trigrams").agg(F.countDistinct("trigram").alias("n"))
        .where("n = trigrams")
        .groupBy("key", "kind", "clauses").agg(F.countDistinct("clause").alias("n")).where("n = clauses")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text, rule, order):
    """Spans of one rule in a column: array<struct<start, place, kind, end>>."""
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    matches = F.zip_with(whole, tested, lambda w, t: F.struct(F.length(w).alias("n"), (F.length(t) >= rule.least).alias("ok")))
    steps = F.zip_with(F.slice(pieces, 1, F.size(whole)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    kind = "array<struct<start:int,place:int,kind:string,end:int>>"
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"]).alias("at"),
            F.when(s["ok"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"),
                (acc["at"] + s["gap"] + s["n"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def quick_test(rule):
    """A pattern that finds a text with a match; length tests on the whole match go into it."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("+"):
        # The last class is repeated at least as often as the length test asks for.
        head = rule.pattern[:rule.pattern.rindex("[")]
        return f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}"
    return rule.pattern


def find_secrets(df, rules=RULES, text="text"):
    """`df` with `spans`, all spans of all rules by start, then rule order."""
    kept = [c for c in df.columns if c != "spans"]
    rows = df.select(*kept).withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_key", F.xxhash64("_text"))
    found = candidates(build_index(rows.select(F.col("_key").alias("key"), F.col("_text").alias("text")), rules), rules)
    joined = rows.join(found.withColumnRenamed("key", "_key").withColumnRenamed("kinds", "_kinds"), "_key", "left")
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    parts = []
    for order, rule in enumerate(rules):
        possible = F.col("_text").rlike(quick_test(rule))
        if trigram_query(rule.pattern):
            possible = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False)) & possible
        parts.append(F.when(possible, rule_spans(F.col("_text"), rule, order)).otherwise(none))
    return joined.select(*kept, F.array_sort(F.concat(*parts)).alias("spans"))


def redact(df, text="text"):
    """`text` with each span replaced by its rule's name in brackets; overlapping spans become one."""
    body = F.coalesce(F.col(text), F.lit(""))
    rebuilt = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    return df.withColumn(text, F.when(F.size("spans") > 0, rebuilt).otherwise(F.col(text)))


def digests(documents):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find_secrets(documents.select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [r.kind for r in BASE]
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    only = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(count, base), F.sha2(listed(only), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

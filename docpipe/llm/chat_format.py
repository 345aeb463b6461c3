r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one
role are merged by an array aggregation, and the merged turns are concatenated:

    <|start|>role<|text|>first text<|join|>second text<|end|>...

<|join|> keeps the border of merged turns, so reading back returns every turn. In roles
and texts, anything that looks like a control string of this template or of
common others (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`) gets a backslash after its
first character, and one more where it has some already; reading back takes one
away. No control string is left inside a text.

`loss` lists the spans of assistant texts in the formatted string (code points, end
exclusive); the spans hold the texts alone, no marks.

Handled cases: a null text or role counts as ''; a row without conv_id is a conversation
of its own; equal turn numbers are ordered by role and text, a null turn comes first;
repeated rows are repeated turns; an empty table gives no rows. Other
columns are not carried. A conversation is one string, so its turns meet in one row.
"""

from pyspark.sql import functions as F

START, TEXT, JOIN, END = "<|start|>", "<|text|>", "<|join|>", "<|end|>"
_CONTROL = r"(\||/?s>|/?INST\])"
LEARNED = ("assistant",)


def escape(c):
    return F.regexp_replace(c, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c):
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def format_conversations(turns, learned=LEARNED):
    """(conv_id, turn, role, text) -> conv_id, formatted, loss array<struct<start, end>>."""
    rows = turns.select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = rows.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merge(groups, t):
        last = F.element_at(groups, -1)
        joined = F.concat(
            F.slice(groups, 1, F.size(groups) - 1),
            F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(escape(t["text"]))).alias("texts"))),
        )
        fresh = F.concat(groups, F.array(F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))))
        return F.when((F.size(groups) > 0) & (last["role"] == t["role"]), joined).otherwise(fresh)

    nothing = F.array().cast("array<struct<role:string,texts:array<string>>>")
    merged = collected.withColumn("groups", F.aggregate("turns", nothing, merge))

    # One piece per string of the output, marked where it is an assistant's text.
    def pieces(g):
        texts = F.transform(g["texts"], lambda x, i: F.array(
            F.struct(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("learn")),
            F.struct(x.alias("s"), g["role"].isin(*learned).alias("learn")),
        ))
        head = F.array(F.struct(F.concat(F.lit(START), escape(g["role"]), F.lit(TEXT)).alias("s"), F.lit(False).alias("learn")))
        return F.concat(head, F.flatten(texts), F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("learn"))))

    built = merged.withColumn("pieces", F.flatten(F.transform("groups", pieces)))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(
                acc["at"].alias("start"), (acc["at"] + F.length(p["s"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return built.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss"),
    )


def read_back(formatted):
    """A column of formatted strings -> array<struct<role, text>>, one per original turn."""
    groups = F.slice(F.split(formatted, r"<\|end\|>", -1), 1, F.size(F.split(formatted, r"<\|end\|>", -1)) - 1)

    def turns(group):
        head = F.substring_index(group, TEXT, 1)
        role = unescape(F.substring(head, len(START) + 1, F.length(head)))
        body = F.substring(group, F.length(head) + len(TEXT) + 1, F.length(group))
        return F.transform(F.split(body, r"<\|join\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(groups, turns))


def learned_text(formatted, loss):
    """The unescaped text under the loss spans, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(turns):
    read = format_conversations(turns).select(
        "conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
        learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def with_probe(conversations):
    """The conversations plus number -7, whose texts are control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)

"""Quotation linking over conversations, in DataFrame operations only.

A line's quote level is the number of '>' marks it begins with.  Consecutive lines of one level are a passage.
Passages are normalised (lower case, runs of white space and punctuation to one space) and hashed; a quoted passage is
joined to the earliest message of its conversation that holds it as its own words: as its whole text, a passage, a
paragraph or a line, or with all of the passage's lines among its own.  A hash has one candidate; a passage of several
lines is compared with the messages that hold the rarest of them, once for all messages that quote it.  A message replies to the latest message that it quotes at the lowest level
found, and messages without links reply to nothing.  Following replies gives each message its thread; conversations
come out in reply order, without quoted lines.

Hot conversations and passages: originals are aggregated before the shuffle, and Spark splits the hot side of the
join.  Passages are found inside a row, so no conversation is gathered in one task.

Ties: of messages that hold a passage the earliest counts, and of passages of one level the latest such message.
Nulls: a null text is empty; rows with a null conv_id or turn keep their own words and are linked to nothing.
Repeated (conv_id, turn) rows stay separate rows with equal links.  Very long messages take time in proportion to their
lines.  Other columns, of whatever name, are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.llm.common import shared_dir, store

_MARKS = r"^[ \t]*(?:>[ \t]?)+"


def line_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def passages(text: Column) -> Column:
    """ARRAY<STRUCT<level, words>>: consecutive lines of one level, joined by a line feed.  A passage begins where the level
    changes and is cut out as a slice, so a message takes time in proportion to its lines."""
    line = lambda x: F.struct(line_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("words"))
    level = lambda ls, i: F.get(ls, i)["level"]
    begins = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (level(ls, i) != level(ls, i - 1)))
    words = lambda ls, i, n: F.array_join(F.transform(F.slice(ls, i + 1, n), lambda x: x["words"]), "\n")
    cut = lambda ls, bs: F.transform(bs, lambda i, k: F.struct(level(ls, i).alias("level"), words(ls, i, F.coalesce(F.get(bs, k + 1), F.size(ls)) - i).alias("words")))
    folded = bound(F.transform(F.split(text, "\r\n|\n", -1), line), lambda ls: bound(begins(ls), lambda bs: cut(ls, bs)))
    plain = F.array(F.struct(F.lit(0).alias("level"), text.alias("words")))
    return F.when(text.contains(">"), folded).otherwise(plain)  # most messages quote nothing


def normalised(words: Column) -> Column:
    """Words of punctuation alone keep it."""
    plain = F.trim(F.regexp_replace(F.lower(words), r"[\s\p{Punct}]+", " "))
    return F.when(plain == "", F.trim(F.regexp_replace(words, r"\s+", " "))).otherwise(plain)


def hashed(words: Column) -> Column:
    return F.md5(words.cast("binary"))


def line_hashes(words: Column) -> Column:
    """The different lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(words, "\n"), normalised), lambda x: x != ""), hashed))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), reply_to, thread_turn, depth, n_quotes, n_linked; sorted order is
    conv_id, thread_turn, turn."""
    spark = messages.sparkSession
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("raw"),
    ).withColumn("parts", passages(F.col("raw")))
    has_quote = F.exists("parts", lambda p: p["level"] > 0)
    keyed = rows.where("conv_id is not null and turn is not null")
    quoted = (
        keyed.where(F.col("raw").contains(">")).where(has_quote)
        .select("conv_id", "turn", F.explode("parts").alias("p")).where("p.level > 0")
        .select("conv_id", "turn", F.col("p.level").alias("level"), normalised(F.col("p.words")).alias("words"), line_hashes(F.col("p.words")).alias("lines"))
        .where(F.col("words") != "")
        .select("conv_id", "turn", "level", hashed(F.col("words")).alias("hash"), "lines", hashed(F.array_join("lines", " ")).alias("of_lines")).distinct()
    )
    quoted = store(quoted, shared_dir(spark, "quotes"))
    # Own words as a whole, their passages, paragraphs and lines: a quote may take any of them.
    own = F.filter("parts", lambda p: p["level"] == 0)
    own_text = F.array_join(F.transform(own, lambda p: p["words"]), "\n")
    pieces = F.concat(F.transform(own, lambda p: p["words"]), F.array(own_text), F.split(own_text, r"\n\s*\n"), F.split(own_text, "\n"))
    units = F.array_distinct(F.transform(pieces, normalised))
    asked = keyed.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    originals = (
        asked.select("conv_id", "turn", F.explode(units).alias("words")).where(F.col("words") != "")
        .groupBy("conv_id", hashed(F.col("words")).alias("hash")).agg(F.min("turn").alias("whole"))
    )
    originals = store(originals, shared_dir(spark, "originals"))
    held = asked.join(quoted.where(F.size("lines") > 1).select("conv_id").distinct(), "conv_id", "left_semi")
    held = store(held.select("conv_id", "turn", line_hashes(own_text).alias("held")), shared_dir(spark, "lines"))
    by_lines = store(lines_found(quoted, held), shared_dir(spark, "by-lines"))
    links = quoted.join(originals, ["conv_id", "hash"], "left").join(by_lines, ["conv_id", "of_lines"], "left")
    links = links.withColumn("of", F.least("whole", "together")).where("of < turn").groupBy("conv_id", "turn", "level", "hash").agg(F.min("of").alias("of"))
    replies = links.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "of"))["of"].alias("reply_to"), F.count("*").alias("n_linked")
    )
    threads = thread_roots(store(replies, shared_dir(spark, "replies")))
    counted = F.size(F.filter("parts", lambda p: p["level"] > 0)).cast("long")
    out = rows.select(
        "conv_id", "turn", "role", F.regexp_replace(F.regexp_replace(own_text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("text"), counted.alias("n_quotes")
    )
    return out.join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def lines_found(quoted: DataFrame, held: DataFrame) -> DataFrame:
    """conv_id, of_lines, together: the earliest message that holds all lines of a passage of several."""
    lines = held.select("conv_id", "turn", F.explode("held").alias("line")).distinct()
    counts = lines.groupBy("conv_id", "line").agg(F.count("*").alias("n"))
    several = quoted.where(F.size("lines") > 1).select("conv_id", "of_lines", "lines").distinct()
    rarest = (
        several.select("conv_id", "of_lines", "lines", F.explode("lines").alias("line")).join(counts, ["conv_id", "line"])
        .groupBy("conv_id", "of_lines").agg(F.min(F.struct("n", "line"))["line"].alias("line"), F.count("*").alias("found"), F.first("lines").alias("lines"))
        .where(F.col("found") == F.size("lines"))
    )
    both = rarest.join(lines, ["conv_id", "line"]).join(held, ["conv_id", "turn"])
    return both.where(F.size(F.array_except("lines", "held")) == 0).groupBy("conv_id", "of_lines").agg(F.min("turn").alias("together"))


def thread_roots(replies: DataFrame) -> DataFrame:
    """Each reply's first message and its distance, by pointer doubling: the number of rounds is the logarithm of the
    longest chain.  Only linked messages take part; every round is written to the shared folder."""
    spark = replies.sparkSession
    now = replies.select("conv_id", "turn", "reply_to", "n_linked", F.col("reply_to").alias("thread_turn"), F.lit(1).alias("depth"))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread_turn").alias("above"), F.col("depth").alias("more"))
        joined = now.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread_turn") == F.col("t")), "left")
        now = store(
            joined.select("conv_id", "turn", "reply_to", "n_linked", F.coalesce("above", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")),
            shared_dir(spark, "threads"),
        )
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")

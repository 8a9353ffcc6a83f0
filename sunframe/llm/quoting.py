"""Conversations without quotes, in reply order.

A line's quote level is the number of ``>`` before its text. Consecutive lines of one level are a passage; its
normalised form (lower case, single spaces) is hashed. What a message says itself (level 0) is hashed as a whole, by
paragraph and by line. A quoted passage links to the message it was taken from: the latest earlier message of the
same conversation that says it, or else the first message anywhere. A message's parent is the source of its first
level-1 passage that has one. A passage that nobody says as a whole (a trimmed quote) is sought by its parts, which are its
paragraphs, lines and sentences, among the same parts of messages; the longest part with a source decides. Parents inside
the conversation are always earlier, so replies form trees, whose roots
are found by doubling pointers.

Only DataFrame expressions run. The search within a conversation is an ordered window over (conversation, passage);
the search everywhere joins passages to one row per distinct passage, so no pair of messages is ever built and a
passage that everybody quotes is a hot key with a single partner, which adaptive execution splits.

Defined cases: NULL text has no quotes and stays NULL; NULL conversations or turns keep their row but are neither
parents nor linked; rows that share (conv_id, turn) are each cleaned and linked, a parent pointer names the pair;
passages without a letter or digit are not linked; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tools import Scratch

#: Fixed: the quote signs that open a line, and the line that introduces a quotation.
PREFIX = r"^([ \t]*>)+"
INTRODUCTION = r"^(?i)[ \t]*(on .{1,200} wrote|am .{1,200} schrieb.*|le .{1,200} a écrit|el .{1,200} escribió)[ \t]*:[ \t]*$"

#: Fixed: where a sentence of normalised text ends.
SENTENCE = r"(?<=[.!?…]) |(?<=[。！？])"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def digest(text: Column) -> Column:
    """The hash of a normalised passage, NULL when it holds no letter or digit."""
    plain = normalised(text)
    return F.when(plain.rlike(r"[\p{L}\p{N}]"), F.md5(plain))


def parts(text: Column) -> Column:
    """array<struct<size, hash>>: the whole text, its paragraphs, lines and sentences, those without letters left out."""
    pieces = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    sentences = F.flatten(F.transform(pieces, lambda x: F.split(normalised(x), SENTENCE)))
    hashed = F.transform(F.concat(pieces, sentences), lambda x: F.struct(F.length(normalised(x)).alias("size"), digest(x).alias("hash")))
    return F.filter(hashed, lambda x: x.hash.isNotNull())


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body, intro>>, one per line."""
    def line(x: Column, i: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, PREFIX, 0), "[^>]", ""))
        body = F.when(level > 0, F.regexp_replace(x, PREFIX + " ?", "")).otherwise(x)
        return F.struct(level.alias("level"), body.alias("body"), ((level == 0) & x.rlike(INTRODUCTION)).alias("intro"))

    return F.transform(F.split(text, "\r?\n", -1), line)


def passages(lines: Column) -> Column:
    """Runs of lines of one quote level: array<struct<level, body>>, in order."""
    start = F.array().cast("array<struct<level:int,body:string>>")
    return F.aggregate(lines, start, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1).level == x.level),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            x.level.alias("level"), F.concat(F.get(acc, F.size(acc) - 1).body, F.lit("\n"), x.body).alias("body")))))
        .otherwise(F.concat(acc, F.array(F.struct(x.level.alias("level"), x.body.alias("body"))))))


def cleaned(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, clean_text, quotes`` (level, hash), ``said`` (hashes), ``max_quote_level``."""
    df = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text",
                         parsed_lines(F.col("text")).alias("__lines"))
    quoted = F.exists("__lines", lambda x: x.level > 0)
    kept = F.filter("__lines", lambda x, i: (x.level == 0) & ~(x.intro & F.coalesce(
        F.get(F.col("__lines"), i + 1).level > 0, F.lit(False))))
    own = F.array_join(F.transform(kept, lambda x: x.body), "\n")
    df = df.withColumn("clean_text", F.when(quoted, F.regexp_replace(F.trim(own), r"^\s+|\s+$", "")).otherwise(F.col("text")))
    runs = F.transform(F.filter(passages(F.col("__lines")), lambda p: p.level > 0),
                       lambda p: F.struct(p.level.alias("level"), digest(p.body).alias("hash"), p.body.alias("body")))
    df = df.withColumn("quotes", F.when(quoted, F.filter(runs, lambda p: p.hash.isNotNull()))
                       .otherwise(F.array().cast("array<struct<level:int,hash:string,body:string>>")))
    units = F.concat(F.array(F.col("clean_text")), F.split("clean_text", r"\n\s*\n"), F.split("clean_text", "\n"))
    said = F.array_distinct(F.array_compact(F.transform(units, digest)))
    level = F.coalesce(F.array_max(F.transform("__lines", lambda x: x.level)), F.lit(0))
    return df.select("conv_id", "turn", "role", "clean_text", "quotes", F.coalesce(said, F.array().cast("array<string>")).alias("said"),
                     level.alias("max_quote_level"))


def sources(said: DataFrame, quotes: DataFrame) -> DataFrame:
    """The rows of ``quotes`` (conv_id, turn, at, hash and more) whose hash is said, with parent_conv and parent_turn."""
    wanted = said.join(quotes.select("hash").distinct(), "hash", "left_semi")
    events = wanted.select("conv_id", "hash", "turn").unionByName(quotes, allowMissingColumns=True)
    # sayings of earlier turns only: a range frame that ends one turn before
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max(F.when(F.col("at").isNull(), F.col("turn"))).over(before)).where("at is not null")
    first = wanted.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("far"))
    out = near.join(first, "hash", "left").select(
        *quotes.columns,
        F.when(F.col("near").isNotNull(), F.col("conv_id")).otherwise(F.col("far.conv_id")).alias("parent_conv"),
        F.coalesce("near", "far.turn").alias("parent_turn"))
    # a message quoting only what it says itself has no source; neither has one quoted before it was said
    own = F.col("parent_conv") == F.col("conv_id")
    return out.where(F.col("parent_turn").isNotNull() & ~(own & (F.col("parent_turn") >= F.col("turn"))))


def linked(clean: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, at, level, parent_conv, parent_turn`` of every quoted passage that has a source; at is its place."""
    named = clean.where("conv_id is not null and turn is not null")
    said = named.select("conv_id", "turn", F.explode("said").alias("hash")).distinct()
    quotes = named.select("conv_id", "turn", F.posexplode("quotes").alias("at", "q")).select(
        "conv_id", "turn", "at", F.col("q.level").alias("level"), F.col("q.hash").alias("hash"), F.col("q.body").alias("body"))
    whole = scratch.save(sources(said, quotes.drop("body").distinct()), "whole")
    run = ["conv_id", "turn", "at", "level", "run"]
    trimmed = (quotes.join(whole.select("conv_id", "turn", "at", "hash"), ["conv_id", "turn", "at", "hash"], "left_anti")
               .select("conv_id", "turn", "at", "level", F.col("hash").alias("run"), F.posexplode(parts(F.col("body"))).alias("place", "p"))
               .groupBy(*run, F.col("p.hash").alias("hash"), F.col("p.size").alias("size")).agg(F.min("place").alias("place")))
    trimmed = scratch.save(trimmed, "trimmed")
    pieces = named.select("conv_id", "turn", F.explode(F.transform(parts(F.col("clean_text")), lambda p: p.hash)).alias("hash")).distinct()
    longest = sources(pieces, trimmed).groupBy(*run).agg(F.max_by(
        F.struct("parent_conv", "parent_turn"), F.struct("size", -F.col("place"))).alias("p"))
    columns = ["conv_id", "turn", "at", "level", "parent_conv", "parent_turn"]
    return whole.select(columns).union(longest.select(*columns[:4], "p.parent_conv", "p.parent_turn"))


def reply_trees(clean: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """All rows of ``clean`` with parent, root and depth, sorted so that replies follow what they answer."""
    links = scratch.save(linked(clean, scratch), "links")
    scratch.drop("whole", "trimmed")
    keys = ["conv_id", "turn"]
    found = links.groupBy(*keys).agg(F.count("*").alias("n_linked"), F.min(F.when(
        F.col("level") == 1, F.struct("at", "parent_conv", "parent_turn"))).alias("first"))
    parents = scratch.save(found.select(*keys, "n_linked", F.col("first.parent_conv").alias("parent_conv"),
                                        F.col("first.parent_turn").alias("parent_turn")), "parents")
    # only parents inside the conversation make the tree: they are earlier, so there are no rings
    up = parents.where("parent_conv = conv_id").select(*keys, F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth"))
    current = scratch.save(up, "up-0")
    for step in range(1, max_rounds + 1):
        above = scratch.read(f"up-{step - 1}").select("conv_id", F.col("turn").alias("root"), F.col("root").alias("__root"),
                                                      F.col("depth").alias("__depth"))
        jumped = current.join(above, ["conv_id", "root"], "left")
        if not jumped.where("__root is not null").limit(1).count():
            break
        current = scratch.save(jumped.select(*keys, F.coalesce("__root", "root").alias("root"),
                                             (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")), f"up-{step}")
        scratch.drop(f"up-{step - 1}")
    out = (clean.join(parents, keys, "left").join(current, keys, "left")
           .select(*keys, "role", "clean_text", F.size("quotes").cast("long").alias("n_quotes"),
                   F.col("max_quote_level").cast("long").alias("max_quote_level"),
                   F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn",
                   F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth")))
    return out.orderBy("conv_id", "root_turn", "depth", "turn")


def conversations_without_quotes(messages: DataFrame) -> DataFrame:
    scratch = Scratch(messages.sparkSession, "quoting")
    return reply_trees(cleaned(messages), scratch)

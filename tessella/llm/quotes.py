"""Quotation linking: who answers whom in conversations that quote.

A line that opens with ``>`` marks is quoted; the number of marks is its level.
Neighbouring lines of one level form a passage.  Passages are normalised (case,
white space) and hashed, and joined to the latest earlier message of the
conversation that has the passage as its own text: all of it however its lines
are broken, or as neighbouring lines (blank ones left out).  For these a message
hashes its runs of as many lines as some passage of the conversation has.  A
passage that nobody has like this was edited: its lines are looked for one by
one, each in the latest earlier message that has it, and the message found for
most lines is taken if it is found for more than half of them.  A message
answers the message that its shallowest linked passage comes from, or the turn
before if it quotes nothing that is known.  The result has the messages without
quotes, in reply order.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch

#: Turns whose quotes are matched together; a conversation of any length is many such stretches.
STRETCH = 256
MARKS = r"^[ \t]*(?:>[ \t]*)+"
#: A line that names who wrote what is quoted below it.
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|.{1,80}\b(?:wrote|writes|said))\s*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _split(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, uid, line_no, level, body`` for each line."""
    lines = messages.select("conv_id", "turn", "uid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("line_no", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return lines.select("conv_id", "turn", "uid", "line_no", level.alias("level"), F.regexp_replace("line", MARKS, "").alias("body"))


def latest_before(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys, ``turn``) with ``source``: the greatest turn of ``held`` (keys, ``turn``) below its own.

    An as-of join without pairs: turns are cut into stretches, the stretches'
    last turns are carried forward over one row a stretch, and within a stretch
    one ordered pass finds the last turn.  So no key makes a long window.
    """
    stretch = F.floor(F.col("turn") / STRETCH)
    held = held.select(*keys, "turn").distinct().withColumn("stretch", stretch)
    wanted = wanted.withColumn("stretch", stretch)
    last = held.groupBy(*keys, "stretch").agg(F.max("turn").alias("last"))
    spots = last.unionByName(wanted.select(*keys, "stretch").distinct().withColumn("last", F.lit(None).cast("long"))).groupBy(*keys, "stretch").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(*keys, "stretch", F.max("last").over(earlier).alias("carried"))
    both = wanted.withColumn("own", F.lit(False)).unionByName(held.withColumn("own", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max(F.when(F.col("own"), F.col("turn"))).over(inside)).where(~F.col("own")).drop("own")
    return found.join(carried, [*keys, "stretch"], "left").withColumn("source", F.coalesce("near", "carried")).drop("near", "carried", "stretch")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """Messages without their quotes, with what they answer, in reply order.

    conversations: ``conv_id, turn, role, text``; other columns are left out.
    Returns, for each row: ``conv_id, turn, role, text`` (without quoted and
    attribution lines), ``quoted_passages``, ``linked_passages``,
    ``quote_depth`` (the deepest level), ``parent_turn``, ``linked`` (whether a
    quote gave the parent), ``thread_turn`` (the turn at the root of its
    replies), ``reply_depth`` (replies above it).  Ordering by ``conv_id,
    thread_turn, turn`` puts every message after the one that it answers.

    Defined cases: a null text is an empty message; rows with a null conv_id or
    turn are returned without a parent as their own threads; rows that repeat a
    turn are messages of that turn, each with its own text, and as a parent the
    turn stands for them; a message never answers its own or a later turn.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "quotes")
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # numbers of rows, fixed by being written
    base = scratch.cut(base.withColumn("uid", F.monotonically_increasing_id()), "messages")
    placed = base.where("conv_id is not null and turn is not null")

    # only messages with a quoted line take part as quoting ones
    quoting = base.where(F.col("text").contains(">") & F.col("text").rlike("(?m)" + MARKS))
    lines = scratch.cut(_split(quoting), "lines")
    order = Window.partitionBy("uid").orderBy("line_no")
    marked = lines.withColumn("opens", (F.lag("level").over(order).isNull() | (F.lag("level").over(order) != F.col("level"))).cast("int"))
    marked = marked.withColumns({"run": F.sum("opens").over(order), "next_level": F.lead("level").over(order)})
    own = marked.where("level = 0").where(~(F.col("body").rlike(ATTRIBUTION) & (F.coalesce("next_level", F.lit(0)) > 0)))
    # the lines of one message are gathered, which its text already was
    bare = own.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x.body), "\n").alias("bare"))
    quoted = marked.where("level > 0 and trim(body) <> ''")
    passages = quoted.groupBy("conv_id", "turn", "uid", "run", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x.body).alias("bodies"))
    passages = scratch.cut(passages.where("conv_id is not null and turn is not null").withColumn("whole", F.xxhash64(_normal(F.array_join("bodies", "\n")))), "passages")
    counted = quoted.groupBy("uid").agg(F.countDistinct("run").alias("quoted_passages"), F.max("level").alias("quote_depth"))

    # what messages hold as their own text: the whole of it, and each line
    texts = placed.select("conv_id", "turn", "uid", "text").join(bare, "uid", "left").select("conv_id", "turn", F.coalesce("bare", "text", F.lit("")).alias("body"))
    asked_convs = passages.select("conv_id").distinct()
    texts = texts.join(asked_convs, "conv_id", "left_semi")
    whole = texts.select("conv_id", "turn", F.xxhash64(_normal(F.col("body"))).alias("hash"))
    in_lines = texts.select("conv_id", "turn", F.transform(F.filter(F.split("body", "\r\n|\r|\n"), lambda x: F.trim(x) != ""), _normal).alias("lines"))
    each = in_lines.select("conv_id", "turn", F.explode("lines").alias("line")).select("conv_id", "turn", F.xxhash64("line").alias("hash"))
    by_run = passages.select("conv_id", "turn", "uid", "run", "level", F.transform("bodies", _normal).alias("lines"))
    # the numbers of lines that passages of a conversation have: few, as n different ones take n * n / 2 quoted lines
    lengths = by_run.groupBy("conv_id").agg(F.collect_set(F.size("lines")).alias("lengths"))
    runs = F.expr("flatten(transform(lengths, m -> if(size(lines) < m, array(), transform(sequence(1, greatest(1, size(lines) - m + 1)), i -> xxhash64(m, array_join(slice(lines, i, m), '\n'))))))")
    runs = in_lines.join(lengths, "conv_id").select("conv_id", "turn", F.explode(runs).alias("hash"))
    keys = ["conv_id", "hash"]
    by_whole = passages.select("conv_id", "turn", "uid", "run", "level", F.col("whole").alias("hash"))
    by_line = by_run.select("conv_id", "turn", "uid", "run", "level", F.size("lines").alias("of"), F.explode("lines").alias("line")).select("conv_id", "turn", "uid", "run", "level", "of", F.xxhash64("line").alias("hash"))
    by_run = by_run.select("conv_id", "turn", "uid", "run", "level", F.expr("xxhash64(size(lines), array_join(lines, '\n'))").alias("hash"))

    def held(rows: DataFrame, asked: DataFrame) -> DataFrame:
        return rows.join(asked.select(*keys).distinct(), keys, "left_semi")

    exact = latest_before(by_whole, held(whole, by_whole), keys).unionByName(latest_before(by_run, held(runs, by_run), keys))
    exact = exact.where("source is not null").groupBy("uid", "run", "level").agg(F.max("source").alias("exact"))
    votes = latest_before(by_line, held(each, by_line), keys).where("source is not null").groupBy("uid", "run", "level", "of", "source").agg(F.count(F.lit(1)).alias("n")).where("2 * n > of")
    partial = votes.groupBy("uid", "run", "level").agg(F.max(F.struct("n", "source")).alias("best")).select("uid", "run", "level", F.col("best.source").alias("partial"))
    linked = exact.join(partial, ["uid", "run", "level"], "full").select("uid", "run", "level", F.coalesce("exact", "partial").alias("source"))
    answers = linked.groupBy("uid").agg(F.min(F.struct("level", "run", "source")).alias("first"), F.count(F.lit(1)).alias("linked_passages"))
    answers = answers.select("uid", F.col("first.source").alias("quoted_turn"), "linked_passages")

    turns = placed.select("conv_id", "turn").distinct()
    # the turn before: the as-of join of the turns with themselves
    previous = latest_before(turns, turns, ["conv_id"]).withColumnRenamed("source", "previous")
    told = base.join(bare, "uid", "left").join(counted, "uid", "left").join(answers, "uid", "left").join(previous, ["conv_id", "turn"], "left")
    told = told.select(
        "conv_id", "turn", "role", F.trim(F.coalesce("bare", "text", F.lit(""))).alias("text"), F.coalesce("quoted_passages", F.lit(0)).cast("long").alias("quoted_passages"),
        F.coalesce("linked_passages", F.lit(0)).cast("long").alias("linked_passages"), F.coalesce("quote_depth", F.lit(0)).cast("int").alias("quote_depth"),
        F.coalesce("quoted_turn", "previous").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("linked"),
    )
    told = scratch.cut(told, "told")

    # a turn's parent is that of its quoting rows if it has several; then pointers are doubled up to the roots
    parents = told.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max(F.struct("linked", "parent_turn")).alias("p")).select("conv_id", "turn", F.col("p.parent_turn").alias("top"))
    # settled rows point at a root; only the others take part in a round
    first = parents.select("conv_id", "turn", F.coalesce("top", "turn").alias("top"), F.when(F.col("top").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("top").isNull().alias("settled"))
    moved = scratch.cut(first, "jumps")
    settled, going = moved.where("settled"), moved.where("not settled")
    while not going.isEmpty():
        above = settled.unionByName(going).select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), "settled")
        moved = going.drop("settled").join(above, ["conv_id", "top"]).select("conv_id", "turn", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), "settled")
        moved = scratch.cut(moved, "jumps")
        settled, going = settled.unionByName(moved.where("settled")), moved.where("not settled")
    roots = settled.select("conv_id", "turn", F.col("top").alias("thread_turn"), F.col("depth").alias("reply_depth"))
    out = told.join(roots, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "quoted_passages", "linked_passages", "quote_depth", "parent_turn", "linked", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"))

"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quotes, as many levels deep as they have marks. Runs of one level are
passages; a passage, normalised and hashed, is joined to the earliest message of its conversation that has it as
its own text, paragraph or line. The shallowest linked passage tells what a message replies to. Threads follow
from the links by pointer jumping, and every message comes out without its quotes, with the columns that order it: by
(conversation, thread, turn) replies follow what they quote. The rows are not sorted, which would shuffle every text
for an order that few sinks keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_MARKS = r"^[ \t]*(?:>[ \t]?)+"
_BLANK = r"\n[ \t]*\n"
_ATTRIBUTION = r"^[ \t]*(?:On\b.{0,300}\bwrote|.{1,200}\bwrote|.{1,200}\bschrieb|.{1,200}\ba écrit|.{1,200}\bescribió)[ \t]*:[ \t]*$"


def _level(line: Column) -> Column:
    """Depth of a line's quotation: its leading > marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def _own_lines(lines: Column) -> Column:
    """Lines that are no quotes and do not introduce one. The next line stands beside each, as a lambda that
    looked into the whole array would split the text again for every line."""
    following = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("")))
    beside = F.zip_with(lines, following, lambda x, y: F.struct(x.alias("line"), y.alias("next")))
    own = F.filter(beside, lambda x: (_level(x["line"]) == 0) & ~(x["line"].rlike(_ATTRIBUTION) & (_level(x["next"]) > 0)))
    return F.transform(own, lambda x: x["line"])


def _normal(text: Column) -> Column:
    """Lower case, white space as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _key(normal: Column) -> Column:
    return F.sha2(normal, 256)


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, quoted_turn): each linked passage of each message.

    messages: conv_id, turn, text. A passage links to the least earlier turn of its conversation that has it; if
    none has the whole passage, its lines and then its paragraphs (between blank quoted lines, perhaps wrapped anew)
    are linked by themselves.
    """
    quoting = messages.where(F.col("text").rlike(r"(?m)" + _MARKS) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    message = ["conv_id", "turn", "h"]
    at = quoting.select("conv_id", "turn", F.xxhash64("text").alias("h"), "text").distinct()
    at = at.select(*message, F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("level", _level(F.col("line")))
    in_order = Window.partitionBy(*message).orderBy("pos")  # the lines of one message
    begins = F.coalesce(F.col("level") != F.lag("level").over(in_order), F.lit(True)).cast("int")
    runs = at.withColumn("begins", begins).withColumn("passage", F.sum("begins").over(in_order)).where("level > 0")
    body = F.regexp_replace("line", _MARKS, "").alias("body")
    passages = runs.select(*message, "passage", "level", "pos", body).groupBy(*message, "passage", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("bodies"))
    passages = passages.select("conv_id", "turn", "passage", "level", F.transform("bodies", lambda x: x["body"]).alias("bodies"))
    passage, joined = ["conv_id", "turn", "passage", "level"], F.array_join("bodies", "\n")
    whole = passages.select(*passage, F.lit(0).alias("unit"), F.lit(0).alias("at"), joined.alias("body"))
    paragraphs = passages.select(*passage, F.split(joined, _BLANK).alias("bodies")).where("size(bodies) > 1").select(*passage, F.lit(2).alias("unit"), F.posexplode("bodies").alias("at", "body"))
    single = passages.where("size(bodies) > 1").select(*passage, F.lit(1).alias("unit"), F.posexplode("bodies").alias("at", "body"))
    asked = whole.unionByName(paragraphs).unionByName(single).withColumn("normal", _normal(F.col("body"))).where("normal <> ''").select(*passage, "unit", "at", _key(F.col("normal")).alias("key"))

    with_quotes = cut(quoting.select("conv_id").distinct())  # written first, so that a very long conversation can be split
    own = messages.where("turn is not null").join(with_quotes, "conv_id", "left_semi").select("conv_id", "turn", _own_lines(_lines(F.coalesce("text", F.lit("")))).alias("own"))
    body = F.array_join("own", "\n")
    units = F.array_distinct(F.transform(F.concat(F.array(body), F.split(body, _BLANK), F.col("own")), _normal))
    units = own.select("conv_id", "turn", F.explode(units).alias("normal")).where("normal <> ''")
    origin = cut(units.groupBy("conv_id", _key(F.col("normal")).alias("key")).agg(F.min("turn").alias("quoted_turn")))
    linked = asked.join(origin, ["conv_id", "key"]).where("quoted_turn < turn")
    return linked.groupBy("conv_id", "turn", "level", "passage").agg(F.min_by("quoted_turn", F.struct("unit", "at")).alias("quoted_turn"))


def threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, reply_to) -> (conv_id, turn, reply_to, root, depth) by pointer jumping: each round doubles
    the distance that a pointer spans."""
    state = cut(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")))
    for _ in range(max_rounds):
        if state.where("not done").isEmpty():
            return state.select("conv_id", "turn", "reply_to", "root", "depth")
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
        state = cut(
            state.join(up, ["conv_id", "root"], "left").select(
                "conv_id", "turn", "reply_to", F.coalesce("up_root", "root").alias("root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.col("up_root").isNull().alias("done")
            )
        )
    raise RuntimeError(f"threads did not settle in {max_rounds} rounds")


def format_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread_root, depth, n_quoted, formatted), a row for each message; sorted by
    (conv_id, thread_root, turn) they read as reply-ordered conversations.

    text has no quotes and no line that introduces one, and is trimmed; formatted wraps it with its role. reply_to
    is the turn that the shallowest linked passage comes from (the first such passage), null if none is linked;
    thread_root is the turn at the end of those links (its own, if it replies to none) and depth the number of
    links to it; n_quoted counts quoted lines. Replies are later than what they quote, so turn orders a thread.
    Null texts are empty, null roles ``user``; a null conv_id or turn links nothing. Messages repeated under one
    (conv_id, turn) stay, with the links of all of them. An empty table gives no rows.
    """
    rows = table.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    linked = link_quotes(rows.select("conv_id", "turn", "text"))
    parents = linked.groupBy("conv_id", "turn").agg(F.min_by("quoted_turn", F.struct("level", "passage")).alias("reply_to"))
    tree = threads(parents).withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    joined = rows.join(tree, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    lines = _lines(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit("user"))
    out = joined.select(
        "conv_id", "turn", role.alias("role"),
        F.regexp_replace(F.array_join(_own_lines(lines), "\n"), r"^\s+|\s+$", "").alias("text"),
        "reply_to", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size(F.filter(lines, lambda x: _level(x) > 0)).cast("long").alias("n_quoted"),
    )
    return out.withColumn("formatted", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")))

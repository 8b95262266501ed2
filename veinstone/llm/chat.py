"""Chat formatting: conversations as training windows of a token budget, in built-in expressions only.

Turns are put in order once, by a range partitioning over (conversation, turn), so that a conversation
of any length lies in as many tasks as it needs, and get a running number.  Prefix sums of the turns'
tokens are taken in two steps, within blocks of ``BLOCK`` running numbers and then over the blocks of
a conversation.  They choose the spans: a turn belongs to the span of ``fresh`` tokens in which it ends;
the one turn that reaches into it from the span before goes along where the whole still has at most
``fresh`` tokens, else it is a span by itself.  So no turn is cut, and a span depends on two sums only.

Each span is a window.  In front of its turns stand the conversation's system turn, if that comes
first, and the turns before it that have at most ``history`` tokens and fit into the budget.  What is
repeated isn't trained on again: the loss mask has each text of an assistant once, in its own span.
A window is over the budget only by a single turn or a system turn that is too long; nothing is cut.

The template is ``<turn role>``, text and ``</turn>`` on lines of their own.  In front of ``<turn`` or
``</turn`` inside a text, and the backslashes before it, one backslash more is put, so a marker without
one is always the template's; the role is percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Tokens of a window, of the new turns in it, and of the turns that it may repeat (at most ``FRESH``).
BUDGET, FRESH, HISTORY = 2048, 1024, 512
#: log2 of the running numbers in a block.
BLOCK = 10
#: A word of letters and digits (all beyond ASCII counts as such) or a mark is a token; markers and role add some to each turn.
TOKEN, TURN_TOKENS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", 4
LAST = "\n</turn>\n"
SYSTEM, TARGET = "system", "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+</?turn)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+</?turn)", "$1")


def opened(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def in_order(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``key, mid, role, text, tokens``: all turns, written in order of conversation, turn, role and a hash of the text; ``mid`` rises with it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.struct(F.col(conv_col).alias("id")).alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = ["key", "turn", "role", "h"]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    return written(numbered.select("key", "mid", "role", "text", (F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS).cast("long").alias("tokens")), "turns")


def prefix_sums(ordered: DataFrame) -> DataFrame:
    """``key, mid, before, after, system_mid, system_tokens``: tokens of a conversation up to each turn, a system turn at its head left out."""
    light = ordered.select("key", "mid", "tokens", (F.col("role") == SYSTEM).alias("system"), F.shiftright("mid", BLOCK).alias("block"))
    blocks = light.groupBy("key", "block").agg(F.sum("tokens").alias("sum"), F.min(F.struct("mid", "system", "tokens")).alias("first"))
    over = W.partitionBy("key").orderBy("block")
    ahead = blocks.select(
        "key", "block", F.coalesce(F.sum("sum").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.first("first").over(over).alias("head")
    ).select("key", "block", "ahead", F.when(F.col("head.system"), F.col("head.mid")).alias("system_mid"), F.when(F.col("head.system"), F.col("head.tokens")).otherwise(0).alias("system_tokens"))
    within = light.withColumn("sum", F.sum("tokens").over(W.partitionBy("key", "block").orderBy("mid")))
    after = F.col("ahead") + F.col("sum") - F.col("system_tokens")
    joined = within.join(ahead, ["key", "block"])
    return joined.select("key", "mid", F.greatest(after - F.col("tokens"), F.lit(0)).alias("before"), after.alias("after"), "system_mid", "system_tokens")


def members(sums: DataFrame, budget: int, fresh: int, history: int) -> DataFrame:
    """``start, mid, fresh``: the turns of every window, which is named by its first new turn."""
    span = F.floor(F.greatest(F.col("after") - 1, F.lit(0)) / fresh)
    group = W.partitionBy("key", "span")
    whole = F.max("after").over(group) - F.min("before").over(group)
    alone = (F.col("before") < F.col("span") * fresh) & (whole > fresh)
    own = sums.withColumn("span", span).withColumn("alone", alone)
    # at the first turn, which has no tokens there, a system turn stands for itself
    own = written(own.withColumn("start", F.min("mid").over(W.partitionBy("key", "span", "alone"))), "spans")
    windows = own.groupBy("key", "start").agg(F.min("before").alias("from"), F.max("after").alias("to"), F.first("system_mid").alias("system_mid"), F.first("system_tokens").alias("system_tokens"))
    room = F.least(F.lit(history), F.col("budget_left"))
    windows = windows.withColumn("budget_left", F.greatest(F.lit(budget) - F.col("system_tokens") - (F.col("to") - F.col("from")), F.lit(0))).withColumn("room", room)
    # turns that may be repeated begin less than ``history`` tokens in front, so in one of two ranges of as many
    at = F.floor(F.col("from") / max(history, 1))
    near = windows.where((F.col("room") > 0) & (F.col("from") > 0)).select("key", "start", "from", "room", F.explode(F.array(at - 1, at)).alias("range"))
    turns = own.where(F.col("after") > 0).select("key", "mid", "before", "after", F.floor(F.col("before") / max(history, 1)).alias("range"))
    earlier = near.join(turns, ["key", "range"]).where((F.col("before") >= F.col("from") - F.col("room")) & (F.col("after") <= F.col("from")))
    system = windows.where("system_mid IS NOT NULL AND start <> system_mid")
    return own.select("start", "mid", F.lit(True).alias("fresh")).union(earlier.select("start", "mid", F.lit(False))).union(system.select("start", F.col("system_mid"), F.lit(False)))


def windows(turns: DataFrame, *, budget: int = BUDGET, fresh: int = FRESH, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``key, start, n_turns, n_repeated, text, loss``: the formatted windows of all conversations.

    ``key`` is a struct with the conversation's id, and ``start`` orders its windows.  The first
    ``n_repeated`` turns of a window were new in another one.  ``loss`` has the code points of ``text``
    (from, to) that are trained on.  Null texts are empty, a null role is the empty one, null turns come
    first, a null id is an id like any other.  Turns with one number go by role, then by a hash of the
    text; repeated rows are turns of their own.  Very long texts are read whole, each within one task;
    an empty table has no window.  No other column is read.
    """
    if not 0 <= history <= fresh <= budget:
        raise ValueError("history has at most as many tokens as the new turns, and these as the budget")
    ordered = in_order(turns, conv_col, turn_col, role_col, text_col)
    each = members(prefix_sums(ordered), budget, fresh, history).join(ordered.select("key", "mid", "role", "text"), "mid")
    parts = each.select("key", "start", "mid", "fresh", opened(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("fresh") & (F.col("role") == TARGET)).alias("target"))
    gathered = parts.groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct("mid", "fresh", "head", "body", "target"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(LAST))), "")
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["target"].alias("target")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    walk = F.aggregate(
        "sizes", F.struct(F.lit(0).alias("at"), none.alias("loss")),
        lambda acc, p: F.struct((acc["at"] + p["head"] + p["body"] + len(LAST)).alias("at"), F.when(p["target"], F.array_append(acc["loss"], F.struct((acc["at"] + p["head"]).alias("from"), (acc["at"] + p["head"] + p["body"]).alias("to")))).otherwise(acc["loss"]).alias("loss")),
    )
    formatted = gathered.select("key", "start", F.size("parts").alias("n_turns"), F.size(F.filter("parts", lambda p: ~p["fresh"])).alias("n_repeated"), text.alias("text"), sizes.alias("sizes"))
    return formatted.withColumn("loss", walk["loss"]).drop("sizes")


def read_back(found: DataFrame) -> DataFrame:
    """``key, start, turns, losses`` from windows: (role, text) of the turns that are new in each, and the texts under its loss mask."""
    pieces = F.split("text", LAST, -1)  # the last one is empty
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - F.col("n_repeated") - 1)
    head = lambda p: F.substring_index(p, "\n", 1)
    role = lambda p: F.url_decode(F.substring(head(p), F.lit(len("<turn ") + 1), F.length(head(p)) - len("<turn >")))
    body = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p))
    turns = F.transform(F.col("new"), lambda p: F.struct(role(p).alias("role"), unescaped(body(p)).alias("text")))
    losses = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["from"] + 1, s["to"] - s["from"])))
    return found.withColumn("new", new).select("key", "start", turns.alias("turns"), losses.alias("losses"), F.length("text").cast("long").alias("chars"))


def digest(found: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """For each conversation: ``conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from its windows.

    A digest of a conversation's turns needs their whole text in one row; windows come together there
    as two strings each.
    """
    one = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(found).select("key", "start", one.alias("turns"), F.size("turns").alias("n"), F.array_join("losses", "").alias("loss"), "chars")
    whole = rows.groupBy("key").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("start", "turns", "loss"))).alias("all"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.sha2(F.array_join(F.col("all").getField(name), ""), 256)
    return whole.select(F.col("key.id").alias(conv_col), "n_turns", joined("turns").alias("turns_sha256"), "loss_chars", joined("loss").alias("loss_sha256"), "formatted_chars")

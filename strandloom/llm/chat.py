"""Chat formatting from an event log.

A conversation is a log of events by sequence number: a message opens, its text is streamed in deltas, replaced by an
edit, or generated anew, which also takes back what was said after it. The log is partitioned by conversation, sorted by
sequence and folded into the final messages, and these are rendered by a template that escapes its own marks in texts, with
the spans that a loss mask covers. All of it are window and aggregate functions of Spark, whose sorts spill, so that a
conversation is held whole only as the one row that it becomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Strings that mark turns and roles in this template or in other common ones.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
#: Opens and closes a turn; stands between its role and its text; breaks up control strings in texts.
OPEN, CLOSE, BETWEEN, ESCAPE = "<|im_start|>", "<|im_end|>\n", "\n", "\u241b"
#: Code points of a delta; kinds of events; roles whose text is learned.
DELTA, KINDS, LEARNED = 400, ("open", "delta", "edit", "regenerate"), ("assistant",)
LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\.[]{}()<>*+-=!?^$|/" else c for c in text)


def escape(text: Column) -> Column:
    """Doubles the escape mark, and puts one behind the first character of each control string, also where they overlap."""
    starts = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, ESCAPE, ESCAPE * 2), f"({starts})", f"$1{ESCAPE}")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, f"(?s){ESCAPE}(.)", "$1")


def turns_as_log(turns: DataFrame, delta: int = DELTA, drafts: bool = False) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text): each opens and streams its text in deltas.

    Rows of a conversation are numbered by turn, role and text, so that repeated rows are turns of their own; a null text has
    no deltas. With ``drafts`` two of three turns begin with their text backwards, which an edit empties or a new generation
    takes back.
    """
    numbered = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("message"))
    streamed = lambda text: F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{delta}}}"), F.lit(0)), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    one = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("text")))
    events = F.concat(one("open"), streamed(F.col("text")))
    if drafts:
        again = F.when(F.col("message") % 3 == 1, F.concat(one("open"), streamed(F.reverse("text")), one("edit"), streamed(F.col("text"))))
        events = again.when(F.col("message") % 3 == 2, F.concat(one("open"), streamed(F.reverse("text")), one("regenerate"), streamed(F.col("text")))).otherwise(events)
    told = numbered.select("conv_id", "message", "role", F.posexplode(events).alias("at", "event"))
    return told.select("conv_id", (F.shiftleft("message", 32) + F.col("at")).alias("seq"), "message", "event.kind", F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text")


def fold_log(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the messages that are left at the end of each conversation's log.

    Events are taken by seq; of several with one seq the least by kind, message and text counts, so that events that were
    delivered twice do no harm. A message stands from its first event that isn't taken back. ``delta`` adds to its text; ``edit``
    puts another text in the place of what it has; ``regenerate`` empties it and takes back the messages of a higher number that
    stood by then, which may come again later. Its role is that of its last ``open``, or empty. Null texts are empty. Events of unknown kind, without seq or message, are left
    out; a null conv_id is a conversation like others. An empty log gives an empty table.
    """
    known = log.filter(F.col("kind").isin(*KINDS) & F.col("seq").isNotNull() & F.col("message").isNotNull()).select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    in_turn = Window.partitionBy("conv_id").orderBy("seq", "kind", "message", "text", "role")
    once = known.withColumn("again", F.coalesce(F.lag("seq").over(in_turn) == F.col("seq"), F.lit(False))).filter("NOT again").drop("again")
    # the least message that a later event generates anew: what belongs to a higher one is taken back
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    anew = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    standing = once.withColumn("anew", anew).filter(F.col("anew").isNull() | (F.col("message") <= F.col("anew"))).drop("anew")
    reset = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    told = standing.withColumn("since", F.max(reset).over(Window.partitionBy("conv_id", "message")))
    adds = F.col("kind").isin("delta", "edit") & (F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(adds, F.struct("seq", "text")))), lambda x: x["text"]), "")
    role = F.max(F.when(F.col("kind") == "open", F.struct("seq", "role")))["role"]
    return told.groupBy("conv_id", "message").agg(F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, formatted and loss: the turns of each conversation as one text, and the spans of it that are learned.

    A span has start and end in code points of ``formatted``, the end exclusive, and covers the escaped text of a turn. A
    line break in a role is escaped too. Conversations without messages give no row.
    """
    role = F.regexp_replace(escape(F.col("role")), BETWEEN, ESCAPE + BETWEEN)
    turns = messages.select("conv_id", "message", F.concat(F.lit(OPEN), role, F.lit(BETWEEN)).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*learned).alias("learned"))
    head, body = F.char_length("head"), F.char_length("body")
    before = F.sum(head + body + len(CLOSE)).over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1))
    placed = turns.withColumn("start", F.coalesce(before, F.lit(0)) + head)
    spans = F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct("start", (F.col("start") + body).alias("end")))))
    text = F.array_sort(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(CLOSE)).alias("text"))))
    return placed.groupBy("conv_id").agg(F.array_join(F.transform(text, lambda x: x["text"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of role and text."""
    role = f"[^{BETWEEN}{ESCAPE}]*(?:{ESCAPE}.[^{BETWEEN}{ESCAPE}]*)*"
    whole = F.regexp_extract_all(formatted, F.lit(f"(?s){_quoted(OPEN)}(.*?){_quoted(CLOSE)}"), F.lit(1))
    part = lambda t, k: unescape(F.regexp_extract(t, f"(?s)^({role}){BETWEEN}(.*)$", k))
    return F.transform(whole, lambda t: F.struct(part(t, 1).alias("role"), part(t, 2).alias("text")))


def read_learned(formatted: Column, loss: Column) -> Column:
    """The learned texts of a formatted text, in order, by its spans."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def format_conversations(turns: DataFrame, delta: int = DELTA, drafts: bool = False) -> DataFrame:
    """conv_id, formatted, loss of finished turns (conv_id, turn, role, text), through their event log.

    Rows of a conversation go by turn; ties, repeated rows, nulls and empty tables are as in ``turns_as_log``; a null role is
    empty; other columns are ignored.
    """
    return render(fold_log(turns_as_log(turns, delta, drafts)))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted texts and their spans."""
    turns, learned = read_turns(F.col("formatted")), F.array_join(read_learned(F.col("formatted"), F.col("loss")), "")
    told = formatted.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))

"""Chat formatting in budgeted, turn-aligned windows, in DataFrame functions only.

Prefix sums of turn tokens place every turn in a window on its own: a window holds the
turns whose tokens lie in one span of ``stride`` tokens, less those of the system turn,
and a turn that reaches over the end of a span is a window by itself. Each window repeats
the system turn and the turns in the last ``history`` tokens before it, so that it has at
most ``stride + history`` tokens; repeated targets are not in its mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import materialise, n_words

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of new turns in a window (budget less history), and of repeated turns.
STRIDE, HISTORY = 1536, 512
#: Turns of a conversation that one task sorts and sums at a time.
BLOCK = 256


def escape(text: Column) -> Column:
    """``<|`` gets a backslash inside, and ``<\\|``, ``<\\\\|`` ... one more, so that the
    result never holds ``<|`` and the step can be undone."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: backslashes and line ends are spelt out, then as texts."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    raw = unescape(role)
    return F.regexp_replace(F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n"), r"\\\\", r"\\")


def ordered_turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n (position), role, text, tokens, before (tokens of earlier turns).

    Positions and sums come in two steps, blocks of turn numbers and then turns within
    a block, so no task holds a whole conversation. Tokens of a turn are its words and
    four for the marks.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).withColumn("tokens", n_words(F.col("text")) + 4).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    sums = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("n0"))
    at = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    inside = turns.withColumn("k", F.row_number().over(at)).withColumn("s", F.sum("tokens").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    both = inside.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("block") == F.col("b_")))
    return both.select("conv_id", (F.col("n0") + F.col("k") - 1).alias("n"), "role", "text", "tokens", (F.col("t0") + F.col("s") - F.col("tokens")).alias("before"))


def format_chats(rows: DataFrame, *, stride: int = STRIDE, history: int = HISTORY, target: str = "assistant", **columns: str) -> DataFrame:
    """Return per window: conv_id, window (its order), text, new_from (code point at
    which its new turns start), n_new, loss (array of start and end, end exclusive).

    * rows are in the order of turn, null first; ties go by role and text, and repeated
      rows are turns of their own
    * null role and null text are empty; a null conversation id is a conversation
    * the system turn is a first turn with role ``system``; its tokens count in every
      window. It is repeated whole if it has at most half of ``stride``; a longer one is
      in the first window only
    * a turn longer than what the system turn leaves of ``stride`` is a window of its
      own, whole, without history: only then can a window be over the budget
    * an empty table gives an empty result; other columns are ignored
    """
    if history > stride:
        raise ValueError("history must not be longer than stride")
    turns = materialise(ordered_turns(rows, **columns), "chat-turns")
    last = F.col("before") + F.col("tokens")
    repeats = (F.col("n") == 0) & (F.col("role") == "system") & (2 * F.col("tokens") <= stride)
    # What a conversation's system turn leaves of the stride: one row for each that has one.
    rooms = turns.where(repeats).select(F.col("conv_id").alias("c_"), (stride - F.col("tokens")).alias("room"))
    turns = turns.join(rooms, F.col("conv_id").eqNullSafe(F.col("c_")), "left").drop("c_").withColumn("room", F.coalesce("room", F.lit(stride)))
    cell = F.floor(F.col("before") / F.col("room"))
    placed = turns.withColumn("w", cell * 2 + F.when(cell < F.floor((last - 1) / F.col("room")), 1).otherwise(0))
    shown = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    piece = F.struct("n", shown.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == target).alias("target"))
    new = placed.select("conv_id", "w", F.lit(2).alias("kind"), piece.alias("p"))
    # Windows and where their new turns start.
    starts = placed.groupBy("conv_id", "room", "w").agg(F.min("before").alias("from"), F.min("n").alias("first"), F.max("tokens").alias("most")).where("first > 0").select(F.col("conv_id").alias("c_"), F.col("room").alias("r_"), "w", "from", "most")
    # A turn lies in the history of windows that start in (its end, its start + history].
    reach = F.sequence(F.floor(last / F.col("room")), F.floor((F.col("before") + history) / F.col("room")))
    near = placed.where((F.col("tokens") <= history) & ~repeats).withColumn("cell", F.explode(reach)).drop("w")
    cells = starts.where("most <= r_").withColumn("e_", F.floor(F.col("from") / F.col("r_")))
    old = near.join(cells, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("cell") == F.col("e_"))).where((last <= F.col("from")) & (F.col("from") <= F.col("before") + history)).select("conv_id", "w", F.lit(1).alias("kind"), piece.alias("p"))
    system = placed.where(repeats).drop("w").join(starts, F.col("conv_id").eqNullSafe(F.col("c_"))).select("conv_id", "w", F.lit(0).alias("kind"), piece.alias("p"))
    parts = new.unionByName(old).unionByName(system).groupBy("conv_id", "w").agg(F.sort_array(F.collect_list(F.struct("kind", "p"))).alias("t"))
    whole = F.transform("t", lambda x: F.concat(x.p.head, x.p.body, F.lit(END + "\n")))
    # One pass carries the code points so far and the mask.
    seen = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("fresh"), F.expr("array()").cast("array<struct<start:bigint,end:bigint>>").alias("loss")),
        lambda s, x: F.struct(
            (s.at + F.length(x.p.head) + F.length(x.p.body) + len(END) + 1).alias("at"),
            F.when(x.kind < 2, s.at + F.length(x.p.head) + F.length(x.p.body) + len(END) + 1).otherwise(s.fresh).alias("fresh"),
            F.when((x.kind == 2) & x.p.target, F.concat(s.loss, F.array(F.struct((s.at + F.length(x.p.head)).alias("start"), (s.at + F.length(x.p.head) + F.length(x.p.body)).alias("end"))))).otherwise(s.loss).alias("loss"),
        ),
    )
    fresh = F.size(F.filter("t", lambda x: x.kind == 2)).cast("long")
    return parts.select("conv_id", F.col("w").alias("window"), F.array_join(whole, "").alias("text"), fresh.alias("n_new"), seen.alias("s")).select("conv_id", "window", "text", F.col("s.fresh").alias("new_from"), "n_new", F.col("s.loss").alias("loss"))


def _turns(text: Column) -> Column:
    """Turns of formatted text, as role, line end, text, line end."""

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        body = F.substring(x, cut + 1, F.length(x) - cut - (len(END) + 1))
        return F.concat(unescape_role(F.substring(x, F.lit(1), cut - 1)), F.lit("\n"), unescape(body), F.lit("\n"))

    return F.transform(F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30), turn)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the conversations, from the windows alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. Windows are joined in
    groups first, so that one task reads few rows of a long conversation."""
    text = F.col("text")
    turns = _turns(F.substring(text, (F.col("new_from") + 1).cast("int"), F.length(text)))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(text, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    each = windows.select("conv_id", "window", F.size(turns).cast("long").alias("n"), F.array_join(turns, "").alias("t"), masked.alias("l"), F.length(text).cast("long").alias("f"))

    def joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        held = F.sort_array(F.collect_list(F.struct(order, "t", "l")))
        both = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("f").alias("f"), held.alias("h"))
        return both.select(*keys, "n", "f", F.array_join("h.t", "").alias("t"), F.array_join("h.l", "").alias("l"))

    some = joined(each.withColumn("group", F.floor(F.col("window") / 32)), ["conv_id", "group"], "window")
    full = joined(some, ["conv_id"], "group")
    return full.select("conv_id", F.col("n").alias("n_turns"), F.sha2("t", 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), F.col("f").alias("formatted_chars"))

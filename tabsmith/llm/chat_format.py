"""Chat formatting into budgeted windows, in DataFrame functions alone.

A conversation's turns are laid on a token axis by prefix sums (a turn's tokens
are its words plus MARKER_TOKENS for its markers). With a budget of B tokens,
S for the system turn and H for repeated history, the axis is cut every
N = max(B - S - H, B / 4) tokens:

* turns that lie between two cuts form one window;
* a turn that lies across a cut forms a window of its own;
* every window starts with the system turn and repeats the turns that begin at
  most H tokens before its own first turn.

So windows are aligned with turns and follow from prefix sums alone, without a
running choice. A window keeps to the budget unless a single turn or the system
turn is too long for it; no turn is cut or dropped (``over_budget`` tells).

The loss mask covers each assistant text once, in the window where the turn is
new; repeated targets are masked. Spans count code points of ``formatted``.

Template: ``<|role|>`` + newline + text + ``<|end|>`` + newline for each turn. In
texts and roles a ``~`` is put behind each ``<`` or ``[`` that could start a
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) or that a
``~`` follows; ``unescape`` takes it away again, so no text can forge a marker.

Defined cases: a null or empty text is an empty turn, a null role the role
``unknown``; turns with one number are ordered by role and text (repeated rows
stay repeated), a null turn number comes first, rows without a conv_id form one
conversation; only the first turn can be the system turn that is retained; an
empty table has no windows. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.store import save, table

MARKER_TOKENS = 4
#: Turns whose prefix sums are made in one window; longer conversations add up block by block.
BLOCK = 512
#: FIXED VALUE: strings that start a marker here or in other common templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    pairs = [("<~", "<~~"), ("[~", "[~~"), *((c, c[0] + "~" + c[1:]) for c in CONTROL)]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescape(text: Column) -> Column:
    pairs = [*((c[0] + "~" + c[1:], c) for c in CONTROL), ("<~~", "<~"), ("[~~", "[~")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def turn_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + MARKER_TOKENS


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Each turn with its number in the conversation, the tokens before it and the
    tokens of the conversation's system turn (0 for none). ``key`` stands for the
    conversation (also for the null one), so that all steps share plain hash keys."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn(
        "tokens", turn_tokens(F.col("text")).cast("long")).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    inside = (Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
              .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("tokens_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn(
        "turns_in", F.count(F.lit(1)).over(inside))
    opening = F.when((F.col("turns_in") == 0) & (F.col("role") == "system"), F.col("tokens"))
    blocks = t.groupBy("key", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"),
                                           F.max(opening).alias("s"))
    # one row for BLOCK turns of a conversation
    order = Window.partitionBy("key").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                           F.coalesce(F.first("s").over(order), F.lit(0)).alias("system_tokens"))
    return (t.join(blocks, ["key", "block"])
            .select("key", "conv_id", "role", "text", "tokens", (F.col("tokens_in") + F.col("t0")).alias("begin"),
                    (F.col("turns_in") + F.col("n0")).alias("number"), "system_tokens"))


def chat_windows(conversations: DataFrame, *, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row a window: conv_id, window (long: the tokens before its first new turn), formatted (string), spans
    (array of struct<number, piece, start, length, repeated, loss>: a turn's place in
    the conversation, where its marker and its text start, code points of its text),
    tokens (long), over_budget (boolean)."""
    room = F.greatest(F.lit(budget) - F.col("system_tokens") - F.lit(history), F.lit(max(1, budget // 4)))
    # the turns are read by several steps below; saved, they are placed once
    turns = save(placed_turns(conversations).withColumn("room", room.cast("long")), "chat-turns")
    opens = (F.col("number") == 0) & (F.col("role") == "system")
    system = turns.where(opens)
    # behind the system turn starts the axis
    body = (turns.where(~opens).withColumn("begin", F.col("begin") - F.col("system_tokens"))
            .withColumn("cell", F.expr("begin div room"))
            .withColumn("across", F.expr("(begin + tokens - 1) div room > cell")))
    place = ["key", "cell", "across"]
    windows = body.groupBy(*place).agg(F.min("begin").alias("window"), F.max("room").alias("room"))
    # a system turn with nothing behind it is a window too
    alone = (turns.groupBy("key").agg(F.max("number").alias("last"), F.max(opens).alias("opens"), F.max("room").alias("room"))
             .where("last = 0 AND opens")
             .select("key", F.lit(0).cast("long").alias("cell"), F.lit(False).alias("across"),
                     F.lit(0).cast("long").alias("window"), "room"))
    windows = save(windows.unionByName(alone), "chat-windows")

    kept = ["conv_id", "number", "role", "text", "tokens"]
    # a window's own turns carry its place; only their window's first place is looked up at the end
    new = body.select(*place, *kept, F.lit(False).alias("repeated"))
    back = (windows.withColumn("from_cell", F.explode(F.sequence(F.col("cell") - F.ceil(F.lit(history) / F.col("room")),
                                                                 F.col("cell")))).alias("w"))
    old = (back.join(body.alias("t"), F.expr("w.key = t.key AND w.from_cell = t.cell "
                                             f"AND t.begin >= w.window - {int(history)} AND t.begin < w.window"))
           .select(*(F.col(f"w.{k}").alias(k) for k in place), *(F.col(f"t.{c}") for c in kept), F.lit(True).alias("repeated")))
    first = (windows.alias("w").join(system.alias("s"), F.expr("w.key = s.key"))
             .select(*(F.col(f"w.{k}").alias(k) for k in place), *(F.col(f"s.{c}") for c in kept),
                     (F.col("w.window") > 0).alias("repeated")))

    parts = new.unionByName(old).unionByName(first)
    parts = (parts.withColumn("loss", (F.col("role") == "assistant") & ~F.col("repeated"))
             .withColumn("role", escape(F.col("role"))).withColumn("text", escape(F.col("text")))
             .select(*place, "conv_id", "number", "tokens", "repeated", "loss",
                     turn_text(F.col("role"), F.col("text")).alias("chunk"), (F.char_length("role") + 5).alias("head"),
                     F.char_length("text").cast("long").alias("length")))
    ahead = Window.partitionBy(*place).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("piece", F.coalesce(F.sum(F.char_length("chunk")).over(ahead), F.lit(0)))
             .withColumn("start", F.col("piece") + F.col("head")))
    # a window's turns are bounded by the budget, or it is one turn
    items = F.array_sort(F.collect_list(F.struct("number", "piece", "start", "length", "repeated", "loss", "chunk")))
    made = parts.groupBy(*place).agg(items.alias("items"), F.sum("tokens").alias("tokens"), F.first("conv_id").alias("conv_id"))
    spans = F.transform("items", lambda x: F.struct(*(x[c].alias(c) for c in ("number", "piece", "start", "length", "repeated", "loss"))))
    made = made.join(windows.select(*place, "window"), place)
    return made.select("conv_id", "window", F.array_join(F.transform("items", lambda x: x["chunk"]), "").alias("formatted"),
                       spans.alias("spans"), "tokens", (F.col("tokens") > budget).alias("over_budget"))


def new_turns() -> Column:
    """The turns that are new in a window, read back: array of struct<number, role, text, loss>."""
    def turn(s: Column) -> Column:
        cut = lambda a, n: unescape(F.substring(F.col("formatted"), (a + 1).cast("int"), n.cast("int")))
        return F.struct(s["number"].alias("number"), cut(s["piece"] + 2, s["start"] - s["piece"] - 5).alias("role"),
                        cut(s["start"], s["length"]).alias("text"), s["loss"].alias("loss"))
    return F.transform(F.filter("spans", lambda s: ~s["repeated"]), turn)


def read_turns(windows: DataFrame) -> DataFrame:
    """The turns that are new in their windows, read back: conv_id, number, role, text, loss."""
    return windows.select("conv_id", F.explode(new_turns()).alias("t")).select("conv_id", "t.*")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(tricky).alias("text"))
    windows = chat_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    # a digest of a whole conversation needs its turns together
    whole = (windows.select("conv_id", new_turns().alias("turns"), F.char_length("formatted").alias("chars"))
             .groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"),
                                     F.sum("chars").cast("long").alias("formatted_chars")))
    text = lambda items, f: F.array_join(F.transform(items, f), "")
    said = text(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"])
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))).cast("binary"), 256).alias("turns_sha256"),
        F.char_length(said).cast("long").alias("loss_chars"), F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")


OP2_SQL = r"""
WITH input AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (
  SELECT *, len(regexp_extract_all(text, '[^ 	-
]+')) + 4 AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS number
  FROM input),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY number) - tokens AS begin_all,
         coalesce(max(CASE WHEN number = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS sys,
         (number = 0 AND role = 'system') AS opens,
         9 + length(role) + 5
           + length(replace(replace(replace(replace(replace(replace(replace(text, '<~', '<~~'), '[~', '[~~'),
             '<|', '<~|'), '<s>', '<~s>'), '</s>', '<~/s>'), '[INST]', '[~INST]'), '[/INST]', '[~/INST]'))
           - 1 AS chars
  FROM turns),
axis AS (
  SELECT *, begin_all - sys AS b, greatest(1024 - sys - 256, 256) AS room FROM placed),
body AS (
  SELECT *, b // room AS cell, ((b + tokens - 1) // room) > (b // room) AS across FROM axis WHERE NOT opens),
windows AS (
  SELECT conv_id, cell, across, min(b) AS w, max(room) AS room FROM body GROUP BY ALL
  UNION ALL
  SELECT conv_id, 0, FALSE, 0, max(room) FROM axis GROUP BY conv_id HAVING count(*) = 1 AND bool_and(opens)),
sizes AS (
  SELECT conv_id, chars FROM body
  UNION ALL
  SELECT w.conv_id, t.chars FROM windows w JOIN body t
    ON w.conv_id = t.conv_id AND t.b >= w.w - 256 AND t.b < w.w
  UNION ALL
  SELECT w.conv_id, s.chars FROM windows w JOIN axis s ON w.conv_id = s.conv_id AND s.opens)
SELECT p.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
FROM (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY number) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
      FROM turns GROUP BY conv_id) p
JOIN (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM sizes GROUP BY conv_id) s ON p.conv_id = s.conv_id
"""

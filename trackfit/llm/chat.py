r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events. Events are grouped by message, sorted by sequence and folded into the final text;
messages are then sorted within their conversation and rendered. The rendered string and its loss mask can be read
back without loss.

Template of a turn: ``### role: text</turn>``. In texts and roles ``\`` becomes ``\b``, ``###`` becomes ``\h`` and
``</turn>`` becomes ``\t``; in roles also ``:`` becomes ``\c``. Every backslash of the output so starts one of these
codes, and neither control string can come from a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfit.llm.common import table

HEAD, COLON, TAIL = "### ", ": ", "</turn>"
#: Roles whose text counts for the loss.
LOSS_ROLES = ("assistant",)


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


TEXT_CODES = [("\\", "\\b"), ("###", "\\h"), (TAIL, "\\t")]
ROLE_CODES = [*TEXT_CODES, (":", "\\c")]


def escape(text: Column, codes: list[tuple[str, str]] = TEXT_CODES) -> Column:
    return _swap(text, codes)


def unescape(text: Column, codes: list[tuple[str, str]] = TEXT_CODES) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(codes)])


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, part, role, text) of the log (conv_id, message, seq, kind, role, text).

    Kinds: ``message`` opens a message; ``delta`` appends to it; ``edit`` and ``regenerate`` replace what is there, and
    later deltas append to the replacement. Null text is empty, null kind is ``message``, null role is the empty role. Rows with the
    same place are ordered by kind, role and text. Each ``message`` event opens a message of its own, so repeated rows
    stay; deltas before any opening event form a message too. The role is that of the event which opened the message. An empty
    log gives no message; other columns of the log are not read, whatever their names. The events of a message are one array,
    and so is a conversation in ``render``: its one output row holds them all, however long, so neither can be split.
    """
    e = F.struct(F.col("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(e)).alias("log"))
    # A part is a run of events from one opening event to the next.
    opens = F.expr("filter(transform(log, (x, i) -> if(x.kind = 'message' or i = 0, i, -1)), i -> i >= 0)")
    parts = logs.withColumn("opens", opens).select(
        "conv_id", "message",
        F.expr("inline(transform(opens, (o, k) -> struct(k as part, slice(log, o + 1, coalesce(try_element_at(opens, k + 2), size(log)) - o) as run)))"),
    )
    last_reset = F.expr("array_max(transform(run, (x, i) -> if(x.kind in ('edit', 'regenerate'), i, 0)))")
    return parts.withColumn("reset", last_reset).select(
        "conv_id", "message", "part", F.expr("run[0].role").alias("role"),
        F.expr("array_join(transform(slice(run, reset + 1, size(run)), x -> x.text), '')").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    ``loss_mask`` has (turn, start, length) for each text that counts for the loss, in code points within that turn's
    part of ``formatted`` (the part up to its closing control string). An empty table gives no row; a conversation is one
    value and must fit a row; columns beside those of ``fold`` are not read.
    """
    role = escape(F.col("role"), ROLE_CODES)
    turn = messages.select(
        "conv_id", "message", "part", F.concat(F.lit(HEAD), role, F.lit(COLON)).alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*LOSS_ROLES).alias("counts")
    )
    m = F.struct("message", "part", F.concat("head", "body", F.lit(TAIL)).alias("out"), F.char_length("head").alias("start"), F.char_length("body").alias("length"), "counts")
    grouped = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.expr("array_join(transform(turns, t -> t.out), '')").alias("formatted"),
        F.expr("filter(transform(turns, (t, i) -> if(t.counts, struct(i as turn, t.start as start, t.length as length), null)), x -> x is not null)").alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the output of ``render``: conv_id, turns (role, text), loss_text, formatted_chars."""
    split = formatted.select("conv_id", "loss_mask", F.char_length("formatted").cast("long").alias("formatted_chars"), F.split("formatted", TAIL).alias("pieces"))
    split = split.withColumn("pieces", F.expr("slice(pieces, 1, size(pieces) - 1)"))
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), COLON, 1), ROLE_CODES).alias("role"),
            unescape(F.substr(p, F.position(F.lit(COLON), p) + len(COLON))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substr(F.col("pieces")[s["turn"]], s["start"] + 1, s["length"]))), "")
    return split.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted_chars")


def events_of(conversations: DataFrame) -> DataFrame:
    """A plain table of turns as a log: each row is one message event at its turn."""
    return conversations.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    log = events_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    back = read_back(render(fold(log)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_E = r"replace(replace(replace({0}, '\', '\b'), '###', '\h'), '</turn>', '\t')"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || replace({_E.format('role')}, ':', '\\c') || ': ' || {_E.format('text')} || '</turn>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

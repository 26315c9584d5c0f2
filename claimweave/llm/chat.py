"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation's log has events (conv_id, seq, msg, kind, role, text): ``message`` and ``edit`` set
a message's text, ``delta`` appends to it, ``regenerate`` empties it for new deltas, ``delete``
takes it out. Events are folded by (conversation, message) and messages by conversation, each in
order of seq, then rendered.

The template: each turn is ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Inside roles and texts a
backslash is doubled, and one goes behind the first character of each control string, so that none
occurs there; taking away one backslash before each character gives the text again. The loss mask
has the span of every assistant text in the output.

Null texts and roles count as empty. Messages of equal order are ordered by role, then text. Events
of equal seq: in order of kind, role and text. Unknown kinds count as message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]")
START, MIDDLE, STOP = "<s>[INST]", "[/INST]", "</s>"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the messages that remain; seq is that of a message's first event.

    A message's events from its last reset on make its text. Its role is the latest that isn't null."""
    kind = F.when(F.col("kind").isin("delta", *RESETS), F.col("kind")).otherwise("message")
    rows = events.select("conv_id", "msg", F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("named")).alias("e"))
    logs = rows.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("log"))
    last = F.expr("aggregate(sequence(1, size(log)), 0, (a, i) -> IF(log[i - 1].kind = 'delta', a, i))")
    live = F.expr("IF(last = 0, log, slice(log, last, size(log) - last + 1))")
    folded = logs.withColumn("last", last).withColumn("live", live).where("last = 0 OR log[last - 1].kind != 'delete'")
    text = F.expr("concat_ws('', transform(live, e -> IF(e.kind = 'regenerate', '', e.text)))")
    role = F.expr("coalesce(try_element_at(filter(log, e -> e.named), -1).role, '')")
    return folded.select("conv_id", F.col("log")[0]["seq"].alias("seq"), role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the conversation as one text, and (start, size) in code points of each text that counts for the loss."""
    parts = F.struct(F.col("seq"), F.col("role"), F.col("text"), escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(parts)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(START), x["r"], F.lit(MIDDLE), x["t"], F.lit(STOP))), "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))
    ends, opening = len(STOP), len(START) + len(MIDDLE)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + opening + F.length(x["r"])
        span = F.array(F.struct(start.alias("start"), F.length(x["t"]).alias("size")))
        return F.struct((start + F.length(x["t"]) + ends).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return turns.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", empty, step, lambda acc: acc["out"]).alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read the output back: (conv_id, turns) with the roles and texts before escaping, and the texts under the loss mask."""
    pieces = F.expr(f"filter(split(formatted, '{STOP}', -1), x -> x != '')")
    split_at = lambda x: F.locate(MIDDLE, x)
    turns = F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(START) + 1), split_at(x) - F.lit(len(START) + 1))).alias("role"),
        unescape(F.substring(x, split_at(x) + F.lit(len(MIDDLE)), F.length(x))).alias("text"),
    ))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))


def digest(parsed: DataFrame) -> DataFrame:
    line = F.lit("\n")
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], line, x["text"], line)), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table that has one row for each turn: a message each. Rows of the same turn stay apart."""
    key = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), "role", "text", F.lit("message").alias("kind"))
    return rows.withColumn("msg", F.struct("seq", key, F.monotonically_increasing_id()))


PROBE = "</s>[INST] ok [/INST]"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation, and -7 (a user, then an assistant, both saying PROBE), formatted and read back."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest(parse(render(fold(as_events(rows)))))


def _sql() -> str:
    def quoted(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in CONTROLS:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    fixed = len(START) + len(MIDDLE) + len(STOP)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({fixed} + length({quoted('role')}) + length({quoted('text')})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""


ORACLE_SQL = _sql()

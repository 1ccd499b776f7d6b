r"""Chat formatting with a grammar that can be read back, in DataFrame functions only.

    conversation = "<s>\n" turn*
    turn         = "[INST] " role " [/INST]\n" text "\n</s>\n"

<s>, </s>, [INST], [/INST], <<SYS>> and <</SYS>> are control strings. Inside roles and texts each of them has a
backslash more before it than in the source, so one that has none is a mark of the grammar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, running

OPEN, ROLE, SAID, END = "<s>\n", "[INST] ", " [/INST]\n", "\n</s>\n"
CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>)"


def escape(text: Column) -> Column:
    r"""One backslash more before each control string and the backslashes before it."""
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, "$1$2")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(ROLE), role, F.lit(SAID), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; a turn that the grammar has not is null. Only a control
    string without a backslash ends or opens a part, so there is one reading at most."""
    body = F.substring(formatted, len(OPEN) + 1, 2**31 - 1)
    turns = F.split(body, r"\n</s>\n", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)  # what follows the last end is empty
    shape = r"(?s)\A\[INST\] (.*?) \[/INST\]\n(.*)\z"

    def turn(t: Column) -> Column:
        role, text = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
        bare = r"(?<!\\)" + CONTROL
        return F.when(t.rlike(shape) & ~role.rlike(bare) & ~text.rlike(bare), F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(turns, turn)


def _unlike(role: Column, text: Column, raw_role: Column, raw_text: Column) -> Column:
    """Whether a turn, rendered with these, does not read back as the source."""
    back = parse(F.concat(F.lit(OPEN), render_turn(role, text)))
    same = (F.size(back) == 1) & (back[0]["role"] == raw_role) & (back[0]["text"] == raw_text)
    return ~F.coalesce(same, F.lit(False))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) for each conversation.

    Every turn is rendered as it is and read back; turns that don't read back identically are escaped and read back
    again, and one that still differs fails the query. loss_spans are [start, end) code points of formatted, one for
    each turn of learn_role: its text and nothing else.

    Turns are ordered by turn, nulls first, then by role and text; repeated rows are repeated turns. Null roles and
    texts count as empty. Rows with a null id are one conversation. Empty tables give no rows; other columns are
    ignored. A conversation is one row, as the result needs it; its turns are all that is gathered.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    plain = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    first = _unlike(F.col("role"), F.col("text"), F.col("role"), F.col("text"))
    turns = plain.withColumn("conflict", first).select(
        "*", F.when(F.col("conflict"), escape(F.col("role"))).otherwise(F.col("role")).alias("as_role"), F.when(F.col("conflict"), escape(F.col("text"))).otherwise(F.col("text")).alias("as_text")
    )
    unread = F.when(F.col("conflict"), _unlike(F.col("as_role"), F.col("as_text"), F.col("role"), F.col("text"))).otherwise(F.lit(False))
    turns = turns.select("conv_id", "turn", "role", "text", F.when(unread, F.raise_error(F.lit("a turn does not read back as it was"))).otherwise(F.col("as_role")).alias("as_role"), "as_text")
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "as_role", "as_text"))).alias("turns"))

    def spans(ts: Column) -> Column:
        around = len(ROLE) + len(SAID) + len(END)
        before = running(F.transform(ts, lambda t: F.length(t["as_role"]) + F.length(t["as_text"]) + around), lambda a, b: a + b)

        def place(z: Column) -> Column:
            start = z["at"] + F.length(z["t"]["as_role"]) + len(OPEN) + len(ROLE) + len(SAID)
            return F.struct(start.alias("start"), (start + F.length(z["t"]["as_text"])).alias("end"))

        return F.transform(F.filter(F.arrays_zip(ts.alias("t"), before.alias("at")), lambda z: z["t"]["role"] == learn_role), place)

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: render_turn(t["as_role"], t["as_text"])), "")).alias("formatted"),
        spans(F.col("turns")).alias("loss_spans"),
    )


#: A formatted conversation is cut into parts of this many code points before pieces of them are taken by place.
_PART = 1024


def pieces(text: Column, spans: Column) -> Column:
    """array<string>: the text of each [start, end) span. Taking a piece walks over its own parts alone."""

    def of(parts: Column) -> Column:
        def piece(s: Column) -> Column:
            first = F.floor(s["start"] / _PART).cast("int")
            some = F.slice(parts, first + 1, F.floor((s["end"] - 1) / _PART).cast("int") - first + 1)
            return F.when(s["end"] > s["start"], F.substring(F.array_join(some, ""), s["start"] - first * _PART + 1, s["end"] - s["start"])).otherwise(F.lit(""))

        return F.transform(spans, piece)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), of)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    chats = format_chats(rows.unionByName(extra)).withColumn("back", parse(F.col("formatted")))
    loss = F.array_join(F.transform(pieces(F.col("formatted"), F.col("loss_spans")), unescape), "")
    return chats.withColumn("loss", loss).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"length(regexp_replace({0}, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>)', '\\\1\2', 'g'))"
QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {
    "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(ROLE + SAID + END)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars + {len(OPEN)} AS BIGINT) AS formatted_chars
FROM c
"""
}

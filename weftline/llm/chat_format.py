r"""Chat formatting with a checked round trip, in built-in expressions only.

A turn is rendered as ``### Role:``, newline, text, newline, ``</turn>``, newline. ``### `` and ``</turn>`` are the
control strings: the parser ends a turn at ``</turn>``, refuses a body that holds a control string without a
backslash before it, and takes one backslash off every control string that has some. Each turn is first rendered
verbatim and parsed again; a turn that does not come back identical is rendered with one more backslash before
each control string and parsed once more. The whole conversation is then parsed and compared with its source,
and a difference raises an error.

Roles of lower-case letters are capitalised; any other role is written as ``=`` and the role with %, colon and line
ends percent-coded, which the parser undoes.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), null turns first; repeated
rows are turns of their own; a null conv_id is one conversation; an empty table gives an empty table. A conversation
is one value by its contract (one digest over all its turns), so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table

#: The control strings, as a pattern for Java and RE2 alike.
CONTROL = r"(### |</turn>)"
HEAD, MID, END = "### ", ":\n", "\n</turn>\n"
LEARNED_ROLE = "assistant"


def role_label(role: Column) -> Column:
    coded = role
    for raw, code in (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("\r", "%0D")):
        coded = F.replace(coded, F.lit(raw), F.lit(code))
    plain = role.rlike(r"\A[a-z][a-z_]*\z")
    return F.when(plain, F.concat(F.upper(F.substring(role, 1, 1)), F.substr(role, F.lit(2)))).otherwise(F.concat(F.lit("="), coded))


def label_role(label: Column) -> Column:
    plain = F.concat(F.lower(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    coded = F.substr(label, F.lit(2))
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), ("%", "%25")):
        coded = F.replace(coded, F.lit(code), F.lit(raw))
    return F.when(label.startswith("="), coded).otherwise(plain)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"\\(\\*)" + CONTROL, "$1$2")


def refused(body: Column) -> Column:
    return body.rlike(r"(?<!\\)" + CONTROL)


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), role_label(role), F.lit(MID), body, F.lit(END))


def parse_turn(piece: Column) -> Column:
    """struct(role, text, at, length) of what stands before a turn's end; text is null where the parser refuses."""
    label_end = F.instr(piece, MID)
    label = F.substr(piece, F.lit(len(HEAD) + 1), label_end - len(HEAD) - 1)
    at = label_end + len(MID)
    body = F.substr(piece, at)
    return F.struct(label_role(label).alias("role"), F.when(refused(body) | (label_end <= len(HEAD)), None).otherwise(unescape(body)).alias("text"), (at - 1).cast("long").alias("at"), F.char_length(body).cast("long").alias("length"))


def pieces(formatted: Column) -> Column:
    """What stands before each turn's end; split leaves one empty piece after the last."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def returns(rendered: Column, role: Column, text: Column) -> Column:
    back = F.transform(pieces(rendered), parse_turn)
    first = F.get(back, F.lit(0))
    return (F.size(back) == 1) & first["role"].eqNullSafe(role) & first["text"].eqNullSafe(text)


def body_of(role: Column, text: Column) -> Column:
    """Verbatim where that comes back identical, else escaped where that does, else null."""
    quoted = escape(text)
    return F.when(returns(render(role, text), role, text), text).when(returns(render(role, quoted), role, text), quoted)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv, formatted, turns (parsed back), loss_spans (start, length in formatted)."""
    src = turns.select(F.col(conv), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy(conv).orderBy("turn", "role", "text")
    src = src.withColumn("rank", F.row_number().over(order)).withColumn("body", body_of(F.col("role"), F.col("text")))
    each = F.sort_array(F.collect_list(F.struct("rank", "role", "text", "body")))
    convs = src.groupBy(conv).agg(each.alias("src"))
    convs = convs.select(conv, "src", F.array_join(F.transform("src", lambda t: render(t["role"], t["body"])), "").alias("formatted"))
    convs = convs.withColumn("parsed", F.transform(pieces(F.col("formatted")), parse_turn)).withColumn("lengths", F.transform(pieces(F.col("formatted")), lambda p: F.char_length(p).cast("long")))
    same = F.transform("parsed", lambda t: F.struct(t["role"], t["text"])) == F.transform("src", lambda t: F.struct(t["role"], t["text"]))
    failed = F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col(conv).cast("string"), F.lit("null")))).cast("string")
    zero = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    walked = F.aggregate(
        F.arrays_zip("parsed", "lengths"), zero,
        lambda s, t: F.struct((s["next"] + t["lengths"] + len(END)).alias("next"), F.when(t["parsed"]["role"] == learned, F.concat(s["spans"], F.array(F.struct((s["next"] + t["parsed"]["at"]).alias("start"), t["parsed"]["length"].alias("length"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"],
    )
    return convs.select(F.col(conv), F.when(same, F.col("formatted")).otherwise(failed).alias("formatted"), F.col("parsed").alias("turns"), walked.alias("loss_spans"))


def digest_columns(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What op1 returns, read from formatted by its turn ends and from the mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.select(
        F.col(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold the template's own control strings.
HARD = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return digest_columns(format_chats(rows.unionByName(hard)))


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {
    "op1_chat_format": r"""
    WITH src AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    r AS (
      SELECT *, length(regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g')) + 15
        + CASE WHEN regexp_full_match(role, '[a-z][a-z_]*') THEN length(role)
               ELSE 1 + length(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A'), chr(13), '%0D')) END AS chars
      FROM src),
    g AS (
      SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
      FROM r GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """
}

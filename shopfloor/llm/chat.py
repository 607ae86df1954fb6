r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one training example: all preceding turns are its
context, and only the reply is trainable. Turns after the last assistant turn
(or of a conversation without one) form a last example without a target, so
the output holds the whole conversation.

Template: ``<s>[INST]text[/INST]</s>`` (user), ``<s>[SYS]text[/SYS]</s>``
(system), ``<s>text</s>`` (assistant), ``<s>[ROLE:hex]text</s>`` (any other
role; ``[ROLE-]`` for a null one). Inside texts a backslash is doubled and the
control strings are written ``\s \/s \I \/I \Y \/Y \R``, which is reversible
and leaves no control string in a text.

Defined cases: a null text is empty; rows that repeat a (conv_id, turn) are
kept in the order of role and text, nulls first; a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are not
read. One conversation's turns are gathered in one row, because the formatted
conversation is one string by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import common

CONTROLS = [("<s>", r"\s"), ("</s>", r"\/s"), ("[INST]", r"\I"), ("[/INST]", r"\/I"),
            ("[SYS]", r"\Y"), ("[/SYS]", r"\/Y"), ("[ROLE", r"\R")]


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(c: Column) -> Column:
    c = _replace(c, "\\", "\\\\")
    for control, code in CONTROLS:
        c = _replace(c, control, code)
    return c


def unescaped(c: Column) -> Column:
    """Doubled backslashes split the text into pieces whose single backslashes
    all begin a code."""
    def decode(piece: Column) -> Column:
        for control, code in CONTROLS:
            piece = _replace(piece, code, control)
        return piece
    return F.array_join(F.transform(F.split(c, r"\\\\"), decode), "\\")


def _body(role: Column, text: Column) -> Column:
    e = escaped(text)
    return (F.when(role == "assistant", e)
            .when(role == "user", F.concat(F.lit("[INST]"), e, F.lit("[/INST]")))
            .when(role == "system", F.concat(F.lit("[SYS]"), e, F.lit("[/SYS]")))
            .otherwise(F.concat(F.coalesce(F.concat(F.lit("[ROLE:"), F.hex(F.encode(role, "UTF-8"))), F.lit("[ROLE-")),
                                F.lit("]"), e)))


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), n_context, formatted, loss_start and
    loss_length (the trainable characters of ``formatted``; length -1: no target)."""
    turn = F.struct("turn", "role", common.text_or_empty().alias("text"))
    t = (conversations.select("conv_id", turn.alias("t"))
         .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
         .select("conv_id",
                 F.transform("turns", lambda x: F.concat(F.lit("<s>"), _body(x["role"], x["text"]),
                                                         F.lit("</s>"))).alias("formatted"),
                 F.transform("turns", lambda x: F.coalesce(x["role"] == "assistant", F.lit(False))).alias("reply")))
    last = F.size("reply")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("reply", i) | (i == last))
    e = t.select("conv_id", "formatted", "reply", F.posexplode(ends).alias("example", "end"))
    context = F.array_join(F.slice("formatted", F.lit(1), F.col("end") - 1), "")
    own = F.element_at("formatted", F.col("end"))
    is_reply = F.element_at("reply", F.col("end"))
    return e.select(
        "conv_id", "example", (F.col("end") - F.when(is_reply, 1).otherwise(0)).alias("n_context"),
        F.concat(context, own).alias("formatted"),
        F.when(is_reply, F.char_length(context) + 3).otherwise(0).alias("loss_start"),
        F.when(is_reply, F.char_length(own) - 7).otherwise(-1).alias("loss_length"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text)."""
    def turn(piece: Column) -> Column:
        body = F.substring(piece, 4, 2147483647)
        other = F.regexp_extract(body, r"^\[ROLE:([0-9A-F]*)\]", 1)
        role = (F.when(body.startswith("[INST]"), "user").when(body.startswith("[SYS]"), "system")
                .when(body.startswith("[ROLE-]"), F.lit(None).cast("string"))
                .when(body.startswith("[ROLE:"), F.decode(F.unhex(other), "UTF-8")).otherwise("assistant"))
        size = F.char_length(body)
        text = (F.when(body.startswith("[INST]"), body.substr(F.lit(7), size - 13))
                .when(body.startswith("[SYS]"), body.substr(F.lit(6), size - 11))
                .when(body.startswith("[ROLE-]"), body.substr(F.lit(8), size))
                .when(body.startswith("[ROLE:"), body.substr(F.char_length(other) + 8, size)).otherwise(body))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))
    pieces = F.split(formatted, "</s>")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the examples alone."""
    target = F.when(F.col("loss_length") >= 0,
                    unescaped(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_length"))))
    conv = examples.select("conv_id", "example", "formatted", target.alias("target")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "target"))),
                                 lambda x: F.coalesce(x["target"], F.lit(""))), "").alias("loss"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"))
    turns = conv.select("conv_id", "loss", "formatted_chars", parsed(F.col("whole")).alias("turns"))
    line = F.transform("turns", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"],
                                                   F.lit("\n")))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
                        F.char_length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose two turns consist of control strings."""
    rows = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(expand(with_control_conversation(common.table(spark, sf_dir, "conversations"))))


def _sql_escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for control, code in CONTROLS:
        c = f"replace({c}, '{control}', '{code}')"
    return c


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, 7 + length({_sql_escaped('text')}) + CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 13
    WHEN 'system' THEN 11 ELSE 7 + coalesce(2 * strlen(role), 0) END AS chars,
    coalesce(role = 'assistant', false) AS reply,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE reply), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE reply), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE reply OR k = n) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""

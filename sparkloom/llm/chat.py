"""Perspective rotation of multi-party dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as assistant, the others as
named users, and a mask that trains on the assistant's words alone. A system turn is shown in every perspective and is
nobody's perspective. The result has a row for each conversation, perspective and turn: its segment of the rendered
dialogue and the span of the segment that is trained on. In order of (turn, speaker, segment), the segments of one
perspective are the dialogue; rows are not collected by conversation, since one may hold a large share of all rows.

Participants are found by a distinct with partial aggregation; the inner join that multiplies turns by perspectives is
one whose skewed partitions Spark splits.

Defined cases: a null or blank role is the speaker ``unknown``; a null text is empty; a null conversation id is a
conversation of its own; a conversation of system turns alone has no perspective and no rows; repeated and tied turns
are rendered each; control tokens inside texts and names are escaped, and line ends in names become spaces; texts of any
length are rendered whole; an empty table gives an empty result; further columns pass through, and the new one takes a
free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import free_name, read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a perspective that are put together in one row at most.
TURNS = 1_000


def escaped(text: Column) -> Column:
    """Control tokens that a text or name spells out, with a space inside, so that they can't forge a turn."""
    for token in (START, END):
        text = F.replace(text, F.lit(token), F.lit(token.replace("<|", "< |")))
    return text


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """``turns`` once for each perspective, with a struct column ``chat``.

    Its fields: perspective, role, name, segment, train, train_start and train_end, the span in characters of the
    segment that counts for the loss (empty unless ``train``).
    """
    who, at, view, out = (free_name(turns, x) for x in ("_who", "_conv", "_view", "chat"))
    # A name is one line of a header.
    line = F.trim(F.regexp_replace(escaped(F.col(f"`{speaker}`")), r"[\r\n]+", " "))
    named = turns.withColumn(who, F.coalesce(F.nullif(line, F.lit("")), F.lit("unknown")))
    people = (
        named.where(F.col(who) != "system")
        .select(F.col(f"`{conv}`").alias(at), F.col(who).alias(view))
        .distinct()
    )
    rows = named.join(people, F.col(f"`{conv}`").eqNullSafe(F.col(f"`{at}`")))
    own = F.col(who) == F.col(view)
    role = F.when(F.col(who) == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col(who))
    header = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    segment = F.concat(header, F.coalesce(escaped(F.col(f"`{text}`")), F.lit("")), F.lit(END + "\n"))
    return rows.select(
        *[F.col(f"`{c}`") for c in turns.columns],
        F.struct(
            F.col(view).alias("perspective"),
            role.alias("role"),
            name.alias("name"),
            segment.alias("segment"),
            own.alias("train"),
            F.when(own, F.length(header)).otherwise(0).alias("train_start"),
            F.when(own, F.length(segment) - 1).otherwise(0).alias("train_end"),
        ).alias(out),
    )


def assembled(
    rotated: DataFrame, conv: str = "conv_id", turn: str = "turn", chat: str = "chat", turns: int = TURNS
) -> DataFrame:
    """(conversation, perspective, part, n_turns, dialogue, spans): the rendered dialogue and its mask.

    Segments stand in order of (turn, name, segment); ``spans`` are the (start, end) characters of the dialogue that
    count for the loss. A dialogue of more than ``turns`` turns comes in several parts, so that no row grows without
    bound; turns are numbered over ranges of all conversations, not in one task for each.
    """
    c = F.col(f"`{chat}`")
    rows = rotated.select(
        F.col(f"`{conv}`").alias("conversation"), c["perspective"].alias("perspective"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(c["name"], F.lit("")).alias("name"), c["segment"].alias("segment"), c["train"].alias("train"),
        c["train_start"].alias("train_start"), c["train_end"].alias("train_end"),
    )
    # Equal segments of one turn may change places: the dialogue stays the same.
    k = numbered(rows, ["conversation", "perspective"], ["turn", "name", "segment"], "k")
    part = k.groupBy("conversation", "perspective", F.floor(F.col("k") / turns).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("k", "segment", "train", "train_start", "train_end"))).alias("s")
    )
    size = lambda s: F.length(s["segment"])
    ends = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + size(s)).alias("at"),
            F.when(
                s["train"],
                F.array_append(
                    a["spans"],
                    F.struct((a["at"] + s["train_start"]).alias("start"), (a["at"] + s["train_end"]).alias("end")),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return part.select(
        "conversation", "perspective", "part", F.size("s").alias("n_turns"),
        F.array_join(F.transform("s", lambda s: s["segment"]), "").alias("dialogue"), ends["spans"].alias("spans"),
    )


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")
    rotated = rotate_perspectives(turns, speaker="speaker")
    names = ("perspective", "role", "name", "segment", "train", "train_start", "train_end")
    return rotated.select("conv_id", "turn", *[F.col("chat")[c].alias(c) for c in names])


def escaped_sql(column: str) -> str:
    for token in (START, END):
        column = f"replace({column}, '{token}', '{token.replace('<|', '< |')}')"
    return column


SQL = f"""
WITH t AS (SELECT conv_id, turn,
             coalesce(nullif(trim(regexp_replace({escaped_sql("role")}, '[\\r\\n]+', ' ', 'g'), ' '), ''), 'unknown') AS who,
             coalesce({escaped_sql("text")}, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
r AS (SELECT t.conv_id, turn, perspective, text, who = perspective AS train,
        CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN who NOT IN ('system', perspective) THEN who END AS name
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '{START}' || role || coalesce(' name=' || name, '') || chr(10) AS header FROM r)
SELECT conv_id, turn, perspective, role, name, header || text || '{END}' || chr(10) AS segment, train,
    CASE WHEN train THEN length(header) ELSE 0 END::INT AS train_start,
    CASE WHEN train THEN length(header || text || '{END}') ELSE 0 END::INT AS train_end
FROM h
"""

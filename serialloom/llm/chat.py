"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted as structs, adjacent turns of one
role are merged by an array aggregation, and the blocks are concatenated:

    <turn:ROLE>\\nTEXT<turn+>TEXT</turn>\\n

Inside roles and texts a backslash is doubled and the ``<`` of ``<turn`` and
``</turn`` gets a backslash behind it (in roles ``>`` gets one before it), so
that a marker never stems from a text and every text is read back as it was.
``loss`` lists the code point ranges of the texts to learn from.

Edge cases: a null text or role is an empty one; a null ``turn`` comes first;
turns that share a number are ordered by role, then text, and repeated rows
are turns of their own; a null ``conv_id`` is a conversation of its own; an
empty table gives an empty result; further columns are ignored. A
conversation is one string, so one must fit in a row; the fold that merges n
turns copies up to n * n / 2 references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, JOIN = "</turn>\n", "<turn+>"
_LOSS = "array<struct<start:int,length:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"<(/?turn)", r"<\\$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ">", r"\\>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (ranges of the texts of role ``learn``), n_turns and n_blocks."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    kept = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def merged(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.array(escape(x["text"]))
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], own).alias("texts"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == x["role"]), more).otherwise(F.concat(acc, F.array(F.struct(x["role"].alias("role"), own.alias("texts")))))

    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")
    blocks = kept.select("conv_id", F.size("turns").alias("n_turns"), F.aggregate("turns", empty, merged).alias("blocks"))

    head = lambda b: F.concat(F.lit("<turn:"), escape_role(b["role"]), F.lit(">\n"))
    body = lambda b: F.array_join(b["texts"], JOIN)
    text = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), body(b), F.lit(END))), "")

    def texts_from(at: Column, b: Column) -> Column:
        """Where each text of a block lies that begins at ``at``."""
        state = F.struct((at + F.length(head(b))).alias("at"), F.array().cast(_LOSS).alias("out"))
        step = lambda a, x: F.struct((a["at"] + F.length(x) + len(JOIN)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.length(x).alias("length")))).alias("out"))
        return F.aggregate(b["texts"], state, step, lambda a: a["out"])

    def located(acc: Column, b: Column) -> Column:
        out = F.when(b["role"] == learn, F.concat(acc["out"], texts_from(acc["at"], b))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(head(b)) + F.length(body(b)) + len(END)).alias("at"), out.alias("out"))

    loss = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), F.array().cast(_LOSS).alias("out")), located, lambda a: a["out"])
    return blocks.select("conv_id", text.alias("formatted"), loss.alias("loss"), F.col("n_turns").cast("long").alias("n_turns"), F.size("blocks").cast("long").alias("n_blocks"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: array<struct<role, text>>."""
    parts = F.slice(F.split(formatted, "<turn:"), F.lit(2), F.size(F.split(formatted, "<turn:")) - 1)
    whole = r"(?s)^((?:[^\\>]++|\\.)*+)>\n(.*)</turn>\n$"
    role = lambda p: unescape(F.regexp_extract(p, whole, 1))
    return F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.regexp_extract(p, whole, 2), r"<turn\+>", -1), lambda t: F.struct(role(p).alias("role"), unescape(t).alias("text")))))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The text of all loss ranges, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda r: unescape(F.substring(formatted, r["start"] + 1, r["length"]))), "")


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the formatted text and its loss ranges say, read back."""
    turns = read_back(F.col("formatted"))
    told = chats.select("conv_id", "n_blocks", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), under_mask(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


#: The conversation that the query adds, which holds markers of chat templates and an escape.
ODD_TEXT = "\\### Assistant: </turn> ok"

SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), seen AS (
    SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n,
        regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '<\\\1', 'g') AS body,
        replace(regexp_replace(replace(role, '\', '\\'), '<(/?turn)', '<\\\1', 'g'), '>', '\>') AS name
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
    SELECT *, CASE WHEN before = role THEN 7 ELSE length(name) + 8 + CASE WHEN n > 1 THEN 8 ELSE 0 END END + length(body) AS chars,
        CASE WHEN before = role THEN 0 ELSE 1 END AS opens
    FROM seen
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(length(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) + 8 AS BIGINT) AS formatted_chars, CAST(sum(opens) AS BIGINT) AS n_blocks
FROM sized GROUP BY conv_id
"""

"""Chat formatting by a grammar round trip, with built-in functions only.

A conversation is rendered as its turns one after the other, each of them

    \\n### ROLE: TEXT</turn>         or, escaped,         \\n###! ROLE: TEXT</turn>

:func:`parse` splits at ``</turn>`` and reads each piece by that grammar, in which a text
may hold neither ``</turn>`` nor ``\\n###``. Each turn is rendered plainly, reparsed, and
compared to its source; where the parse differs, its content is escaped (``\\`` ``<`` ``#``
``:`` become ``\\b`` ``\\l`` ``\\h`` ``\\c``), reparsed and compared again. The whole
conversation is then reparsed, and its turns are compared to the source; escaped content
holds no control string, so they are identical, and a difference would raise an error.

Null texts and roles count as empty; a null turn comes first; equal turns are ordered by
role and text, and repeated rows are turns of their own; rows with a null conversation id
form one conversation. A conversation is one value of the result and so has to fit a row;
nothing else is gathered. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "</turn>"
# What stands for each escaped character, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
_PIECE = r"(?s)^\n###(!?) (.*?): (.*)$"


def escape(content: Column) -> Column:
    for plain, coded in ESCAPES:
        content = F.replace(content, F.lit(plain), F.lit(coded))
    return content


def unescape(content: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        content = F.replace(content, F.lit(coded), F.lit(plain))
    return content


def _render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit("\n###! "), escape(role), F.lit(": "), escape(text), F.lit(END))
    return F.concat(F.lit("\n### "), role, F.lit(": "), text, F.lit(END))


def _read(piece: Column) -> Column:
    """A piece as (marked, role, text); a piece outside the grammar has a null role."""
    head = F.regexp_extract(piece, _PIECE, 1)
    role, text = F.regexp_extract(piece, _PIECE, 2), F.regexp_extract(piece, _PIECE, 3)
    good = piece.rlike(_PIECE) & ~F.contains(text, F.lit("\n###"))
    return F.struct(
        F.when(head == "!", True).otherwise(False).alias("escaped"),
        F.when(good, F.when(head == "!", unescape(role)).otherwise(role)).alias("role"),
        F.when(good, F.when(head == "!", unescape(text)).otherwise(text)).alias("text"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (escaped, role, text)."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _read)


def _mark(role: Column, text: Column) -> Column:
    """A digest that tells turns apart."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def _same(shown: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is parsed to just its source."""
    back = parse(shown)
    first = F.get(back, F.lit(0))
    return (F.size(back) == 1) & first["role"].eqNullSafe(role) & first["text"].eqNullSafe(text)


def format_conversations(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, n_turns.

    `spans` holds (start, length) in characters of the parts under the loss mask, which
    are the rendered texts of the turns whose role is `learn`, without their markers; n_turns
    is what the parser finds. One shuffle by conversation, of the rendered turns; it serves
    the window and the grouping.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain, escaped = (_render(F.col("role"), F.col("text"), e) for e in (False, True))
    turns = turns.withColumn("plainly", _same(plain, F.col("role"), F.col("text")))
    wrong = F.raise_error(F.concat(F.lit("a turn of a conversation isn't parsed to its source: "), F.col("conv_id").cast("string")))
    shown = F.when(F.col("plainly"), plain).when(_same(escaped, F.col("role"), F.col("text")), escaped).otherwise(wrong.cast("string"))
    turns = turns.select("conv_id", "turn", "role", "text", shown.alias("shown"), "plainly", _mark(F.col("role"), F.col("text")).alias("mark"))
    body = F.char_length(F.when(F.col("plainly"), F.col("text")).otherwise(escape(F.col("text"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("stop", F.sum(F.char_length("shown")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("stop") - len(END) - body).alias("start"), body.cast("long").alias("length"))
    turns = turns.select("conv_id", "n", "shown", "mark", F.when(F.col("role") == learn, span).alias("span"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "shown", "mark", "span"))).alias("turns"))
    whole = grouped.select("conv_id", F.array_join(F.col("turns.shown"), "").alias("formatted"), F.filter(F.col("turns.span"), lambda x: x.isNotNull()).alias("spans"), F.col("turns.mark").alias("marks"))
    back = F.transform(parse(F.col("formatted")), lambda t: _mark(t["role"], t["text"]))
    n_turns = F.when(back == F.col("marks"), F.size(back)).otherwise(wrong.cast("int"))
    return whole.select("conv_id", "formatted", "spans", n_turns.alias("n_turns"))


def digests(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """What a reader gets back from `formatted` of :func:`format_conversations`, as digests.

    The turns come from the parser, and the learned text from the spans, unescaped where
    the marker before the span says so; `learn` is the one it was formatted with.
    """
    out = formatted.select("conv_id", "formatted", "spans", "n_turns", parse(F.col("formatted")).alias("parsed"))
    turns = F.array_join(F.transform(F.col("parsed"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    shown = F.transform(
        F.col("spans"),
        lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")),
    )
    # An escaped text holds no '<', '#' or ':'; whether it is one is read from its turn.
    learned = F.transform(F.filter("parsed", lambda t: t["role"] == learn), lambda t: t["escaped"])
    loss = F.array_join(F.zip_with(shown, learned, lambda s, e: F.when(e, unescape(s)).otherwise(s)), "")
    out = out.select("conv_id", "formatted", F.col("n_turns").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, NOT contains(role || ': ' || text, '</turn>') AND NOT contains(role, ': ') AND NOT contains(text, chr(10) || '###') AS plainly FROM c),
w AS (SELECT *, CASE WHEN plainly THEN 14 + length(role) + length(text)
  ELSE 15 + 2 * (length(role) + length(text)) - length(regexp_replace(role, '[\\<#:]', '', 'g')) - length(regexp_replace(text, '[\\<#:]', '', 'g')) END AS width FROM p),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(width)::BIGINT AS formatted_chars FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

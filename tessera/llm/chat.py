"""Chat formatting with Spark expressions only.

Turns are sorted, adjacent turns of one role are merged into a block, and blocks are concatenated:

    ### role: text<sep/>text</turn>

Inside roles and texts the characters that control strings are made of are escaped, so a control string
can't occur there: \\ as \\s, # as \\h, < as \\l and, in roles, : as \\c. Undoing the
last three before the first gives the original back.

Segments carry the loss mask: (text, loss) pairs whose texts concatenate to the formatted string; the mask
covers assistant texts and nothing between them. A conversation is one output string, so its turns are
gathered by conversation, as structs in an array that is sorted; the places where the role changes cut it into
blocks. Each step is linear in the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.operators.stats import computed_once

OPEN, COLON, BETWEEN, CLOSE = "### ", ": ", "<sep/>", "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for raw, safe in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), *((":", "\\c"),) * role):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\s")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments) from turns (conv_id, turn, role, text).

    Null roles and texts count as empty. Turns with one number follow the order of role and text. Null turns come
    first; rows without conv_id form one conversation. Other columns are ignored; an empty table gives none.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # each array is a column of its own, computed once a conversation and not once an element
    changes = lambda i: (i == 1) | (F.get("turns", i - 1).role != F.get("turns", i - 2).role)
    cut = computed_once(sorted_, F.col("conv_id"), F.col("turns"), F.filter(F.sequence(F.lit(1), F.size("turns")), changes).alias("starts"))

    def block(start: Column, k: Column) -> Column:
        """Turns of one role that follow each other."""
        size = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - start
        return F.struct(F.get("turns", start - 1).role.alias("role"), F.transform(F.slice("turns", start, size), lambda t: t.text).alias("texts"))

    merged = computed_once(cut, F.col("conv_id"), F.transform("starts", block).alias("blocks"))

    def segments(b: Column, k: Column) -> Column:
        head = F.concat(F.when(k > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(b.role, role=True), F.lit(COLON))
        lead = lambda j: F.struct(F.when(j == 0, head).otherwise(F.lit(BETWEEN)).alias("text"), F.lit(False).alias("loss"))
        return F.flatten(F.transform(b.texts, lambda t, j: F.array(lead(j), F.struct(escape(t).alias("text"), (b.role == TRAINED_ROLE).alias("loss")))))

    pairs = F.flatten(F.transform("blocks", segments))
    last = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    chats = computed_once(merged, F.col("conv_id"), F.concat(pairs, last).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def parse_turns(formatted: Column) -> Column:
    """The turns, as an array of (role, text), of a formatted conversation."""
    blocks = F.split(F.substring(formatted, 1, F.length(formatted) - F.lit(len(CLOSE))), CLOSE, -1)

    def of_block(block: Column) -> Column:
        role = unescape(F.substring(F.substring_index(block, COLON, 1), F.lit(len(OPEN) + 1), F.length(block)))
        body = F.substring(block, F.length(F.substring_index(block, COLON, 1)) + F.lit(len(COLON) + 1), F.length(block))
        return F.transform(F.split(body, BETWEEN, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings, and reads turns and loss text back. An empty table gives that one alone."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations")
    turns = turns.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in extra.schema]).union(extra)
    back = format_chats(turns).select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    # the same output by string functions over rows; chr() keeps control characters out of the SQL text
    esc = r"replace(replace(replace({0}, '\', '\s'), '#', '\h'), '<', '\l')"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS prev FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length({esc.format("text")})
    + CASE WHEN prev IS NOT NULL AND prev = role THEN {len(BETWEEN)}
      ELSE {len(OPEN) + len(COLON) + len(CLOSE)} + length(replace({esc.format("role")}, ':', '\c')) END AS chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


SQL = _sql()

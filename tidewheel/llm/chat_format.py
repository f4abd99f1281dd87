"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows in each conversation is
rendered as its completion, with the character spans that a loss may see: assistant turns with their end
marker. Everything else of a completion, and the whole prompt, is masked.

Turns are ordered by turn, then role, then text. A null role is ``unknown``, a null text is empty; turns
without a conversation id belong to none; repeated turns are turns each. Two equal conversations give two empty
completions, a null one has no turns. Repeated pairs are formatted alike, an empty table gives an empty one. A
conversation is one row, however long its texts. Input columns named like an added one are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def conversations(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``(id, turns)``: one row per conversation, its turns in order as (role, text)."""
    rows = turns.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"),
        F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("id").agg(ordered.alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def trainable(turns: Column) -> Column:
    """Character spans of assistant turns in the rendering of ``turns``."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), add, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn lists."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(first == 0, F.size(a)).otherwise((first - 1).cast("int"))


#: Columns that ``preference_format`` adds.
ADDED = ("prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with prompt_turns, prompt, and of both sides the completion and its trainable spans.

    ``chosen`` and ``rejected`` are turn lists as ``conversations`` gives them; both are replaced.
    """
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *ADDED)]
    none = F.array().cast(pairs.schema[chosen].dataType.simpleString())
    # the caller's columns travel in one struct, so that none clashes with a name used here
    sides = pairs.select(
        F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.col(f"`{chosen}`"), none).alias("c"),
        F.coalesce(F.col(f"`{rejected}`"), none).alias("r"),
    )
    n = F.col("n")

    def rest(side: str) -> Column:
        return F.slice(F.col(side), n + 1, F.greatest(F.size(side) - n, F.lit(0)))

    cut = sides.withColumn("n", common_turns(F.col("c"), F.col("r"))).select("row", "n", F.slice("c", F.lit(1), n).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        n.alias("prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        trainable(F.col("c")).alias("chosen_spans"),
        render(F.col("r")).alias("rejected"),
        trainable(F.col("r")).alias("rejected_spans"),
    )


def swapped_replies(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``(id, chosen, rejected)``: each conversation that has a reply, against itself with another's last reply.

    The other is its neighbour (ids 2k and 2k + 1); where that has no reply, the reply is left out.
    """
    whole = conversations(turns, id_column)
    is_reply = F.transform("turns", lambda t: t["role"] == "assistant")
    last = F.size("turns") - F.array_position(F.reverse(is_reply), True).cast("int") + 1
    found = whole.filter(F.array_contains(is_reply, True)).withColumn("last", last)
    given = found.select((F.col("id") + 1 - 2 * F.pmod("id", F.lit(2))).alias("id"), F.get("turns", F.col("last") - 1).alias("other"))
    joined = found.join(given, "id", "left")
    head = F.slice("turns", F.lit(1), F.col("last") - 1)
    tail = F.slice("turns", F.col("last") + 1, F.size("turns") - F.col("last"))
    return joined.select(
        "id",
        F.col("turns").alias("chosen"),
        F.when(F.col("other").isNull(), F.concat(head, tail)).otherwise(F.concat(head, F.array("other"), tail)).alias("rejected"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(i) AS i FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT t.conv_id + 1 - 2 * (((t.conv_id % 2) + 2) % 2) AS conv_id, t.text FROM t JOIN last USING (conv_id, i)),
chosen AS (SELECT t.* FROM t JOIN last USING (conv_id)),
kept AS (
  SELECT t.conv_id, t.i AS old_i, t.role, CASE WHEN t.i = last.i THEN reply.text ELSE t.text END AS text
  FROM t JOIN last USING (conv_id) LEFT JOIN reply USING (conv_id) WHERE t.i <> last.i OR reply.conv_id IS NOT NULL),
rejected AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY old_i) AS i, role, text FROM kept),
differ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.i, r.i)) AS i FROM chosen c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.i = r.i
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
prefix AS (SELECT c.conv_id, coalesce(any_value(differ.i) - 1, count(*)) AS n FROM chosen c LEFT JOIN differ USING (conv_id) GROUP BY c.conv_id),
c AS (
  SELECT conv_id, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i <= n), '') AS prompt,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > n), '') AS chosen,
    coalesce(sum(length(text) + 7) FILTER (i > n AND role = 'assistant'), 0)::BIGINT AS chosen_trainable, any_value(n)::INTEGER AS prompt_turns
  FROM chosen JOIN prefix USING (conv_id) GROUP BY conv_id),
r AS (
  SELECT conv_id, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > n), '') AS rejected,
    coalesce(sum(length(text) + 7) FILTER (i > n AND role = 'assistant'), 0)::BIGINT AS rejected_trainable
  FROM rejected JOIN prefix USING (conv_id) GROUP BY conv_id)
SELECT conv_id, prompt_turns, prompt, chosen, chosen_trainable, coalesce(rejected, '') AS rejected, coalesce(rejected_trainable, 0) AS rejected_trainable
FROM c LEFT JOIN r USING (conv_id)
"""

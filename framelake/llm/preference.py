"""Preference formatting of chat pairs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
RESULTS = ("n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns as an array of (role, text) in order.

    Exactly repeated rows count once; turns of one number stand in order of role and text; a
    row without conv_id belongs to no conversation. A conversation is one training record
    and is assembled whole.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return found.select("conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share; null equals null."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)


def _rendered(turn: Column) -> Column:
    head = F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))
    return F.concat(head, F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _rendered))


def mask(turns: Column) -> Column:
    """Spans start:end (code points of the rendered turns) on which a model is trained:
    what the assistant says, with its end marker, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        role = F.length(F.coalesce(turn["role"], F.lit("unknown"))) + 5
        end = acc["at"] + F.length(_rendered(turn))
        span = F.concat_ws(":", (acc["at"] + role).cast("string"), (end - 1).cast("string"))
        spans = F.when(turn["role"].eqNullSafe(F.lit("assistant")), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with its two arrays of turns replaced by n_prompt_turns, prompt, chosen,
    chosen_mask, rejected, rejected_mask.

    The longest common turn prefix is the prompt, rendered once; what follows in each is its
    completion, with the spans to train on. Equal conversations leave two empty
    completions. Another column that bears the name of a result comes back as pair_<name>. A missing (null) rejected side: the last turn is the completion, the rest
    the prompt, and rejected and its mask are null. A null chosen side gives nulls.
    """
    a, b = F.col(f"`{chosen}`"), F.col(f"`{rejected}`")
    n = F.when(b.isNull(), F.greatest(F.size(a) - 1, F.lit(0))).otherwise(common_prefix(a, b))
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    df = pairs.withColumn("__n", F.when(a.isNotNull(), n))
    after = lambda x: F.slice(x, F.col("__n") + 1, F.greatest(F.size(x) - F.col("__n"), F.lit(0)))
    return df.select(
        *[F.col(f"`{c}`").alias(f"pair_{c}" if c in RESULTS else c) for c in rest], F.col("__n").alias("n_prompt_turns"),
        F.when(a.isNotNull(), render(F.slice(a, F.lit(1), F.col("__n")))).alias("prompt"),
        F.when(a.isNotNull(), render(after(a))).alias("chosen"), mask(after(a)).alias("chosen_mask"),
        F.when(b.isNotNull(), render(after(b))).alias("rejected"), mask(after(b)).alias("rejected_mask"),
    )


def pair_by_first_turn(conversations: DataFrame) -> DataFrame:
    """Pairs (chosen_id, chosen, rejected_id, rejected) of conversations that open alike.

    The conversation of the smallest id is preferred over each of the others with the same first
    turn; one that opens like no other stands alone, with a null rejected side. Pairs grow
    with the conversations. An opening may be that of a third of all conversations, so the preferred
    side is dealt to SALTS places.
    """
    opening = F.xxhash64(F.element_at("turns", 1)["role"], F.element_at("turns", 1)["text"])
    convs = conversations.withColumn("opening", opening)
    heads = convs.groupBy("opening").agg(F.min("conv_id").alias("head"), F.count("*").alias("n"))
    several = heads.where("n > 1")
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # 64 bits name the opening; that it is the same is checked on the turns themselves
    first = convs.join(several.select(F.col("head").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("head"), F.col("turns").alias("chosen"))
    salted = salted.join(first, "head").select("opening", "salt", "head", "chosen")
    keyed = convs.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(salted, ["opening", "salt"], "left")
    same = F.element_at("turns", 1).eqNullSafe(F.try_element_at("chosen", F.lit(1)))
    paired = F.col("head").isNotNull() & same
    return joined.where(~F.coalesce(F.col("head") == F.col("conv_id"), F.lit(False))).select(
        F.when(paired, F.col("head")).otherwise(F.col("conv_id")).alias("chosen_id"),
        F.when(paired, F.col("chosen")).otherwise(F.col("turns")).alias("chosen"),
        F.when(paired, F.col("conv_id")).alias("rejected_id"),
        F.when(paired, F.col("turns")).alias("rejected"),
    )


ORACLE = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM d),
r AS (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS body,
        length(coalesce(role, 'unknown')) + 5 AS head FROM t),
n AS (SELECT conv_id, CAST(max(pos) AS INTEGER) AS n FROM t GROUP BY conv_id),
f AS (SELECT t.conv_id, min(t.conv_id) OVER (PARTITION BY role, text) AS first_id, count(*) OVER (PARTITION BY role, text) AS m FROM t WHERE pos = 1),
p AS (SELECT CASE WHEN m > 1 THEN first_id ELSE conv_id END AS chosen_id, CASE WHEN m > 1 THEN conv_id END AS rejected_id
      FROM f WHERE m = 1 OR conv_id <> first_id),
x AS (SELECT p.chosen_id, p.rejected_id, min(a.pos) AS differ
      FROM p JOIN t a ON a.conv_id = p.chosen_id JOIN t b ON b.conv_id = p.rejected_id AND a.pos = b.pos
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY ALL),
q AS (SELECT p.*, CAST(CASE WHEN p.rejected_id IS NULL THEN na.n - 1 ELSE coalesce(x.differ - 1, least(na.n, nb.n)) END AS INTEGER) AS n_prompt_turns
      FROM p JOIN n na ON na.conv_id = p.chosen_id LEFT JOIN n nb ON nb.conv_id = p.rejected_id
      LEFT JOIN x ON x.chosen_id = p.chosen_id AND x.rejected_id = p.rejected_id),
c AS (SELECT q.chosen_id, q.rejected_id, q.n_prompt_turns, r.pos, r.body, r.role, r.head,
        coalesce(sum(length(body)) FILTER (r.pos > q.n_prompt_turns) OVER (PARTITION BY q.chosen_id, q.rejected_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
      FROM q JOIN r ON r.conv_id = q.chosen_id),
e AS (SELECT q.chosen_id, q.rejected_id, q.n_prompt_turns, r.pos, r.body, r.role, r.head,
        coalesce(sum(length(body)) FILTER (r.pos > q.n_prompt_turns) OVER (PARTITION BY q.chosen_id, q.rejected_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
      FROM q JOIN r ON r.conv_id = q.rejected_id),
ca AS (SELECT chosen_id, rejected_id, any_value(n_prompt_turns) AS n_prompt_turns,
        coalesce(string_agg(body, '' ORDER BY pos) FILTER (pos <= n_prompt_turns), '') AS prompt,
        coalesce(string_agg(body, '' ORDER BY pos) FILTER (pos > n_prompt_turns), '') AS chosen,
        coalesce(string_agg(CAST(begins + head AS BIGINT) || ':' || CAST(begins + length(body) - 1 AS BIGINT), ',' ORDER BY pos) FILTER (pos > n_prompt_turns AND role = 'assistant'), '') AS chosen_mask
       FROM c GROUP BY chosen_id, rejected_id),
ea AS (SELECT chosen_id, rejected_id,
        coalesce(string_agg(body, '' ORDER BY pos) FILTER (pos > n_prompt_turns), '') AS rejected,
        coalesce(string_agg(CAST(begins + head AS BIGINT) || ':' || CAST(begins + length(body) - 1 AS BIGINT), ',' ORDER BY pos) FILTER (pos > n_prompt_turns AND role = 'assistant'), '') AS rejected_mask
       FROM e GROUP BY chosen_id, rejected_id)
SELECT ca.chosen_id, ca.rejected_id, ca.n_prompt_turns, ca.prompt, ca.chosen, ca.chosen_mask, ea.rejected, ea.rejected_mask
FROM ca LEFT JOIN ea ON ca.chosen_id = ea.chosen_id AND ca.rejected_id = ea.rejected_id
"""

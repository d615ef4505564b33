"""Chat formatting by rotation of perspective.

For every participant of a conversation the whole dialogue is rendered once
with that speaker as the assistant, everyone else as a named user and system
messages as they are, with the spans of the assistant's words: the only ones to
be learnt.

A dialogue is one row for each participant, whatever its length.  Who wants
bounded rows sets ``part``: parts of that many turns, each with the ``context``
turns before it, which are rendered and not learnt.

Defined cases: turns are ordered by number (null first), then role, then text;
rows repeated in all four columns count once.  A null role is the participant
``unknown``; a null text is empty.  Marker brackets within texts and roles are
broken up and line breaks in roles are spaces, so that none can pose as a turn;
roles that are equal then are one participant.  A conversation with only system
messages has no participant and no row.  A null conversation id is a
conversation of its own.  Other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, ASSISTANT = "system", "<|assistant|>\n"


def safe(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(
    turns: DataFrame, part: int | None = None, context: int = 0, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, participant, part, n_turns, text, assistant_spans,
    n_assistant_chars``: a row for each participant (and part, else 0).

    ``assistant_spans`` are ``start-end`` in characters of ``text``, joined by
    commas; each covers a message of the participant and its end marker.
    A message's place is that with every speaker named, moved by what the
    participant's own messages before it are shorter or longer: so places are
    sums over a dialogue and do not depend on the number of participants.
    """
    role = F.regexp_replace(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), r"[\r\n]+", " ")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        safe(role).alias("role"),
        safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"),
    ).distinct()
    order = [F.col("turn").asc_nulls_first(), "role", "body"]
    rows = rows.withColumn("own", F.lit(True)).withColumn("part", F.lit(0).cast("long"))
    if part:
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)
        home = F.floor(F.col("at") / part)
        later = F.when(F.col("at") >= (home + 1) * part - context, F.array(home, home + 1)).otherwise(F.array(home))
        last = F.floor((F.count(F.lit(1)).over(Window.partitionBy("conv_id")) - 1) / part)
        rows = rows.withColumn("last", last).withColumn("home", home).withColumn("part", F.explode(later)).where("part <= last").withColumn("own", F.col("part") == F.col("home"))
    system = F.col("role") == SYSTEM
    rows = rows.withColumn("head", F.when(system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))).withColumn("tail", F.concat("body", F.lit("<|end|>\n")))
    dialogue = Window.partitionBy("conv_id", "part").orderBy(*order)
    own = Window.partitionBy("conv_id", "part", "role").orderBy(*order)
    shift = F.lit(len(ASSISTANT)) - F.length("head")
    # As assistant, the participant's own turns up to this one have another head.
    past = F.sum((F.length("head") + F.length("tail")).cast("long")).over(dialogue) + shift * F.row_number().over(own)
    rows = rows.withColumn("nth", F.row_number().over(dialogue)).withColumn("past", past)
    whole = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "own", "head", "tail"))).alias("turns"))
    size = F.length("tail").cast("long")
    span = F.when(F.col("own"), F.struct((F.col("past") - size).alias("begin"), F.col("past").alias("end")))
    people = rows.where(~system).groupBy(F.col("conv_id").alias("conv"), F.col("part").alias("piece"), F.col("role").alias("participant"))
    people = people.agg(F.array_sort(F.collect_list(span)).alias("spans"), F.coalesce(F.sum(F.when(F.col("own"), size)), F.lit(0).cast("long")).alias("n_assistant_chars"))
    seen = whole.join(people, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("piece")))
    text = F.transform("turns", lambda t: F.concat(F.when(t["role"] == F.col("participant"), F.lit(ASSISTANT)).otherwise(t["head"]), t["tail"]))
    return seen.select(
        "conv_id",
        "participant",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(text, "").alias("text"),
        F.array_join(F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("assistant_spans"),
        "n_assistant_chars",
    )


_SAFE = "replace(replace({}, '<|', '< |'), '|>', '| >')"
ORACLE = f"""
    WITH t AS (SELECT DISTINCT conv_id, turn,
                      {_SAFE.format("regexp_replace(coalesce(role, 'unknown'), '[' || chr(13) || chr(10) || ']+', ' ', 'g')")} AS role,
                      {_SAFE.format("coalesce(text, '')")} AS body FROM conversations),
    p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> '{SYSTEM}'),
    s AS (SELECT t.*, p.participant, t.role = p.participant AS own, body || '<|end|>' || chr(10) AS tail,
                 CASE WHEN t.role = p.participant THEN '<|assistant|>' WHEN t.role = '{SYSTEM}' THEN '<|system|>'
                      ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    w AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, participant
                     ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING) AS past FROM s)
    SELECT conv_id, participant, 0::BIGINT AS part, count(*) AS n_turns,
           string_agg(head || tail, '' ORDER BY turn NULLS FIRST, role, body) AS text,
           coalesce(string_agg((past - length(tail))::BIGINT || '-' || past::BIGINT, ',' ORDER BY past) FILTER (own), '') AS assistant_spans,
           coalesce(sum(length(tail)) FILTER (own), 0)::BIGINT AS n_assistant_chars
    FROM w GROUP BY conv_id, participant"""

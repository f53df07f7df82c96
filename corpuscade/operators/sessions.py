"""Sessions, keys and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_hash_col
from .ranking import grouped_running_sum


def authenticated(sent: DataFrame, stored: DataFrame, now: DataFrame) -> DataFrame:
    """The sent tokens (``token``) with the session of their hash that hasn't expired at ``now`` (one row, column now).

    Tokens are never stored; ``stored`` has ``token_hash, expires_at``.
    """
    keyed = sent.withColumn("token_hash", token_hash_col(F.col("token"))).drop("token")
    from ..session import scalars

    return keyed.join(stored, "token_hash").where(F.col("expires_at") > scalars(now)["now"])


def open_keys(sent: DataFrame, keys: DataFrame) -> DataFrame:
    """The sent tokens whose key (``token_hash, revoked_at``) is known and isn't revoked."""
    keyed = sent.withColumn("token_hash", token_hash_col(F.col("token"))).drop("token")
    return keyed.join(keys.where("revoked_at IS NULL"), "token_hash", "left_semi")


def append_turns(messages: DataFrame | None, turns: DataFrame) -> DataFrame:
    """``conversation, seq, role, content``: the messages with the question and the reply of every turn behind them.

    ``turns``: conversation, turn (their order), question, reply.  Numbers go on from each
    conversation's last one; a conversation may span many tasks.
    """
    both = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    new = turns.select("conversation", "turn", F.explode(both).alias("m")).select("conversation", "turn", "m.*").withColumn("one", F.lit(1))
    numbered = grouped_running_sum(new, ["conversation"], ["turn", "k"], "one", "seq").select("conversation", "seq", "role", "content")
    if messages is None:
        return numbered
    last = messages.groupBy(F.col("conversation").alias("c")).agg(F.max("seq").alias("last"))
    behind = numbered.join(last, F.col("conversation").eqNullSafe(F.col("c")), "left").select("conversation", (F.col("seq") + F.coalesce("last", F.lit(0))).alias("seq"), "role", "content")
    return messages.select("conversation", "seq", "role", "content").unionByName(behind)

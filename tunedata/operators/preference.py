"""Preference data: (type, prompt, chosen, rejected).

``preference_pairs`` (upstream behaviour): the rejected answer is generated
from the rejection prompt by a backend and joined back on ``request_id``.
``cross_class_rejected`` (re-aim, no model): the rejected answer is a real
answer of the *opposite modality* - an Original row (code) gets the
questions of an other-class row and vice versa - paired by seeded ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.functions import templates as T
from tunedata.operators.generate import generate_responses, request_table, responses_at
from tunedata.operators.prompts import keep_complete, preference_prompt, rejection_prompt
from tunedata.operators.rank import hash_rank
from tunedata.operators.sampling import ORIGINAL_FLAG, is_original
from tunedata.session import materialize

#: rows that share one copy of a partner's answer
ROWS_PER_SALT = 1000

# FIXED VALUE: stored when the backend returns an empty text
EMPTY_REJECTED = "Error generating incorrect code"


def rejection_requests(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Complete records -> requests for a worse answer (stage 'reject')."""
    c = keep_complete(records)
    req = c.select(key, "type", "problem", "answer",
                   rejection_prompt().alias("prompt"),
                   F.when(is_original("type"), F.lit("original")).otherwise(F.lit("other"))
                   .alias("kind"),
                   F.col("answer").alias("text"))
    return request_table(req, "reject")


def preference_pairs(records: DataFrame, key: str = "record_id", backend="rules",
                     path: str | None = None, with_status: bool = False) -> DataFrame:
    """One row per complete record. A request without a usable answer keeps its
    row: ``rejected`` is then the fixed error text, and ``status`` (with
    ``with_status``) tells why. ``path`` keeps the responses, so that the
    backend is asked once however often the result is read."""
    req = rejection_requests(records, key)
    resp = generate_responses(req, backend) if path is None else responses_at(req, path, backend)
    usable = (F.col("status") == "ok") & (F.coalesce(F.col("response"), F.lit("")) != "")
    status = [F.coalesce("status", F.lit("missing")).alias("status")] if with_status else []
    return req.join(resp.select("request_id", "response", "status"), "request_id", "left").select(
        key, "type", preference_prompt().alias("prompt"), F.col("answer").alias("chosen"),
        F.when(usable, F.col("response")).otherwise(F.lit(EMPTY_REJECTED)).alias("rejected"),
        *status)


def cross_class_rejected(records: DataFrame, key: str = "record_id", seed: int = 0,
                         rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Row of rank ``rk`` in its class takes the answer of rank
    ``(rk - 1) % n_opposite + 1`` in the opposite class; with an empty opposite
    class there is no row. ``key`` must be unique.

    Ranks and pairs are worked out on keys alone. A tiny opposite class serves
    very many rows: each of its answers is copied once per ``rows_per_salt``
    rows that take it, and those rows are dealt out over the copies."""
    c = keep_complete(records).withColumn(ORIGINAL_FLAG, is_original("type"))
    keys = c.select(key, ORIGINAL_FLAG)
    r = materialize(hash_rank(keys, seed, key, name="_rk", by=(ORIGINAL_FLAG,)), "cross-ranks")
    counts = r.agg(F.count_if(F.col(ORIGINAL_FLAG)).alias("_n_o"),
                   F.count_if(~F.col(ORIGINAL_FLAG)).alias("_n_x"))
    own = F.when(F.col(ORIGINAL_FLAG), F.col("_n_o")).otherwise(F.col("_n_x"))
    opp = F.when(F.col(ORIGINAL_FLAG), F.col("_n_x")).otherwise(F.col("_n_o"))
    sized = r.crossJoin(F.broadcast(counts)).withColumn("_n_own", own).withColumn("_n_opp", opp)
    # copies of an answer: of the class it is taken from (opp) and of the taker (own)
    turn = F.floor(F.try_divide(F.col("_rk") - 1, F.col("_n_opp")))
    taken = sized.where(F.col("_n_opp") > 0).select(
        key, (~F.col(ORIGINAL_FLAG)).alias("_opp"),
        (F.try_mod(F.col("_rk") - 1, F.col("_n_opp")) + 1).alias("_prk"),
        F.floor(turn / rows_per_salt).cast("long").alias("_salt"))
    copies = F.greatest(F.ceil(F.ceil(F.col("_n_opp") / F.col("_n_own")) / rows_per_salt), F.lit(1))
    partner = (sized.withColumn("_copies", copies.cast("int"))
               .select(F.col(key).alias("rejected_id"), F.col(ORIGINAL_FLAG).alias("_opp"),
                       F.col("_rk").alias("_prk"), "_copies")
               .join(c.select(F.col(key).alias("rejected_id"), F.col("answer").alias("rejected")),
                     "rejected_id")
               .select("rejected_id", "rejected", "_opp", "_prk",
                       F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_s"))
               .withColumn("_salt", F.col("_s").cast("long")).drop("_s"))
    pairs = taken.join(partner, ["_opp", "_prk", "_salt"]).drop("_opp", "_prk", "_salt")
    return c.join(pairs, key).select(
        key, "type", preference_prompt().alias("prompt"), F.col("answer").alias("chosen"),
        "rejected", "rejected_id")

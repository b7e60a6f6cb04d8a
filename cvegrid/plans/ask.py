"""From a table of structured questions to one context each."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators.children import children_of
from ..operators.context import blocks, contexts, pack
from ..operators.intents import has_filter, with_filters
from ..operators.retrieval import retrieve_distinct
from ..schemas import CHARS_PER_TOKEN, RESULT_LIMIT, TOKEN_BUDGET
from ..session import cut


def ask(
    intents: DataFrame,
    vulns: DataFrame,
    packages: DataFrame,
    exploits: DataFrame,
    references: DataFrame,
    now: datetime,
    token_budget: int = TOKEN_BUDGET,
    limit: int = RESULT_LIMIT,
) -> DataFrame:
    """``(intent_id, context, blocks, mode)`` for every question.

    Ranks first and fetches sub-records of the winners only. Winners and their
    sub-records are each read twice further on, so they are written once. Equal
    questions have one context, which is handed to them at the end.
    """
    filters = with_filters(intents)
    rows = cut(retrieve_distinct(filters, vulns, packages, now, limit))
    children = cut(children_of(rows, packages, exploits, references))
    facts = rows.drop("signature", "rank").dropDuplicates(["cve_id"])
    texts = blocks(facts, children, token_budget * CHARS_PER_TOKEN).select("cve_id", "block")
    ranks = rows.select(F.col("signature").alias("intent_id"), "rank", "cve_id")
    packed = pack(ranks.join(texts, "cve_id"), token_budget)
    distinct = filters.select(F.col("signature").alias("intent_id")).distinct()
    answers = contexts(distinct, packed).withColumnRenamed("intent_id", "signature")
    asked = filters.select("intent_id", "signature").join(answers, "signature").drop("signature")
    others = intents.where(~F.coalesce(has_filter(), F.lit(False)))
    return asked.unionByName(contexts(others, packed.limit(0)))

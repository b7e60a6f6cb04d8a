"""Text blocks per CVE and their packing into a token budget."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import fixed
from ..schemas import CHARS_PER_TOKEN, TOKEN_BUDGET
from .children import sizes

_LABELS = {"package": "Affects: ", "exploit": "Exploits: ", "reference": "Sources: "}
_JOINERS = {"package": "; ", "exploit": "; ", "reference": ", "}


def header() -> Column:
    """``[id] (SEVERITY | CVSS x.x | EPSS x.xx | KEV: … | Exploit: …)``; absent parts vanish."""
    parts = F.concat_ws(
        " | ",
        F.nullif("severity", F.lit("")),
        F.concat(F.lit("CVSS "), fixed(F.col("cvss_score"), 1)),
        F.concat(F.lit("EPSS "), fixed(F.col("epss_score"), 2)),
        F.when(F.col("cisa_kev"), "KEV: Yes").otherwise("KEV: No"),
        F.when(F.coalesce("exploit_n", F.lit(0)) > 0, "Exploit: Yes").otherwise("Exploit: No"),
    )
    return F.concat(F.lit("["), F.col("cve_id"), F.lit("] ("), parts, F.lit(")"))


def _line(kind: str) -> Column:
    return F.concat(F.lit(_LABELS[kind]), F.col(f"{kind}_text"))


def block() -> Column:
    """Block of one CVE; lines without content are left out."""
    return F.concat_ws(
        "\n",
        header(),
        _line("package"),
        F.when(F.col("description") != "", F.concat(F.lit("Description: "), "description")),
        _line("exploit"),
        _line("reference"),
    )


def _texts(children: DataFrame, totals: DataFrame, budget: int) -> DataFrame:
    """One text per CVE and kind, only where all its text fits the budget."""
    fitting = totals.where(F.col("total_chars") <= budget).select("cve_id")
    entry = F.struct("key1", "key2", "key3", "segment")
    sorted_lists = (
        children.join(fitting, "cve_id", "left_semi")
        .groupBy("cve_id")
        .agg(*[
            F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind) for kind in _LABELS
        ])
    )
    return sorted_lists.select("cve_id", *[
        F.when(F.size(kind) > 0, F.array_join(F.transform(kind, lambda e: e.segment), joiner)).alias(f"{kind}_text")
        for kind, joiner in _JOINERS.items()
    ])


#: Lines of a block in order; the parts of a line are joined by its kind's joiner.
LINES = {"header": 0, "package": 1, "description": 2, "exploit": 3, "reference": 4}


def block_lines(rows: DataFrame, children: DataFrame) -> DataFrame:
    """Blocks of any size as ordered rows ``(cve_id, line, pos, text)``: one for each part of a line.

    Nothing is gathered per CVE, so a CVE with very many sub-records is as many rows.
    """
    exploits = sizes(children).where(F.col("kind") == "exploit").select("cve_id", F.col("n").alias("exploit_n"))
    facts = rows.join(exploits, "cve_id", "left")
    heads = facts.select("cve_id", F.lit(LINES["header"]).alias("line"), F.lit(1).alias("pos"), header().alias("text"))
    described = rows.where(F.col("description") != "").select(
        "cve_id", F.lit(LINES["description"]).alias("line"), F.lit(1).alias("pos"), F.col("description").alias("text"))
    order = Window.partitionBy("cve_id", "kind").orderBy("key1", "key2", "key3", "segment")
    line = F.coalesce(*[F.when(F.col("kind") == kind, LINES[kind]) for kind in _LABELS])
    parts = children.join(rows.select("cve_id"), "cve_id", "left_semi").select(
        "cve_id", line.alias("line"), F.row_number().over(order).alias("pos"), F.col("segment").alias("text"))
    return heads.unionByName(described).unionByName(parts)


def blocks(rows: DataFrame, children: DataFrame, budget_chars: int) -> DataFrame:
    """Rows with their ``block``, for packing; ``block_lines`` has blocks of any size.

    ``block`` is NULL where the sub-records alone exceed the budget: such a
    block can never be kept, so its text is not built, whatever its size.
    """
    per_kind = sizes(children)
    totals = per_kind.groupBy("cve_id").agg(
        # segments and the two characters between any two of a kind
        F.sum(F.col("chars") + 2 * (F.col("n") - 1)).alias("total_chars"),
        F.sum(F.when(F.col("kind") == "exploit", F.col("n"))).alias("exploit_n"),
    )
    return (
        rows.join(totals, "cve_id", "left")
        .join(_texts(children, totals, budget_chars), "cve_id", "left")
        .withColumn("block", F.when(F.coalesce("total_chars", F.lit(0)) <= budget_chars, block()))
        .drop("total_chars", "exploit_n", *[f"{k}_text" for k in _LABELS])
    )


def pack(ranked_blocks: DataFrame, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Blocks kept per question: in rank order up to the first that does not fit.

    Separators are not counted. A question has at most the result limit of rows.
    """
    budget = token_budget * CHARS_PER_TOKEN
    so_far = Window.partitionBy("intent_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    length = F.coalesce(F.length("block"), F.lit(budget + 1)).cast("bigint")
    return (
        ranked_blocks.withColumn("used_chars", F.sum(length).over(so_far))
        .where(F.col("used_chars") <= budget)
    )


def contexts(intents: DataFrame, packed: DataFrame) -> DataFrame:
    """One context per question, '' where nothing was retrieved or fits.

    ``mode`` names the answer style: grounded on the context, or conversational.
    """
    texts = packed.groupBy("intent_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda e: e.block), "\n\n"
        ).alias("context"),
        F.count("*").alias("blocks"),
    )
    return intents.select("intent_id").join(texts, "intent_id", "left").select(
        "intent_id",
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("blocks", F.lit(0)).alias("blocks"),
        answer_mode(F.col("context")).alias("mode"),
    )


def answer_mode(context: Column) -> Column:
    return F.when(context != "", "grounded").otherwise("conversational")

"""Checking and annotating answers."""

from pyspark.sql import Column, DataFrame, functions as F

# Texts put around the findings of a check.
UNSUPPORTED_NOTE = (
    "\n---\n**Note:** The following claims could not be verified "
    "against the retrieved data and may be inaccurate:\n"
)
OMITTED_NOTE = "\n---\n**Additional information** from the retrieved data that may be relevant:\n"
CVE_PATTERN = r"CVE-\d{4}-\d{4,}"


def unsupported(claims: Column) -> Column:
    return F.filter(F.coalesce(claims, F.array()), lambda c: c.status == "unsupported")


def _section(note: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(note), F.array_join(lines, "\n")))


def annotate(answers: DataFrame) -> DataFrame:
    """Adds ``final_answer`` and the claim counts.

    Unsupported claims are listed first, then omissions; an answer without
    either stays as it is.
    """
    bad = unsupported(F.col("claims"))
    warnings = F.transform(
        bad, lambda c: F.concat(F.lit("- "), c.claim, F.lit(" (Reason: "), c.rationale, F.lit(")"))
    )
    missed = F.transform(
        F.coalesce("omissions", F.array().cast("array<string>")), lambda o: F.concat(F.lit("- "), o)
    )
    return answers.withColumns({
        "final_answer": F.concat_ws(
            "\n", "answer", _section(UNSUPPORTED_NOTE, warnings), _section(OMITTED_NOTE, missed)
        ),
        "claim_count": F.coalesce(F.size("claims"), F.lit(0)),
        "unsupported_count": F.size(bad),
    })


def cited(text: Column, pattern: str = CVE_PATTERN) -> Column:
    """Distinct identifiers in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


def grounding(pairs: DataFrame, pattern: str = CVE_PATTERN) -> DataFrame:
    """Compares identifiers of ``answer`` and ``context``.

    ``not_in_context`` are cited without backing, ``not_cited`` are retrieved
    but not mentioned. An empty context is not checked.
    """
    checked = F.col("context") != ""
    seen, said = cited(F.col("context"), pattern), cited(F.col("answer"), pattern)
    none = F.array().cast("array<string>")
    return pairs.withColumns({
        "not_in_context": F.when(checked, F.array_except(said, seen)).otherwise(none),
        "not_cited": F.when(checked, F.array_except(seen, said)).otherwise(none),
    })


def grounding_claims(checked: DataFrame) -> DataFrame:
    """The findings in the form ``annotate`` takes."""
    return checked.withColumns({
        "claims": F.transform("not_in_context", lambda x: F.struct(
            F.concat(F.lit("mentions "), x).alias("claim"),
            F.lit("unsupported").alias("status"),
            F.lit(None).cast("string").alias("evidence"),
            F.lit("not in the retrieved data").alias("rationale"),
        )),
        "omissions": F.col("not_cited"),
    })

"""Evidence packs for writers, and documents put together from what they return.

A pack holds the data a document is to be written from; the prose itself comes from outside.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.text import evidence_line, guidance_block, ordered_lines, score_text, shown
from roadsift.operators.citations import ITEM, evidence_pool, with_siblings
from roadsift.operators.scoring import named
from roadsift.schemas import EVIDENCE_POOL_SIZE, SIBLING_COUNT

THEME_CHARS, SIBLING_CHARS, PREVIEW_CHARS = 300, 200, 220

# The headings of a stored memo, which readers of such documents know.
MEMO_HEAD = "# Prioritization Boardroom — Decision Memo\n\n## Roadmap considered\n"
MEMO_PANEL = "\n\n# Panel debate\n"


def theme_pack(
    opportunities: DataFrame, themes: DataFrame, items: DataFrame, guidance: str = "", n: int = EVIDENCE_POOL_SIZE
) -> DataFrame:
    """(theme_id, pack) per opportunity: name, summary, figures and the worst items by id."""
    line = evidence_line(F.col("id"), F.col("fb_type"), F.col("severity"), F.col("body"), THEME_CHARS)
    evidence = (
        evidence_pool(items, themes, n)
        .withColumn("_line", line)
        .groupBy("theme_id")
        .agg(ordered_lines("_line", "rank").alias("evidence"))
    )
    offered = named(opportunities, themes)
    summary = F.col("summary") if "summary" in offered.columns else F.lit(None).cast("string")
    pack = F.concat(
        F.lit("Theme to write about: "), F.col("name"), F.lit("\nWhat it is about: "), shown(summary),
        F.lit("\nSize: "), F.col("reach").cast("string"), F.lit(" items; mean severity (1 to 4): "),
        F.col("impact").cast("string"), F.lit("; score: "), score_text(F.col("rice_score")),
        F.lit("\n\nItems, each under the number that cites it:\n"), F.coalesce(F.col("evidence"), F.lit("")),
        F.lit("\n"), guidance_block(F.lit(guidance)),
    )
    return offered.join(evidence, "theme_id", "left").select("theme_id", pack.alias("pack"))


def review_pack(
    items: DataFrame, themes: DataFrame | None = None, guidance: str = "", n: int = SIBLING_COUNT
) -> DataFrame:
    """(id, pack) per classified item: its whole text and its siblings' opening characters."""
    classified = items.filter(F.col("status") == "classified").select("theme_id", *ITEM)
    targets = with_siblings(classified, items, themes, n)
    lines = F.array_join(
        F.transform(
            "siblings",
            lambda other: evidence_line(other["id"], other["fb_type"], other["severity"], other["body"], SIBLING_CHARS),
        ),
        "\n",
    )
    related = F.when(
        F.size("siblings") > 0, F.concat(F.lit("\nRelated feedback of the same theme, which may be cited too:\n"), lines, F.lit("\n"))
    ).otherwise("")
    pack = F.concat(
        F.lit("Item to write about, cited as [#"), F.col("id").cast("string"), F.lit("]. Label: "), shown(F.col("fb_type")),
        F.lit("; severity (1 to 4): "), shown(F.col("severity")), F.lit('. In full:\n"""'), F.col("body"), F.lit('"""\n'),
        related, guidance_block(F.lit(guidance)),
    )
    return targets.select("id", pack.alias("pack"))


def sibling_preview(items: DataFrame, themes: DataFrame | None = None, n: int = SIBLING_COUNT) -> DataFrame:
    """(id, preview): an item's siblings as they are listed before a document is ordered."""
    lines = F.transform(
        "siblings",
        lambda other: F.concat(
            F.lit("**[#"), other["id"].cast("string"), F.lit("]** ("), shown(other["fb_type"]), F.lit(", sev "),
            shown(other["severity"]), F.lit("): "), F.substring(other["body"], 1, PREVIEW_CHARS),
        ),
    )
    themed = items.filter(F.col("theme_id").isNotNull()).select("id", "theme_id")
    listed = with_siblings(themed, items, themes, n).filter(F.size("siblings") > 0)
    return listed.select("id", F.array_join(lines, "\n").alias("preview"))


def opinion_packs(roadmap: DataFrame, roles: DataFrame) -> DataFrame:
    """(position, role, pack) per panel member: who they are, what they care about, and the roadmap.

    ``roles(position, role, mandate)`` is the caller's.
    """
    text = roadmap.select("roadmap").scalar()
    pack = F.concat(
        F.lit("Speak for this role: "), F.col("role"), F.lit(". "), F.col("mandate"),
        F.lit("\n\nThemes, the best score first:\n"), text, F.lit("\n"),
    )
    return roles.select("position", "role", pack.alias("pack"))


def decision_pack(roadmap: DataFrame, opinions: DataFrame) -> DataFrame:
    """One row: the roadmap and the panel's opinions (position, role, opinion), for the one who decides."""
    parts = opinions.select(
        "position", F.concat(F.lit("### "), F.col("role"), F.lit("\n"), F.col("opinion")).alias("_part")
    )
    panel = parts.agg(F.coalesce(ordered_lines("_part", "position", "\\n\\n"), F.lit("")).alias("_panel")).scalar()
    pack = F.concat(F.lit("Themes, the best score first:\n"), F.col("roadmap"), F.lit("\n\nWhat each role says:\n"), panel, F.lit("\n"))
    return roadmap.select(pack.alias("pack"))


def memo_markdown(roadmap: DataFrame, opinions: DataFrame, decision: str | DataFrame) -> DataFrame:
    """(target_kind, target_id, markdown): roadmap text, the panel's opinions and the decision.

    ``opinions(position, role, opinion)`` and ``decision``, a text or one row (reply), come from outside.
    """
    decided = F.lit(decision) if isinstance(decision, str) else F.coalesce(decision.select("reply").scalar(), F.lit(""))
    parts = opinions.select("position", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("opinion")).alias("_part"))
    panel = parts.agg(F.coalesce(ordered_lines("_part", "position", "\\n\\n"), F.lit("")).alias("_panel")).scalar()
    return roadmap.select(
        F.lit("memo").alias("target_kind"),
        F.lit(None).cast("bigint").alias("target_id"),
        F.concat(
            F.lit(MEMO_HEAD), F.col("roadmap"), F.lit(MEMO_PANEL), panel, F.lit("\n\n---\n"), decided, F.lit("\n"),
        ).alias("markdown"),
    )

"""Prompt text per group from summary tables.

A prompt is a short list of lines per group: a header, an optional focus block,
one line per top item / category / insight, closing lines.  Each section is an
ordered ``collect_list`` per group — at most N lines, since the inputs are
top-N lists — and the sections are joined on the group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed_text
from .ranking import join_on_group

# Prompt wording of the two back ends.
HEADER_LINE = "Here is a summary of recent sales data:"
FOCUS_LINES = (
    "IMPORTANT FOCUS ITEM:",
    "- The ONLY main item for this content is {item}.",
    "Instagram caption, TikTok hook, hashtags, and promotion actions must all center on this item.",
    "You may mention the restaurant generally, but do not make Pho Beef or any other item the star "
    "unless it is the selected item.",
)
ITEMS_TITLE = "Top-selling items:"
CATS_TITLE = "Top categories:"
INSIGHTS_TITLE = "Key business insights:"
CLOSING_LINES = (
    "Based on this data, generate Instagram content, TikTok content, and promotion ideas following "
    "the platform guidelines.",
    "Remember: Instagram needs 8-12 hashtags, TikTok needs 3-5 hashtags.",
)
CLOSING_LINES_API = (
    "Based on this data, generate:",
    "1. Top 3 recommended actions (concise strategy points)",
    "2. An Instagram caption with 8-12 hashtags",
    "3. A TikTok caption with 2-4 hashtags",
)
NEW_VARIATION_LINE = "Generate a NEW variation that avoids repeating phrases from previous_text."
# Platform -> system prompt key.
PLATFORM_PROMPTS = {"instagram": "INSTAGRAM_PROMPT", "tiktok": "TIKTOK_PROMPT", "actions": "ACTIONS_PROMPT"}

# A request for a group without a summary.
NO_SUMMARY = "No summary for this group"


def _money2(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x.cast("double"), 2))


def _truthy(x: Column) -> Column:
    """Python truthiness of an optional number (null and 0 are false)."""
    return F.coalesce(x.cast("double"), F.lit(0.0)) != 0


def item_lines(top_items: DataFrame, group_cols: Sequence[str], units_word: str = "units sold",
               keep: Sequence[str] = ()) -> DataFrame:
    has_rev = "net_sales" in top_items.columns
    base = F.concat(F.lit("- "), F.col("item_name"), F.lit(": "), F.col("quantity").cast("string"),
                    F.lit(f" {units_word}"))
    if has_rev:
        rich = F.concat(base, F.lit(", "), _money2(F.col("net_sales")), F.lit(" revenue, $"),
                        fixed_text(F.coalesce(F.col("avg_price"), F.lit(0.0)), 2), F.lit(" avg price"))
        # revenue without a price column: the price reads 0.00, the line stays
        line = F.when(_truthy(F.col("net_sales")), rich).otherwise(base)
    else:
        line = base
    return top_items.select(*group_cols, F.col("rank").alias("k"), line.alias("line"), *keep)


def category_lines(top_cats: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    base = F.concat(F.lit("- "), F.col("category"), F.lit(": "), F.col("quantity").cast("string"), F.lit(" units"))
    if "net_sales" in top_cats.columns:
        line = F.when(_truthy(F.col("net_sales")),
                      F.concat(base, F.lit(", "), _money2(F.col("net_sales")), F.lit(" revenue"))).otherwise(base)
    else:
        line = base
    return top_cats.select(*group_cols, F.col("rank").alias("k"), line.alias("line"))


def _section(lines: DataFrame, group_cols, title: str, name: str, extra=()) -> DataFrame:
    """One ordered array per group: title, the lines by ``k``, a blank line."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return lines.groupBy(*group_cols).agg(
        F.concat(F.array(F.lit(title)), body, F.array(F.lit(""))).alias(name), *extra)


def user_prompt(top_items: DataFrame, top_cats: DataFrame, insights: DataFrame, group_cols: Sequence[str],
                selections: DataFrame | None = None, variant: str = "backend") -> DataFrame:
    """X1 (``backend``: focus block, "units sold") / X2 (``api``: no focus,
    "units", three numbered closing lines).  Returns ``(group…, prompt)``.

    ``selections`` = ``(group…, selected_item)``; the focus block appears only
    when the selected name equals a top item's name (P12).  Each input is
    aggregated once into an ordered array per group; a section whose list is
    empty is left out.
    """
    group_cols = list(group_cols)
    api = variant == "api"
    items = top_items
    focus_agg = []
    if selections is not None and not api:
        items = top_items.join(selections, group_cols, "left")
        focus_agg = [F.min(F.when(F.col("item_name") == F.col("selected_item"), F.col("item_name"))).alias("_focus")]
    il = item_lines(items, group_cols, "units" if api else "units sold",
                    keep=["item_name", "selected_item"] if focus_agg else [])
    sec_items = _section(il, group_cols, ITEMS_TITLE, "_items", focus_agg)
    sec_cats = _section(category_lines(top_cats, group_cols), group_cols, CATS_TITLE, "_cats")
    sec_ins = _section(insights.select(*group_cols, F.col("seq").alias("k"),
                                       F.concat(F.lit("- "), F.col("text")).alias("line")),
                       group_cols, INSIGHTS_TITLE, "_ins")
    j = sec_items.join(sec_cats, group_cols, "full_outer").join(sec_ins, group_cols, "full_outer")
    empty = F.array().cast("array<string>")
    if focus_agg:
        focus = F.when(F.col("_focus").isNotNull(), F.array(*[
            F.concat(F.lit(t.split("{item}")[0]), F.col("_focus"), F.lit(t.split("{item}")[1])) if "{item}" in t
            else F.lit(t) for t in FOCUS_LINES + ("",)])).otherwise(empty)
    else:
        focus = empty
    closing = CLOSING_LINES_API if api else CLOSING_LINES
    lines = F.concat(F.array(F.lit(HEADER_LINE), F.lit("")), focus,
                     F.coalesce(F.col("_items"), empty), F.coalesce(F.col("_cats"), empty),
                     F.coalesce(F.col("_ins"), empty), F.array(*[F.lit(t) for t in closing]))
    return j.select(*group_cols, F.array_join(lines, "\n").alias("prompt"))


def platform_prompt(prompts: DataFrame, requests: DataFrame, group_cols: Sequence[str],
                    templates: DataFrame | None = None) -> DataFrame:
    """``requests = (group…, platform, nonce, previous_text)`` -> the system
    prompt key and the user prompt with the nonce and previous-text lines.
    Unknown platforms, and groups that have no prompt, get ``error`` and no prompt.
    ``templates = (platform, system_prompt)`` gives each platform's system prompt itself,
    so that the wording is a table and not part of the program."""
    j = join_on_group(requests, prompts, group_cols, "left")
    key = F.create_map(*[F.lit(x) for kv in PLATFORM_PROMPTS.items() for x in kv])[F.col("platform")]
    nonce = F.coalesce(F.nullif(F.col("nonce"), F.lit(0)), F.unix_timestamp())
    prev = F.nullif(F.col("previous_text"), F.lit(""))
    text = F.concat(F.col("prompt"), F.lit("\n\n"), F.lit("nonce="), nonce.cast("string"), F.lit("\n"),
                    F.when(prev.isNotNull(), F.concat(F.lit("previous_text="), prev, F.lit("\n"),
                                                      F.lit(NEW_VARIATION_LINE + "\n"))).otherwise(F.lit("")))
    system = key
    if templates is not None:
        j = j.join(templates.select("platform", F.col("system_prompt").alias("_system")), "platform", "left")
        system = F.when(key.isNotNull(), F.col("_system"))
    return j.select(*group_cols, "platform", system.alias("system_prompt"),
                    F.when(key.isNotNull(), text).alias("user_prompt"),
                    F.when(key.isNull(), F.lit("platform must be one of: instagram, tiktok, actions"))
                    .when(F.col("prompt").isNull(), F.lit(NO_SUMMARY)).alias("error"))

"""Content documents (F19-F22): copy texts and per-section refresh.

A refreshed section is merged into its document with ``Column.withField`` —
one projection over a table of documents joined to their refresh replies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import col_
from ..functions.text import actions_to_ideas


def replace_section(doc, platform, post, actions) -> Column:
    """instagram / tiktok replace that post; actions replace the ideas with
    ``{text, reason: 'Refreshed suggestion'}`` objects; anything else keeps the
    document.  A missing document stays missing."""
    d, p = col_(doc), col_(platform)
    return (F.when(d.isNull(), d)
            .when(p == "instagram", d.withField("instagram", col_(post)))
            .when(p == "tiktok", d.withField("tiktok", col_(post)))
            .when(p == "actions", d.withField(
                "promotion_ideas", actions_to_ideas(F.coalesce(col_(actions), F.array().cast("array<string>")))))
            .otherwise(d))

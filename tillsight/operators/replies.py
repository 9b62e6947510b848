"""Reply-table jobs (X3-X12): fence stripping, JSON parsing, recovery,
validation and legacy conversion, written with VARIANT expressions.

Each function maps a column of reply texts to a ``struct`` with the parsed
content and the first error message in the reference's check order, so a
table of millions of replies is validated in one projection (no Python).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_text

CONTENT_TYPE = ("struct<instagram:struct<caption:string,hashtags:array<string>>,"
                "tiktok:struct<caption:string,hashtags:array<string>>,"
                "promotion_ideas:array<struct<text:string,reason:string>>>")

# Reply error messages, in check order.
ERR_JSON = "Failed to parse LLM response as JSON"
ERR_IG_OBJ = "Instagram must be an object"
ERR_TT_OBJ = "TikTok must be an object"
ERR_IG_KEYS = "Instagram must have caption and hashtags"
ERR_IG_CAP = "Instagram caption must be a string"
ERR_IG_TAGS = "Instagram hashtags must be a list"
ERR_TT_KEYS = "TikTok must have caption and hashtags"
ERR_TT_CAP = "TikTok caption must be a string"
ERR_TT_TAGS = "TikTok hashtags must be a list"
ERR_EMBED = "{platform} caption contains embedded JSON instead of plain caption text"
ERR_IDEA_OBJ = "promotion ideas must contain objects"
ERR_IDEA_KEYS = "Each promotion idea must have text and reason"
ERR_LAYOUT = "Response missing required keys. Expected either new or old format"
DEFAULT_IG_CAPTION = "Check out our delicious food!"
DEFAULT_TT_CAPTION = "This food is amazing!"
LEGACY_IG_TAGS, LEGACY_TT_TAGS = 8, 3

# Serverless reply messages.
ERR_API_ACTIONS = "Missing or invalid 'recommended_actions'"
ERR_API_IG = "Missing or invalid 'instagram'"
ERR_API_TT = "Missing or invalid 'tiktok'"
ERR_API_CAP = "Missing 'caption' in {platform}"
ERR_API_TAGS = "Missing or invalid 'hashtags' in {platform}"

# Single-platform reply messages.
PLATFORMS = ("instagram", "tiktok", "actions")
ERR_PLATFORM = "platform must be one of: instagram, tiktok, actions"
ERR_PLATFORM_JSON = "Failed to parse platform response as JSON"
ERR_PLATFORM_POST = "{platform} response must contain caption (string) and hashtags (list)"
ERR_PLATFORM_ACTIONS = "actions response must contain actions: [..] with 3 items"
MIN_ACTIONS = 3


def strip_fences(text) -> Column:
    """Body of the first ```` ```json ```` fence, else of the first plain fence,
    up to the next fence or the end of the text; trimmed."""
    t = strip_text(text)
    tagged = F.regexp_extract(t, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(t, r"(?s)```(.*?)(?:```|$)", 1)
    body = F.when(t.contains("```json"), tagged).when(t.contains("```"), plain).otherwise(t)
    return strip_text(body)


def _get(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def _has(v: Column, key: str) -> Column:
    """Key present (a JSON null value still counts, as ``in`` does in Python)."""
    return F.when(_is_obj(v), _get(v, f"$.{key}").isNotNull()).otherwise(F.lit(False))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_obj(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _is_str(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _is_list(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False))


def _str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _first_bad_idea(ideas: Column) -> Column:
    """Message of the first promotion idea that fails (objects first, then keys)."""
    arr = F.try_variant_get(ideas, "$", "array<variant>")

    def msg(x):
        return F.when(~_is_obj(x), F.lit(ERR_IDEA_OBJ)).when(
            ~(_has(x, "text") & _has(x, "reason")), F.lit(ERR_IDEA_KEYS))

    # an object iterates its keys and a string its characters (never objects);
    # empty ones iterate nothing; null / numbers / booleans cannot be iterated
    n_keys = F.size(F.coalesce(F.try_variant_get(ideas, "$", "map<string,variant>"),
                               F.create_map().cast("map<string,variant>")))
    non_list = (F.when(_is_obj(ideas), F.when(n_keys > 0, F.lit(ERR_IDEA_OBJ)))
                .when(_is_str(ideas), F.when(F.length(_str(ideas)) > 0, F.lit(ERR_IDEA_OBJ)))
                .otherwise(F.lit(ERR_IDEA_OBJ)))
    first = F.get(F.filter(F.transform(arr, msg), lambda m: m.isNotNull()), 0)
    return F.when(_is_list(ideas), first).otherwise(non_list)


def _post(v: Column, platform: str) -> Column:
    caption = _str(_get(v, f"$.{platform}.caption"))
    tags = F.try_variant_get(v, f"$.{platform}.hashtags", "array<string>")
    return F.struct(caption.alias("caption"), tags.alias("hashtags"))


IDEAS_TYPE = "array<struct<text:string,reason:string>>"


def _ideas(typed: Column, ideas: Column) -> Column:
    """Ideas as (text, reason); an idea that is a plain text, as in legacy replies, has no reason.  ``typed``: the list
    read as objects in one go; only where one of them is none of that are the ideas looked at one by one."""
    def idea(x: Column) -> Column:
        plain = F.struct(_str(x).alias("text"), F.lit(None).cast("string").alias("reason"))
        return F.when(_is_str(x), plain).otherwise(F.try_variant_get(x, "$", "struct<text:string,reason:string>"))
    whole = typed.isNotNull() & ~F.exists(typed, lambda x: x.isNull())
    return F.when(whole, typed).otherwise(F.transform(F.try_variant_get(ideas, "$", "array<variant>"), idea))


def _whole_ideas(typed: Column) -> Column:
    """Every idea is an object with a text and a reason."""
    return F.coalesce(F.forall(typed, lambda x: x.isNotNull() & x["text"].isNotNull() & x["reason"].isNotNull()), F.lit(False))


def allow_repeated_keys(spark: SparkSession) -> None:
    """A JSON object that repeats a key parses, the last one wins.  Spark reads this from the session when a reply is parsed,
    so a session that was not made by ``get_session`` gets the setting here."""
    name = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(name, "false") != "true":
        spark.conf.set(name, "true")


def _c(name: str) -> Column:
    return F.col(name)


def parse_replies(df: DataFrame, text_col: str, out_col: str = "reply") -> DataFrame:
    """Add ``out_col = struct<content, layout, error>`` for every reply text.

    ``layout`` is ``current`` / ``legacy``; on failure ``content`` is null and
    ``error`` holds the first failing check in the reference's order.  Each step
    is its own projection so a parsed VARIANT is referenced, not re-parsed.
    """
    allow_repeated_keys(df.sparkSession)
    tmp = ["_v0", "_v1", "_cap", "_looks", "_nested", "_v", "_ig", "_tt", "_pi", "_typed", "_cur", "_leg", "_nfail", "_err"]
    d = df.withColumn("_v0", F.try_parse_json(strip_fences(F.col(text_col))))
    # A JSON string that holds JSON is parsed again
    d = d.withColumn("_v1", F.when(_is_str(_c("_v0")), F.try_parse_json(_str(_c("_v0")))).otherwise(_c("_v0")))
    # Whole document inside instagram.caption
    cap_v = _get(_c("_v1"), "$.instagram.caption")
    d = d.withColumn("_cap", F.when(_is_obj(_get(_c("_v1"), "$.instagram")) & _is_str(cap_v),
                                    strip_text(_str(cap_v))))
    d = d.withColumn("_looks", F.coalesce(_c("_cap").startswith("{") & _c("_cap").contains('"instagram"')
                                          & _c("_cap").contains('"tiktok"'), F.lit(False)))
    d = d.withColumn("_nested", F.when(_c("_looks"), F.try_parse_json(_c("_cap"))))
    use = _c("_looks") & _has(_c("_nested"), "instagram") & _has(_c("_nested"), "tiktok")
    d = d.withColumn("_v", F.when(use, _c("_nested")).otherwise(_c("_v1"))) \
         .withColumn("_nfail", _c("_looks") & _c("_nested").isNull())
    v = _c("_v")
    d = d.withColumn("_ig", _get(v, "$.instagram")).withColumn("_tt", _get(v, "$.tiktok")) \
         .withColumn("_pi", _get(v, "$.promotion_ideas")) \
         .withColumn("_cur", _has(v, "instagram") & _has(v, "tiktok") & _has(v, "promotion_ideas")) \
         .withColumn("_leg", _has(v, "captions") & _has(v, "hashtags") & _has(v, "promotion_ideas")) \
         .withColumn("_typed", F.try_variant_get(_c("_pi"), "$", IDEAS_TYPE))
    ig, tt = _c("_ig"), _c("_tt")

    def embedded(pv: Column) -> Column:
        cap = strip_text(_str(_get(pv, "$.caption")))
        return cap.startswith("{") & (cap.contains('"instagram"') | cap.contains('"tiktok"'))

    current_err = (
        F.when(~_is_obj(ig), F.lit(ERR_IG_OBJ))
        .when(~_is_obj(tt), F.lit(ERR_TT_OBJ))
        .when(~(_has(ig, "caption") & _has(ig, "hashtags")), F.lit(ERR_IG_KEYS))
        .when(~_is_str(_get(ig, "$.caption")), F.lit(ERR_IG_CAP))
        .when(~_is_list(_get(ig, "$.hashtags")), F.lit(ERR_IG_TAGS))
        .when(~(_has(tt, "caption") & _has(tt, "hashtags")), F.lit(ERR_TT_KEYS))
        .when(~_is_str(_get(tt, "$.caption")), F.lit(ERR_TT_CAP))
        .when(~_is_list(_get(tt, "$.hashtags")), F.lit(ERR_TT_TAGS))
        .when(embedded(ig), F.lit(ERR_EMBED.format(platform="instagram")))
        .when(embedded(tt), F.lit(ERR_EMBED.format(platform="tiktok")))
        .when(_whole_ideas(_c("_typed")), F.lit(None).cast("string"))
        .otherwise(_first_bad_idea(_c("_pi"))))
    d = d.withColumn("_err", F.when(_c("_v0").isNull() | _c("_v1").isNull() | _c("_nfail"), F.lit(ERR_JSON))
                     .when(_c("_cur"), current_err)
                     .when(_c("_leg"), F.lit(None).cast("string"))
                     .otherwise(F.lit(ERR_LAYOUT)))

    caps = F.try_variant_get(v, "$.captions", "array<string>")
    tags = F.try_variant_get(v, "$.hashtags", "array<string>")
    has_caps = F.coalesce(F.size(caps) > 0, F.lit(False))
    legacy = F.struct(
        F.struct(F.when(has_caps, F.get(caps, 0)).otherwise(F.lit(DEFAULT_IG_CAPTION)).alias("caption"),
                 F.slice(tags, 1, LEGACY_IG_TAGS).alias("hashtags")).alias("instagram"),
        F.struct(F.when(F.size(caps) > 1, F.get(caps, 1)).when(has_caps, F.get(caps, 0))
                 .otherwise(F.lit(DEFAULT_TT_CAPTION)).alias("caption"),
                 F.slice(tags, 1, LEGACY_TT_TAGS).alias("hashtags")).alias("tiktok"),
        _ideas(_c("_typed"), _c("_pi")).alias("promotion_ideas"))
    current = F.struct(_post(v, "instagram").alias("instagram"), _post(v, "tiktok").alias("tiktok"),
                       _ideas(_c("_typed"), _c("_pi")).alias("promotion_ideas"))
    ok = _c("_err").isNull()
    content = F.when(ok & _c("_cur"), current).when(ok & _c("_leg"), legacy)
    layout = F.when(ok & _c("_cur"), F.lit("current")).when(ok & _c("_leg"), F.lit("legacy"))
    d = d.withColumn(out_col, F.struct(content.alias("content"), layout.alias("layout"),
                                       _c("_err").alias("error")))
    return d.drop(*tmp)


def parse_api_replies(df: DataFrame, text_col: str, out_col: str = "reply") -> DataFrame:
    """X11: the serverless layout ``{recommended_actions[], instagram{}, tiktok{}}``."""
    allow_repeated_keys(df.sparkSession)
    d = df.withColumn("_v", F.try_parse_json(strip_fences(F.col(text_col))))
    v = _c("_v")
    d = d.withColumn("_ig", _get(v, "$.instagram")).withColumn("_tt", _get(v, "$.tiktok"))
    err = F.when(v.isNull(), F.lit(ERR_JSON)) \
        .when(~(_has(v, "recommended_actions") & _is_list(_get(v, "$.recommended_actions"))), F.lit(ERR_API_ACTIONS)) \
        .when(~(_has(v, "instagram") & _is_obj(_c("_ig"))), F.lit(ERR_API_IG)) \
        .when(~(_has(v, "tiktok") & _is_obj(_c("_tt"))), F.lit(ERR_API_TT))
    for p, pv in (("instagram", _c("_ig")), ("tiktok", _c("_tt"))):
        err = err.when(~_has(pv, "caption"), F.lit(ERR_API_CAP.format(platform=p))) \
            .when(~(_has(pv, "hashtags") & _is_list(_get(pv, "$.hashtags"))),
                  F.lit(ERR_API_TAGS.format(platform=p)))
    d = d.withColumn("_err", err)
    actions = F.try_variant_get(v, "$.recommended_actions", "array<string>")
    content = F.struct(actions.alias("recommended_actions"), _post(v, "instagram").alias("instagram"),
                       _post(v, "tiktok").alias("tiktok"))
    d = d.withColumn(out_col, F.struct(F.when(_c("_err").isNull(), content).alias("content"),
                                       _c("_err").alias("error")))
    return d.drop("_v", "_ig", "_tt", "_err")


def parse_platform_replies(df: DataFrame, platform_col: str, text_col: str,
                           out_col: str = "reply") -> DataFrame:
    """X3 choice + X12: one platform's reply; unknown platform is an error."""
    allow_repeated_keys(df.sparkSession)
    p = F.col(platform_col)
    d = df.withColumn("_v", F.try_parse_json(strip_fences(F.col(text_col))))
    v = _c("_v")
    post_ok = _has(v, "caption") & _has(v, "hashtags") & _is_list(_get(v, "$.hashtags"))
    acts = _get(v, "$.actions")
    acts_ok = _has(v, "actions") & _is_list(acts) & \
        F.coalesce(F.size(F.try_variant_get(acts, "$", "array<variant>")) >= MIN_ACTIONS, F.lit(False))
    err = (F.when(~p.isin(*PLATFORMS), F.lit(ERR_PLATFORM))
           .when(v.isNull(), F.lit(ERR_PLATFORM_JSON))
           .when(p.isin("instagram", "tiktok") & ~post_ok,
                 F.concat(p, F.lit(ERR_PLATFORM_POST.replace("{platform}", ""))))
           .when((p == "actions") & ~acts_ok, F.lit(ERR_PLATFORM_ACTIONS)))
    d = d.withColumn("_err", err)
    content = F.struct(_str(_get(v, "$.caption")).alias("caption"),
                       F.try_variant_get(v, "$.hashtags", "array<string>").alias("hashtags"),
                       F.try_variant_get(v, "$.actions", "array<string>").alias("actions"))
    d = d.withColumn(out_col, F.struct(F.when(_c("_err").isNull(), content).alias("content"),
                                       _c("_err").alias("error")))
    return d.drop("_v", "_err")

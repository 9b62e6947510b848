"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression.  ``trigram_query`` derives from it a Boolean query: an
OR of alternatives, each an AND of the trigrams that any match must contain (letters
folded to lower case, which only widens the query).  The index is the relation of
postings (trigram, document) for the trigrams that the rules ask for; joining it with the
queries and gathering them per document and alternative intersects the posting lists.  They
are gathered by document, so a trigram that nearly all documents hold is no hot key: its
postings are combined before the shuffle.  Candidates are verified with the rule's expression
on the whole text.  A rule with an alternative that holds no trigram has no query and
scans every document.

Positions come from the text between matches: ``split`` and ``regexp_extract_all`` give
pieces and matches by turns, and their running lengths are the spans, in code points,
end exclusive.  A rule may ask for a least length of a group; matches that fail are
dropped, without another try inside them.

Defined cases: null text has no spans.  Ids may repeat or be null: candidates of an id
hold for all its rows, and verification is by row.  Only id and text are read, so other
columns can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: The contract's kinds, in its order.  A run of the class is maximal, so asking for its
#: length inside the pattern (access, hex) drops the same matches as a check after it.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abpr]-[0-9A-Za-z-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@"),
)
RULES = BASE_RULES + ADDED_RULES
#: A character class up to this size is spelt out, a larger one is a gap.
CLASS_SPELT = 5
ALTERNATIVES = 64
#: Matches whose places are found in one go.
RUN = 128


def fragments(pattern: str) -> list[list[str]]:
    """For each way through the pattern, the literal pieces that a match must contain; a
    gap (anything not spelt out) lies between two pieces."""
    from re import _constants as op
    from re import _parser

    gap = [["", ""]]  # two empty pieces: what stands left and right is not joined

    def joined(ways: list[list[str]], more: list[list[str]]) -> list[list[str]]:
        if len(ways) * len(more) > ALTERNATIVES:
            more = gap
        return [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(ways, more)]

    def of(items) -> list[list[str]]:
        ways = [[""]]
        for kind, arg in items:
            if kind is op.LITERAL:
                more = [[chr(arg).lower()]]
            elif kind is op.SUBPATTERN:
                more = of(arg[-1])
            elif kind is op.BRANCH:
                more = [w for branch in arg[1] for w in of(branch)]
            elif kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= CLASS_SPELT:
                more = [[chr(c).lower()] for _, c in arg]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                least, most, inner = arg
                once = of(inner)
                if (least, most) == (0, 1) and all(len(w) == 1 for w in once):
                    more = [[""], *once]
                elif least == most and least * len(once) <= 8:
                    more = [[""]]
                    for _ in range(least):
                        more = joined(more, once)
                elif least:
                    more = [[*w, ""] for w in once] if all(len(w) == 1 for w in once) else gap
                else:
                    more = gap
            else:
                more = gap
            ways = joined(ways, more)
        return ways

    return of(_parser.parse(pattern))


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """OR of ANDs of trigrams, or None where some way through the pattern has none."""
    query = []
    for pieces in fragments(rule.pattern):
        grams = sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})
        if not grams:
            return None
        query.append(grams)
    # an alternative that asks for all of another one, or more, adds nothing
    ways = sorted(set(map(tuple, query)))
    return [list(q) for q in ways if not any(set(o) < set(q) for o in ways)]


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The index: (trigram, id), once per row of ``docs`` that holds the trigram."""
    folded = F.lower(F.col(text_col))
    held = F.array(*[F.when(F.contains(folded, F.lit(g)), F.lit(g)) for g in trigrams])
    return docs.select(F.col(id_col).alias("__id"), F.explode(F.array_compact(held)).alias("__gram"))


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rules to verify), for the ids that meet the query of some rule."""
    spark = docs.sparkSession
    asked = [(r.kind, n, g, 1 << i, (1 << len(q)) - 1) for r in rules for n, q in enumerate(trigram_query(r) or []) for i, g in enumerate(q)]
    queries = spark.createDataFrame(asked or [("", 0, "", 0, 1)], "__kind string, __way int, __gram string, __bit long, __all long")
    index = postings(docs, sorted({a[2] for a in asked}) or [""], id_col, text_col)
    # one bit for each trigram of the alternative, so that rows which repeat an id don't count twice
    met = (
        index.join(F.broadcast(queries), "__gram")  # bounded by the rules, not by the data
        .groupBy("__id", "__kind", "__way", "__all").agg(F.bit_or("__bit").alias("__met"))
        .where(F.col("__met") == F.col("__all"))
    )
    return met.groupBy("__id").agg(F.collect_set("__kind").alias("__kinds"))


def turns_of(rule: Rule, text: Column) -> Column:
    """(gap, n, part) by turns: the length of the text before a match, of the match and of the group that is checked; the last has a gap only."""
    pattern = F.lit(rule.java)
    lengths = lambda xs: F.transform(xs, F.length)
    both = F.arrays_zip(lengths(F.split(text, rule.java, -1)).alias("gap"), lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("n"),
                        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    return F.when(F.regexp_like(text, pattern), both)


def _runs(turns: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.size(turns) / RUN).cast("int") - 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def run_totals(turns: Column) -> Column:
    """The text lengths of the runs of ``RUN`` turns."""
    return F.transform(_runs(turns), lambda r: _total(F.transform(F.slice(turns, r * RUN + 1, RUN), lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0)))))


def spans_of(rule: Rule, turns: Column, totals: Column) -> Column:
    """Array of (start, order, end, kind) of a rule's matches, in time that grows with their number: a run of turns starts at the
    sum of the runs before, and only a run's own list grows step by step."""
    def placed(r: Column) -> Column:
        return F.aggregate(
            F.slice(turns, r * RUN + 1, RUN),
            F.struct(_total(F.slice(totals, 1, r)).alias("at"), F.array().cast("array<struct<start:int,end:int,part:int>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
                F.when(x["n"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), F.length(x["part"]).alias("part"))))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    kept = F.filter(F.flatten(F.transform(_runs(turns), placed)), lambda s: s["part"] >= rule.least)
    order = [r.kind for r in RULES].index(rule.kind)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` (start, order, end, kind), by start, then rule."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    asked = candidates(rows, rules, id_col, "__text")
    joined = rows.join(asked, rows[id_col].eqNullSafe(asked["__id"]), "left")
    turns, totals = [f"__turns{i}" for i in range(len(rules))], [f"__totals{i}" for i in range(len(rules))]
    # in steps: what a lambda refers to must be a column, else it is computed anew for each element
    found = [turns_of(r, F.col("__text")) if trigram_query(r) is None else F.when(F.array_contains("__kinds", r.kind), turns_of(r, F.col("__text"))) for r in rules]
    step = joined.select(F.col(id_col), *[c.alias(t) for c, t in zip(found, turns)])
    step = step.select("*", *[run_totals(F.col(t)).alias(n) for t, n in zip(turns, totals)])
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = [F.coalesce(spans_of(r, F.col(t), F.col(n)), none) for r, t, n in zip(rules, turns, totals)]
    return step.select(F.col(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in base],
                        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))

"""Secret scans: an inverted index of trigrams finds the texts each rule has to look at."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser as regex_tree  # the standard library's own reading of a pattern

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm.columns import bind, kept_table, running_totals

_MOST_STRINGS = 8


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose group is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The three base kinds, in the order in which they are listed.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, base=True),
    # runs that are too short are no match here, which drops the same ones and makes fewer
    Rule("hex", r"[0-9a-f]{16,}", least=16, base=True),
)
# Formats that issuers document.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = (*BASE, *ADDED)

# A query is a conjunction of clauses, a clause a disjunction of sets of trigrams.
TrigramQuery = list[list[frozenset[str]]]


def _strings(node) -> set[str] | None:
    """All strings that a node matches, in lower case, if they are few."""
    kind, value = node
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        if all(str(k) == "LITERAL" for k, _ in value) and len(value) <= _MOST_STRINGS:
            return {chr(v).lower() for _, v in value}
        return None
    if name == "SUBPATTERN":
        return _all_strings(value[-1])
    if name == "BRANCH":
        sets = [_all_strings(branch) for branch in value[1]]
        return None if None in sets else set().union(*sets)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = value
        one = _all_strings(body)
        if one is not None and (low, high) == (0, 1):
            return one | {""}
        if one is not None and low == high and len(one) ** low <= _MOST_STRINGS:
            return {"".join(p) for p in product(one, repeat=low)}
    return None


def _all_strings(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        one = _strings(node)
        if one is None or len(found) * len(one) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _clause(strings: set[str]) -> TrigramQuery:
    """One of the strings is present; nothing follows if one is shorter than a trigram."""
    if any(len(s) < 3 for s in strings):
        return []
    return [sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)]


def _of_nodes(nodes) -> TrigramQuery:
    clauses: TrigramQuery = []
    run = {""}
    for node in nodes:
        one = _strings(node)
        if one is not None and len(run) * len(one) <= _MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        clauses += _clause(run)
        run = one if one is not None else {""}
        if one is None:
            kind, value = node
            if str(kind) == "SUBPATTERN":
                clauses += _of_nodes(value[-1])
            elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                clauses += _of_nodes(value[2])
    return clauses + _clause(run)


def trigram_query(pattern: str) -> TrigramQuery:
    """Trigrams that a text must have, in lower case, for the pattern to match in it.

    An empty query says nothing: the rule has no mandatory trigram.
    """
    return _of_nodes(regex_tree.parse(pattern))


def postings(docs: DataFrame, trigrams: Sequence[str], *, key: str, text: str) -> DataFrame:
    """The inverted index (trigram, doc_id) over those trigrams that the rules ask for."""
    lowered = docs.select(F.col(f"`{key}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("low"))
    met = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]
    return lowered.select("doc_id", F.explode(F.array_compact(F.array(*met))).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, TrigramQuery]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query holds, by intersecting postings."""
    lists = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("met"))

    def held(query: TrigramQuery) -> Column:
        clauses = [
            reduce(
                lambda a, b: a | b,
                [
                    reduce(lambda a, b: a & b, [F.array_contains("met", t) for t in sorted(every)])
                    for every in clause
                ],
            )
            for clause in query
        ]
        return reduce(lambda a, b: a & b, clauses)

    kinds = [F.when(held(query), F.lit(kind)) for kind, query in queries.items()]
    return lists.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(
        F.size("kinds") > 0
    )


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, kind, end) of the rule's matches in code points, from the text between them."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            moved = F.transform(
                m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("bigint")
            )

            def cut(before: Column) -> Column:
                every = F.transform(
                    m,
                    lambda x, i: F.struct(
                        (F.get(before, i) + F.length(F.get(g, i))).alias("start"),
                        F.lit(number).alias("kind"),
                        (F.get(before, i) + F.length(F.get(g, i)) + F.length(x)).alias("end"),
                        x.alias("match"),
                    ),
                )
                long_enough = F.filter(
                    every,
                    lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group))
                    >= rule.least,
                )
                return F.transform(
                    long_enough, lambda s: F.struct(s["start"], s["kind"], s["end"])
                )

            return bind(running_totals(moved), cut)

        return F.when(F.size(m) > 0, bind(gaps, with_gaps))

    return F.coalesce(bind(matches, placed).cast(_SPANS), F.array().cast(_SPANS))


def _joined(spans: Column, kinds: Sequence[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    told = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    )
    return F.array_join(told, ",")


def _n_of(number: int) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == number)).cast("bigint")


def secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every secret in every text, one row per input row.

    ``found`` holds (start, kind, end) in code points, end exclusive, by start and then
    by the order of the rules; ``spans`` the same as text, ``base_spans`` those of the
    base rules. Rules with mandatory trigrams look only at texts that the inverted index
    names for them, the others at all texts; matches are the same either way.

    A null text counts as an empty one and has no span. Rows that share a key, or have
    none, are candidates together and are verified one by one. An empty table gives no
    row. Other columns are left out, so that their names cannot clash.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: query for kind, query in queries.items() if query}
    needed = sorted({t for q in indexed.values() for clause in q for every in clause for t in every})
    body = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    named = kept_table(
        candidates(postings(body, needed, key="doc_id", text="text"), indexed), "secret-candidates"
    )
    named = named.withColumnRenamed("doc_id", "named")
    joined = body.join(named, body["doc_id"].eqNullSafe(named["named"]), "left")

    def of_rule(number: int, rule: Rule) -> Column:
        spans = _spans(F.col("text"), rule, number)
        if rule.kind not in indexed:
            return spans
        return F.when(F.array_contains("kinds", rule.kind), spans)

    kinds = [r.kind for r in rules]
    parts = [of_rule(i, r) for i, r in enumerate(rules)]
    none = F.array().cast(_SPANS)
    base = [i for i, r in enumerate(rules) if r.base]
    found = joined.select(
        "doc_id", F.sort_array(F.concat(*[F.coalesce(p, none) for p in parts])).alias("found")
    )
    of_base = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        "found",
        _joined(F.col("found"), kinds).alias("spans"),
        _joined(of_base, kinds).alias("base_spans"),
        *[_n_of(i).alias(f"n_{kinds[i]}") for i in base],
    )

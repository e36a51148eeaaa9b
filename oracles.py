"""The queries of ``__spark_entry__`` in plain SQL, for an independent engine."""

from __future__ import annotations

from groveline import presets as P
from groveline.operators.models import DEFAULT, SHALLOW
from groveline.operators.tuning import DEPTHS, FOLDS
from groveline.sources.campaign import MULTIPLIER

FEATURES = P.FEATURES
ENCODED = [*FEATURES, P.LABEL]
TEXT = [*P.CATEGORIES, P.UNUSED]


def _q(name: str) -> str:
    return f'"{name}"'


def _draw(name: str, n: int) -> str:
    return (
        f"(((((o_orderkey + 1) % 2147483647) * {MULTIPLIER[name]}) % 2147483647) % 1000003) % {n}"
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(name: str, values: list[str]) -> str:
    return f"{_list(values)}[{_draw(name, len(values))} + 1]"


def _campaign() -> str:
    columns = {
        "age": f"CAST(18 + {_draw('age', 70)} AS INT)",
        "job": _pick("job", P.JOB),
        "marital": _pick("marital", P.MARITAL),
        "education": _pick("education", P.EDUCATION),
        "default": _pick("default", P.YES_NO),
        "balance": "CAST(floor(o_totalprice / 100) AS INT)",
        "housing": "CASE o_orderstatus WHEN 'O' THEN 'yes' ELSE 'no' END",
        "loan": "CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' ELSE 'no' END",
        "contact": _pick("contact", P.CONTACT),
        "day": "CAST(day(o_orderdate) AS INT)",
        "month": f"{_list(P.MONTH)}[month(o_orderdate)]",
        "duration": f"CAST({_draw('duration', 1500)} AS INT)",
        "campaign": f"CAST(1 + {_draw('campaign', 8)} AS INT)",
        "pdays": f"CAST({_draw('pdays', 400)} - 1 AS INT)",
        "previous": f"CAST({_draw('previous', 6)} AS INT)",
        "poutcome": _pick("poutcome", P.POUTCOME),
        "deposit": (
            f"CASE WHEN {_draw('noise', 10)} = 0"
            f" THEN CASE WHEN {_draw('flip', 2)} = 0 THEN 'yes' ELSE 'no' END"
            f" WHEN {_draw('duration', 1500)} >= 900 THEN 'yes'"
            " WHEN o_orderstatus <> 'O' AND o_totalprice > 400000 THEN 'yes' ELSE 'no' END"
        ),
    }
    shown = ",\n  ".join(f"{columns[c]} AS {_q(c)}" for c in P.CAMPAIGN_COLUMNS)
    return f"SELECT o_orderkey AS row_id,\n  {shown}\nFROM orders"


def _code(name: str) -> str:
    return f"CAST(list_position({_list(P.CATEGORIES[name])}, {_q(name)}) - 1 AS DOUBLE)"


def _encoded() -> str:
    shown = ", ".join(
        f"{_code(c)} AS {_q(c)}" if c in P.CATEGORIES else _q(c) for c in ENCODED
    )
    return f"SELECT row_id, {shown} FROM campaign"


def _hash(salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || CAST(row_id AS VARCHAR)), 1, 8))::BIGINT"


def _uniform(salt: str) -> str:
    return f"({_hash(salt)} / 4294967296.0::DOUBLE)"


_IS_TRAIN = f"{_uniform('split:')} < 0.8::DOUBLE"
_VECTOR = ", ".join(f"CAST({_q(c)} AS DOUBLE) AS f{i}" for i, c in enumerate(FEATURES))

def _coarse() -> str:
    shown = ", ".join(
        f"CAST(least(floor(({_q(c)} - ({P.GROUPS[c][0]})) / {P.GROUPS[c][1]}.0::DOUBLE), {P.MOST_GROUPS - 1}) AS INT)"
        f" AS {_q(c)}"
        for c in P.GROUPS
    )
    return f"SELECT * REPLACE ({shown}) FROM encoded"


CTES = {
    "campaign": _campaign(),
    "encoded": _encoded(),
    "coarse": _coarse(),
    "fractions": (
        "SELECT deposit AS class, min(count(*)) OVER () / count(*)::DOUBLE AS fraction"
        " FROM encoded GROUP BY deposit"
    ),
    "balanced": (
        "SELECT encoded.* FROM encoded JOIN fractions ON deposit = class"
        f" WHERE {_uniform('strat:')} < fraction"
    ),
    "coarse_balanced": "SELECT * FROM coarse WHERE row_id IN (SELECT row_id FROM balanced)",
}


def _with(body: str, extra: dict[str, str] | None = None) -> str:
    ctes = {**CTES, **(extra or {})}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + f"\n{body}"


def _describe(table: str, columns: list[str], where: str = "TRUE") -> str:
    parts = []
    for c in columns:
        text = table == "campaign" and c in TEXT
        number = f"try_cast({_q(c)} AS DOUBLE)" if text else f"{_q(c)}::DOUBLE"
        low = "NULL::DOUBLE" if text else f"min({_q(c)})::DOUBLE"
        high = "NULL::DOUBLE" if text else f"max({_q(c)})::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({_q(c)}) AS count,"
            f" round(avg({number}), 6) AS mean, round(stddev_samp({number}), 6) AS stddev,"
            f" {low} AS min, {high} AS max, min({_q(c)})::VARCHAR AS min_text,"
            f" max({_q(c)})::VARCHAR AS max_text FROM {table} WHERE {where}"
        )
    return _with("\nUNION ALL ".join(parts))


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(ENCODED) for b in ENCODED[i + 1 :]]


def _corr() -> str:
    return _with(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\","
            f" round(corr({_q(a)}, {_q(b)}), 6) + 0.0::DOUBLE AS corr FROM encoded"
            for a, b in _pairs()
        )
    )


def _binned() -> dict[str, str]:
    limits = ", ".join(
        f"min({_q(c)})::DOUBLE AS {_q('lo_' + c)}, max({_q(c)})::DOUBLE AS {_q('hi_' + c)}"
        for c in ENCODED
    )

    def place(c: str) -> str:
        lo, hi = _q("lo_" + c), _q("hi_" + c)
        return f"least(floor(({_q(c)}::DOUBLE - {lo}) / ({hi} - {lo}) * 10), 9)::INT AS {_q(c)}"

    return {
        "limits": f"SELECT {limits} FROM encoded",
        "binned": f"SELECT {', '.join(place(c) for c in ENCODED)} FROM encoded, limits",
    }


def _hist_1d() -> str:
    parts = []
    for c in ENCODED:
        lo, hi = _q("lo_" + c), _q("hi_" + c)
        parts.append(
            f"SELECT '{c}' AS \"column\", {_q(c)} AS bin,"
            f" round(any_value({lo} + ({hi} - {lo}) / 10 * {_q(c)}), 6) AS lower,"
            f" round(any_value({lo} + ({hi} - {lo}) / 10 * ({_q(c)} + 1)), 6) AS upper,"
            f" count(*) AS n FROM binned, limits GROUP BY {_q(c)}"
        )
    return _with("\nUNION ALL ".join(parts), _binned())


def _hist_2d() -> str:
    return _with(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {_q(a)} AS left_bin,"
            f" {_q(b)} AS right_bin, count(*) AS n FROM binned GROUP BY {_q(a)}, {_q(b)}"
            for a, b in _pairs()
        ),
        _binned(),
    )


def _split_search(prefix: str, rows: str) -> dict[str, str]:
    """The best split by gini gain of each node of ``rows`` (node, deposit, features)."""
    values = " UNION ALL ".join(
        f"SELECT node, {i} AS f, {_q(c)}::DOUBLE AS v, deposit AS y FROM {rows}"
        for i, c in enumerate(FEATURES)
    )

    def gini(p: str, n: str) -> str:
        return f"2 * ({p} / {n}) * (1 - {p} / {n})"

    return {
        f"{prefix}_values": values,
        f"{prefix}_hist": (
            f"SELECT node, f, v, count(*)::DOUBLE AS n, sum(y) AS p FROM {prefix}_values GROUP BY ALL"
        ),
        f"{prefix}_sums": (
            "SELECT node, f, v, lead(v) OVER w AS nv, sum(n) OVER w AS nl, sum(p) OVER w AS pl,"
            " sum(n) OVER (PARTITION BY node, f) AS nt, sum(p) OVER (PARTITION BY node, f) AS pt"
            f" FROM {prefix}_hist WINDOW w AS (PARTITION BY node, f ORDER BY v)"
        ),
        f"{prefix}_gains": (
            "SELECT node, f, (v + nv) / 2 AS thr,"
            f" {gini('pt', 'nt')} - (nl / nt) * {gini('pl', 'nl')}"
            f" - ((nt - nl) / nt) * {gini('(pt - pl)', '(nt - nl)')} AS gain,"
            " pl / nl > 0.5 AS low_yes, (pt - pl) / (nt - nl) > 0.5 AS high_yes"
            f" FROM {prefix}_sums WHERE nv IS NOT NULL"
        ),
        f"{prefix}_best": (
            f"SELECT * FROM {prefix}_gains WHERE gain > 0"
            " QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, thr) = 1"
        ),
    }


def _value_of(best: str) -> str:
    return (
        f"CASE {best}.f "
        + " ".join(f"WHEN {i} THEN {_q(c)}::DOUBLE" for i, c in enumerate(FEATURES))
        + " END"
    )


def _stump(table: str = "coarse", tag: str = "s") -> dict[str, str]:
    """Train on the split of ``table`` and score its test rows, one split deep."""
    best = f"{tag}1_best"
    return {
        f"{tag}_train": f"SELECT 0 AS node, * FROM {table} WHERE {_IS_TRAIN}",
        **_split_search(f"{tag}1", f"{tag}_train"),
        f"{tag}_scored": (
            f"SELECT t.*, CASE WHEN CASE WHEN {_value_of(best)} <= thr THEN low_yes ELSE high_yes END"
            f" THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction"
            f" FROM (SELECT * FROM {table} WHERE NOT ({_IS_TRAIN})) t, {best}"
        ),
        f"{tag}_counts": (
            "SELECT deposit AS label, prediction, count(*) AS n"
            f" FROM {tag}_scored GROUP BY ALL"
        ),
    }


_X = "[" + ", ".join(f"{_q(c)}::DOUBLE" for c in FEATURES) + "] AS x"


def _gini(n: str, s: str) -> str:
    no, yes = f"(({n} - {s}) / {n})", f"({s} / {n})"
    return f"(1 - {no} * {no} - {yes} * {yes})"


def _variance(n: str, s: str, q: str) -> str:
    return f"(({q} - {s} * {s} / {n}) / {n})"


def _grown(tag: str, rows: str, depth: int, target: str = "label") -> dict[str, str]:
    """Trees grown level by level, one for every ``tree`` of ``rows`` (tree, x, t).

    Node n has the children 2n and 2n + 1. Every level is one histogram of the rows by node,
    feature and value, its running sums, and the best split of each node: of Gini impurity
    for a 0/1 ``label``, of variance for a ``number``. Thresholds are halfway between
    neighbouring values of all training rows. ``{tag}_splits`` has the splits,
    ``{tag}_nodes`` the rows and the sum of targets of every node.
    """
    features = f"unnest(range({len(FEATURES)})) AS f, unnest(x) AS v"
    if target == "label":
        parts = _gini("nt", "st"), _gini("nl", "sl"), _gini("(nt - nl)", "(st - sl)")
    else:
        parts = (
            _variance("nt", "st", "qt"),
            _variance("nl", "sl", "ql"),
            _variance("(nt - nl)", "(st - sl)", "(qt - ql)"),
        )
    gain = f"{parts[0]} - (nl / nt) * {parts[1]} - ((nt - nl) / nt) * {parts[2]}"
    ctes = {
        f"{tag}_grid": (
            "SELECT tree, f, v, (v + lead(v) OVER (PARTITION BY tree, f ORDER BY v)) / 2 AS thr"
            f" FROM (SELECT DISTINCT tree, {features} FROM {rows})"
        ),
        f"{tag}_rows0": f"SELECT tree, x, t, 1::BIGINT AS node FROM {rows}",
    }
    for level in range(depth):
        here, after = f"{tag}_rows{level}", f"{tag}_rows{level + 1}"
        ctes[f"{tag}_sums{level}"] = (
            "SELECT tree, node, f, v, lead(v) OVER w IS NOT NULL AS more,"
            " sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(q) OVER w AS ql,"
            " sum(n) OVER a AS nt, sum(s) OVER a AS st, sum(q) OVER a AS qt FROM ("
            " SELECT tree, node, f, v, count(*)::DOUBLE AS n, sum(t) AS s, sum(t * t) AS q"
            f" FROM (SELECT tree, node, t, {features} FROM {here}) GROUP BY ALL)"
            " WINDOW w AS (PARTITION BY tree, node, f ORDER BY v), a AS (PARTITION BY tree, node, f)"
        )
        ctes[f"{tag}_best{level}"] = (
            f"SELECT tree, node, f, thr FROM (SELECT *, {gain} AS gain FROM {tag}_sums{level} WHERE more)"
            f" JOIN {tag}_grid USING (tree, f, v) WHERE gain > 0"
            " QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, v) = 1"
        )
        ctes[after] = (
            "SELECT r.* REPLACE (2 * r.node + CASE WHEN r.x[f + 1] <= thr THEN 0 ELSE 1 END AS node)"
            f" FROM {here} r JOIN {tag}_best{level} USING (tree, node)"
        )
    ctes[f"{tag}_splits"] = " UNION ALL ".join(f"SELECT * FROM {tag}_best{n}" for n in range(depth))
    ctes[f"{tag}_nodes"] = " UNION ALL ".join(
        f"SELECT tree, node, count(*)::DOUBLE AS n, sum(t) AS s FROM {tag}_rows{n} GROUP BY ALL"
        for n in range(depth + 1)
    )
    return ctes


def _walked(tag: str, tests: str, depth: int) -> dict[str, str]:
    """``{tag}_leaves``: the rows of ``tests`` (tree, x, ...) with the ``node`` they end in."""
    ctes = {f"{tag}_at0": f"SELECT *, 1::BIGINT AS node FROM {tests}"}
    for level in range(depth):
        ctes[f"{tag}_at{level + 1}"] = (
            "SELECT a.* REPLACE (CASE WHEN f IS NULL THEN a.node WHEN a.x[f + 1] <= thr THEN 2 * a.node"
            f" ELSE 2 * a.node + 1 END AS node) FROM {tag}_at{level} a LEFT JOIN {tag}_best{level} USING (tree, node)"
        )
    ctes[f"{tag}_leaves"] = f"SELECT * FROM {tag}_at{depth}"
    return ctes


def _rows_of(table: str, where: str, extra: str = "") -> str:
    return f"SELECT 0 AS tree, row_id, deposit, {_X}, deposit::DOUBLE AS t{extra} FROM {table} WHERE {where}"


def _tree(table: str, depth: int) -> dict[str, str]:
    """One decision tree and the counts of its test rows, as ``d_counts``."""
    return {
        "d_train": _rows_of(table, _IS_TRAIN),
        "d_test": _rows_of(table, f"NOT ({_IS_TRAIN})"),
        **_grown("d", "d_train", depth),
        **_walked("d", "d_test", depth),
        "d_counts": (
            "SELECT deposit AS label, CASE WHEN s / n > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction,"
            " count(*) AS n FROM d_leaves JOIN (SELECT tree, node, n, s FROM d_nodes) USING (tree, node) GROUP BY 1, 2"
        ),
    }


def _boosted(table: str, rounds: int, depth: int, step: float) -> dict[str, str]:
    """Boosted trees with log loss, and the counts of the test rows, as ``g_counts``.

    The first tree counts whole, the others by the step; each fits four times the label
    over one plus the exponential of twice the margin.
    """
    y = "(2 * deposit - 1)::DOUBLE"
    ctes = {"g0": _rows_of(table, "TRUE", f", {y} AS y, 0::DOUBLE AS margin, {_IS_TRAIN} AS train")}
    for k in range(rounds):
        tag, target = f"g{k}t", "y" if k == 0 else "4 * y / (1 + exp(2 * y * margin))"
        weight = 1.0 if k == 0 else step
        ctes |= {
            f"{tag}_train": f"SELECT tree, x, {target} AS t FROM g{k} WHERE train",
            **_grown(tag, f"{tag}_train", depth, "number"),
            **_walked(tag, f"g{k}", depth),
            f"g{k + 1}": (
                f"SELECT l.* EXCLUDE (node) REPLACE (margin + s / n * {weight}::DOUBLE AS margin)"
                f" FROM {tag}_leaves l JOIN {tag}_nodes USING (tree, node)"
            ),
        }
    ctes["g_counts"] = (
        "SELECT deposit AS label, CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction,"
        f" count(*) AS n FROM g{rounds} WHERE NOT train GROUP BY ALL"
    )
    return ctes


def _boosted_preset(table: str, preset: dict) -> dict[str, str]:
    return _boosted(table, preset["maxIter"], preset.get("maxDepth", 5), preset.get("stepSize", 0.1))


def _at_depth(leaves: str, depth: str) -> str:
    """The node that a tree cut off at ``depth`` ends in, for rows of ``leaves``."""
    return f"SELECT * REPLACE (node >> greatest(0, floor(log2(node))::INT - {depth}) AS node) FROM {leaves}"


def _depth_search(depths: list[int] = DEPTHS) -> dict[str, str]:
    """Three folds, every depth; the best one is fitted again on all training rows.

    A tree grows level by level, so that of a smaller depth is the deepest one cut off.
    """
    deepest = max(depths)
    area = (
        "(count(*) FILTER (WHERE deposit = 1 AND yes) / count(*) FILTER (WHERE deposit = 1)::DOUBLE"
        " + count(*) FILTER (WHERE deposit = 0 AND NOT yes) / count(*) FILTER (WHERE deposit = 0)::DOUBLE) / 2"
    )
    ctes = {
        "c_all": _rows_of("coarse_balanced", _IS_TRAIN, f", ({_hash('fold:')} % {FOLDS})::INT AS fold"),
        "c_train": f"SELECT c_all.* REPLACE (k.k AS tree) FROM c_all, (SELECT unnest(range({FOLDS})) AS k) k WHERE fold <> k",
        "c_held": "SELECT * REPLACE (fold AS tree) FROM c_all",
        **_grown("c", "c_train", deepest),
        **_walked("c", "c_held", deepest),
        "c_cut": " UNION ALL ".join(f"SELECT {d} AS depth, * FROM ({_at_depth('c_leaves', str(d))})" for d in depths),
        "c_area": (
            f"SELECT depth, tree, {area} AS area FROM (SELECT depth, tree, deposit, s / n > 0.5 AS yes"
            " FROM c_cut JOIN c_nodes USING (tree, node)) GROUP BY depth, tree"
        ),
        "c_average": "SELECT depth, avg(area) AS area FROM c_area GROUP BY depth",
        "c_chosen": "SELECT depth AS best FROM c_average ORDER BY area DESC, depth LIMIT 1",
        "f_test": _rows_of("coarse_balanced", f"NOT ({_IS_TRAIN})"),
        **_grown("f", "c_all", deepest),
        **_walked("f", "f_test", deepest),
        "f_scored": (
            "SELECT row_id, deposit, CASE WHEN s / n > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction"
            f" FROM ({_at_depth('(SELECT * FROM f_leaves, c_chosen)', 'best')}) JOIN f_nodes USING (tree, node)"
        ),
        "f_counts": "SELECT deposit AS label, prediction, count(*) AS n FROM f_scored GROUP BY ALL",
        f"z{deepest + 1}": "SELECT 0::BIGINT AS node, 0 AS nodes, 0 AS depth, TRUE AS yes WHERE FALSE",
    }
    # from the leaves up: leaves of one parent that agree are one leaf
    for level in range(deepest, -1, -1):
        under = f"z{level + 1}"
        ctes[f"z{level}"] = (
            "SELECT m.node, CASE WHEN leaf OR one THEN 1 ELSE 1 + l + r END AS nodes,"
            " CASE WHEN leaf OR one THEN 0 ELSE 1 + greatest(dl, dr) END AS depth,"
            " CASE WHEN leaf THEN s / n > 0.5 WHEN one THEN yl END AS yes FROM ("
            " SELECT m.node, m.n, m.s, a.node IS NULL AS leaf, a.nodes AS l, b.nodes AS r, a.depth AS dl,"
            " b.depth AS dr, a.yes AS yl, coalesce(a.nodes = 1 AND b.nodes = 1 AND a.yes = b.yes, FALSE) AS one"
            f" FROM f_nodes m, c_chosen LEFT JOIN {under} a ON a.node = 2 * m.node AND {level} < best"
            f" LEFT JOIN {under} b ON b.node = 2 * m.node + 1 AND {level} < best"
            f" WHERE m.node >= {1 << level} AND m.node < {2 << level}) m"
        )
    return ctes


def _matrix(counts: str) -> str:
    return (
        "SELECT label, prediction, coalesce(n, 0) AS n FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) a(label)"
        " CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) b(prediction)"
        f" LEFT JOIN {counts} USING (label, prediction)"
    )


def _per_label(tag: str) -> dict[str, str]:
    return {
        f"{tag}_sides": (
            "SELECT label, n AS n_label, 0 AS n_predicted,"
            f" CASE WHEN label = prediction THEN n ELSE 0 END AS n_hit FROM {tag}_counts"
            f" UNION ALL SELECT prediction, 0, n, 0 FROM {tag}_counts"
        ),
        f"{tag}_totals": (
            "SELECT label, sum(n_label)::DOUBLE AS rows, sum(n_predicted)::DOUBLE AS predicted,"
            f" sum(n_hit)::DOUBLE AS hits FROM {tag}_sides GROUP BY label"
        ),
        f"{tag}_ratios": (
            "SELECT label, rows, hits, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END::DOUBLE"
            " AS precision, CASE WHEN rows = 0 THEN 0.0 ELSE hits / rows END::DOUBLE AS recall"
            f" FROM {tag}_totals"
        ),
        f"{tag}_labels": (
            "SELECT *, CASE WHEN precision + recall = 0 THEN 0.0"
            f" ELSE 2 * precision * recall / (precision + recall) END::DOUBLE AS f1 FROM {tag}_ratios"
        ),
    }


def _long(tag: str, overall: list[str], per_label: list[str], lead: str = "") -> str:
    whole = {
        "accuracy": "sum(hits) / sum(rows)",
        "f1_micro": "sum(hits) / sum(rows)",
        "f1_weighted": "sum(f1 * rows) / sum(rows)",
        "precision_weighted": "sum(precision * rows) / sum(rows)",
        "recall_weighted": "sum(recall * rows) / sum(rows)",
    }
    parts = [
        f"SELECT {lead}'{m}' AS metric, NULL::DOUBLE AS label, round({whole[m]}, 9) AS value"
        f" FROM {tag}_labels"
        for m in overall
    ] + [
        f"SELECT {lead}'{m}' AS metric, label, round({m}, 9) AS value FROM {tag}_labels"
        for m in per_label
    ]
    return "\nUNION ALL ".join(parts)


_OVERALL = ["accuracy", "f1_micro", "f1_weighted", "precision_weighted", "recall_weighted"]
_SPARK_TYPES = {"row_id": "bigint", **{c: "int" for c in FEATURES}, **{c: "string" for c in TEXT}}


def _schema_profile() -> str:
    sure = ("housing", "loan", "deposit")
    return _with(
        "\nUNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{_SPARK_TYPES[c]}' AS type,"
            f" {str(c not in sure).upper()} AS nullable, count({_q(c)}) AS n_values,"
            f" count(*) - count({_q(c)}) AS n_nulls FROM campaign"
            for i, c in enumerate(["row_id", *P.CAMPAIGN_COLUMNS])
        )
    )


def oracle_sql() -> dict[str, str]:
    labels = _per_label("s")
    both = {**_stump("coarse", "s"), **_stump("coarse_balanced", "b"), **labels, **_per_label("b")}
    encoders = {
        "job": ["job"], "marital": ["marital"], "education": ["education"],
        "binary": ["housing", "loan", "deposit"], "contact": ["contact"], "month": ["month"],
        "poutcome": ["poutcome"],
    }
    part = f"CASE WHEN {_IS_TRAIN} THEN 'train' ELSE 'test' END AS part"
    nominal = {"housing", "loan"}
    auc = (
        "(sum(CASE WHEN label = 1 AND prediction = 1 THEN n ELSE 0 END)"
        " / sum(CASE WHEN label = 1 THEN n ELSE 0 END)::DOUBLE"
        " + sum(CASE WHEN label = 0 AND prediction = 0 THEN n ELSE 0 END)"
        " / sum(CASE WHEN label = 0 THEN n ELSE 0 END)::DOUBLE) / 2"
    )
    rank = (
        "SELECT deposit AS y, avg(place) OVER (PARTITION BY duration) AS r FROM"
        " (SELECT deposit, duration, row_number() OVER (ORDER BY duration)::DOUBLE AS place"
        f" FROM coarse WHERE NOT ({_IS_TRAIN}))"
    )
    search = _depth_search()
    return {
        "scan_csv": _with("SELECT * FROM campaign"),
        "scan_csv_inferred": _with("SELECT * FROM campaign"),
        "schema_profile": _schema_profile(),
        "drop_column": _with("SELECT * EXCLUDE (\"default\") FROM campaign"),
        "encode_all": _with("SELECT * FROM encoded"),
        **{
            f"encode_{name}": _with(
                f"SELECT row_id, {', '.join(_q(c) for c in columns)} FROM encoded"
            )
            for name, columns in encoders.items()
        },
        "materialised_encode": _with("SELECT * FROM encoded"),
        "bounded_collect": _with("SELECT deposit, count(*) AS n FROM campaign GROUP BY deposit"),
        "numeric_columns": (
            "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"
        ),
        "preview": _with("SELECT * FROM campaign ORDER BY row_id LIMIT 5"),
        "class_counts": _with("SELECT deposit, count(*) AS n FROM campaign GROUP BY deposit"),
        "class_counts_balanced": _with(
            "SELECT deposit, count(*) AS n FROM balanced GROUP BY deposit"
        ),
        "describe_raw": _describe("campaign", P.CAMPAIGN_COLUMNS),
        "describe_encoded": _describe("encoded", ENCODED),
        "describe_train": _describe("encoded", ENCODED, _IS_TRAIN),
        "corr_pairs": _corr(),
        "hist_1d": _hist_1d(),
        "hist_2d": _hist_2d(),
        "stratified_sample": _with("SELECT row_id, deposit FROM balanced"),
        "random_split": _with(f"SELECT row_id, {part} FROM encoded"),
        "split_balanced": _with(f"SELECT row_id, deposit, {part} FROM balanced"),
        "bernoulli_sample": _with(
            f"SELECT * FROM encoded WHERE {_IS_TRAIN} AND {_uniform('samp:')} < 0.02::DOUBLE"
        ),
        "kfold_assign": _with(
            f"SELECT row_id, ({_hash('fold:')} % 3)::INT AS fold FROM balanced WHERE {_IS_TRAIN}"
        ),
        "assemble_features": _with(f"SELECT row_id, deposit, {_VECTOR} FROM encoded"),
        "assemble_nominal": _with(
            "\nUNION ALL ".join(
                f"SELECT {i} AS position, '{c}' AS name,"
                f" '{'nominal' if c in nominal else 'numeric'}' AS kind,"
                f" {2 if c in nominal else 0} AS arity,"
                f" count(*) AS n, sum({_q(c)}::DOUBLE) AS total FROM encoded"
                for i, c in enumerate(FEATURES)
            )
        ),
        "score_select": _with(
            f"SELECT row_id, prediction, deposit, {_VECTOR} FROM s_scored", _stump()
        ),
        "score_preview": _with(
            f"SELECT row_id, prediction, deposit, {_VECTOR} FROM s_scored ORDER BY row_id LIMIT 25",
            _stump(),
        ),
        "predictions_labels": _with("SELECT prediction, deposit AS label FROM s_scored", _stump()),
        "tree_rules": _with(
            "SELECT 0 AS tree, line_no, CASE line_no"
            " WHEN 0 THEN 'If (feature ' || f || ' <= ' || thr || ')'"
            " WHEN 1 THEN 'Predict: ' || CASE WHEN low_yes THEN '1.0' ELSE '0.0' END"
            " WHEN 2 THEN 'Else (feature ' || f || ' > ' || thr || ')'"
            " ELSE 'Predict: ' || CASE WHEN high_yes THEN '1.0' ELSE '0.0' END END AS text"
            " FROM s1_best, (VALUES (0), (1), (2), (3)) lines(line_no)",
            _stump(),
        ),
        "confusion_matrix": _with(_matrix("s_counts"), _stump()),
        "confusion_matrix_balanced": _with(_matrix("b_counts"), _stump("coarse_balanced", "b")),
        # trees of a forest that draws nothing are all the one tree
        **{f"{m}_exact": _with(_matrix("d_counts"), _tree("coarse", 2)) for m in ("dt_depth2", "rf")},
        **{
            f"{m}_balanced_exact": _with(_matrix("d_counts"), _tree("coarse_balanced", 2))
            for m in ("dt_depth2", "rf")
        },
        "dt_default_exact": _with(_matrix("d_counts"), _tree("coarse_balanced", 5)),
        "gbt_exact": _with(_matrix("g_counts"), _boosted_preset("coarse", SHALLOW["gbt"])),
        "gbt_balanced_exact": _with(_matrix("g_counts"), _boosted_preset("coarse_balanced", SHALLOW["gbt"])),
        "gbt_10_exact": _with(_matrix("g_counts"), _boosted_preset("coarse_balanced", DEFAULT["gbt"])),
        "score_gbt_exact": _with(
            "SELECT row_id, CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction, deposit,"
            " round(margin, 6) + 0.0::DOUBLE AS margin FROM g10 WHERE NOT train",
            _boosted_preset("coarse_balanced", DEFAULT["gbt"]),
        ),
        "cv_exact": _with(
            "SELECT depth AS max_depth, round(area, 9) AS avg_auc, depth = best AS chosen"
            " FROM c_average, c_chosen",
            search,
        ),
        "best_model_exact": _with(
            "SELECT depth::INT AS depth, nodes::INT AS num_nodes, 1 AS num_trees,"
            f" {len(FEATURES)} AS num_features FROM z0",
            search,
        ),
        "score_tuned_exact": _with("SELECT row_id, prediction, deposit FROM f_scored", search),
        "auc_tuned_exact": _with(f"SELECT round({auc}, 9) AS auc FROM f_counts", search),
        "precision_by_label": _with(
            "SELECT label, precision FROM s_labels", {**_stump(), **labels}
        ),
        "recall_by_label": _with("SELECT label, recall FROM s_labels", {**_stump(), **labels}),
        "f_measures": _with(
            _long("s", ["accuracy", "f1_micro", "f1_weighted"], ["f1"]), {**_stump(), **labels}
        ),
        "metric_report": _with(
            _long("s", _OVERALL, ["precision", "recall", "f1"], "'unbalanced' AS dataset, 'dt' AS model, ")
            + "\nUNION ALL "
            + _long("b", _OVERALL, ["precision", "recall", "f1"], "'balanced' AS dataset, 'dt' AS model, "),
            both,
        ),
        "auc_hard": _with(f"SELECT round({auc}, 9) AS auc FROM s_counts", _stump()),
        "auc_score": _with(
            f"SELECT 'tree' AS score, round({auc}, 6) AS auc FROM s_counts UNION ALL"
            " SELECT 'duration', round((sum(y * r) - sum(y) * (sum(y) + 1) / 2)"
            " / (sum(y) * (count(*) - sum(y))), 6) FROM ranked",
            {**_stump(), "ranked": rank},
        ),
    }

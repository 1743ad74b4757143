"""DuckDB SQL equivalents of the catalog queries (tables pre-registered as
views). Queries left out here are checked rows-only: trained models with
random initialisation or no closed form."""

from __future__ import annotations

from kilowatt.plans import catalog as C

_HOURLY = """
    SELECT event_type, date_trunc('hour', ts) AS hour_ts, SUM(value) AS load, COUNT(*) AS n_events
    FROM events GROUP BY ALL
"""

def _words_sql(content: str, where: str) -> str:
    """Text -> lines (text-file rules on ``content``) -> words (split on
    single spaces) -> (word, count)."""
    return rf"""
    WITH l AS (
        SELECT unnest(string_split_regex(regexp_replace({content}, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) AS line
        FROM documents WHERE {where}
    ), w AS (
        SELECT CASE WHEN line = '' THEN ['']
                    WHEN rtrim(line, ' ') = '' THEN []::VARCHAR[]
                    ELSE string_split(rtrim(line, ' '), ' ') END AS ws
        FROM l
    )
    SELECT word, COUNT(*) AS count FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word
    """


# A text column read as file content; empty texts have no lines.
_WORDS = _words_sql("text", "text IS NOT NULL AND text <> ''")
# Texts written one value per line and scanned back: content is text + "\n".
_TEXT_FILE_WORDS = _words_sql("text || chr(10)", "text IS NOT NULL")

_WS = r"[ \t\n\x0B\f\r]"
_TOKENS = rf"""
    WITH t AS (SELECT doc_id, lower(text) AS s FROM documents WHERE text IS NOT NULL),
    k AS (
        SELECT doc_id,
               CASE WHEN s = '' THEN ['']
                    WHEN regexp_replace(s, '{_WS}+$', '') = '' THEN []::VARCHAR[]
                    ELSE regexp_split_to_array(regexp_replace(s, '{_WS}+$', ''), '{_WS}') END AS toks
        FROM t
    )
"""

_EXPLODED_EMB = """
    p AS (
        SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v
        FROM embeddings
    )
"""

_NEAREST = f"""
    WITH {_EXPLODED_EMB},
    c AS (SELECT label AS cluster, i, AVG(v) AS m FROM p GROUP BY 1, 2),
    d AS (
        SELECT p.vec_id, p.label, c.cluster, SUM((p.v - c.m) * (p.v - c.m)) AS dist
        FROM p JOIN c ON p.i = c.i GROUP BY 1, 2, 3
    ),
    a AS (SELECT vec_id, label, arg_min(cluster, dist) AS cluster FROM d GROUP BY vec_id, label)
"""


def _stump_sql() -> str:
    return """
    WITH v AS (SELECT l_quantity AS x, COUNT(*) AS c, SUM(l_extendedprice) AS s FROM lineitem GROUP BY 1),
    cum AS (
        SELECT x, SUM(c) OVER (ORDER BY x) AS nl, SUM(s) OVER (ORDER BY x) AS sl,
               SUM(c) OVER () AS n, SUM(s) OVER () AS st
        FROM v
    ),
    best AS (
        SELECT x AS thr, sl / nl AS ml, (st - sl) / (n - nl) AS mr FROM cum WHERE nl < n
        ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (n - nl) DESC LIMIT 1
    )
    SELECT l_orderkey, l_linenumber,
           ROUND(CASE WHEN l_quantity <= thr THEN ml ELSE mr END, 4) AS prediction
    FROM lineitem, best
    """


_CV_FITS = """
    WITH d AS (
        SELECT l_quantity AS x, l_extendedprice AS y, CAST(((l_orderkey % 3) + 3) % 3 AS INTEGER) AS fold
        FROM lineitem
    ),
    folds AS (SELECT * FROM (VALUES (0), (1), (2)) t(f)),
    fit AS (
        SELECT f.f, regr_slope(d.y, d.x) AS b1, regr_intercept(d.y, d.x) AS b0,
               SUM(d.x * d.y) / SUM(d.x * d.x) AS bz
        FROM folds f JOIN d ON d.fold <> f.f GROUP BY f.f
    ),
    ev AS (
        SELECT fit.f, SQRT(AVG(POWER(d.y - (fit.b0 + fit.b1 * d.x), 2))) AS rt,
               SQRT(AVG(POWER(d.y - fit.bz * d.x, 2))) AS rf
        FROM fit JOIN d ON d.fold = fit.f GROUP BY fit.f
    ),
    res AS (
        SELECT true AS fit_intercept, AVG(rt) AS m FROM ev
        UNION ALL SELECT false AS fit_intercept, AVG(rf) AS m FROM ev
    )
"""


def _pagerank_sql(rounds: int) -> str:
    c, s, n = C.CUSTOMER, C.SUPPLIER, C.NATION
    parts = [f"""
    WITH e AS (
        SELECT DISTINCT src, dst FROM (
            SELECT CAST(o.o_custkey AS BIGINT) * 3 + {c} AS src, CAST(l.l_suppkey AS BIGINT) * 3 + {s} AS dst
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
            UNION ALL SELECT CAST(s_suppkey AS BIGINT) * 3 + {s}, CAST(s_nationkey AS BIGINT) * 3 + {n} FROM supplier
            UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 3 + {n}, CAST(c_custkey AS BIGINT) * 3 + {c} FROM customer
        ) WHERE src IS NOT NULL AND dst IS NOT NULL
    ),
    deg AS (SELECT src, CAST(COUNT(*) AS DOUBLE) AS d FROM e GROUP BY src),
    nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    r0 AS (SELECT node, CAST(1.0 AS DOUBLE) AS rank FROM nodes)"""]
    for i in range(1, rounds + 1):
        parts.append(f""",
    r{i} AS (
        SELECT nodes.node, 0.15 + 0.85 * COALESCE(c.s, 0.0) AS rank
        FROM nodes LEFT JOIN (
            SELECT e.dst, SUM(r.rank / deg.d) AS s
            FROM e JOIN deg ON e.src = deg.src JOIN r{i - 1} r ON r.node = e.src GROUP BY e.dst
        ) c ON c.dst = nodes.node
    )""")
    parts.append(f"\n    SELECT node, ROUND(rank, 6) AS rank FROM r{rounds}")
    return "".join(parts)


# Every subset of every basket, a set as its items in order: grown an item at a time.
_ITEMSETS = f"""
    WITH RECURSIVE b AS (
        SELECT DISTINCT l.l_orderkey AS o, p.p_brand AS item
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
    ),
    grown AS (
        SELECT o, item AS itemset, item AS last FROM b
        UNION ALL
        SELECT g.o, g.itemset || ',' || b.item, b.item FROM grown g JOIN b ON b.o = g.o AND b.item > g.last
    ),
    n AS (SELECT CAST(COUNT(DISTINCT o) AS DOUBLE) AS baskets FROM b),
    sets AS (
        SELECT itemset, CAST(COUNT(*) AS BIGINT) AS freq FROM grown GROUP BY itemset
        HAVING COUNT(*) >= CEIL({C.FP_MIN_SUPPORT} * (SELECT baskets FROM n))
    )
"""

# A rule takes one item of a frequent set as its consequent.
_RULES = _ITEMSETS + f""",
    rules AS (
        SELECT array_to_string(list_filter(string_split(s.itemset, ','), lambda x: x <> c.item), ',') AS antecedent,
               c.item AS consequent, s.freq AS freq
        FROM sets s JOIN (SELECT DISTINCT item FROM b) c ON list_contains(string_split(s.itemset, ','), c.item)
        WHERE s.itemset LIKE '%,%'
    )
    SELECT r.antecedent, r.consequent, ROUND(r.freq / a.freq, 8) AS confidence,
           ROUND((r.freq / a.freq) / (k.freq / n.baskets), 8) AS lift, ROUND(r.freq / n.baskets, 8) AS support
    FROM rules r JOIN sets a ON a.itemset = r.antecedent JOIN sets k ON k.itemset = r.consequent, n
    WHERE r.freq / a.freq >= {C.FP_MIN_CONFIDENCE}
"""


def _sentiment_sql() -> str:
    return _TOKENS + f""",
    tb AS (
        SELECT doc_id, list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))
               AS terms
        FROM k
    ),
    occ AS (SELECT doc_id, unnest(terms) AS term FROM tb),
    lab AS (
        SELECT d.doc_id, d.term, l.quality FROM (SELECT DISTINCT doc_id, term FROM occ) d
        JOIN labels l ON l.doc_id = d.doc_id
    ),
    lex AS (
        SELECT term, CAST(FLOOR(10.0 * SUM(quality) / COUNT(*)) AS BIGINT) - 5 AS score
        FROM lab GROUP BY term HAVING COUNT(*) >= {C.SENTIMENT_MIN_DOCS}
    ),
    hits AS (SELECT o.doc_id, SUM(x.score) AS s, COUNT(*) AS h FROM occ o JOIN lex x ON x.term = o.term GROUP BY 1),
    per AS (
        SELECT d.doc_id, d.source, COALESCE(h.s, 0) AS score, COALESCE(h.h, 0) AS n_hits
        FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id
    )
    SELECT source, COUNT(*) AS n_docs, CAST(SUM(score) AS BIGINT) AS total_score,
           CAST(SUM(n_hits) AS BIGINT) AS n_hits
    FROM per GROUP BY source
    """


# Best single split of l_extendedprice by l_quantity, per value: (x, c rows, f prediction).
_FIRST_TREE = """
    WITH v AS (SELECT l_quantity AS x, COUNT(*) AS c, SUM(l_extendedprice) AS s FROM lineitem GROUP BY 1),
    cum AS (SELECT x, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER () AS n, SUM(s) OVER () AS st FROM v WINDOW w AS (ORDER BY x)),
    best AS (
        SELECT x AS thr, sl / nl AS ml, (st - sl) / (n - nl) AS mr FROM cum WHERE nl < n
        ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (n - nl) DESC LIMIT 1
    ),
    one AS (SELECT x, c, s, CASE WHEN x <= thr THEN ml ELSE mr END AS f FROM v, best)
"""

# The second tree fits twice the residual (the squared loss's gradient).
_TWO_ROUNDS = _FIRST_TREE + f""",
    r AS (SELECT x, c, f, 2 * (s - c * f) AS s FROM one),
    cum2 AS (SELECT x, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER () AS n, SUM(s) OVER () AS st FROM r WINDOW w AS (ORDER BY x)),
    best2 AS (
        SELECT x AS thr, sl / nl AS ml, (st - sl) / (n - nl) AS mr FROM cum2 WHERE nl < n
        ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (n - nl) DESC LIMIT 1
    )
    SELECT x AS l_quantity, ROUND(f + {C.GBT_RATE} * CASE WHEN x <= thr THEN ml ELSE mr END, 4) AS prediction FROM r, best2
"""

_RANKING = f"""
    WITH b AS (SELECT o.o_custkey AS u, l.l_partkey AS i, l.l_quantity AS q, l.l_returnflag AS f FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
    lists AS (
        SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY SUM(q) DESC, i) AS place FROM b GROUP BY u, i QUALIFY place <= {C.RANKING_K}
    ),
    wanted AS (SELECT DISTINCT u, i FROM b WHERE f = 'R'),
    hits AS (SELECT l.u, l.place, row_number() OVER (PARTITION BY l.u ORDER BY l.place) AS nth FROM lists l JOIN wanted w ON w.u = l.u AND w.i = l.i),
    per AS (SELECT u, COUNT(*) AS h, SUM(nth / place) AS p, SUM(1 / log2(place + 1)) AS g FROM hits GROUP BY u),
    users AS (SELECT u, LEAST(COUNT(*), {C.RANKING_K}) AS most FROM wanted GROUP BY u),
    ideal AS (SELECT k AS most, SUM(1 / log2(i + 1)) OVER (ORDER BY k) AS best FROM (SELECT unnest(range(1, {C.RANKING_K + 1})) AS k), LATERAL (SELECT k AS i))
    SELECT COUNT(*) AS n_users, ROUND(AVG(COALESCE(h, 0) / {C.RANKING_K}), 8) AS precision_at_k, ROUND(AVG(COALESCE(p, 0) / users.most), 8) AS map_at_k,
           ROUND(AVG(COALESCE(g, 0) / best), 8) AS ndcg_at_k
    FROM users LEFT JOIN per ON per.u = users.u JOIN ideal ON ideal.most = users.most
"""


def _lloyd_sql(rounds: int) -> str:
    """Rounds of assignment and means from the labels' centers, unrolled."""
    sql = f"""
    WITH {_EXPLODED_EMB}, c0 AS (SELECT label AS cluster, i, AVG(v) AS m FROM p GROUP BY 1, 2)"""
    for k in range(rounds):
        sql += f""",
    d{k} AS (SELECT p.vec_id, c.cluster, SUM((p.v - c.m) * (p.v - c.m)) AS dist FROM p JOIN c{k} c ON p.i = c.i GROUP BY 1, 2),
    a{k} AS (SELECT vec_id, cluster FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1),
    m{k} AS (SELECT a.cluster, p.i, AVG(p.v) AS m FROM p JOIN a{k} a ON a.vec_id = p.vec_id GROUP BY 1, 2),
    c{k + 1} AS (SELECT c.cluster, c.i, COALESCE(m.m, c.m) AS m FROM c{k} c LEFT JOIN m{k} m ON m.cluster = c.cluster AND m.i = c.i)"""
    return sql


def _lloyd_centers(rounds: int) -> str:
    return _lloyd_sql(rounds) + f" SELECT cluster, CAST(i - 1 AS INTEGER) AS slot, ROUND(m, 6) AS value FROM c{rounds}"


# One batch of streaming k-means is one round; clusters are numbered in the order of the labels.
_STREAM_SCORED = _lloyd_sql(1) + """,
    number AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS k FROM (SELECT DISTINCT cluster FROM c1)),
    dist AS (SELECT p.vec_id, p.label, number.k, SUM((p.v - c.m) * (p.v - c.m)) AS d FROM p JOIN c1 c ON c.i = p.i JOIN number ON number.cluster = c.cluster GROUP BY 1, 2, 3),
    near AS (SELECT vec_id, label, k FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)
    SELECT label, CAST(k AS INTEGER) AS cluster, COUNT(*) AS n FROM near GROUP BY 1, 2
"""


_COHERENCE = _TOKENS.replace("SELECT doc_id, lower(text) AS s FROM documents WHERE text IS NOT NULL", "SELECT doc_id, lang, lower(text) AS s FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL").replace(
    "SELECT doc_id,\n               CASE", "SELECT doc_id, lang,\n               CASE") + f""",
    occ AS (SELECT doc_id, lang, unnest(toks) AS term FROM k),
    terms AS (
        SELECT lang AS topic, term, row_number() OVER (PARTITION BY lang ORDER BY COUNT(*) DESC, term) AS rank FROM occ GROUP BY lang, term
        QUALIFY rank <= {C.COHERENCE_TERMS}
    ),
    has AS (SELECT DISTINCT t.topic, t.rank, o.doc_id FROM occ o JOIN terms t ON t.term = o.term),
    single AS (SELECT topic, rank, COUNT(*) AS docs FROM has GROUP BY 1, 2),
    pair AS (SELECT a.topic, a.rank AS i, b.rank AS j, COUNT(*) AS n FROM has a JOIN has b ON a.topic = b.topic AND a.doc_id = b.doc_id AND a.rank < b.rank GROUP BY 1, 2, 3),
    every AS (SELECT a.topic, a.rank AS i, b.rank AS j, a.docs FROM single a JOIN single b ON a.topic = b.topic AND a.rank < b.rank)
    SELECT e.topic, (SELECT COUNT(*) FROM single s WHERE s.topic = e.topic) AS n_terms, ROUND(SUM(LN((COALESCE(p.n, 0) + 1) / e.docs)), 6) AS coherence
    FROM every e LEFT JOIN pair p ON p.topic = e.topic AND p.i = e.i AND p.j = e.j GROUP BY e.topic
"""


def _leaf_wise_sql() -> str:
    """Three splits, each of the leaf with the largest gain, over cells of two features."""
    sql = """
    WITH cells0 AS (SELECT l_quantity AS x0, l_discount AS x1, COUNT(*) AS c, SUM(l_extendedprice) AS s, 1 AS leaf FROM lineitem GROUP BY 1, 2)"""
    for k in range(3):
        sql += f""",
    per{k} AS (
        SELECT leaf, 0 AS slot, x0 AS x, SUM(c) AS c, SUM(s) AS s FROM cells{k} WHERE leaf < 8 GROUP BY ALL
        UNION ALL SELECT leaf, 1, x1, SUM(c), SUM(s) FROM cells{k} WHERE leaf < 8 GROUP BY ALL
    ),
    run{k} AS (
        SELECT leaf, slot, x, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER (PARTITION BY leaf, slot) AS n, SUM(s) OVER (PARTITION BY leaf, slot) AS st
        FROM per{k} WINDOW w AS (PARTITION BY leaf, slot ORDER BY x)
    ),
    pick{k} AS (
        SELECT leaf, slot, x FROM run{k} WHERE nl < n
        ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (n - nl) - st * st / n DESC, slot, x LIMIT 1
    ),
    cells{k + 1} AS (
        SELECT x0, x1, c, s, CASE WHEN z.leaf <> p.leaf THEN z.leaf
                                  WHEN CASE WHEN p.slot = 0 THEN x0 ELSE x1 END <= p.x THEN 2 * z.leaf ELSE 2 * z.leaf + 1 END AS leaf
        FROM cells{k} z, pick{k} p
    )"""
    return sql


_LEAF_WISE = _leaf_wise_sql()
_LEAF_WISE_SCORED = _LEAF_WISE + """
    SELECT x0 AS l_quantity, x1 AS l_discount, ROUND(SUM(s) OVER w / SUM(c) OVER w, 4) AS prediction FROM cells3 WINDOW w AS (PARTITION BY leaf)
"""
# A threshold lies half-way to the next value there is.
_LEAF_WISE_NODES = _LEAF_WISE + """,
    grid AS (
        SELECT 0 AS slot, x, LEAD(x) OVER (ORDER BY x) AS above FROM (SELECT DISTINCT x0 AS x FROM cells0)
        UNION ALL SELECT 1, x, LEAD(x) OVER (ORDER BY x) FROM (SELECT DISTINCT x1 AS x FROM cells0)
    ),
    picks AS (SELECT * FROM pick0 UNION ALL SELECT * FROM pick1 UNION ALL SELECT * FROM pick2),
    split AS (SELECT p.leaf, p.slot, (p.x + g.above) / 2 AS threshold FROM picks p JOIN grid g ON g.slot = p.slot AND g.x = p.x),
    passed AS (
        SELECT leaf, c, s FROM cells0 UNION ALL SELECT z.leaf, c, s FROM cells1 z, pick0 p WHERE z.leaf // 2 = p.leaf
        UNION ALL SELECT z.leaf, c, s FROM cells2 z, pick1 p WHERE z.leaf // 2 = p.leaf
        UNION ALL SELECT z.leaf, c, s FROM cells3 z, pick2 p WHERE z.leaf // 2 = p.leaf
    ),
    total AS (SELECT SUM(s) / SUM(c) AS mean FROM cells0),
    node AS (SELECT leaf, SUM(c) AS n, SUM(s) AS s FROM passed GROUP BY leaf)
    SELECT CAST(node.leaf AS INTEGER) AS node, CAST(split.slot AS INTEGER) AS slot, ROUND(split.threshold, 6) AS threshold,
           CAST(node.n AS BIGINT) AS n, ROUND(node.s / node.n, 4) AS value
    FROM node LEFT JOIN split ON split.leaf = node.leaf
"""

# One tree of two leaves for each fold, added whole and by half to the mean.
_BOOSTED_CV = """
    WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, CAST(((l_orderkey % 3) + 3) % 3 AS INTEGER) AS fold FROM lineitem),
    folds AS (SELECT * FROM (VALUES (0), (1), (2)) t(f)),
    tr AS (SELECT f, x, COUNT(*) AS c, SUM(y) AS s FROM folds JOIN d ON d.fold <> f GROUP BY f, x),
    cum AS (
        SELECT f, x, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER (PARTITION BY f) AS n, SUM(s) OVER (PARTITION BY f) AS st
        FROM tr WINDOW w AS (PARTITION BY f ORDER BY x)
    ),
    nxt AS (SELECT f, x, LEAD(x) OVER (PARTITION BY f ORDER BY x) AS above FROM (SELECT DISTINCT folds.f, d.x FROM folds, d)),
    best AS (
        SELECT cum.f, arg_max(struct_pack(thr := (cum.x + nxt.above) / 2, ml := sl / nl, mr := (st - sl) / (n - nl), m := st / n),
                              sl * sl / nl + (st - sl) * (st - sl) / (n - nl)) AS b
        FROM cum JOIN nxt ON nxt.f = cum.f AND nxt.x = cum.x WHERE nl < n GROUP BY cum.f
    ),
    rates AS (SELECT * FROM (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) t(rate)),
    e AS (
        SELECT rate, f, y - (b.m + rate * (CASE WHEN x <= b.thr THEN b.ml ELSE b.mr END - b.m)) AS e FROM best JOIN d ON d.fold = f, rates
    ),
    per AS (SELECT rate, f, SQRT(AVG(e * e)) AS rmse, AVG(ABS(e)) AS mae FROM e GROUP BY ALL)
    SELECT rate AS learning_rate, ROUND(AVG(rmse), 3) AS avg_rmse, ROUND(AVG(mae), 3) AS avg_mae FROM per GROUP BY rate
"""

# Categories in the order of their means; the second tree fits twice the residual.
_INDEXED_GBT = """
    WITH v AS (
        SELECT l_returnflag AS k, COUNT(*) AS c, SUM(l_quantity + CASE WHEN l_returnflag = 'N' THEN 100 ELSE 0 END) AS s FROM lineitem GROUP BY 1
    ),
    one AS (
        SELECT k, c, s, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER () AS n, SUM(s) OVER () AS st, s / c AS m FROM v WINDOW w AS (ORDER BY s / c)
    ),
    cut AS (SELECT m AS upto, sl / nl AS ml, (st - sl) / (n - nl) AS mr FROM one WHERE nl < n
            ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (n - nl) DESC LIMIT 1),
    first AS (SELECT k, c, s, CASE WHEN m <= upto THEN ml ELSE mr END AS f FROM one, cut),
    rest AS (SELECT k, c, f, 2 * (s - c * f) AS s FROM first),
    two AS (SELECT k, f, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER () AS n, SUM(s) OVER () AS st, s / c AS m FROM rest WINDOW w AS (ORDER BY s / c)),
    cut2 AS (SELECT m AS upto, sl / nl AS ml, (st - sl) / (n - nl) AS mr FROM two WHERE nl < n
             ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (n - nl) DESC LIMIT 1)
    SELECT k AS l_returnflag, ROUND(f + 0.1 * CASE WHEN m <= upto THEN ml ELSE mr END, 4) AS prediction FROM two, cut2
"""

# Isotonic fit at i: the largest over starts of the least over ends of the mean from start to end.
_ISOTONIC = """
    WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x, COUNT(*) AS c, SUM(l_extendedprice) AS s FROM lineitem GROUP BY 1),
    cum AS (SELECT x, SUM(c) OVER w AS cc, SUM(s) OVER w AS ss, c, s FROM v WINDOW w AS (ORDER BY x)),
    spans AS (
        SELECT a.x AS lo, b.x AS hi, (b.ss - a.ss + a.s) / (b.cc - a.cc + a.c) AS m FROM cum a JOIN cum b ON b.x >= a.x
    ),
    least_end AS (SELECT v.x, spans.lo, MIN(spans.m) AS m FROM v JOIN spans ON spans.lo <= v.x AND spans.hi >= v.x GROUP BY 1, 2)
    SELECT x AS quantity, ROUND(MAX(m), 4) AS prediction FROM least_end GROUP BY x
"""

_DEPTH_GRID = """
    WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, CAST(((l_orderkey % 3) + 3) % 3 AS INTEGER) AS fold FROM lineitem),
    folds AS (SELECT * FROM (VALUES (0), (1), (2)) t(f)),
    tr AS (SELECT f, x, COUNT(*) AS c, SUM(y) AS s FROM folds JOIN d ON d.fold <> f GROUP BY f, x),
    cum AS (
        SELECT f, x, SUM(c) OVER w AS nl, SUM(s) OVER w AS sl, SUM(c) OVER (PARTITION BY f) AS n, SUM(s) OVER (PARTITION BY f) AS st
        FROM tr WINDOW w AS (PARTITION BY f ORDER BY x)
    ),
    best AS (
        SELECT f, arg_max(struct_pack(thr := x, ml := sl / nl, mr := (st - sl) / (n - nl), m := st / n),
                          sl * sl / nl + (st - sl) * (st - sl) / (n - nl)) AS b
        FROM cum WHERE nl < n GROUP BY f
    ),
    ev AS (
        SELECT f, SQRT(AVG(POWER(y - b.m, 2))) AS r0, SQRT(AVG(POWER(y - CASE WHEN x <= b.thr THEN b.ml ELSE b.mr END, 2))) AS r1
        FROM best JOIN d ON d.fold = f GROUP BY f
    )
    SELECT 0 AS max_depth, ROUND(AVG(r0), 3) AS avg_rmse FROM ev UNION ALL SELECT 1, ROUND(AVG(r1), 3) FROM ev
"""

_SELECTION = _CV_FITS + """,
    e AS (
        SELECT fit.f, d.y, d.y - (fit.b0 + fit.b1 * d.x) AS et, d.y - fit.bz * d.x AS ef FROM fit JOIN d ON d.fold = fit.f
    ),
    lng AS (SELECT f, true AS fit_intercept, y, et AS e FROM e UNION ALL SELECT f, false, y, ef FROM e),
    per AS (
        SELECT f, fit_intercept, SQRT(AVG(e * e)) AS rmse, AVG(e * e) AS mse, 1 - SUM(e * e) / (COUNT(*) * var_pop(y)) AS r2, AVG(ABS(e)) AS mae
        FROM lng GROUP BY ALL
    ),
    m AS (UNPIVOT (SELECT fit_intercept, AVG(rmse) AS rmse, AVG(mse) AS mse, AVG(r2) AS r2, AVG(mae) AS mae FROM per GROUP BY 1)
          ON rmse, mse, r2, mae INTO NAME metric VALUE v),
    c AS (SELECT *, CASE WHEN metric = 'r2' THEN v = MAX(v) OVER (PARTITION BY metric) ELSE v = MIN(v) OVER (PARTITION BY metric) END AS chosen FROM m)
    SELECT metric, fit_intercept, CAST(printf('%.6g', v) AS DOUBLE) AS avg_metric, chosen FROM c
"""

_USER_DAYS = f"""
    WITH ev AS (SELECT * FROM events WHERE ts < TIMESTAMP '{C.fc.T_END}'),
    h AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS hour_ts, SUM(value) AS load, COUNT(*) AS n_events FROM ev GROUP BY ALL),
    l AS (
        SELECT a.*, b.load AS t_m24, c.load AS t_m48 FROM h a
        LEFT JOIN h b ON b.user_id = a.user_id AND b.hour_ts = a.hour_ts - INTERVAL 24 HOUR
        LEFT JOIN h c ON c.user_id = a.user_id AND c.hour_ts = a.hour_ts - INTERVAL 48 HOUR
    ),
    o AS (SELECT user_id, ts, arg_max(value, event_id) AS obs_value FROM ev WHERE event_type = 'view' GROUP BY ALL)
    SELECT l.user_id, l.hour_ts, l.n_events, ROUND(l.load, 6) AS load, ROUND(l.t_m24, 6) AS t_m24, ROUND(l.t_m48, 6) AS t_m48,
           ROUND(o.obs_value, 6) AS obs_value
    FROM l ASOF LEFT JOIN o ON l.user_id = o.user_id AND l.hour_ts >= o.ts
"""


# lineitem's columns and their Spark types.
_LINEITEM_TYPES = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
    ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
)


def oracle_sql() -> dict[str, str]:
    li_cols = (
        "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
        "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    )
    return {
        "csv_roundtrip": "SELECT * FROM orders",
        "schema_table": " UNION ALL ".join(
            f"SELECT '{c}' AS name, '{t}' AS type, COUNT({c}) AS n_values FROM lineitem" for c, t in _LINEITEM_TYPES),
        "csv_inferred": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice, o_orderpriority
                           FROM orders""",
        "filter_boolean": "SELECT l_orderkey, l_linenumber, true AS returned FROM lineitem WHERE l_returnflag = 'R'",
        "assemble_two_columns": """
            SELECT l_orderkey, l_linenumber, 0 AS slot, l_quantity AS value FROM lineitem
            UNION ALL SELECT l_orderkey, l_linenumber, 1, l_discount FROM lineitem
        """,
        "random_split_summary": "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_both, CAST(0 AS BIGINT) AS n_none, true AS shares_right FROM lineitem",
        "user_daily_series": _USER_DAYS,
        "kmeans_two_groups": """
            SELECT CASE WHEN l_linestatus = 'F' THEN 0.0 ELSE 10000.0 END::DOUBLE AS far, ROUND(AVG(l_quantity), 6) AS quantity
            FROM lineitem GROUP BY 1
        """,
        "logistic_two_rates": """
            WITH r AS (
                SELECT AVG(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT l_quantity > 25) AS p0,
                       AVG(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) FILTER (WHERE l_quantity > 25) AS p1
                FROM lineitem
            )
            SELECT ROUND(LN(p0 / (1 - p0)), 4) AS intercept, ROUND(LN(p1 / (1 - p1)) - LN(p0 / (1 - p0)), 4) AS slope FROM r
        """,
        "isotonic_by_quantity": _ISOTONIC,
        "gbt_two_rounds": _TWO_ROUNDS,
        "fitted_indexer_stump": """
            SELECT l_orderkey, l_linenumber, ROUND(AVG(l_extendedprice) OVER (PARTITION BY l_linestatus), 4) AS prediction FROM lineitem
        """,
        "cv_depth_grid": _DEPTH_GRID,
        "leaf_budget_small": _LEAF_WISE_SCORED,
        "ranking_metrics": _RANKING,
        "lloyd_three_rounds": _lloyd_centers(C.LLOYD_ROUNDS),
        "lloyd_text_vectors": _lloyd_centers(1),
        "stream_kmeans_scored": _STREAM_SCORED,
        "topic_coherence": _COHERENCE,
        "regular_series": """
            WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t, SUM(value) AS load, COUNT(*) AS n FROM events GROUP BY ALL),
            g AS (SELECT user_id, unnest(generate_series(MIN(t), MAX(t), INTERVAL 1 DAY)) AS t FROM d GROUP BY user_id)
            SELECT g.user_id, g.t AS hour_ts, ROUND(COALESCE(d.load, 0), 6) AS load, COALESCE(d.n, 0) AS n_events
            FROM g LEFT JOIN d ON d.user_id IS NOT DISTINCT FROM g.user_id AND d.t = g.t
        """,
        "csv_text_lines": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5, lang FROM documents",
        "baskets_roundtrip": "SELECT l_partkey AS item, COUNT(DISTINCT l_orderkey) AS n_baskets FROM lineitem GROUP BY 1",
        "labeled_rows_roundtrip": """
            SELECT CAST(l_linenumber AS DOUBLE) AS label, COUNT(*) AS n, ROUND(SUM(l_quantity), 4) AS quantity, ROUND(SUM(l_discount), 4) AS discount
            FROM lineitem GROUP BY 1
        """,
        "tree_nodes": _LEAF_WISE_NODES,
        "forest_rescored": _stump_sql(),
        "gbt_rescored": _TWO_ROUNDS,
        "boosted_cv_small": _BOOSTED_CV,
        "indexed_gbt_small": _INDEXED_GBT,
        "cv_selection_metrics": _SELECTION,
        "libsvm_roundtrip": """
            SELECT CAST(label AS DOUBLE) AS label, CAST(i - 1 AS INTEGER) AS slot, ROUND(v, 6) AS value
            FROM (
                SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v
                FROM embeddings
            )
        """,
        "word_count": _WORDS,
        "word_count_saved": _WORDS,
        "files_partitioned": """
            SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n_lines,
                   CAST(SUM(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS n_bytes
            FROM orders GROUP BY ALL
        """,
        "project_view": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem",
        "filter_before": f"SELECT {li_cols} FROM lineitem WHERE l_shipdate < TIMESTAMP '{C.T0}'",
        "filter_half_open": (
            f"SELECT {li_cols} FROM lineitem "
            f"WHERE l_shipdate >= TIMESTAMP '{C.T0}' AND l_shipdate < TIMESTAMP '{C.T1}'"
        ),
        "filter_after": f"SELECT {li_cols} FROM lineitem WHERE l_shipdate > TIMESTAMP '{C.T_LATE}'",
        "split_time": f"""
            SELECT l_orderkey, l_linenumber,
                   CASE WHEN l_shipdate < TIMESTAMP '{C.T0}' THEN 'train' ELSE 'test' END AS split
            FROM lineitem WHERE l_shipdate < TIMESTAMP '{C.T1}'
        """,
        "split_key": """
            SELECT l_orderkey, l_linenumber,
                   CASE WHEN ((l_orderkey % 10) + 10) % 10 < 7 THEN 'train' ELSE 'test' END AS split
            FROM lineitem
        """,
        "hourly_load": f"""
            SELECT event_type, hour_ts, ROUND(load, 6) AS load, n_events FROM ({_HOURLY})
        """,
        "calendar_features": """
            SELECT event_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, CAST(dayofyear(ts) AS INTEGER) AS doy,
                   CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month,
                   CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute
            FROM events
        """,
        "lag_24_48": f"""
            WITH h AS ({_HOURLY})
            SELECT a.event_type, a.hour_ts, ROUND(a.load, 6) AS load, a.n_events,
                   ROUND(b.load, 6) AS t_m24, ROUND(c.load, 6) AS t_m48
            FROM h a
            LEFT JOIN h b ON b.event_type = a.event_type AND b.hour_ts = a.hour_ts - INTERVAL 24 HOUR
            LEFT JOIN h c ON c.event_type = a.event_type AND c.hour_ts = a.hour_ts - INTERVAL 48 HOUR
        """,
        "asof_last_view": """
            SELECT c.event_id, c.user_id, c.ts, v.ts AS view_ts, v.event_id AS view_event_id,
                   v.value AS view_value
            FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c
            ASOF LEFT JOIN (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view') v
            ON c.user_id = v.user_id AND c.ts >= v.ts
        """,
        "assemble_slots": """
            SELECT l_orderkey, l_linenumber, 0 AS slot, l_quantity AS value FROM lineitem
            UNION ALL SELECT l_orderkey, l_linenumber, 1, l_extendedprice FROM lineitem
            UNION ALL SELECT l_orderkey, l_linenumber, 2, l_discount FROM lineitem
            UNION ALL SELECT l_orderkey, l_linenumber, 3, l_tax FROM lineitem
        """,
        "index_categories": """
            WITH f AS (
                SELECT l_orderkey, l_linenumber,
                       CASE l_returnflag WHEN 'A' THEN -1.0 WHEN 'N' THEN 0.0 ELSE 5.0 END::DOUBLE AS f0,
                       CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 2.0 END::DOUBLE AS f1,
                       CAST(month(l_shipdate) % 3 AS DOUBLE) AS f2,
                       l_discount AS f3, l_tax AS f4
                FROM lineitem
            ),
            lng AS (
                SELECT l_orderkey, l_linenumber, 0 AS slot, f0 AS v FROM f
                UNION ALL SELECT l_orderkey, l_linenumber, 1, f1 FROM f
                UNION ALL SELECT l_orderkey, l_linenumber, 2, f2 FROM f
                UNION ALL SELECT l_orderkey, l_linenumber, 3, f3 FROM f
                UNION ALL SELECT l_orderkey, l_linenumber, 4, f4 FROM f
            ),
            dist AS (SELECT DISTINCT slot, v FROM lng),
            cnt AS (SELECT slot, COUNT(*) AS nd, BOOL_OR(v = 0) AS has0 FROM dist GROUP BY slot),
            codes AS (
                SELECT d.slot, d.v,
                       CASE WHEN d.v = 0 THEN 0
                            ELSE ROW_NUMBER() OVER (PARTITION BY d.slot, d.v = 0 ORDER BY d.v) - 1
                                 + CASE WHEN c.has0 THEN 1 ELSE 0 END END AS code
                FROM dist d JOIN cnt c ON c.slot = d.slot WHERE c.nd <= 4
            )
            SELECT l.l_orderkey, l.l_linenumber, l.slot, COALESCE(CAST(k.code AS DOUBLE), l.v) AS value
            FROM lng l LEFT JOIN codes k ON k.slot = l.slot AND k.v = l.v
        """,
        "persistence_metrics": f"""
            WITH h AS ({_HOURLY}),
            s AS (
                SELECT a.load AS y, b.load AS p FROM h a
                JOIN h b ON b.event_type = a.event_type AND b.hour_ts = a.hour_ts - INTERVAL 24 HOUR
                WHERE a.hour_ts >= TIMESTAMP '{C.fc.T_TEST}' AND a.hour_ts < TIMESTAMP '{C.fc.T_END}'
            )
            SELECT COUNT(*) AS n, ROUND(SQRT(AVG((y - p) * (y - p))), 6) AS rmse,
                   ROUND(AVG((y - p) * (y - p)), 6) AS mse,
                   ROUND(1 - SUM((y - p) * (y - p)) / (SUM(y * y) - SUM(y) * SUM(y) / COUNT(*)), 6) AS r2,
                   ROUND(AVG(ABS(y - p)), 6) AS mae
            FROM s
        """,
        "forest_stump": _stump_sql(),
        "gbt_stump": _stump_sql(),
        "leaf_budget_stump": _stump_sql(),
        "cv_results": _CV_FITS + " SELECT fit_intercept, ROUND(m, 4) AS avg_rmse FROM res",
        "cv_closed_form": _CV_FITS + """,
            pick AS (SELECT fit_intercept FROM res ORDER BY m LIMIT 1),
            full_fit AS (
                SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, SUM(x * y) / SUM(x * x) AS bz FROM d
            )
            SELECT pick.fit_intercept,
                   ROUND(CASE WHEN pick.fit_intercept THEN b1 ELSE bz END, 4) AS slope,
                   ROUND(CASE WHEN pick.fit_intercept THEN b0 ELSE 0.0 END, 4) AS intercept
            FROM pick, full_fit
        """,
        "assign_given_centers": _NEAREST + " SELECT vec_id, cluster FROM a",
        "silhouette_given_labels": f"""
            WITH {_EXPLODED_EMB},
            pn AS (SELECT vec_id, label, SUM(v * v) AS xx FROM p GROUP BY 1, 2),
            cs AS (SELECT label AS cluster, CAST(COUNT(*) AS DOUBLE) AS n, SUM(xx) AS psi FROM pn GROUP BY 1),
            cy AS (SELECT label AS cluster, i, SUM(v) AS y FROM p GROUP BY 1, 2),
            dots AS (SELECT p.vec_id, cy.cluster, SUM(p.v * cy.y) AS xy FROM p JOIN cy ON p.i = cy.i GROUP BY 1, 2),
            d AS (
                SELECT pn.vec_id, pn.label, cs.cluster, cs.n, pn.xx + cs.psi / cs.n - 2 * dots.xy / cs.n AS dist
                FROM pn JOIN dots ON pn.vec_id = dots.vec_id JOIN cs ON cs.cluster = dots.cluster
            ),
            ab AS (
                SELECT vec_id,
                       MAX(CASE WHEN cluster = label THEN dist * n / (n - 1) END) AS a,
                       MAX(CASE WHEN cluster = label THEN n END) AS own_n,
                       MIN(CASE WHEN cluster <> label THEN dist END) AS b
                FROM d GROUP BY vec_id
            )
            SELECT ROUND(AVG(CASE WHEN own_n <= 1 THEN 0 WHEN a < b THEN 1 - a / b
                                  WHEN a > b THEN b / a - 1 ELSE 0 END), 8) AS silhouette
            FROM ab
        """,
        "classification_metrics": _NEAREST + """,
            conf AS (SELECT CAST(label AS DOUBLE) AS y, CAST(cluster AS DOUBLE) AS p, CAST(COUNT(*) AS DOUBLE) AS c
                     FROM a GROUP BY 1, 2),
            ks AS (SELECT y AS k FROM conf UNION SELECT p FROM conf),
            per AS (
                SELECT ks.k,
                       COALESCE((SELECT SUM(c) FROM conf WHERE y = ks.k), 0) AS n_label,
                       COALESCE((SELECT SUM(c) FROM conf WHERE p = ks.k), 0) AS n_pred,
                       COALESCE((SELECT SUM(c) FROM conf WHERE y = ks.k AND p = ks.k), 0) AS tp
                FROM ks
            ),
            pr AS (
                SELECT k, n_label, tp,
                       CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS prec,
                       CASE WHEN n_label > 0 THEN tp / n_label ELSE 0 END AS rec
                FROM per
            ),
            f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM pr)
            SELECT ROUND(SUM(tp) / SUM(n_label), 8) AS accuracy,
                   ROUND(SUM(prec * n_label) / SUM(n_label), 8) AS weighted_precision,
                   ROUND(SUM(rec * n_label) / SUM(n_label), 8) AS weighted_recall,
                   ROUND(SUM(f1 * n_label) / SUM(n_label), 8) AS weighted_f1
            FROM f
        """,
        "auc_given_score": """
            WITH s AS (
                SELECT l_discount AS sc,
                       SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos,
                       SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS neg
                FROM lineitem WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1
            ),
            c AS (
                SELECT pos, neg,
                       COALESCE(SUM(neg) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                       AS below
                FROM s
            )
            SELECT ROUND(SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)), 8) AS auc FROM c
        """,
        "tokenize_counts": _TOKENS + " SELECT token, COUNT(*) AS count FROM (SELECT unnest(toks) AS token FROM k) GROUP BY token",
        "hash_tf_totals": _TOKENS + " SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_terms FROM k",
        "pagerank_5": _pagerank_sql(C.PAGERANK_ROUNDS),
        "frequent_itemsets": _ITEMSETS + " SELECT itemset, freq FROM sets",
        "association_rules": _RULES,
        "sentiment_by_source": _sentiment_sql(),
        "stream_sentiment_by_source": _sentiment_sql(),
        "text_scan_word_count": _TEXT_FILE_WORDS,
        "delimited_roundtrip": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
        "preview_lineitem": """
            SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
            ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 10
        """,
        # Ridge, one feature, standardised: the least-squares slope shrunk by
        # 1 / (1 + reg / population std of the label).
        "ridge_one_feature": f"""
            SELECT ROUND(b, 4) AS slope, ROUND(my - b * mx, 4) AS intercept FROM (
                SELECT regr_slope(l_extendedprice, l_quantity) / (1 + {C.RIDGE_REG} / stddev_pop(l_extendedprice)) AS b,
                       AVG(l_quantity) AS mx, AVG(l_extendedprice) AS my
                FROM lineitem
            )
        """,
    }

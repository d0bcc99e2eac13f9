"""Pieces of the DuckDB statements that the queries are held against."""

SEQS = "seqs AS (SELECT CAST(doc_id AS VARCHAR) AS header, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS seq FROM documents)"

FEATS = (
    SEQS + ", feats AS (SELECT header, CAST(i AS BIGINT) AS i, header || '.' || i AS name, CASE WHEN txt[1] IN ('N','n','X','x') THEN 'GAP' ELSE 'SEGMENT' END AS kind, txt AS text, length(txt) AS len"
    " FROM (SELECT header, unnest(p) AS txt, generate_subscripts(p, 1) AS i FROM (SELECT header, regexp_extract_all(seq, '[NnXx]+|[^NnXx]+') AS p FROM seqs)))"
)

READS = "reads AS (SELECT CAST(doc_id AS VARCHAR) AS header, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"

LINES = (
    "gl AS (SELECT l_orderkey AS path, l_partkey AS part, CAST(l_quantity AS BIGINT) AS q, l_shipdate, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS orientation,"
    " row_number() OVER w AS o, lead(l_partkey) OVER w AS nxt, lead(CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END) OVER w AS nxt_or"
    " FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"
)

COMPS = (
    LINES + ", gc AS (SELECT CAST(path AS VARCHAR) AS path, 2 * o - 1 AS ord, 'SEGMENT' AS ctype, CAST(part AS VARCHAR) AS comp, orientation, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS \"end\", CAST(p_size AS BIGINT) AS len"
    " FROM gl JOIN part ON gl.part = p_partkey UNION ALL SELECT CAST(path AS VARCHAR), 2 * o, 'GAP', 'gap_' || path || '_' || o, '0', 0, 0, q FROM gl WHERE nxt IS NOT NULL)"
)

EDGES = LINES + (
    ", ge AS (SELECT 'e_' || path || '_' || o AS header, part AS s1, orientation AS s1_or, nxt AS s2, nxt_or AS s2_or, q || 'M' AS cigar FROM gl WHERE nxt IS NOT NULL"
    " QUALIFY row_number() OVER (PARTITION BY part ORDER BY l_shipdate DESC, path DESC, o DESC) = 1)"
)

ADJ = EDGES + (
    ", k1 AS (SELECT DISTINCT least({'a': s1, 'b': s1_or, 'c': s2, 'd': s2_or}, {'a': s2, 'b': translate(s2_or, '+-', '-+'), 'c': s1, 'd': translate(s1_or, '+-', '-+')}) AS k FROM ge)"
    ", adj AS (SELECT k.a AS node, k.b AS o0, k.c AS other, k.d AS o1 FROM k1 UNION ALL SELECT k.c, translate(k.d, '+-', '-+'), k.a, translate(k.b, '+-', '-+') FROM k1)"
)

_ADJ_OF = ADJ[len(EDGES):]

#: Each order's first four lines as a bubble: line 1 to 2 and 3, both to 4.
BUBBLES = LINES + (
    ", ge AS (SELECT a.path * 10 + a.o AS s1, a.orientation AS s1_or, b.path * 10 + b.o AS s2, b.orientation AS s2_or FROM gl a JOIN gl b ON a.path = b.path"
    " WHERE (a.o = 1 AND b.o IN (2, 3)) OR (a.o IN (2, 3) AND b.o = 4))"
) + _ADJ_OF

#: Edges between parts of at most 25 bases.
SMALL_ADJ = EDGES.replace(", ge AS (", ", ge0 AS (") + ", ge AS (SELECT * FROM ge0 WHERE s1 IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND s2 IN (SELECT p_partkey FROM part WHERE p_size <= 25))" + _ADJ_OF

CLOSURE = ADJ + (
    ", reach AS (SELECT p_partkey AS node, p_partkey AS label FROM part UNION SELECT a.other, r.label FROM reach r JOIN adj a ON a.node = r.node WHERE r.label < a.other)"
    ", comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node)"
)


def counts(col: str) -> str:
    parts = [f"length(regexp_replace({col}, '[^{b.upper()}{b}]', '', 'g')) AS {b}" for b in "acgt"]
    return ", ".join([*parts, f"length(regexp_replace({col}, '[^a-z]', '', 'g')) AS lower"])


def nstar(lengths: str, base: str = "CAST(tot AS DOUBLE)") -> str:
    return (
        f"l AS ({lengths}), cum AS (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS cs, row_number() OVER (ORDER BY len DESC) AS rk, (SELECT sum(len) FROM l) AS tot FROM l)"
        f" SELECT CAST(n AS INTEGER) AS n, coalesce(max(len), 0) AS nx, coalesce(min(rk), 0) AS lx FROM range(1, 11) t(n) LEFT JOIN cum ON cs >= {base} / 10 * n GROUP BY n"
    )


def windows(k: int, source: str = "reads", keep: str = "header") -> str:
    return f"SELECT {keep}, p - 1 AS pos, substr(s, p, {k}) AS k FROM (SELECT {keep}, s, unnest(generate_series(1, length(s) - {k - 1})) AS p FROM {source} WHERE length(s) >= {k})"


def canonical(k: str) -> str:
    return f"least({k}, reverse(translate({k}, 'ACGT', 'TGCA')))"


def code(k: str, n: int) -> str:
    return " + ".join(f"(instr('ACGT', substr({k}, {i + 1}, 1)) - 1) * {4 ** (n - 1 - i)}" for i in range(n))


RUNS = SEQS + (
    ", ch AS (SELECT header, unnest(generate_series(1, length(seq))) AS p, seq FROM seqs WHERE length(seq) > 0)"
    ", c2 AS (SELECT header, p, substr(seq, p, 1) AS b FROM ch)"
    ", c3 AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY header ORDER BY p) THEN 0 ELSE 1 END AS new FROM c2)"
    ", c4 AS (SELECT *, sum(new) OVER (PARTITION BY header ORDER BY p) AS run FROM c3)"
    ", runs AS (SELECT header, run, min(p) - 1 AS start, max(p) AS stop, any_value(b) AS b FROM c4 GROUP BY header, run)"
)


def minimisers(k: int, s: int) -> str:
    return (
        READS + f", sm AS (SELECT header, pos, {code('c', s)} AS h FROM (SELECT header, pos, {canonical('k')} AS c FROM ({windows(s)})))"
        f", mn AS (SELECT header, pos, min(h) OVER w AS h, count(*) OVER w AS n FROM sm WINDOW w AS (PARTITION BY header ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - s} FOLLOWING))"
        f", mins AS (SELECT header, pos, h, coalesce(h <> lag(h) OVER (PARTITION BY header ORDER BY pos), true) AS is_new FROM mn WHERE n = {k - s + 1})"
    )


#: Segments' slices on their paths, and groups of variants on segments: every 20 bases a substitution of two alternatives, a deletion or an insertion.
VARIANTS = FEATS + (
    ", sl AS (SELECT *, CAST(header AS BIGINT) % 2 = 1 AS minus, CASE WHEN kind = 'SEGMENT' AND len >= 60 THEN 3 ELSE 0 END AS sh, CASE WHEN kind = 'SEGMENT' AND len >= 60 THEN len - 6 ELSE len END AS sz FROM feats)"
    ", pc AS (SELECT *, CAST(sum(sz) OVER (PARTITION BY header ORDER BY CASE WHEN minus THEN -i ELSE i END) - sz AS BIGINT) AS begin_ FROM sl)"
    ", vg AS (SELECT *, CASE WHEN p % 60 = 9 THEN [translate(b, 'ACGTacgt', 'TGCAtgca'), b || b] WHEN p % 60 = 29 THEN [''] ELSE ['GT'] END AS alts, CASE WHEN p % 60 = 9 THEN 1 WHEN p % 60 = 29 THEN 2 ELSE 0 END AS most,"
    " CASE WHEN p % 60 = 9 THEN (p % 7 + p % 5) / 2.0 WHEN p % 60 = 29 THEN 3.0 ELSE 4.0 END AS q"
    " FROM (SELECT *, substr(text, CAST(p + 1 AS BIGINT), 1) AS b FROM (SELECT *, unnest(generate_series(9, len - 1, 20)) AS p FROM pc WHERE kind = 'SEGMENT')) WHERE p % 60 <> 29 OR p + 2 <= len)"
    ", inner_ AS (SELECT * FROM vg WHERE p >= sh AND p + most <= sh + sz)"
)

#: Reads with a choice at some places: another base, none, or three.
PLACES = READS + (
    ", base AS (SELECT header, p - 1 AS p, substr(s, p, 1) AS b FROM (SELECT header, s, unnest(generate_series(1, length(s))) AS p FROM reads WHERE length(s) > 0))"
    ", places AS (SELECT header, p, CASE WHEN p % 12 IN (3, 7, 11) THEN '0' ELSE '' END AS c, b AS a FROM base UNION ALL"
    " SELECT header, p, '1', CASE p % 12 WHEN 3 THEN translate(b, 'ACGT', 'TGCA') WHEN 7 THEN '' ELSE b || 'GT' END FROM base WHERE p % 12 IN (3, 7, 11))"
)

"""The rows of operators 11 to 13 in plain SQL (DuckDB), by other ways than the operators."""

from __future__ import annotations

from tidelake.llm import codes as C
from tidelake.llm import quality as Q

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

INTERACTIONS = f"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               {_WORDS.format("coalesce(text, '')")} AS w FROM documents
    ), marked AS (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
        FROM labels GROUP BY doc_id
    ), f AS (
        SELECT d.doc_id, part, good, toxic,
               CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
               || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)
                       THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
        FROM d LEFT JOIN marked USING (doc_id)
    ), cells AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good,
               count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), gone AS (
        SELECT *, coalesce(list_min(list_transform(list_filter(string_split(fails, ''),
                      lambda x: x <> ''), lambda x: instr(filter_order, x))), 6) AS place
        FROM cells CROSS JOIN orders
    ), steps AS (
        SELECT part, filter_order, step, substr(filter_order, step, 1) AS own,
               sum(n) FILTER (place > step) AS kept, sum(n) FILTER (place = step) AS removed,
               sum(n) FILTER (place < step AND contains(fails, substr(filter_order, step, 1))) AS redundant,
               sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
               sum(good) FILTER (place = step) AS good_lost, sum(toxic) FILTER (place = step) AS toxic_lost
        FROM gone CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)
        GROUP BY part, filter_order, step
    )
    SELECT part, filter_order, step,
           {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
           coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
    FROM steps
"""


def quality_rules() -> str:
    """Every concentration step as a query of its own; nearest rows by rank, not by counts."""

    def named(formulas: list[tuple[str, str]]) -> str:
        return ", ".join(f"{e} AS {k}" for k, e in formulas)

    def estimated(rows: str, keys: str, factor: float) -> str:
        """Later columns use the earlier ones' names."""
        return f"""SELECT {keys}, {named(Q._moments())}, {named(Q._centre(factor))},
                   {named(Q._cholesky())} FROM {rows} GROUP BY {keys}"""

    x = [f"x{i + 1}" for i in range(Q.DIMS)]
    params = ", ".join(Q._PARAMETERS)
    quartile = lambda c, k: f"list_sort(list({c} // {Q.GRID}))[({k} * count(*) + 3) // 4]"
    middle = [(f"m{i + 1}", f"({quartile(c, 2)} + 0.5) * {Q.GRID}") for i, c in enumerate(x)]
    spread = [
        (f"w{i + 1}", f"({quartile(c, 3)} - {quartile(c, 1)}) * {Q.GRID} / 1.349e0") for i, c in enumerate(x)
    ]
    covered = [
        (f"c{i}{j}", f"w{i} * w{i} + {(Q.WIDTH[i - 1] * Q.UNIT) ** 2!r}" if i == j else "0e0")
        for i, j in Q._PAIRS
    ]
    steps, last = [], "start"
    for n in range(Q.STEPS):
        steps.append(f"""
        met{n} AS (SELECT f.*, p.start, {named(Q._distance())}
                   FROM fitted f JOIN {last} p USING (pool)),
        near{n} AS (SELECT * FROM met{n} QUALIFY 4 * (rank() OVER (
                        PARTITION BY pool, start ORDER BY {Q._BIN}) - 1)
                    < 3 * count(*) OVER (PARTITION BY pool, start)),
        step{n} AS MATERIALIZED ({estimated(f"near{n}", "pool, start", 1.0)})""")
        last = f"step{n}"
    return f"""
    WITH t AS (
        SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang,
               coalesce(source, '') AS source, coalesce(text, '') AS t,
               {_WORDS.format("coalesce(text, '')")} AS w FROM documents
    ), windows AS (
        SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t)
    ), again AS (
        SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, k) > 1
    ), covered AS (
        SELECT rid, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(5)) AS j) GROUP BY rid
    ), stats AS MATERIALIZED (
        SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
               length(array_to_string(w, ''))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
               coalesce(c.n, 0)::BIGINT AS n_repeat_words,
               n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.REPEAT_SHARE} * n_words AS base_failed
        FROM (SELECT *, list_filter(string_split(t, chr(10)),
                  lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t)
        LEFT JOIN covered c USING (rid)
    ), sound AS (
        SELECT rid, lang, source, {", ".join(f"({e})::BIGINT AS {c}" for c, e in zip(x, Q.VECTOR, strict=True))}
        FROM stats WHERE NOT base_failed
    ), sized AS (
        SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM sound
    ), fitted AS MATERIALIZED (
        SELECT rid, {", ".join(x)}, CASE
            WHEN n >= {Q.LEAST_ROWS} THEN {{'kind': 'source', 'lang': lang, 'source': source}}
            WHEN count(*) FILTER (n < {Q.LEAST_ROWS}) OVER (PARTITION BY lang) >= {Q.LEAST_ROWS}
            THEN {{'kind': 'language', 'lang': lang, 'source': ''}}
            ELSE {{'kind': 'all', 'lang': '', 'source': ''}} END AS pool FROM sized
    ), middle AS (
        SELECT *, {named(covered)}, {named(Q._cholesky())}
        FROM (SELECT pool, count(*) AS n, {named(middle + spread)} FROM fitted GROUP BY pool)
    ), everyone AS ({estimated("fitted", "pool", 1.0)}
    ), start AS MATERIALIZED (
        SELECT pool, 0 AS start, {params} FROM middle WHERE n >= {Q.LEAST_ROWS}
        UNION ALL SELECT pool, 1 AS start, {params} FROM everyone WHERE n >= {Q.LEAST_ROWS}
    ), {",".join(steps)}, best AS MATERIALIZED (
        SELECT pool, {params} FROM {last}
        QUALIFY row_number() OVER (PARTITION BY pool ORDER BY det, start) = 1
    ), met AS (SELECT f.*, {named(Q._distance())} FROM fitted f JOIN best USING (pool)
    ), inner_rows AS (SELECT * FROM met WHERE d2 <= {Q.NEAR * Q.CONSISTENT_HALF!r}
    ), final AS ({estimated("inner_rows", "pool", Q.CONSISTENT_NEAR)}
    ), judged AS (SELECT f.rid, {named(Q._distance())} FROM fitted f JOIN final USING (pool))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(d2 <= {Q.CUTOFF}, true) AS kept
    FROM stats LEFT JOIN judged USING (rid)
    """


def vector_codes() -> str:
    """Every round as a query of its own, each vector against all entries."""
    far = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(books: str) -> str:
        return f"""SELECT row, part, any_value(p.v) AS v, min({{'far': {far}, 'entry': entry}}) AS best
                   FROM parts p JOIN {books} b USING (part) GROUP BY row, part"""

    rounds = []
    for r in range(C.ROUNDS):
        rounds.append(f"""
        near{r} AS ({assigned(f"book{r}")}),
        sums{r} AS (
            SELECT part, best.entry AS entry, place, count(*) AS n, sum(v[place])::BIGINT AS s
            FROM near{r}, (SELECT unnest(range(1, (SELECT len(v) + 1 FROM parts LIMIT 1))) AS place)
            GROUP BY ALL
        ), mean{r} AS (
            SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM sums{r} GROUP BY ALL
        ), book{r + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
            FROM book{r} b LEFT JOIN mean{r} m USING (part, entry)
        )""")
    return f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
               list_transform(embedding, lambda x: floor({C.FACTOR} * x::DOUBLE)::BIGINT) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
        SELECT row, part, list_slice(e, part * (len(e) // {C.PARTS}) + 1, (part + 1) * (len(e) // {C.PARTS})) AS v
        FROM kept, (SELECT unnest(range({C.PARTS})) AS part)
    ), book0 AS (
        SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {C.ENTRIES}
    ), {",".join(rounds)}, final AS ({assigned(f"book{C.ROUNDS}")}
    ), coded AS (
        SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
               sum(best.far)::BIGINT AS error FROM final GROUP BY row
    ), digest AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
        FROM book{C.ROUNDS}
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (row) CROSS JOIN digest
    """

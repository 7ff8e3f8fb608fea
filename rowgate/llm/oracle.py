"""DuckDB SQL for the llm queries that SQL can express."""

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Window length in words -> percent of characters that duplicated windows may cover.
COVERAGE = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}


def _repetition() -> str:
    def key(n):
        lead = ", ".join(f"lead(w, {j}) OVER o" for j in range(n))
        return f"CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN concat_ws(' ', {lead}) END AS k{n}"
    return rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM d),
        lw AS (SELECT rid, no, row_number() OVER (PARTITION BY rid, line ORDER BY no) > 1 AS again,
                      len(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS chars
               FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        ls AS (SELECT rid, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS dup_line_chars FROM lw GROUP BY rid),
        x AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
              FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
        k AS (SELECT rid, p, len(w) AS c, {", ".join(key(n) for n in COVERAGE)} FROM x WINDOW o AS (PARTITION BY rid ORDER BY p)),
        m AS (SELECT rid, p, c, {", ".join(f"k{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, k{n}) > 1 AS m{n}" for n in COVERAGE)} FROM k),
        v AS (SELECT rid, c, {", ".join(f"max(m{n}) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v{n}" for n in COVERAGE)} FROM m),
        s AS (SELECT rid, count(*) AS n_words, sum(c) AS word_chars, count(*) FILTER (v8) AS n_repeat_words,
                     {", ".join(f"coalesce(sum(c) FILTER (v{n}), 0) AS dup_chars_{n}" for n in COVERAGE)} FROM v GROUP BY rid),
        a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
                     CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
                     {", ".join(f"CAST(coalesce(dup_chars_{n}, 0) AS BIGINT) AS dup_chars_{n}" for n in COVERAGE)}
              FROM d LEFT JOIN s USING (rid) LEFT JOIN ls USING (rid)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
        SELECT *, NOT base_failed AND 100 * dup_line_chars <= 20 * word_chars
                  AND {" AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in COVERAGE.items())} AS kept FROM f
    """


def _collocations(low: int = 100, top: int = 2000) -> str:
    words = [f"lead(w, {j}) OVER o" for j in range(1, 5)]
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS k, concat_ws(' ', {', '.join(['w', *[f'w{j}' for j in range(1, n)]])}) AS phrase FROM g"
        + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "") for n in range(1, 6))
    return rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {NORM} AS t FROM documents),
        p AS MATERIALIZED (SELECT rid, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS no
              FROM (SELECT rid, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
        x AS MATERIALIZED (SELECT rid, lang, no, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT rid, lang, no, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
        g AS MATERIALIZED (SELECT lang, w, {", ".join(f"{e} AS w{j}" for j, e in enumerate(words, 1))} FROM x WINDOW o AS (PARTITION BY rid, no ORDER BY i)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
        n AS MATERIALIZED (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {low}),
        u AS MATERIALIZED (SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
        s AS MATERIALIZED (SELECT u.lang, u.k, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, n.n,
                     CAST(CAST(1000 AS HUGEINT) * u.a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
              FROM u JOIN f AS l ON l.lang = u.lang AND l.phrase = u.lp
                     JOIN f AS r ON r.lang = u.lang AND r.phrase = u.rp
                     JOIN n ON n.lang = u.lang),
        b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS MATERIALIZED (SELECT lang, array_to_string(ws[p0:p0 + m - 1], ' ') AS phrase, max(a) AS longer
              FROM (SELECT *, unnest(range(1, k - m + 2)) AS p0 FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
        kept AS MATERIALIZED (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE coalesce(longer, 0) < a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}
    """


ORACLE = {
    "op11_repetition": _repetition(),
    "op12_hard_negatives": """
        WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT q.vec_id AS anchor_id, q.label AS anchor_label, c.vec_id, c.label,
                          CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                   FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             r AS (SELECT p.anchor_id, p.positive_id,
                          CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
                          s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
                   FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
                     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
        SELECT * FROM r WHERE rank <= 10
    """,
    "op13_collocations": _collocations(),
    "op1_topk": """
        WITH c AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                   FROM c AS q JOIN c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
        SELECT * FROM (SELECT query_id,
                              CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                              vec_id, score FROM s)
        WHERE rank <= 5
    """,
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {NORM} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, lang, source,
                          CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web'
                               WHEN right(source, 1) IN ('5', '6', '7') THEN 'books' ELSE 'code' END AS domain,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
        leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
        n_domain AS (SELECT domain, CAST(sum(tokens) * 2 AS HUGEINT) AS cap, CAST(CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS HUGEINT) AS w
                      FROM leaf GROUP BY domain),
        s_domain AS (SELECT n.domain, n.cap, n.w, least((SELECT CAST(sum(n_tokens) AS HUGEINT) * 6 // 10 FROM d), sum(n.cap) OVER ()) AS b FROM n_domain n),
        o_domain AS (SELECT *, sum(w) OVER () AS all_w,
                             coalesce(sum(w) OVER before, 0) AS w_before, coalesce(sum(cap) OVER before, 0) AS c_before
                      FROM s_domain
                      WINDOW before AS ( ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), domain NULLS FIRST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f_domain AS (SELECT *, cap = 0 OR cap * (all_w - w_before) <= w * (b - c_before) AS is_full FROM o_domain),
        b_domain AS (SELECT domain, CASE WHEN is_full THEN cap
                             ELSE (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w
                                  // (all_w - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ()) END AS budget
                      FROM f_domain),
        n_lang AS (SELECT domain, lang, CAST(sum(tokens) * 2 AS HUGEINT) AS cap, CAST(CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS HUGEINT) AS w
                      FROM leaf GROUP BY domain, lang),
        s_lang AS (SELECT n.domain, n.lang, n.cap, n.w, CAST(p.budget AS HUGEINT) AS b FROM n_lang n JOIN b_domain p ON n.domain IS NOT DISTINCT FROM p.domain),
        o_lang AS (SELECT *, sum(w) OVER (PARTITION BY domain) AS all_w,
                             coalesce(sum(w) OVER before, 0) AS w_before, coalesce(sum(cap) OVER before, 0) AS c_before
                      FROM s_lang
                      WINDOW before AS (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), lang NULLS FIRST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f_lang AS (SELECT *, cap = 0 OR cap * (all_w - w_before) <= w * (b - c_before) AS is_full FROM o_lang),
        b_lang AS (SELECT domain, lang, CASE WHEN is_full THEN cap
                             ELSE (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain)) * w
                                  // (all_w - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER (PARTITION BY domain)) END AS budget
                      FROM f_lang),
        n_source AS (SELECT domain, lang, source, CAST(sum(tokens) * 2 AS HUGEINT) AS cap, CAST(CASE source WHEN 'src0' THEN 2 ELSE 1 END AS HUGEINT) AS w
                      FROM leaf GROUP BY domain, lang, source),
        s_source AS (SELECT n.domain, n.lang, n.source, n.cap, n.w, CAST(p.budget AS HUGEINT) AS b FROM n_source n JOIN b_lang p ON n.domain IS NOT DISTINCT FROM p.domain AND n.lang IS NOT DISTINCT FROM p.lang),
        o_source AS (SELECT *, sum(w) OVER (PARTITION BY domain, lang) AS all_w,
                             coalesce(sum(w) OVER before, 0) AS w_before, coalesce(sum(cap) OVER before, 0) AS c_before
                      FROM s_source
                      WINDOW before AS (PARTITION BY domain, lang ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), source NULLS FIRST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f_source AS (SELECT *, cap = 0 OR cap * (all_w - w_before) <= w * (b - c_before) AS is_full FROM o_source),
        b_source AS (SELECT domain, lang, source, CASE WHEN is_full THEN cap
                             ELSE (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang)) * w
                                  // (all_w - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER (PARTITION BY domain, lang)) END AS budget
                      FROM f_source),
        plan AS (SELECT l.*, CAST(b.budget AS BIGINT) AS budget, CAST(b.budget // l.tokens AS BIGINT) AS whole,
                        CAST(b.budget % l.tokens AS BIGINT) AS rest
                 FROM leaf l JOIN b_source b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang
                      AND l.source IS NOT DISTINCT FROM b.source WHERE b.budget > 0),
        e AS (SELECT d.*, p.tokens, p.budget, p.whole, p.rest,
                     unnest(generate_series(1, p.whole + 1)) AS epoch
              FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang
                   AND d.source IS NOT DISTINCT FROM p.source),
        c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
                                 ORDER BY substr(md5('17:' || epoch || ':' || doc_id), 1, 15), doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
        SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens,
               CAST(CASE WHEN epoch <= whole THEN n_tokens ELSE least(n_tokens, rest - start) END AS BIGINT) AS take_tokens,
               CAST(tokens AS BIGINT) AS leaf_tokens, budget AS leaf_budget
        FROM c WHERE epoch <= whole OR start < rest
    """,
}

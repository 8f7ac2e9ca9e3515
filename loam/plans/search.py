"""Registered document searches and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import clusters as C
from loam.operators import match as M
from loam.operators import results as R
from loam.operators import score as S
from loam.operators import terms as Q
from loam.operators import trigrams as X
from loam.session import folder

#: No proper prefix of these terms is a suffix, so SQL finds their places by splitting.
TERMS = (Q.Term("the", 0), Q.Term("ion", 1), Q.Term("and", 0), Q.Term("sch", 2))
WORDS = ("Bulgraia energy", "the", "Schön", "ENERGY", "nation", "distribution")
FUZZY = ("Ontion", "theat")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return table(spark, sf, name).select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def matched(spark, sf, terms=TERMS, name="documents", key="doc_id", text="text"):
    rows = M.match(M.spread(corpus(spark, sf, name, key, text), "doc_id"), terms)
    return rows.select("doc_id", F.length("text").alias("len"), "matches").where(F.size("matches") > 0)


def match_positions(spark, sf):
    return M.exploded(matched(spark, sf), "doc_id").select("doc_id", "term", F.col("pos").cast("long"))


def match_positions_split(spark, sf):
    """The same in the JVM alone, by splitting at each term."""
    return M.positions(M.spread(corpus(spark, sf), "doc_id"), TERMS, "doc_id")


def match_counts(spark, sf):
    return M.exploded(matched(spark, sf), "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def scored(spark, sf, how, **more):
    rows = matched(spark, sf)
    return rows.select("doc_id", F.size("matches").cast("long").alias("n"), S.unique_terms(F.col("matches")).alias("u"), F.round(how(F.col("matches"), F.col("len"), **more), 6).alias("score"))


def found(spark, sf, **how):
    rows = R.search(corpus(spark, sf), TERMS, columns=("n", "score"), **how)
    return rows.select(F.col("uri").cast("long").alias("doc_id"), "n", F.round("score", 6).alias("score"))


def search_topk(spark, sf):
    return found(spark, sf, min_score=1.0).orderBy(F.desc("score"), "doc_id").limit(20)


def proximity_clusters(spark, sf):
    return matched(spark, sf).select("doc_id", S.clusters(F.col("matches")).alias("clusters"))


def line_numbers(spark, sf):
    return M.exploded(matched(spark, sf), "doc_id").select("doc_id", "term", F.col("pos").cast("long"), F.col("line").cast("long"))


def line_clusters(spark, sf):
    numbers = M.exploded(matched(spark, sf, [Q.Term("sch")]), "doc_id").select("doc_id", F.col("line").cast("long")).distinct()
    return R.line_clusters(numbers, ["doc_id"], 1)


def context_snippets(spark, sf):
    results = R.with_contexts(corpus(spark, sf), [Q.Term("sch")], 1, min_score=0.0)
    return results.select(F.col("uri").cast("long").alias("doc_id"), F.size("line_numbers").cast("long").alias("n"), F.array_join("matches_with_context", "\n--\n").alias("contexts"))


def doc_title(spark, sf):
    return corpus(spark, sf).select("doc_id", T.title(F.col("text")).alias("title"))


def bulk_search(spark, sf):
    results = R.bulk_search(corpus(spark, sf), TERMS, context=2, min_score=4.0)
    return results.select("uri", F.round("score", 6).alias("score"), F.to_json("search_term_match_counts").alias("counts"), F.size("line_numbers").alias("n_lines"), "title", F.size("matches_with_context").alias("n_contexts"))


def fuzzy_search(spark, sf):
    """Terms expanded by case variants and n-grams."""
    rows = R.search(corpus(spark, sf), Q.prepare(FUZZY, exact=False), min_score=2.0, columns=("n", "score"))
    return rows.select(F.col("uri").cast("long").alias("doc_id"), "n", F.round("score", 6).alias("score"))


def search_table_terms(spark, sf):
    """Documents that hold words of the benchmark, each of which is a term, and how many of these terms they hold."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]{6,})"), 1)).alias("text"))
    rows = M.match(M.spread(corpus(spark, sf), "doc_id"), Q.from_table(words)).where(F.size("matches") > 0)
    found = F.array_distinct(F.transform("matches", lambda m: m["term"]))
    return rows.select("doc_id", F.size(found).cast("long").alias("n_terms"), F.array_min(found).alias("first_term"), F.array_max(found).alias("last_term"))


#: Terms that most blocks of the corpus don't hold.
RARE = (Q.Term("AKIA", 0), Q.Term("token = ", 1), Q.Term("@mail7", 0), Q.Term("password", 2))


def search_indexed(spark, sf):
    """The corpus is indexed once; the search reads the blocks that the index leaves."""
    at = folder(spark, "trigrams")
    X.store(table(spark, sf, "documents"), at, block_bytes=1 << 16)
    rows = X.indexed_search(spark, at, RARE, min_score=0.0, columns=("n", "score"))
    return rows.select(F.col("uri").cast("long").alias("doc_id"), "n", F.round("score", 6).alias("score"))


def on_corpus(name, key, text, extra=None):
    def query(spark, sf):
        rows = matched(spark, sf, TERMS, name, key, text)
        return rows.select("doc_id", F.size("matches").cast("long").alias("n"), F.round(S.advanced(F.col("matches"), F.col("len")), 6).alias("score"))

    return query


def conversation_search(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = M.match(rows, TERMS).where(F.size("matches") > 0)
    return rows.select("conv_id", "turn", F.size("matches").cast("long").alias("n"), F.round(S.advanced(F.col("matches"), F.length("text")), 6).alias("score"))


def term_variants(spark, sf):
    rows = [(w, i, t.order, t.text) for w in WORDS for i, t in enumerate(Q.expand(w))]
    return spark.createDataFrame(rows, "word string, seq int, order int, text string")


def term_order_parse(spark, sf):
    names = table(spark, sf, "nation").select(F.concat_ws("::", "n_name", F.col("n_nationkey").cast("string")).alias("s"))
    more = table(spark, sf, "region").select(F.concat_ws("::", "r_name", F.lit("a"), F.lit("1")).alias("s"))
    parts = F.split("s", "::", -1)
    return names.unionByName(more).select("s", F.element_at(parts, 1).alias("text"), F.when(F.size(parts) == 2, F.element_at(parts, -1).cast("int")).otherwise(0).cast("long").alias("order"))


def term_ngrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(T.ngrams(F.col("p_name"))).alias("i", "gram")).select("p_partkey", F.col("i").cast("long"), "gram")


def term_dedup(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("order"), F.col("o_orderpriority").alias("text"))
    return Q.last_wins_frame(rows)


def frequency_dict(spark, sf):
    words = M.spread(corpus(spark, sf), "doc_id").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def spell_correct(spark, sf):
    words = spark.createDataFrame([("thw",), ("adn",), ("ontoin",), ("schhn",), ("qqqqqqqq",), ("thing",)], "word string")
    return Q.corrections(words, frequency_dict(spark, sf))


def spell_correct_table(spark, sf):
    """The words of the benchmark, each without its second letter, corrected by those of the corpus."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{4,})"), 1)).alias("w")).select(F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)")).alias("word"))
    return Q.corrections(words, frequency_dict(spark, sf))


#: What a user types, with a slip in each word.
TYPED = ("ontoin theat", "wass")


def corrected_search(spark, sf):
    rows = R.corrected_search(corpus(spark, sf), TYPED, frequency_dict(spark, sf), min_score=2.0, columns=("n", "score"))
    return rows.select(F.col("uri").cast("long").alias("doc_id"), "n", F.round("score", 6).alias("score"))


def best_results(spark, sf):
    return C.top_results(R.with_contexts(corpus(spark, sf), TERMS, min_score=1.0))


def word_frequency(spark, sf):
    return C.word_frequency(best_results(spark, sf)).orderBy(F.desc("n"), "word").limit(50)


def word_clusters_topk(spark, sf):
    return C.word_clusters(best_results(spark, sf))


def derivative_search(spark, sf):
    rows = C.derivative_search(corpus(spark, sf), TERMS)
    return rows.select(F.col("uri").cast("long").alias("doc_id"), "n", F.round("score", 6).alias("score"))


def set_queries(kind):
    def query(spark, sf):
        a = table(spark, sf, "documents").select("doc_id")
        b = table(spark, sf, "labels").select("doc_id")
        if kind == "union":
            return a.unionByName(b).distinct()
        return a.intersect(b) if kind == "intersect" else a.join(b, "doc_id", "left_anti")

    return query


QUERIES = {
    "match_positions": match_positions, "match_positions_split": match_positions_split, "match_counts": match_counts,
    "search_or": lambda s, d: found(s, d, min_score=0.0), "search_and": lambda s, d: found(s, d, min_score=0.0, all_terms=True),
    "search_min_score": lambda s, d: found(s, d, min_score=8.0), "search_topk": search_topk,
    "score_basic": lambda s, d: scored(s, d, S.basic), "score_improved": lambda s, d: scored(s, d, S.improved),
    "score_advanced": lambda s, d: scored(s, d, S.advanced), "score_noise_filtered": lambda s, d: scored(s, d, S.advanced, noise=["io", "sc"]),
    "proximity_clusters": proximity_clusters, "line_numbers": line_numbers, "line_clusters": line_clusters, "context_snippets": context_snippets,
    "doc_title": doc_title, "bulk_search": bulk_search, "fuzzy_search": fuzzy_search, "search_table_terms": search_table_terms, "search_indexed": search_indexed, "html_as_code_search": on_corpus("pages", "page_id", "html"),
    "benchmark_search": on_corpus("benchmark", "item_id", "text"), "conversation_search": conversation_search,
    "term_variants": term_variants, "term_order_parse": term_order_parse, "term_ngrams": term_ngrams, "term_dedup_last_wins": term_dedup,
    "frequency_dict": frequency_dict, "spell_correct": spell_correct, "spell_correct_table": spell_correct_table, "corrected_search": corrected_search, "word_frequency": word_frequency, "word_clusters_topk": word_clusters_topk,
    "derivative_search": derivative_search, "set_union": set_queries("union"), "set_intersect": set_queries("intersect"), "set_except": set_queries("except"),
}


def stem(term: str) -> str:
    """The longest prefix that can't overlap itself; splitting at it finds every place of the term, overlapping ones too."""
    return next(p for p in (term[:n] for n in range(len(term), 0, -1)) if not any(p[:k] == p[-k:] for k in range(1, len(p))))


def text_cte(terms=TERMS, source="SELECT doc_id, coalesce(text, '') AS text FROM documents", listed: str | None = None) -> str:
    """CTE m(doc_id, len, term, ord, pos): the places of each term (or of those that `listed` selects), by splitting."""
    listed = listed or "VALUES " + ", ".join(f"('{t.text}', {t.order}, '{stem(t.text)}')" for t in terms)
    return f"""d AS ({source}), t(term, ord, stem) AS ({listed}),
sp AS (SELECT doc_id, length(text) AS len, term, ord, stem, string_split(text, stem) AS ps FROM d, t WHERE contains(text, term)),
un AS (SELECT doc_id, len, term, ord, stem, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, len(ps) AS k FROM sp),
m AS (SELECT doc_id, len, term, ord, pos FROM (SELECT *, CAST(sum(length(p)) OVER w + (i - 1) * length(stem) AS BIGINT) AS pos, stem || lead(p) OVER w || CASE WHEN i + 1 < k THEN stem ELSE '' END AS ahead FROM un WINDOW w AS (PARTITION BY doc_id, term ORDER BY i)) WHERE i < k AND starts_with(ahead, term))"""


#: CTE s(doc_id, len, n, u, w, wb, c): what the scores are made of, from m.
SCORE_CTE = """o AS (SELECT doc_id, ord, count(*) AS k FROM m GROUP BY 1, 2),
w AS (SELECT doc_id, sum(k * (CAST(0.9 AS DOUBLE) / (ord + 1))) AS w, sum(k * pow(10.0, -ord)) AS wb FROM o GROUP BY 1),
g AS (SELECT doc_id, any_value(len) AS len, count(*) AS n, count(DISTINCT term) AS u, list_sort(list(pos)) AS ps FROM m GROUP BY 1),
c AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {'c': 1, 's': x}), lambda a, x: CASE WHEN x.s - a.s > 50 THEN {'c': a.c + 1, 's': x.s} ELSE a END).c AS c FROM g),
s AS (SELECT g.doc_id, g.len, g.n, g.u, w.w, w.wb, CAST(c.c AS BIGINT) AS c FROM g JOIN w USING (doc_id) JOIN c USING (doc_id))"""
ADVANCED = "w * sqrt(u) * (1 + CAST(n AS DOUBLE) / len) * (1 + 1 / CAST(c AS DOUBLE)) * (1 + least(1.0, CAST(n AS DOUBLE) / len))"


def scored_sql(select: str, terms=TERMS, source="SELECT doc_id, coalesce(text, '') AS text FROM documents") -> str:
    return f"WITH {text_cte(terms, source)}, {SCORE_CTE} {select}"


def search_sql(where: str = "", terms=TERMS) -> str:
    return scored_sql(f"SELECT doc_id, n, round({ADVANCED}, 6) AS score FROM s {where}", terms)


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)
FREQUENCY = r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY word"
#: tt(t, o, stem): the typed strings, their corrections and cases, and the n-grams of these; of equal texts the last, which has the highest order here; stem as in stem().
TYPED_TERMS = f"""fq AS ({FREQUENCY}), ty(q, s) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(TYPED))}),
tw AS (SELECT q, unnest(string_split(s, ' ')) AS word, generate_subscripts(string_split(s, ' '), 1) AS i FROM ty),
tk AS (SELECT tw.q, tw.i, tw.word, fq.word AS known FROM tw JOIN (SELECT *, translate(word, 'àâäáçéèêëîïíñôöóùûüúß', 'ABCDEFGHIJKLMNOPQRSTU') AS w FROM fq) fq ON levenshtein(tw.word, fq.w) <= 2 QUALIFY row_number() OVER (PARTITION BY tw.q, tw.i ORDER BY levenshtein(tw.word, fq.w), n DESC, fq.word) = 1),
tv AS (SELECT q, s, list_filter([c, CASE WHEN lower(s) <> s THEN lower(s) END, CASE WHEN upper(s) <> s THEN upper(s) END, CASE WHEN title <> s THEN title END], lambda x: x IS NOT NULL) AS vs FROM (
  SELECT ty.q, ty.s, (SELECT string_agg(known, ' ' ORDER BY i) FROM tk WHERE tk.q = ty.q AND known <> word) AS c, array_to_string(list_transform(string_split(s, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM ty)),
te AS (SELECT q, unnest([{{'o': 0, 't': s}}] || flatten(list_transform(vs, lambda x: [{{'o': 1, 't': x}}] || CASE WHEN length(x) < 5 THEN [{{'o': 2, 't': x}}]
  ELSE list_transform(range(1, length(x) + 2 - CASE WHEN length(x) >= 9 THEN 5 WHEN length(x) >= 7 THEN 4 ELSE 3 END), lambda i: {{'o': 2, 't': x[i : i - 1 + CASE WHEN length(x) >= 9 THEN 5 WHEN length(x) >= 7 THEN 4 ELSE 3 END]}}) END))) AS e FROM tv),
tt AS (SELECT t, o, t[1:list_filter(range(length(t), 0, -1), lambda m: len(list_filter(range(1, m), lambda k: t[1:k] = t[m - k + 1:m])) = 0)[1]] AS stem FROM (SELECT e.t AS t, max(e.o) AS o FROM te GROUP BY e.t))"""
#: Words of the title and the contexts (16 lines about each match) of the four best results.
TOP_CTE = f"""top AS (SELECT doc_id, {ADVANCED} AS sc FROM s WHERE {ADVANCED} >= 1 ORDER BY round({ADVANCED}, 9) DESC, CAST(doc_id AS VARCHAR) LIMIT 4),
tl AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT d.doc_id, string_split(d.text, chr(10)) AS ls FROM top JOIN d USING (doc_id))),
ml AS (SELECT DISTINCT m.doc_id, 1 + pos - length(replace(substr(d.text, 1, CAST(pos AS INTEGER)), chr(10), '')) AS l FROM m JOIN top USING (doc_id) JOIN d USING (doc_id)),
tt AS (SELECT line FROM tl WHERE i <= 5 UNION ALL SELECT line FROM tl WHERE EXISTS (SELECT 1 FROM ml WHERE ml.doc_id = tl.doc_id AND ml.l BETWEEN tl.i - 16 AND tl.i + 16)),
tw AS (SELECT lower(word) AS word FROM (SELECT unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+')) AS word FROM tt) WHERE length(word) >= 5 AND lower(word) NOT IN ({STOP})),
tf AS (SELECT word, count(*) AS n FROM tw GROUP BY word ORDER BY n DESC, word LIMIT 50)"""

CLUSTERS = scored_sql("SELECT 1 AS x").replace(" SELECT 1 AS x", f""", {TOP_CTE}, r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS i FROM tf),
        k2 AS (SELECT [a.word, b.word] AS ws, a.n + b.n AS t, b.i AS i FROM r a JOIN r b ON b.i > a.i), k3 AS (SELECT list_append(ws, r.word) AS ws, t + r.n AS t, r.i AS i FROM k2 JOIN r ON r.i > k2.i),
        k4 AS (SELECT list_append(ws, r.word) AS ws, t + r.n AS t, r.i AS i FROM k3 JOIN r ON r.i > k3.i)
        SELECT array_to_string(ws, ' ') AS cluster, round(sc, 6) AS score FROM (SELECT ws, t / 2 AS sc FROM k2 UNION ALL SELECT ws, t / 3 FROM k3 UNION ALL SELECT ws, t / 4 FROM k4) ORDER BY sc DESC, ws DESC LIMIT 10""")
TITLE = r"regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10))[1:5], lambda x: regexp_replace(x, '\r$', '')), chr(10)), '^\s+|\s+$', '', 'g')"

ORACLES = {
    "match_positions": f"WITH {text_cte()} SELECT doc_id, term, pos FROM m",
    "match_positions_split": f"WITH {text_cte()} SELECT doc_id, term, pos FROM m",
    "match_counts": f"WITH {text_cte()} SELECT doc_id, term, count(*) AS n FROM m GROUP BY 1, 2",
    "search_or": search_sql(), "search_and": search_sql(f"WHERE u >= {len(TERMS)}"), "search_min_score": search_sql(f"WHERE {ADVANCED} >= 8"),
    "search_topk": search_sql(f"WHERE {ADVANCED} >= 1 ORDER BY score DESC, doc_id LIMIT 20"),
    "score_basic": scored_sql("SELECT doc_id, n, u, round(wb * sqrt(u) * (1 + least(1.0, CAST(n AS DOUBLE) / len)), 6) AS score FROM s"),
    "score_improved": scored_sql(f"SELECT doc_id, n, u, round({ADVANCED}, 6) AS score FROM s"),
    "score_advanced": scored_sql(f"SELECT doc_id, n, u, round({ADVANCED}, 6) AS score FROM s"),
    "score_noise_filtered": f"""WITH {text_cte()}, everything AS (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS u FROM m GROUP BY 1),
        {SCORE_CTE.replace("FROM m ", "FROM (SELECT * FROM m WHERE term NOT IN ('ion', 'sch')) ")}
        SELECT e.doc_id, e.n, e.u, coalesce(round({ADVANCED.replace("n AS", "s.n AS").replace("sqrt(u)", "sqrt(s.u)")}, 6), 0) AS score FROM everything e LEFT JOIN s USING (doc_id)""",
    "proximity_clusters": scored_sql("SELECT doc_id, c AS clusters FROM s"),
    "line_numbers": f"WITH {text_cte()} SELECT doc_id, term, pos, CAST(1 + pos - length(replace(substr(d.text, 1, CAST(pos AS INTEGER)), chr(10), '')) AS BIGINT) AS line FROM m JOIN d USING (doc_id)",
    "line_clusters": f"""WITH {text_cte([Q.Term("sch")])}, l AS (SELECT DISTINCT doc_id, CAST(1 + pos - length(replace(substr(d.text, 1, CAST(pos AS INTEGER)), chr(10), '')) AS BIGINT) AS line FROM m JOIN d USING (doc_id)),
        r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) > 2 THEN 1 ELSE 0 END AS f FROM l))
        SELECT doc_id, min(line) AS first, max(line) AS last FROM r GROUP BY doc_id, run""",
    "context_snippets": f"""WITH {text_cte([Q.Term("sch")])}, a AS (SELECT doc_id, 1 + pos - length(replace(substr(d.text, 1, CAST(pos AS INTEGER)), chr(10), '')) AS line FROM m JOIN d USING (doc_id)),
        l AS (SELECT DISTINCT doc_id, line FROM a), r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) > 2 THEN 1 ELSE 0 END AS f FROM l)),
        x AS (SELECT doc_id, run, greatest(min(line) - 1, 1) AS a, max(line) + 1 AS b FROM r GROUP BY doc_id, run),
        li AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d WHERE doc_id IN (SELECT doc_id FROM x))),
        y AS (SELECT x.doc_id, run, string_agg('|' || i || '|    ' || regexp_replace(line, '\\r$', ''), chr(10) ORDER BY i) AS t FROM x JOIN li ON li.doc_id = x.doc_id AND i BETWEEN a AND b GROUP BY x.doc_id, run)
        SELECT doc_id, (SELECT count(*) FROM a WHERE a.doc_id = y.doc_id) AS n, string_agg(t, chr(10) || '--' || chr(10) ORDER BY run) AS contexts FROM y GROUP BY doc_id""".replace("\\\\r", "\\r"),
    "doc_title": f"SELECT doc_id, {TITLE} AS title FROM documents",
    "bulk_search": scored_sql(f"""SELECT * FROM (SELECT CAST(s.doc_id AS VARCHAR) AS uri, round({ADVANCED}, 6) AS score, counts, n AS n_lines, {TITLE} AS title, n_contexts FROM s JOIN d USING (doc_id) JOIN jc USING (doc_id) JOIN rc USING (doc_id) WHERE {ADVANCED} >= 4)""").replace(" SELECT * FROM (", """,
        jc AS (SELECT doc_id, '{' || string_agg('"' || term || '":' || k, ',' ORDER BY term) || '}' AS counts FROM (SELECT doc_id, term, count(*) AS k FROM m GROUP BY 1, 2) GROUP BY doc_id),
        li AS (SELECT DISTINCT doc_id, 1 + pos - length(replace(substr(d.text, 1, CAST(pos AS INTEGER)), chr(10), '')) AS line FROM m JOIN d USING (doc_id)),
        rc AS (SELECT doc_id, count(*) FILTER (before IS NULL OR line - before > 4) AS n_contexts FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM li) GROUP BY doc_id)
        SELECT * FROM (""", 1),
    "fuzzy_search": search_sql(f"WHERE {ADVANCED} >= 2", Q.last_wins(Q.prepare(FUZZY, exact=False))),
    "search_indexed": search_sql("", RARE),
    "search_table_terms": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS term FROM benchmark)
        SELECT doc_id, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM documents, t WHERE contains(text, term) GROUP BY doc_id""",
    "derivative_search": f"""WITH {text_cte(listed=f"SELECT word, 0, word FROM (SELECT unnest(string_split(cluster, ' ')) AS word FROM (SELECT cluster FROM ({CLUSTERS}) ORDER BY score DESC, cluster DESC LIMIT 1))")}, {SCORE_CTE}
        SELECT doc_id, n, round({ADVANCED}, 6) AS score FROM s WHERE {ADVANCED} >= 1""",
    "term_variants": f"""WITH q(word) AS (VALUES {", ".join(f"('{w}')" for w in WORDS)}),
        v AS (SELECT word, list_filter([lower(word), upper(word), array_to_string(list_transform(string_split(word, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')], lambda x: x <> word) AS vs FROM q),
        e AS (SELECT word, [{{'o': 0, 't': word}}] || flatten(list_transform(vs, lambda x: [{{'o': 1, 't': x}}] || CASE WHEN length(x) < 5 THEN [{{'o': 2, 't': x}}]
              ELSE list_transform(range(1, length(x) + 2 - CASE WHEN length(x) >= 9 THEN 5 WHEN length(x) >= 7 THEN 4 ELSE 3 END), lambda i: {{'o': 2, 't': x[i : i - 1 + CASE WHEN length(x) >= 9 THEN 5 WHEN length(x) >= 7 THEN 4 ELSE 3 END]}}) END)) AS es FROM v),
        u AS (SELECT word, unnest(es) AS x, generate_subscripts(es, 1) - 1 AS seq FROM e)
        SELECT word, CAST(seq AS INTEGER) AS seq, CAST(x.o AS INTEGER) AS "order", x.t AS text FROM u""",
    "html_as_code_search": scored_sql(f"SELECT doc_id, n, round({ADVANCED}, 6) AS score FROM s", TERMS, "SELECT page_id AS doc_id, coalesce(html, '') AS text FROM pages"),
    "benchmark_search": scored_sql(f"SELECT doc_id, n, round({ADVANCED}, 6) AS score FROM s", TERMS, "SELECT item_id AS doc_id, coalesce(text, '') AS text FROM benchmark"),
    "conversation_search": scored_sql(f"SELECT doc_id.c AS conv_id, doc_id.t AS turn, n, round({ADVANCED}, 6) AS score FROM s", TERMS, "SELECT {'c': conv_id, 't': turn} AS doc_id, coalesce(text, '') AS text FROM conversations"),
    "term_order_parse": """WITH x AS (SELECT n_name || '::' || n_nationkey AS s FROM nation UNION ALL SELECT r_name || '::a::1' FROM region)
        SELECT s, string_split(s, '::')[1] AS text, CASE WHEN len(string_split(s, '::')) = 2 THEN CAST(string_split(s, '::')[2] AS BIGINT) ELSE 0 END AS "order" FROM x""",
    "term_ngrams": """WITH w AS (SELECT p_partkey, p_name AS w, CASE WHEN length(p_name) >= 9 THEN 5 WHEN length(p_name) >= 7 THEN 4 ELSE 3 END AS k FROM part)
        SELECT p_partkey, i - 1 AS i, substr(w, CAST(i AS INTEGER), k) AS gram FROM (SELECT *, unnest(range(1, length(w) - k + 2)) AS i FROM w WHERE length(w) >= 5)
        UNION ALL SELECT p_partkey, 0, w FROM w WHERE length(w) < 5""",
    "term_dedup_last_wins": "SELECT max(o_orderkey) AS seq, arg_max(o_custkey, o_orderkey) AS \"order\", o_orderpriority AS text FROM orders WHERE o_orderpriority <> '' GROUP BY o_orderpriority",
    "frequency_dict": FREQUENCY,
    "spell_correct": f"""WITH f AS ({FREQUENCY}), q(word) AS (VALUES ('thw'), ('adn'), ('ontoin'), ('schhn'), ('qqqqqqqq'), ('thing')),
        c AS (SELECT q.word, f.word AS known, row_number() OVER (PARTITION BY q.word ORDER BY levenshtein(q.word, f.word), n DESC, f.word) AS rn FROM q JOIN f ON abs(length(f.word) - length(q.word)) <= 2 AND levenshtein(q.word, f.word) <= 2)
        SELECT q.word, coalesce(known, q.word) AS correction FROM q LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (word)""",
    # levenshtein counts bytes here, so letters of two bytes become capitals, which no word has
    "spell_correct_table": f"""WITH f AS ({FREQUENCY}), q AS (SELECT DISTINCT w[1] || w[3:] AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM benchmark)),
        c AS (SELECT q.word, f.word AS known, levenshtein(q.word, translate(f.word, 'àâäáçéèêëîïíñôöóùûüúß', 'ABCDEFGHIJKLMNOPQRSTU')) AS d, n FROM q JOIN f ON length(f.word) BETWEEN length(q.word) - 2 AND length(q.word) + 2)
        SELECT q.word, coalesce(known, q.word) AS correction FROM q LEFT JOIN (SELECT * FROM c WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, n DESC, known) = 1) USING (word)""",
    "corrected_search": f"WITH {TYPED_TERMS}, {text_cte(listed='SELECT t, o, stem FROM tt')}, {SCORE_CTE} SELECT doc_id, n, round({ADVANCED}, 6) AS score FROM s WHERE {ADVANCED} >= 2",
    "word_frequency": scored_sql("SELECT word, n FROM tf").replace(" SELECT word, n FROM tf", f", {TOP_CTE} SELECT word, n FROM tf"),
    "word_clusters_topk": CLUSTERS,
    "set_union": "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels", "set_intersect": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "set_except": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}

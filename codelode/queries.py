"""The registered queries over the given tables, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import clones, diffs, findings, history, hotspots, intervals, joins, rollups, rules, scopes, structure, study, tokens
from .plans import cases
from .sources import files, formats, store, table_functions


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


LINES_SQL = """
WITH l AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
d AS (SELECT doc_id, lang, count(*) AS total_lines, count(*) FILTER (WHERE trim(translate(line, chr(9) || chr(13), '  ')) = '') AS blank_lines,
  max(length(line)) AS longest_line FROM l GROUP BY doc_id, lang)
"""


@query(LINES_SQL + """
SELECT lang, count(*) AS files, sum(total_lines)::BIGINT AS total_lines, sum(blank_lines)::BIGINT AS blank_lines,
  sum(total_lines - blank_lines)::BIGINT AS text_lines, max(longest_line)::INTEGER AS longest_line FROM d GROUP BY lang""")
def doc_line_metrics(spark, sf_dir):
    lines = rollups.line_metrics(t(spark, sf_dir, "documents"), F.col("text"))
    return lines.groupBy("lang").agg(
        F.count("*").alias("files"), F.sum("total_lines").alias("total_lines"), F.sum("blank_lines").alias("blank_lines"),
        F.sum("text_lines").alias("text_lines"), F.max("longest_line").alias("longest_line"),
    )


@query("""
WITH k AS (SELECT coalesce(nullif(lang, ''), 'unknown') AS language, n_chars, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS b FROM k)
SELECT language AS scope, language, count(*) AS files, sum(n_chars)::BIGINT AS chars, max(n_chars) AS most_chars,
  max(n_chars) AS longest_size, max(CASE WHEN a = 1 THEN doc_id END) AS longest_name FROM r GROUP BY language
UNION ALL SELECT 'project', NULL, count(*), sum(n_chars)::BIGINT, max(n_chars), max(n_chars), max(CASE WHEN b = 1 THEN doc_id END) FROM r""")
def rollup_language_project(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return rollups.rollup_totals(d, F.col("lang"), {"chars": F.col("n_chars")}, {"most_chars": F.col("n_chars")}, F.col("n_chars"), F.col("doc_id"), F.col("doc_id"))


HEALTH_SQL = """
WITH m AS (SELECT lang,
    sum(length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS code,
    sum(length(text) - length(replace(text, ',', '')))::DOUBLE AS complexity,
    avg(length(text) - length(replace(text, '.', '')))::DOUBLE AS avg_function,
    sum(length(text) - length(replace(text, '-', '')))::DOUBLE AS comments,
    sum(length(text) - length(replace(text, '#', '')))::DOUBLE AS todos, 4 AS nesting FROM documents GROUP BY lang),
p AS (SELECT lang,
    least(greatest((complexity / greatest(code, 1) - 0.5::DOUBLE) / (0.15::DOUBLE - 0.5::DOUBLE) * 100, 0), 100) AS complexity_density,
    least(greatest((avg_function - 60.0::DOUBLE) / (15.0::DOUBLE - 60.0::DOUBLE) * 100, 0), 100) AS avg_function_length,
    least(greatest((comments / greatest(code, 1) - 0.02::DOUBLE) / (0.2::DOUBLE - 0.02::DOUBLE) * 100, 0), 100) AS comment_coverage,
    least(greatest((todos / greatest(code, 1) - 0.05::DOUBLE) / (0.01::DOUBLE - 0.05::DOUBLE) * 100, 0), 100) AS todo_density,
    least(greatest((nesting::DOUBLE - 8) / (3.0::DOUBLE - 8) * 100, 0), 100) AS nesting_depth FROM m),
s AS (SELECT *, complexity_density * 0.35::DOUBLE + avg_function_length * 0.25::DOUBLE + comment_coverage * 0.2::DOUBLE + todo_density * 0.1::DOUBLE + nesting_depth * 0.1::DOUBLE AS score FROM p)
"""


def _health(spark, sf_dir) -> DataFrame:
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    m = t(spark, sf_dir, "documents").groupBy("lang").agg(
        F.sum(count("\n") + 1).alias("code"), F.sum(count(",")).alias("complexity"), F.avg(count(".")).alias("avg_function"),
        F.sum(count("-")).alias("comments"), F.sum(count("#")).alias("todos"), F.lit(4).alias("nesting"),
    )
    return rollups.with_health(m, "code", "complexity", "avg_function", "comments", "todos", "nesting")


@query(HEALTH_SQL + """
SELECT lang, round(complexity_density, 6) AS complexity_density, round(avg_function_length, 6) AS avg_function_length, round(comment_coverage, 6) AS comment_coverage,
  round(todo_density, 6) AS todo_density, round(nesting_depth, 6) AS nesting_depth, round(score, 6) AS health_score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS health_grade FROM s""")
def doc_health_by_lang(spark, sf_dir):
    return _health(spark, sf_dir).select("lang", *[rounded(c).alias(c) for c in S.HEALTH_RAMPS], rounded("health_score").alias("health_score"), "health_grade")


@query(HEALTH_SQL + """
, e AS (SELECT lang, unnest(['complexity_density', 'avg_function_length', 'comment_coverage', 'todo_density', 'nesting_depth']) AS component,
    unnest([(100 - complexity_density) * 0.35::DOUBLE, (100 - avg_function_length) * 0.25::DOUBLE, (100 - comment_coverage) * 0.2::DOUBLE, (100 - todo_density) * 0.1::DOUBLE, (100 - nesting_depth) * 0.1::DOUBLE]) AS loss,
    unnest([1, 2, 3, 4, 5]) AS place FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY loss DESC, place) AS r FROM e WHERE loss > 0)
SELECT s.lang, k.component, round(k.loss, 6) AS points_lost FROM s LEFT JOIN k ON s.lang = k.lang AND k.r = 1""")
def weakest_component(spark, sf_dir):
    return rollups.weakest_component(_health(spark, sf_dir), ["lang"]).withColumn("points_lost", rounded("points_lost"))


@query("""
WITH g AS (SELECT lang, sum(n_chars)::BIGINT AS amount FROM documents GROUP BY lang HAVING sum(n_chars) > 0),
s AS (SELECT *, amount / sum(amount) OVER () AS share FROM g)
SELECT lang, amount, round(share::DOUBLE, 6) AS share,
  CASE WHEN share < 0.001 THEN '<0.1%' ELSE printf('%.1f', floor(share * 1000 + 0.5) / 10) || '%' END AS share_text FROM s""")
def language_share(spark, sf_dir):
    shares = rollups.share_of_total(t(spark, sf_dir, "documents"), "lang", F.col("n_chars"))
    return shares.select("lang", "amount", rounded("share").alias("share"), S.share_text(F.col("share")).alias("share_text"))


@query("""
WITH p AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, length(html) AS n FROM pages),
e AS (SELECT regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1) AS name, n FROM p)
SELECT name, count(*) AS files, CASE WHEN count(n) = count(*) THEN sum(n)::BIGINT END AS lines FROM e GROUP BY name""")
def unanalyzed_by_ext(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return rollups.group_lines(t(spark, sf_dir, "pages"), S.extension(path), F.length("html").cast("long"))


LICENSES = ["apache license", "mit license", "gnu general public license", "creative commons", "all rights reserved"]


@query("""
WITH l AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM documents),
h AS (SELECT doc_id, CASE WHEN contains(plain, 'apache license') THEN 'apache license' WHEN contains(plain, 'mit license') THEN 'mit license'
  WHEN contains(plain, 'gnu general public license') THEN 'gnu general public license' WHEN contains(plain, 'creative commons') THEN 'creative commons'
  WHEN contains(plain, 'all rights reserved') THEN 'all rights reserved' END AS phrase FROM l)
SELECT doc_id, phrase FROM h WHERE phrase IS NOT NULL""")
def license_phrase_hits(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", S.first_phrase(F.col("text"), LICENSES).alias("phrase")).filter("phrase is not null")


@query()
def secret_token_scan(spark, sf_dir):
    """Provider tokens in texts and pages; the given tables may hold none."""
    d, p = t(spark, sf_dir, "documents"), t(spark, sf_dir, "pages")
    both = d.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text").unionByName(p.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    return findings.secret_hits(both, ["source", "id"], F.col("text"))


_SAME = "|".join(f"{c}{{6}}" for c in "0123456789abcdef")


@query(f"""
WITH b AS (SELECT c_nationkey % 6 AS kind, md5(c_custkey::VARCHAR) || substr(md5(c_custkey || 'x'), 1, 8) AS body FROM customer),
t AS (SELECT CASE kind WHEN 0 THEN 'gh' WHEN 1 THEN 'AKIA' WHEN 2 THEN 'sk-ant-' ELSE 'sk-' END AS format,
  CASE kind WHEN 0 THEN body WHEN 1 THEN substr(body, 1, 16) WHEN 2 THEN substr(body, 1, 32) ELSE '9' || body END AS body FROM b WHERE kind < 4)
SELECT format, count(*) AS n, sum(length(body))::BIGINT AS chars FROM t WHERE NOT regexp_matches(body, '{_SAME}') AND NOT contains(body, '123456') GROUP BY format""")
def secret_token_cases(spark, sf_dir):
    """Provider tokens in texts that are written from the customers: four kinds, one without a boundary, one a placeholder."""
    key, kind = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 6
    body = F.concat(F.md5(key.cast("binary")), F.substring(F.md5(F.concat(key, F.lit("x")).cast("binary")), 1, 8))
    text = (
        F.when(kind == 0, F.concat(F.lit('t = "ghp_'), body, F.lit('"'))).when(kind == 1, F.concat(F.lit("key AKIA"), F.upper(F.substring(body, 1, 16)), F.lit(" end")))
        .when(kind == 2, F.concat(F.lit("sk-ant-"), F.substring(body, 1, 32))).when(kind == 3, F.concat(F.lit("(sk-Zz9"), body, F.lit(")")))
        .when(kind == 4, F.concat(F.lit("xghp_"), body)).otherwise(F.concat(F.lit("gho_example"), body))
    )
    found = findings.secret_hits(t(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), ["c_custkey"], F.col("text"))
    held = F.length(F.regexp_replace("token", "^(sk-ant-|sk-Zz|AKIA|gh[a-z]_)", ""))
    return found.groupBy("format").agg(F.count("*").alias("n"), F.sum(held).cast("bigint").alias("chars"))


SEEDS_SQL = """
WITH w AS (SELECT lang AS language, doc_id AS file, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS tok FROM documents),
c AS (SELECT language, file, tok, unnest(range(0, len(tok) // 40)) AS chunk FROM w WHERE len(tok) >= 40),
s AS (SELECT language, file, chunk::INTEGER AS chunk, md5(array_to_string(tok[chunk * 40 + 1 : chunk * 40 + 40], chr(31))) AS digest FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY language, digest) AS n, row_number() OVER (PARTITION BY language, digest ORDER BY file, chunk) AS place FROM s),
k AS (SELECT * FROM n WHERE n > 1 AND place <= 64),
p AS (SELECT DISTINCT a.language, a.file AS file_a, b.file AS file_b, a.chunk AS chunk_a, b.chunk AS chunk_b FROM k a JOIN k b ON a.language = b.language AND a.digest = b.digest AND a.place < b.place),
r AS (SELECT *, chunk_b - chunk_a AS d, chunk_a - row_number() OVER (PARTITION BY language, file_a, file_b, chunk_b - chunk_a ORDER BY chunk_a) AS run FROM p),
q AS (SELECT language, file_a, file_b, min(chunk_a) AS chunk_a, min(chunk_b) AS chunk_b, count(*) AS chunks FROM r GROUP BY language, file_a, file_b, d, run)
"""


def _seeds(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split("text", "[ \t\n]+", -1), lambda x: x != "")
    return clones.seed_windows(t(spark, sf_dir, "documents").filter("text is not null"), "lang", "doc_id", words)


@query(SEEDS_SQL + "SELECT language, digest, count(*) AS windows, count(DISTINCT file) AS files FROM s GROUP BY language, digest HAVING count(*) > 1")
def clone_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir).groupBy("language", "digest").agg(F.count("*").alias("windows"), F.count_distinct("file").alias("files")).filter("windows > 1")


@query(SEEDS_SQL + "SELECT * FROM q")
def clone_pairs(spark, sf_dir):
    return clones.clone_pairs(_seeds(spark, sf_dir))


@query(SEEDS_SQL + """
, i AS (SELECT file_a AS file, unnest(range(chunk_a::BIGINT, chunk_a + chunks)) AS c FROM q UNION SELECT file_b, unnest(range(chunk_b::BIGINT, chunk_b + chunks)) FROM q)
SELECT file, (count(*) * 40)::BIGINT AS covered FROM i GROUP BY file""")
def clone_line_coverage(spark, sf_dir):
    return clones.clone_coverage(clones.clone_pairs(_seeds(spark, sf_dir)))


# By tokens: the diagonals that a seed lies on, the runs of equal tokens on them, and those runs that hold a seed.
MATCHES_SQL = """
WITH x AS (SELECT doc_id, lang, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL),
y AS (SELECT lang AS language, doc_id AS path, line, list_filter(string_split_regex(string_split(text, chr(10))[line], '[ \\t]+'), lambda x: x <> '') AS tok FROM x),
z AS (SELECT language, path, line, tok, unnest(range(len(tok))) AS i FROM y),
w AS (SELECT language, path, line, tok[i + 1] AS code, row_number() OVER (PARTITION BY language, path ORDER BY line, i) - 1 AS place FROM z),
s AS (SELECT language, path, place // 40 AS chunk, string_agg(code, chr(31) ORDER BY place) AS run40 FROM w GROUP BY ALL HAVING count(*) = 40),
n AS (SELECT *, count(*) OVER (PARTITION BY language, run40) AS n, row_number() OVER (PARTITION BY language, run40 ORDER BY path, chunk) AS rank FROM s),
k AS (SELECT * FROM n WHERE n > 1 AND rank <= 64),
p AS (SELECT DISTINCT a.language, a.path AS path_a, b.path AS path_b, a.chunk * 40 AS at, (b.chunk - a.chunk) * 40 AS d FROM k a JOIN k b ON a.language = b.language AND a.run40 = b.run40 AND a.rank < b.rank),
g AS (SELECT DISTINCT language, path_a, path_b, d FROM p),
e AS (SELECT g.*, a.place, a.line AS line_a, b.line AS line_b, a.place - row_number() OVER (PARTITION BY g.language, g.path_a, g.path_b, g.d ORDER BY a.place) AS run
  FROM g JOIN w a ON a.language = g.language AND a.path = g.path_a JOIN w b ON b.language = g.language AND b.path = g.path_b AND b.place = a.place + g.d AND b.code = a.code),
r AS (SELECT language, path_a, path_b, d, min(place) AS first, count(*) AS token_count, min(line_a) AS line_start_a, max(line_a) AS line_end_a, min(line_b) AS line_start_b, max(line_b) AS line_end_b
  FROM e GROUP BY language, path_a, path_b, d, run),
m AS (SELECT * FROM r SEMI JOIN p ON p.language = r.language AND p.path_a = r.path_a AND p.path_b = r.path_b AND p.d = r.d AND p.at BETWEEN r.first AND r.first + r.token_count - 40
  WHERE path_a <> path_b OR d >= token_count),
o AS (SELECT language, path_a, line_start_a::INTEGER AS line_start_a, line_end_a::INTEGER AS line_end_a, path_b, line_start_b::INTEGER AS line_start_b, line_end_b::INTEGER AS line_end_b, token_count::INTEGER AS token_count, (line_end_a - line_start_a + 1)::INTEGER AS line_count
  FROM m QUALIFY row_number() OVER (PARTITION BY language, path_a, line_start_a, path_b, line_start_b ORDER BY token_count DESC, line_end_a DESC, line_end_b DESC) = 1)
"""


def _matches(spark, sf_dir) -> DataFrame:
    own = t(spark, sf_dir, "documents"), "lang", "doc_id", "text"
    return clones.clone_matches(clones.text_chunks(*own), ends=clones.text_ends(*own))


@query(MATCHES_SQL + "SELECT * FROM o")
def clone_matches(spark, sf_dir):
    """Clones among the documents, word by word, with their lines."""
    return _matches(spark, sf_dir)


@query(MATCHES_SQL + """
, v AS (SELECT path_a AS path, unnest(range(line_start_a, line_end_a + 1)) AS line FROM o UNION SELECT path_b, unnest(range(line_start_b, line_end_b + 1)) FROM o)
SELECT path, count(*) AS duplicate_lines FROM v GROUP BY path""")
def clone_duplicate_lines(spark, sf_dir):
    return clones.duplicate_lines(_matches(spark, sf_dir))


@query(MATCHES_SQL + """
, u AS (SELECT *, row_number() OVER (ORDER BY line_count DESC, path_a, line_start_a, path_b, line_start_b) AS rank FROM o)
SELECT * EXCLUDE (rank) FROM u WHERE rank <= 50""")
def clone_top_matches(spark, sf_dir):
    """The clones with the most lines: a report's first fifty."""
    return clones.ordered_matches(_matches(spark, sf_dir), "line_count", 50)


@query("""
WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, (floor(epoch(ts))::BIGINT + (value * 60)::BIGINT) AS e FROM events),
f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY user_id, island""")
def interval_merge_sessions(spark, sf_dir):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = t(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.round(F.col("value") * 60).cast("long")).alias("end"))
    return intervals.merge_intervals(spans, ["user_id"], gap=300)


@query("""
WITH s AS (SELECT l_orderkey AS file, l_linenumber AS span, (floor(l_quantity) - l_linenumber)::BIGINT AS a, (floor(l_quantity) + 3 * l_linenumber)::BIGINT AS b, floor(l_quantity)::BIGINT AS here FROM lineitem),
j AS (SELECT p.file, p.span AS point, p.here, s.span, row_number() OVER (PARTITION BY p.file, p.span, p.here ORDER BY s.b - s.a, s.a DESC, s.span DESC) AS r
  FROM (SELECT DISTINCT file, span, here FROM s) p JOIN s ON p.file = s.file AND p.here BETWEEN s.a AND s.b)
SELECT file, span, count(*) AS points FROM j WHERE r = 1 GROUP BY file, span""")
def innermost_interval(spark, sf_dir):
    at = F.floor("l_quantity").cast("long")
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n"), at.alias("at"))
    spans = rows.select("file", F.col("n").alias("span"), (F.col("at") - F.col("n")).alias("start"), (F.col("at") + 3 * F.col("n")).alias("end"))
    points = rows.select("file", (F.col("n") * 1000 + F.col("at")).alias("point"), "at").distinct()
    held = joins.innermost_interval(points, spans, ["file"])
    return held.groupBy("file", "span").agg(F.count("*").alias("points"))


PATHS_SQL = """
WITH f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages),
files AS (SELECT DISTINCT path FROM f),
"""


def _paths(spark, sf_dir) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    return t(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def _edges(spark, sf_dir) -> DataFrame:
    paths = _paths(spark, sf_dir)
    last, two = F.element_at(F.split("path", "/"), -1), F.array_join(F.slice(F.split("path", "/"), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1)), 2), "/")
    wanted = paths.select((F.col("page_id") - 1).alias("page_id"), two.alias("c1"), last.alias("c2"))
    targets = paths.join(wanted, "page_id").select(F.col("path").alias("src"), F.col("c1").alias("target"), F.posexplode(F.array("c1", "c2")).alias("rank", "candidate"))
    return joins.resolve_suffixes(targets, paths.select("path").distinct())


EDGES_SQL = PATHS_SQL + """
w AS (SELECT page_id - 1 AS page_id, array_to_string(string_split(path, '/')[greatest(len(string_split(path, '/')) - 1, 1):], '/') AS c1, string_split(path, '/')[-1] AS c2 FROM f),
c AS (SELECT f.path AS src, w.c1 AS target, 0 AS rank, w.c1 AS candidate FROM f JOIN w USING (page_id) UNION ALL SELECT f.path, w.c1, 1, w.c2 FROM f JOIN w USING (page_id)),
m AS (SELECT c.src, c.target, files.path AS dst, row_number() OVER (PARTITION BY c.src, c.target ORDER BY c.rank, files.path) AS r
  FROM c JOIN files ON files.path = c.candidate OR suffix(files.path, '/' || c.candidate)),
e AS (SELECT DISTINCT src, dst FROM m WHERE r = 1 AND src <> dst)
"""


@query(EDGES_SQL + "SELECT src, dst FROM e")
def suffix_resolve(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(EDGES_SQL + """
SELECT files.path, (SELECT count(*) FROM e WHERE src = files.path) AS fan_out, (SELECT count(*) FROM e WHERE dst = files.path) AS fan_in,
  coalesce((SELECT string_agg(dst, ' ' ORDER BY dst) FROM e WHERE src = files.path), '') AS depends_on,
  coalesce((SELECT string_agg(src, ' ' ORDER BY src) FROM e WHERE dst = files.path), '') AS depended_on_by FROM files""")
def dependency_coupling(spark, sf_dir):
    out = joins.coupling(_paths(spark, sf_dir).select("path").distinct(), _edges(spark, sf_dir))
    return out.select("path", "fan_out", "fan_in", F.array_join("depends_on", " ").alias("depends_on"), F.array_join("depended_on_by", " ").alias("depended_on_by"))


@query(PATHS_SQL + """
e AS (SELECT DISTINCT 'build/' || regexp_replace(path, '^[^/]*/', '') AS entry FROM f),
fs AS (SELECT path, array_to_string(string_split(path, '/')[i:], '/') AS suffix, len(string_split(path, '/')) - i + 1 AS parts FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files)),
es AS (SELECT entry, array_to_string(string_split(entry, '/')[i:], '/') AS suffix FROM (SELECT entry, unnest(range(1, len(string_split(entry, '/')) + 1)) AS i FROM e)),
l AS (SELECT es.entry, fs.path, max(fs.parts) AS parts FROM es JOIN fs USING (suffix) GROUP BY es.entry, fs.path),
b AS (SELECT entry, parts, count(*) AS n, min(path) AS path FROM l GROUP BY entry, parts),
k AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY parts DESC) AS r FROM b)
SELECT e.entry, CASE WHEN k.n = 1 THEN k.path END AS path, CASE WHEN k.n = 1 THEN k.parts::INTEGER END AS parts FROM e LEFT JOIN k ON e.entry = k.entry AND k.r = 1""")
def coverage_argmax_join(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    entries = paths.select(F.concat(F.lit("build/"), F.regexp_replace("path", "^[^/]*/", "")).alias("entry"))
    return joins.match_by_suffix(entries, paths.select("path"))


@query("""
WITH c AS (SELECT l_partkey, count(*) AS commits FROM lineitem GROUP BY l_partkey),
j AS (SELECT p_partkey::VARCHAR AS path, p_size AS complexity, coalesce(commits, 0) AS commits FROM part LEFT JOIN c ON p_partkey = l_partkey)
SELECT path, complexity, commits, round(complexity::DOUBLE / max(complexity) OVER () * (commits::DOUBLE / max(commits) OVER ()) * 100, 6) AS score FROM j""")
def hotspots_git(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("complexity"))
    churn = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.count("*").alias("commits"))
    return hotspots.churn_hotspots(parts, churn).withColumn("score", rounded("score"))


@query("""
WITH s AS (SELECT s_suppkey::VARCHAR AS path, (floor(s_acctbal) % 97)::BIGINT AS complexity, s_nationkey AS nesting FROM supplier),
f AS (SELECT *, (complexity::DOUBLE / max(complexity) OVER () + nesting::DOUBLE / max(nesting) OVER ()) / 2 * 100 AS score FROM s WHERE complexity > 1)
SELECT path, complexity, nesting, round(score, 6) AS score FROM f ORDER BY f.score DESC, complexity DESC, nesting DESC, path LIMIT 3""")
def hotspots_fallback_top3(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.floor("s_acctbal") % 97).alias("complexity"), F.col("s_nationkey").alias("nesting"))
    return hotspots.structural_hotspots(s).withColumn("score", rounded("score"))


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (WHERE l_shipdate >= DATE '1999-01-01') AS now, count(*) FILTER (WHERE l_shipdate < DATE '1999-01-01') AS old FROM lineitem GROUP BY l_suppkey, l_returnflag),
c AS (SELECT l_suppkey::VARCHAR AS path, count(*) FILTER (WHERE l_shipdate >= DATE '1999-01-01') AS now, count(*) FILTER (WHERE l_shipdate < DATE '1999-01-01') AS old FROM lineitem GROUP BY l_suppkey),
b AS (SELECT * FROM c WHERE now > 0 AND old > 0)
SELECT (SELECT sum(greatest(now - old, 0))::BIGINT FROM a) AS added, (SELECT sum(greatest(old - now, 0))::BIGINT FROM a) AS resolved,
  count(*) FILTER (WHERE now < old) AS simpler, count(*) FILTER (WHERE now > old) AS more_complex,
  (SELECT path FROM b WHERE now > old ORDER BY now - old DESC, path LIMIT 1) AS worst_path, (SELECT max(now - old) FROM b WHERE now > old) AS worst_increase FROM b""")
def scan_delta(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.col("l_returnflag").alias("rule_id"), (F.col("l_shipdate") >= "1999-01-01").alias("now"))
    now, then = rows.filter("now"), rows.filter("not now")
    size = lambda df: df.groupBy("path").agg(F.count("*").alias("complexity"))
    return diffs.finding_delta(now, then, ["path", "rule_id"]).crossJoin(diffs.complexity_delta(size(now), size(then)))


EVENT_CATALOG = {"error": ("critical", "high"), "purchase": ("high", "medium"), "signup": ("medium", "high"), "click": ("low", "low")}
FINDINGS_SQL = """
WITH v AS (SELECT event_id AS ord, 'user/' || user_id AS path, (event_id % 100)::INTEGER AS line, event_type AS rule_id, 'Type ' || event_type AS title, (user_id % 3)::VARCHAR AS language,
  'seen ' || value AS message,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'medium' END AS tier,
  CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'signup' THEN 'high' WHEN 'click' THEN 'low' ELSE 'low' END AS confidence FROM events),
s AS (SELECT *, CASE tier WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS tier_place,
  floor(CASE tier WHEN 'critical' THEN 100 WHEN 'high' THEN 60 WHEN 'medium' THEN 30 ELSE 10 END * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * 10 + 0.5) / 10 AS score FROM v)
"""


def _findings(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("user/"), "user_id").alias("path"), (F.col("event_id") % 100).cast("int").alias("line"),
        F.col("event_type").alias("rule_id"), F.concat(F.lit("Type "), "event_type").alias("title"), (F.col("user_id") % 3).cast("string").alias("language"),
        F.concat(F.lit("seen "), "value").alias("message"), F.lit("warning").alias("severity"),
    )
    known = spark.createDataFrame([(k, *v) for k, v in EVENT_CATALOG.items()], "rule_id string, tier string, confidence string")
    return findings.enrich(rows, known)


@query(FINDINGS_SQL + """
, k AS (SELECT *, row_number() OVER (PARTITION BY title, tier, confidence ORDER BY ord) AS k FROM s),
g AS (SELECT title, tier, confidence, max(score) AS score, max(tier_place) AS tier_place, count(*) AS count, count(DISTINCT path) AS affected_files,
  string_agg(DISTINCT rule_id, ',') AS rule_ids, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages,
  string_agg(CASE WHEN k <= 5 THEN path || ':' || line END, ',' ORDER BY ord) AS locations FROM k GROUP BY title, tier, confidence)
SELECT row_number() OVER (ORDER BY score DESC, tier_place, count DESC, title)::INTEGER AS rank, title, tier, confidence, score, count, affected_files, rule_ids, languages, locations
FROM g ORDER BY g.score DESC, tier_place, g.count DESC, title LIMIT 5""")
def fix_first(spark, sf_dir):
    top = findings.fix_first(_findings(spark, sf_dir))
    return top.withColumns({c: F.array_join(c, ",") for c in ("rule_ids", "languages", "locations")})


@query(FINDINGS_SQL + """
SELECT language, count(*) FILTER (WHERE tier = 'critical') AS critical, count(*) FILTER (WHERE tier = 'high') AS high,
  count(*) FILTER (WHERE tier = 'medium') AS medium, count(*) FILTER (WHERE tier = 'low') AS low FROM s GROUP BY language""")
def tier_counts_pivot(spark, sf_dir):
    return findings.tier_counts(_findings(spark, sf_dir), ["language"])


@query(FINDINGS_SQL + """
, k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY path, line, ord) AS k, row_number() OVER (PARTITION BY rule_id ORDER BY ord) AS f FROM s)
SELECT rule_id, min(tier_place)::INTEGER AS tier_place, count(*) AS count, count(DISTINCT path) AS files, max(CASE WHEN f = 1 THEN message END) AS message,
  string_agg(CASE WHEN k <= 5 THEN path || ':' || line END, ',' ORDER BY path, line, ord) AS locations, greatest(count(*) - 5, 0) AS remaining FROM k GROUP BY rule_id""")
def security_groups_top(spark, sf_dir):
    return findings.security_groups(_findings(spark, sf_dir)).withColumn("locations", F.array_join("locations", ","))


@query(FINDINGS_SQL + "SELECT ord, path, line, rule_id, tier, confidence, score FROM s ORDER BY score DESC, path, line, ord LIMIT 500")
def ranked_findings_500(spark, sf_dir):
    return findings.ranked_findings(_findings(spark, sf_dir)).select("ord", "path", "line", "rule_id", "tier", "confidence", "score")


@query(FINDINGS_SQL + """
, p AS (SELECT path, count(*) AS findings, count(*) FILTER (WHERE tier IN ('critical', 'high')) AS severe FROM s GROUP BY path),
c AS (SELECT DISTINCT 'user/' || user_id AS path, (user_id % 7)::BIGINT AS complexity FROM events)
SELECT path, complexity, findings, severe FROM c JOIN p USING (path) ORDER BY severe DESC, findings DESC, complexity DESC, path LIMIT 10""")
def severest_files_top10(spark, sf_dir):
    users = t(spark, sf_dir, "events").select(F.concat(F.lit("user/"), "user_id").alias("path"), (F.col("user_id") % 7).alias("complexity")).distinct()
    return findings.severest_files(_findings(spark, sf_dir), users)


@query(FINDINGS_SQL + """
, u AS (SELECT * FROM s WHERE line % 2 = 0 AND tier IN ('critical', 'high') AND confidence = 'high')
SELECT rule_id, count(*) AS count, count(DISTINCT path) AS files FROM u GROUP BY rule_id""")
def fix_now_rules(spark, sf_dir):
    # Findings on odd lines are of security here.
    category = F.when(F.col("line") % 2 == 1, "security").otherwise("style")
    return findings.fix_now(_findings(spark, sf_dir).withColumn("category", category))


@query(FINDINGS_SQL + """
, f AS (SELECT n_name || '/' || c_name AS path, 'user/' || c_custkey AS user_path, floor(c_acctbal / 1000)::BIGINT AS complexity, c_nationkey::BIGINT AS nesting, length(c_name)::BIGINT AS lines FROM customer JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT path AS user_path, count(*) AS issues FROM s GROUP BY path)
SELECT path, complexity, nesting, lines, coalesce(issues, 0)::BIGINT AS issues FROM f LEFT JOIN i USING (user_path) WHERE contains(lower(path), 'n_1')""")
def file_search(spark, sf_dir):
    """Customers as files below their nations; a user's events are the findings of the customer of that number."""
    j = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = j.select(
        F.concat_ws("/", "n_name", "c_name").alias("path"), F.concat(F.lit("user/"), "c_custkey").alias("user_path"), F.floor(F.col("c_acctbal") / 1000).alias("complexity"),
        F.col("c_nationkey").cast("long").alias("nesting"), F.length("c_name").cast("long").alias("lines"),
    )
    found = _findings(spark, sf_dir).withColumnRenamed("path", "user_path").join(own.select("path", "user_path"), "user_path")
    return findings.search_files(own.drop("user_path"), found, " N_1 ", "issues")


@query(FINDINGS_SQL + """
, k AS (SELECT path, ord, tier, line, row_number() OVER (PARTITION BY path ORDER BY tier_place, line, ord)::INTEGER AS place FROM s)
SELECT path, ord, tier, line, place FROM k WHERE place <= 50""")
def file_findings(spark, sf_dir):
    return findings.findings_of_files(_findings(spark, sf_dir)).select("path", "ord", "tier", "line", "place")


@query(FINDINGS_SQL + """
, m AS (SELECT *, max((rule_id = 'error')::INTEGER) OVER (PARTITION BY path, line) AS hit FROM s)
SELECT path, line, rule_id, count(*) AS n FROM m WHERE NOT (rule_id = 'click' AND hit = 1) GROUP BY path, line, rule_id""")
def superseded_findings(spark, sf_dir):
    left = joins.supersede(_findings(spark, sf_dir), F.col("rule_id") == "click", F.col("rule_id") == "error", ["path", "line"])
    return left.groupBy("path", "line", "rule_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k <= 5")
def history_cap(spark, sf_dir):
    return history.cap_history(t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def previous_scan(spark, sf_dir):
    return history.previous_scan(t(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "previous")


@query("""
WITH v AS (SELECT event_type, (1 + (floor(value))::BIGINT % 5) AS rating FROM events)
SELECT event_type, count(rating) AS ratings, sum(rating)::BIGINT AS total, floor(sum(rating) / count(rating) * 10 + 0.5) / 10 AS average FROM v GROUP BY event_type""")
def feedback_average(spark, sf_dir):
    rated = t(spark, sf_dir, "events").select("event_type", (1 + F.floor("value") % 5).alias("rating"))
    return history.rating_stats(rated, "event_type", "rating")


@query("""
WITH f AS (SELECT o_orderkey::VARCHAR AS path, o_orderstatus = 'P' AS is_new FROM orders WHERE o_orderstatus <> 'O'),
a AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'),
v AS (SELECT l_orderkey::VARCHAR AS path, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS line FROM lineitem),
j AS (SELECT v.path, CASE WHEN v.line = 0 THEN f.is_new ELSE a.path IS NOT NULL END AS introduced FROM v JOIN f ON v.path = f.path LEFT JOIN a ON v.path = a.path AND v.line = a.line)
SELECT introduced, count(*) AS n, count(DISTINCT path) AS files FROM j GROUP BY introduced""")
def diff_split(spark, sf_dir):
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    changed = o.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") == "P").alias("is_new"))
    path = F.col("l_orderkey").cast("string").alias("path")
    added = li.filter("l_returnflag = 'R'").select(path, F.col("l_linenumber").alias("line"))
    found = li.select(path, F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber")).alias("line"))
    return diffs.split_by_diff(found, changed, added).groupBy("introduced").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@query("""
WITH f AS (SELECT o_orderkey::VARCHAR AS path, o_orderstatus = 'P' AS is_new FROM orders WHERE o_orderstatus <> 'O'),
a AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'),
v AS (SELECT l_orderkey::VARCHAR AS path, l_linenumber AS line, CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN l_discount > 0.07 THEN 'high' WHEN l_discount > 0.03 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem),
j AS (SELECT v.*, floor(CASE tier WHEN 'critical' THEN 100 WHEN 'high' THEN 60 WHEN 'medium' THEN 30 ELSE 10 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END * 10 + 0.5) / 10 AS score
  FROM v JOIN f ON v.path = f.path JOIN a ON v.path = a.path AND v.line = a.line),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, line, tier, confidence) AS place, count(*) OVER () > 500 AS truncated FROM j)
SELECT path, line, tier, confidence, score::DOUBLE AS score, truncated FROM r WHERE place <= 500""")
def diff_introduced(spark, sf_dir):
    """The first five hundred findings that a diff introduces, and whether there are more."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    changed = o.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderstatus") == "P").alias("is_new"))
    path = F.col("l_orderkey").cast("string").alias("path")
    added = li.filter("l_returnflag = 'R'").select(path, F.col("l_linenumber").alias("line"))
    tier = F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 30, "high").when(F.col("l_quantity") > 10, "medium").otherwise("low")
    confidence = F.when(F.col("l_discount") > 0.07, "high").when(F.col("l_discount") > 0.03, "medium").otherwise("low")
    found = li.select(path, F.col("l_linenumber").alias("line"), tier.alias("tier"), confidence.alias("confidence")).withColumn("ord", F.struct("tier", "confidence"))
    return findings.introduced_list(diffs.split_by_diff(found, changed, added), 500).select("path", "line", "tier", "confidence", "score", "truncated")


@query("""
WITH f AS (SELECT o_orderkey AS path, o_orderstatus = 'P' AS is_new FROM orders WHERE o_orderstatus <> 'O'),
a AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'),
v AS (SELECT l_orderkey AS path, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS line,
  CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' ELSE 'low' END AS tier FROM lineitem),
j AS (SELECT v.tier, CASE WHEN v.line = 0 THEN f.is_new ELSE a.path IS NOT NULL END AS introduced FROM v JOIN f ON v.path = f.path LEFT JOIN a ON v.path = a.path AND v.line = a.line)
SELECT (SELECT count(*) FROM f) AS files_in_diff, (SELECT count(*) FROM a) AS added_lines, count(*) FILTER (WHERE introduced) AS introduced, count(*) FILTER (WHERE NOT introduced) AS preexisting,
  count(*) FILTER (WHERE introduced AND tier = 'critical') AS critical, count(*) FILTER (WHERE introduced AND tier = 'high') AS high,
  count(*) FILTER (WHERE introduced AND tier = 'medium') AS medium, count(*) FILTER (WHERE introduced AND tier = 'low') AS low FROM j""")
def diff_summary(spark, sf_dir):
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    changed = o.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("path"), (F.col("o_orderstatus") == "P").alias("is_new"))
    added = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"))
    tier = F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 30, "high").when(F.col("l_quantity") > 10, "medium").otherwise("low")
    found = li.select(F.col("l_orderkey").alias("path"), F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber")).alias("line"), tier.alias("tier"))
    return diffs.diff_summary(diffs.split_by_diff(found, changed, added), changed, added, findings.TIERS)


@query("""
WITH d AS (SELECT o_orderkey AS path, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS language FROM orders WHERE o_orderstatus <> 'O'),
s AS (SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_linenumber = 2)
SELECT coalesce(d.path, s.path) AS path, CASE WHEN d.path IS NULL THEN 'not in diff' WHEN d.language IS NULL THEN 'unsupported' WHEN s.path IS NULL THEN 'content not supplied' ELSE 'analysed' END AS status
FROM d FULL JOIN s ON d.path = s.path""")
def diff_reconcile(spark, sf_dir):
    changed = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("language"))
    supplied = t(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("path")).distinct()
    return diffs.reconcile(changed, supplied)


@query("""
WITH l AS (SELECT p_type, (CASE WHEN l_tax = 0 THEN '-' ELSE (l_quantity::BIGINT)::VARCHAR END) AS a, l_linenumber AS d,
  'src/' || (CASE WHEN l_linestatus = 'F' THEN p_type ELSE 'new-' || p_type END) || '/f' || l_linenumber AS path FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT path, count(*) AS commits, sum(CASE WHEN a = '-' THEN 0 ELSE a::BIGINT END)::BIGINT AS added, sum(d)::BIGINT AS deleted FROM l GROUP BY path""")
def numstat_churn(spark, sf_dir):
    """Churn from numstat text that is written from lineitem and part, with renames and binary files, and read back."""
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    added = F.when(F.col("l_tax") == 0, "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    place = F.when(F.col("l_linestatus") == "F", F.col("p_type")).otherwise(F.concat(F.lit("{"), "p_type", F.lit(" => new-"), "p_type", F.lit("}")))
    text = F.concat(added, F.lit("\t"), F.col("l_linenumber").cast("string"), F.lit("\tsrc/"), place, F.lit("/f"), F.col("l_linenumber").cast("string"))
    return formats.numstat_churn(li.select(text.alias("text")))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber AS line, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END) AS hits FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey::VARCHAR AS file, 'src/' || l_orderkey || '.py' AS source, count(*) AS lines_found, count(*) FILTER (WHERE hits > 0) AS lines_hit,
  floor(count(*) FILTER (WHERE hits > 0) / count(*) * 10000 + 0.5) / 100 AS coverage_pct, coalesce(string_agg(CASE WHEN hits <= 0 THEN line::VARCHAR END, ',' ORDER BY line), '') AS uncovered
FROM l GROUP BY l_orderkey""")
def lcov_entries(spark, sf_dir):
    """Coverage from LCOV text that is written from lineitem, one record an order, and read back."""
    hits = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("long"))
    own = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(hits).alias("h"))
    da = F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), F.col("h").cast("string"))
    texts = own.groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(da)), "\n").alias("da"))
    texts = texts.select("file", F.concat(F.lit("TN:\nSF:src/"), "file", F.lit(".py\n"), "da", F.lit("\nend_of_record\n")).alias("text"))
    return formats.lcov_entries(formats.lines_of(texts, "file", "text")).withColumn("uncovered", F.array_join("uncovered", ","))


DIFF_SQL = """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey AS diff, 'src/' || l_orderkey || '.py' AS path, l_orderkey % 2 = 0 AS is_new, (10 * l_linenumber + 1)::INTEGER AS line FROM l"""


def _diff_texts(spark, sf_dir) -> DataFrame:
    """Unified diffs that are written from lineitem, one hunk a row."""
    k = F.col("l_linenumber")
    start = (10 * k).cast("string")
    hunk = F.concat(F.lit("@@ -"), start, F.lit(",2 +"), start, F.lit(",2 @@\n context\n--- a removed line\n++++ an added line\n"))
    own = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    texts = own.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct(k, hunk.alias("h"))))["h"], "").alias("hunks"))
    name = F.concat(F.lit("src/"), F.col("l_orderkey").cast("string"), F.lit(".py\n"))
    old = F.when(F.col("l_orderkey") % 2 == 0, F.lit("/dev/null\n")).otherwise(F.concat(F.lit("a/"), name))
    return texts.select("l_orderkey", F.concat(F.lit("diff --git a/x b/x\n--- "), old, F.lit("+++ b/"), name, "hunks").alias("text"))


@query(DIFF_SQL)
def diff_parse(spark, sf_dir):
    """Added lines of the diffs, read back."""
    found = formats.diff_lines(formats.lines_of(_diff_texts(spark, sf_dir), "l_orderkey", "text"))
    return found.filter("kind = 'added'").select(F.col("file").alias("diff"), "path", "is_new", F.col("line").cast("int").alias("line"))


@query(DIFF_SQL)
def diff_parse_sql(spark, sf_dir):
    """The same by a table function, in SQL alone."""
    table_functions.register(spark)
    _diff_texts(spark, sf_dir).createOrReplaceTempView("diff_texts")
    return spark.sql("SELECT CAST(file AS BIGINT) AS diff, path, is_new, line FROM parse_diff(TABLE(SELECT l_orderkey AS file, text FROM diff_texts))")


@query("""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
SELECT page_id, path, length(path) <= 512 AND path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..') AS safe, regexp_matches(path, '#[0-9]|[A-Z]+-[0-9]') AS ticket,
  split_part(path, '/', 2) AS folder FROM u""")
def url_scalars(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    return t(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), S.safe_relative_path(path).isNotNull().alias("safe"), S.has_ticket(path).alias("ticket"), F.split_part(path, F.lit("/"), F.lit(2)).alias("folder")
    )


NONPROD = "'test', 'tests', 'testing', 'spec', 'docs', 'examples', 'samples', 'benchmark', 'fuzz', 'fixtures', 'third_party', 'vendor'"


@query(f"""
WITH u AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
v AS (SELECT CASE WHEN length(path) % 3 = 0 THEN 'docs/' ELSE 'lib/' END || path || CASE WHEN length(path) % 5 = 0 THEN '_test.py' ELSE '.py' END AS path FROM u)
SELECT len(list_filter(string_split(lower(path), '/')[:-2], lambda x: x IN ({NONPROD}))) > 0 OR regexp_matches(string_split(path, '/')[-1], '^(test_.*\\.py|.*_test\\.py|.*Test\\.java|.*\\.(spec|test)\\.(ts|js|tsx|jsx))$') AS non_production, count(*) AS n FROM v GROUP BY 1""")
def nonprod_split(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    full = F.concat(F.when(F.length(path) % 3 == 0, "docs/").otherwise("lib/"), path, F.when(F.length(path) % 5 == 0, "_test.py").otherwise(".py"))
    return t(spark, sf_dir, "pages").groupBy(S.non_production(full).alias("non_production")).agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT c_nationkey, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
r AS (SELECT x, y, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2)::DOUBLE AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2)::DOUBLE AS ry FROM n)
SELECT count(*) AS n, median(x) AS median_x, round(median(y), 4) AS median_y, round(quantile_cont(x, 0.9), 6) AS p90_x, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def study_correlations(spark, sf_dir):
    j = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # A row a nation, made once: ranks are joined by value.
    n = store.cut(j.groupBy("c_nationkey").agg(F.count("*").alias("x"), study.exact_sum(F.col("o_totalprice")).alias("y")))
    out = study.summary(n, F.col("x"), F.col("y"))
    return out.withColumns({"median_y": rounded("median_y", 4), **{c: rounded(c) for c in ("p90_x", "pearson", "spearman")}})


@query("""
SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def study_buckets(spark, sf_dir):
    return study.bucket_counts(t(spark, sf_dir, "orders"), F.col("o_totalprice"), [50000.0, 150000.0, 300000.0])


@query("""
WITH r AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders),
k AS (SELECT x, y, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2)::DOUBLE AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2)::DOUBLE AS ry FROM r)
SELECT count(*) AS n, round(median(x), 4) AS median_x, median(y) AS median_y, round(quantile_cont(x, 0.9), 4) AS p90_x, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k""")
def study_ranks(spark, sf_dir):
    """Exact quantiles and rank correlation of as many values as there are orders."""
    o = t(spark, sf_dir, "orders")
    out = study.summary(o, F.col("o_totalprice"), F.col("o_custkey"))
    return out.withColumns({"median_x": rounded("median_x", 4), "p90_x": rounded("p90_x", 4), **{c: rounded(c) for c in ("pearson", "spearman")}})


@query("""
WITH a AS (SELECT date_diff('day', o_orderdate::DATE, DATE '2006-01-01') / 365.25 AS age, o_totalprice::DOUBLE AS v FROM orders),
g AS (SELECT CASE WHEN age < 10 THEN 0 WHEN age < 15 THEN 1 WHEN age < 20 THEN 2 ELSE 3 END AS age_group, v FROM a)
SELECT age_group, count(*) AS n, round(median(v), 4) AS median, round(sum(v), 2) AS total FROM g GROUP BY age_group""")
def study_age_groups(spark, sf_dir):
    """Orders by age: how many, the median and the sum of their prices."""
    age = study.age_in_years(F.col("o_orderdate").cast("date"), F.lit("2006-01-01").cast("date"))
    return study.age_groups(t(spark, sf_dir, "orders"), age, F.col("o_totalprice")).withColumns({"median": rounded("median", 4), "total": rounded("total", 2)})


@query("""
WITH s AS (SELECT n_name, c_acctbal / 100 AS score FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0)
SELECT n_name, count(*) FILTER (WHERE score >= 90) AS "A", count(*) FILTER (WHERE score >= 80 AND score < 90) AS "B", count(*) FILTER (WHERE score >= 70 AND score < 80) AS "C",
  count(*) FILTER (WHERE score >= 60 AND score < 70) AS "D", count(*) FILTER (WHERE score < 60) AS "F", count(*) AS n, round(avg(score), 6) AS average FROM s GROUP BY n_name""")
def study_grades(spark, sf_dir):
    """Grades of the customers' balances by nation."""
    j = t(spark, sf_dir, "customer").filter("c_acctbal >= 0").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return study.grade_counts(j, ["n_name"], F.col("c_acctbal") / 100).withColumn("average", rounded("average"))


@query("""
WITH v AS (SELECT o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, o_custkey) AS rank FROM v)
SELECT o_custkey, round(value, 2) AS value, round(value / (SELECT sum(value) FROM v), 8) AS share, (SELECT count(*) FROM r WHERE rank > 5) AS others FROM r WHERE rank <= 5""")
def study_outliers(spark, sf_dir):
    """The five customers that buy most, their shares, and how many there are besides."""
    v = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("value"))
    rest = study.without_outliers(v, "o_custkey", F.col("value"), 5).agg(F.count("*").alias("others"))
    top = study.outlier_shares(v, "o_custkey", F.col("value"), 5).crossJoin(F.broadcast(rest))  # one row
    return top.withColumns({"value": rounded("value", 2), "share": rounded("share", 8)})


@query("""
WITH n AS (SELECT n_name, '<' || n_name || '&' AS label, avg(c_acctbal) / 100 AS score FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name),
c AS (SELECT *, CASE WHEN score >= 90 THEN '#4c1' WHEN score >= 80 THEN '#97ca00' WHEN score >= 70 THEN '#dfb317' WHEN score >= 60 THEN '#fe7d37' ELSE '#e05d44' END AS colour FROM n)
SELECT n_name, '<svg xmlns="http://www.w3.org/2000/svg" width="160" height="20"><rect width="160" height="20" fill="' || colour || '"/><text x="6" y="14">' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ': ' || floor(score + 0.5)::BIGINT || '/100</text></svg>' AS badge FROM c""")
def html_escape_badge(spark, sf_dir):
    j = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    n = j.groupBy("n_name").agg((F.avg("c_acctbal") / 100).alias("score"))
    return n.select("n_name", S.badge_svg(F.concat(F.lit("<"), "n_name", F.lit("&")), F.col("score")).alias("badge"))


def _page_files(spark, sf_dir) -> DataFrame:
    """Pages as files of all six languages in turn; pages hold scripts, quotes, brackets and comments."""
    languages = F.array(*map(F.lit, tokens.LANGUAGES))
    return t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.element_at(languages, (F.col("page_id") % 6 + 1).cast("int")).alias("language"), F.col("html").alias("content"))


def _pages_as(spark, sf_dir, *languages: str) -> DataFrame:
    """Every page as a file of each of the languages."""
    return t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.explode(F.array(*map(F.lit, languages))).alias("language"), F.col("html").alias("content"))


# The java expression without what RE2 lacks (possessive quantifiers don't change what these branches match first).
JAVA_SQL = r"""//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*(?:"|\n|\z)|''[^''\\\n]*(?:\\[\s\S][^''\\\n]*)*(?:''|\n|\z)|[0-9][0-9A-Za-z_.]*|[A-Za-z_$][A-Za-z0-9_$]*|\n|[\t\v\f\r ]+|[\s\S]"""


TOKENS_SQL = f"""
WITH k AS (SELECT page_id::VARCHAR AS path, unnest(regexp_extract_all(html, '{JAVA_SQL}')) AS value FROM pages),
s AS (SELECT path, value FROM k WHERE NOT regexp_full_match(value, '[\\t\\v\\f\\r ]+'))
SELECT path, count(*) AS tokens, count(*) FILTER (WHERE value LIKE '"%') AS strings, count(*) FILTER (WHERE regexp_matches(value, '^[0-9]')) AS numbers,
  count(*) FILTER (WHERE regexp_matches(value, '^[A-Za-z_$]')) AS words, count(*) FILTER (WHERE value LIKE '//%') AS comments FROM s GROUP BY path"""


@query(TOKENS_SQL)
def tokens_java(spark, sf_dir):
    found = tokens.tokens(_pages_as(spark, sf_dir, "java"))
    word = F.col("type").isin("IDENTIFIER", "KEYWORD")
    return found.groupBy("path").agg(
        F.count("*").alias("tokens"), F.count_if(F.col("type") == "STRING").alias("strings"), F.count_if(F.col("type") == "NUMBER").alias("numbers"),
        F.count_if(word).alias("words"), F.count_if(F.col("type") == "LINE_COMMENT").alias("comments"),
    )


@query(TOKENS_SQL)
def tokens_java_sql(spark, sf_dir):
    """The same by a table function, in SQL alone."""
    table_functions.register(spark)
    t(spark, sf_dir, "pages").createOrReplaceTempView("some_pages")
    return spark.sql("""SELECT path, count(*) AS tokens, count_if(type = 'STRING') AS strings, count_if(type = 'NUMBER') AS numbers,
        count_if(type IN ('IDENTIFIER', 'KEYWORD')) AS words, count_if(type = 'LINE_COMMENT') AS comments
        FROM lex_source(TABLE(SELECT CAST(page_id AS STRING) AS path, 'java' AS language, html AS content FROM some_pages)) GROUP BY path""")


@query()
def tokens_by_language(spark, sf_dir):
    return tokens.tokens(_page_files(spark, sf_dir)).groupBy("language", "type").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


@query()
def file_metrics_health(spark, sf_dir):
    """Lines, functions, complexity and nesting of each page as source text, and each language's health."""
    own = _page_files(spark, sf_dir)
    metrics = structure.file_metrics(tokens.tokens(own), own).groupBy("language").agg(
        F.count("*").alias("files"), F.sum("code_lines").alias("code"), F.sum("complexity").alias("complexity"), F.sum("comment_lines").alias("comments"), F.sum("todos").alias("todos"),
        F.max("max_nesting").alias("nesting"), F.coalesce(F.try_divide(F.sum("function_lines"), F.sum("functions")), F.lit(0.0)).alias("avg_function"),
    )
    return rollups.with_health(metrics, "code", "complexity", "avg_function", "comments", "todos", "nesting")


@query("""
WITH s AS (SELECT page_id::VARCHAR AS path, html, unnest(['ts-var-usage', 'js-var-usage']) AS rule_id FROM pages)
SELECT path, rule_id, count(*) AS n FROM s WHERE contains(html, '<script>var t=') GROUP BY path, rule_id""")
def rule_findings_var(spark, sf_dir):
    # A page is two files here, one a language.
    own = _pages_as(spark, sf_dir, "javascript", "typescript").withColumn("path", F.concat_ws(":", "path", "language"))
    found = rules.sequence_findings(own).filter("rule_id like '%-var-usage'").withColumn("path", F.split_part("path", F.lit(":"), F.lit(1)))
    return found.groupBy("path", "rule_id").agg(F.count("*").alias("n"))


@query()
def rule_findings(spark, sf_dir):
    """All 98 rules over the pages as source text, counted by rule."""
    own = _page_files(spark, sf_dir)
    return rules.findings(tokens.tokens(own), own).groupBy("rule_id", "severity", "category", "tier", "confidence").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@query("SELECT source AS target, count(*) AS n FROM documents GROUP BY source")
def import_graph(spark, sf_dir):
    """Imports that word tokens of the documents, read as Python, name."""
    d = t(spark, sf_dir, "documents")
    own = files.files_from_table(d, F.col("doc_id").cast("string"), F.concat(F.lit("import "), F.col("source"), F.lit("\n")), F.lit("python"))
    return structure.import_targets(tokens.tokens(own)).groupBy("target").agg(F.count("*").alias("n"))


def _case_files(spark, sf_dir) -> DataFrame:
    """A file of each language for each supplier, its cases once or twice."""
    return cases.case_files(t(spark, sf_dir, "supplier"), F.col("s_suppkey"), (F.col("s_nationkey") % 2 + 1).cast("int"))


_CASES_SQL = "WITH f AS (SELECT s_nationkey % 2 + 1 AS k FROM supplier), "


@query(_CASES_SQL + f"""c(rule_id, line, before, height, once) AS (VALUES {", ".join(map(str, cases.expected_findings()))})
SELECT rule_id, sum(CASE WHEN once = 1 THEN 1 ELSE k END)::BIGINT AS n,
  sum(CASE WHEN once = 1 AND line = 0 THEN 0 WHEN once = 1 THEN before * k + line ELSE k * (before * k + line) + height * (k * (k - 1) // 2) END)::BIGINT AS lines
FROM c, f GROUP BY rule_id""")
def rule_cases(spark, sf_dir):
    """Findings of all 98 rules, and the sums of their lines, where a stated number of them is; near misses give none."""
    own = _case_files(spark, sf_dir)
    return rules.findings(tokens.tokens(own), own).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query(_CASES_SQL + f"""c(language, height, functions, points) AS (VALUES {", ".join(map(str, cases.expected_structure()))}),
g AS (SELECT language, sum(height) AS height, sum(functions) AS functions, sum(points) AS points FROM c GROUP BY language)
SELECT language, count(*) AS files, sum(k * height + 1)::BIGINT AS total_lines, sum(k * functions)::BIGINT AS functions, sum(k * points + 1)::BIGINT AS complexity FROM g, f GROUP BY language""")
def structure_cases(spark, sf_dir):
    """Lines, functions and complexity of files that state them."""
    own = _case_files(spark, sf_dir)
    return structure.file_metrics(tokens.tokens(own), own).groupBy("language").agg(
        F.count("*").alias("files"), F.sum("total_lines").alias("total_lines"), F.sum("functions").alias("functions"), F.sum("complexity").alias("complexity"),
    )


def _declaration_files(spark, sf_dir) -> DataFrame:
    return cases.declaration_files(t(spark, sf_dir, "supplier"), F.col("s_suppkey"), (F.col("s_nationkey") % 2 + 1).cast("int"))


@query(_CASES_SQL + f"""c(language, kind, line, before, height) AS (VALUES {", ".join(map(str, cases.expected_types()))})
SELECT language, kind, sum(k)::BIGINT AS n, sum(k * (before * k + line) + height * (k * (k - 1) // 2))::BIGINT AS lines FROM c, f GROUP BY language, kind""")
def type_cases(spark, sf_dir):
    """Types and namespaces by kind, and the sums of their lines, in files that state them."""
    found = scopes.type_declarations(tokens.tokens(_declaration_files(spark, sf_dir)))
    return found.groupBy("language", "kind").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query(_CASES_SQL + f"""c(language, types, variables, loops, conditions, tries) AS (VALUES {", ".join(map(str, cases.expected_declarations()))}),
g AS (SELECT language, sum(variables) AS variables, sum(loops) AS loops, sum(conditions) AS conditions, sum(tries) AS tries FROM c GROUP BY language)
SELECT language, sum(k * variables)::BIGINT AS variables, sum(k * loops)::BIGINT AS loops, sum(k * conditions)::BIGINT AS conditions, sum(k * tries)::BIGINT AS tries FROM g, f GROUP BY language""")
def declaration_cases(spark, sf_dir):
    """Variables, loops, conditions and tries of files that state them."""
    own = _declaration_files(spark, sf_dir)
    counted = scopes.declaration_counts(tokens.tokens(own)).join(own.select("path", "language"), "path")
    return counted.groupBy("language").agg(*[F.sum(c).alias(c) for c in ("variables", "loops", "conditions", "tries")])

"""A query for every operator over the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocabulary as V
from lodestone.operators import answer as A
from lodestone.operators import evaluate as E
from lodestone.operators import index as I
from lodestone.operators import prompts as P
from lodestone.operators import report as R
from lodestone.operators import retrieve as T
from lodestone.operators import segment as S
from lodestone.plans import fixtures as FX
from lodestone.sources import readers, writers
from lodestone.sources.shared import keep, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Rows of a narrow table that a task makes texts of. Its file has few bytes a row, so that Spark would read most of it in one task.
ROWS = 10_000


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    tasks = -(-customer.count() // ROWS)
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=customer.repartition(tasks) if tasks > 1 else customer)


# --- pieces of SQL


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(V.WORD)})"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)\\bPage\\s+[0-9]+(?:\\s+of\\s+[0-9]+)?\\b', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n\\s*[0-9]+\\s*\\n', chr(10), 'g')"
    return strip_sql(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g')")


def pre_sql(x: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in V.STOP_WORDS) + "]"
    return f"array_to_string(list_filter({words_sql(f'lower({x})')}, lambda t: NOT list_contains({stop}, t)), ' ')"


def ws_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def norm_sql(x: str) -> str:
    return f"regexp_replace(translate(coalesce({x}, ''), chr(13) || '–—−', chr(10) || '---'), '[ \\t]+', ' ', 'g')"


def currency_sql(x: str, positive: bool = False) -> str:
    kept = f"regexp_replace({x}, '[^0-9,.\\-]', '', 'g')"
    digits = f"CASE WHEN {kept} LIKE '-%' THEN substr({kept}, 2) ELSE {kept} END"
    sign = "''" if positive else f"CASE WHEN ({x} LIKE '%(%' AND {x} LIKE '%)%') OR {kept} LIKE '-%' THEN '-' ELSE '' END"
    return f"CASE WHEN ({digits}) <> '' THEN ({sign}) || '£' || ({digits}) END"


def amounts_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(V.AMOUNT)})"


def first_amount_sql(x: str, positive: bool = False) -> str:
    return currency_sql(f"{amounts_sql(x)}[1]", positive)


def guard_sql(x: str) -> str:
    found = f"list_transform(regexp_extract_all({x}, {lit(V.GUARDED)}), lambda n: regexp_replace(n, '[,$£€]', '', 'g'))"
    return f"list_transform({found}, lambda n: CASE WHEN n LIKE '(%' AND n LIKE '%)' THEN '-' || substr(n, 2, length(n) - 2) ELSE n END)"


def format_sql(x: str) -> str:
    """Needs x to be a cheap expression; it is repeated."""
    raw = f"regexp_replace({x}, '[, £$€]', '', 'g')"
    inner = f"CASE WHEN {raw} LIKE '(%)' THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    body = f"regexp_replace({inner}, '^-', '')"
    sign = f"CASE WHEN {raw} LIKE '(%)' OR ({inner}) LIKE '-%' THEN -1 ELSE 1 END"
    decimal = f"regexp_replace(regexp_replace(format('{{:,.2f}}', CAST({body} AS DOUBLE) * ({sign})), '0+$', ''), '[.]$', '')"
    whole = f"format('{{:,}}', CAST({body} AS BIGINT) * ({sign}))"
    return f"CASE WHEN regexp_full_match({body}, '[0-9]*[.][0-9]+|[0-9]+[.]') THEN {decimal} WHEN regexp_full_match({body}, '[0-9]+') THEN {whole} ELSE {x} END"


def excl_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, {lit(V.GROUPED)}), lambda n: NOT regexp_matches(replace(n, ',', ' '), {lit(V.YEAR)}))"


def years_sql(x: str) -> str:
    pair = lit(r"(20[0-9]{2})\s*[/\- ]\s*([0-9]{2})")
    a, b, y = f"regexp_extract({x}, {pair}, 1)", f"regexp_extract({x}, {pair}, 2)", f"regexp_extract({x}, '20[0-9]{{2}}')"
    return (
        f"CASE WHEN {a} <> '' THEN [{a} || ' ' || {b}, {a} || '/' || {b}] WHEN {y} = '' THEN CAST([] AS VARCHAR[]) "
        f"WHEN CAST({y} AS INTEGER) >= 2010 THEN [{y}, CAST(CAST({y} AS INTEGER) - 1 AS VARCHAR) || ' ' || substr({y}, 3, 2)] ELSE [{y}] END"
    )


def year_sql(text: str, name: str) -> str:
    return f"CAST(coalesce(nullif(regexp_extract({text}, '(?i)YEAR ENDED 31 MARCH ([0-9]{{4}})', 1), ''), nullif(regexp_extract({name}, '20[0-9]{{2}}'), '')) AS INTEGER)"


def has_any_sql(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


def currency_add_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[£$€]') THEN {x} ELSE '£' || {x} END"


def eval_clean_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '[Â,]', '', 'g')")


def norm_num_sql(x: str) -> str:
    found = f"regexp_extract_all({eval_clean_sql(x)}, {lit(V.COMPARED)})"
    one = "CASE WHEN n LIKE '-%' OR n LIKE '(%)' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(n, '^[$£€()]+|[$£€()]+$', '', 'g') AS DOUBLE)"
    return f"list_filter(list_transform({found}, lambda n: {one}), lambda v: v IS NOT NULL)"


def metric_sql(x: str) -> str:
    hits = {k: " + ".join(f"CAST(contains(lower({x}), {lit(s)}) AS INTEGER)" for s in v) for k, v in V.SYNONYMS.items()}
    best = f"greatest({', '.join(hits.values())})"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {h} = {best} THEN {lit(k)}" for k, h in hits.items()) + " END"


# --- scalar functions over one table each

joined = lambda c: F.array_join(c, "|")
joined_sql = lambda x: f"array_to_string({x}, '|')"
numbers = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 100).cast("long").cast("string")), "|")
numbers_sql = lambda x: f"array_to_string(list_transform({x}, lambda v: CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR)), '|')"


def scalar(name: str, source: str, key: str, col: str, fn: Callable[[Column], Column], sql: str) -> None:
    """A query of (key, out) with out a function of one text column of a table or of a fixture."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fixture(spark, sf_dir, source) if " " in source else table(spark, sf_dir, source)
        return df.select(key, fn(F.col(col)).alias("out"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, {sql} AS out FROM " + (f"({source}) AS t" if " " in source else source)


scalar("clean_text", "documents", "doc_id", "text", X.clean_text, clean_sql("text"))
scalar("tokenize", "documents", "doc_id", "text", lambda c: F.array_join(X.tokenize(c), " "), f"array_to_string({words_sql('text')}, ' ')")
scalar("preprocess_query", "benchmark", "item_id", "text", X.preprocess_query, pre_sql("text"))
scalar("ws_tokenize", "documents", "doc_id", "text", lambda c: joined(X.ws_tokenize(c)), joined_sql(ws_sql("text")))
scalar("norm_ws", FX.MONEY, "id", "line", X.norm_ws, norm_sql("line"))
scalar("currency_norm", FX.MONEY, "id", "line", X.currency_norm, currency_sql("line"))
scalar("first_amount", FX.MONEY, "id", "line", X.first_amount, first_amount_sql("line"))
scalar("last_amount", FX.MONEY, "id", "line", X.last_amount, currency_sql(f"{amounts_sql('line')}[-1]"))
scalar("guard_numbers", FX.MONEY, "id", "line", lambda c: joined(X.guard_numbers(c)), joined_sql(guard_sql("line")))
scalar("num_pat", FX.MONEY, "id", "line", X.first_number, f"nullif(regexp_extract(line, {lit(V.NUMBER)}), '')")
scalar("format_number", FX.MONEY, "id", "line", lambda c: X.format_number(F.coalesce(X.first_number(c), c)), format_sql(f"coalesce(nullif(regexp_extract(line, {lit(V.NUMBER)}), ''), line)"))
scalar("extract_numbers_excl_years", FX.MONEY, "id", "line", lambda c: joined(X.numbers_excluding_years(c)), joined_sql(excl_sql("line")))
scalar("parse_years", FX.MONEY, "id", "line", lambda c: joined(X.parse_years(c)), joined_sql(years_sql("line")))
scalar("add_currency", FX.MONEY, "id", "line", X.add_currency, currency_add_sql("line"))
scalar("clean_eval", FX.MONEY, "id", "line", X.clean_eval, eval_clean_sql("line"))
scalar("norm_num", FX.MONEY, "id", "line", lambda c: numbers(X.norm_num(c)), numbers_sql(norm_num_sql("line")))
scalar("digits_only", FX.MONEY, "id", "line", X.digits_only, "regexp_replace(line, '[^0-9]', '', 'g')")
scalar("output_name", FX.REPORTS, "id", "name", X.output_name, "'report_' || coalesce(nullif(regexp_extract(name, '20[0-9]{2}'), ''), 'unknown') || '.txt'")
scalar("sink_ui", "documents", "doc_id", "text", X.cut, "CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END")
scalar("scan_html", "pages", "page_id", "html", X.strip_html, clean_sql("replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"))
scalar("scope_guard", FX.QUESTIONS, "q_id", "question", A.in_scope, has_any_sql("question", V.IN_SCOPE))
scalar("numeric_intent", FX.QUESTIONS, "q_id", "question", A.numeric_intent, has_any_sql("question", V.NUMERIC))
scalar("detect_metric", FX.QUESTIONS, "q_id", "question", A.detect_metric, metric_sql("question"))
scalar("dedupe_phrase", "conversations", "conv_id, turn".split(",")[0], "text", lambda c: X.dedupe_phrase(F.concat_ws(" ", c, c)), "''")
del ORACLES["dedupe_phrase"]
scalar("after_marker", FX.QUESTIONS, "q_id", "question", lambda c: X.after_marker(F.concat(c, F.lit(" Answer: a Answer: "), c)), strip_sql("question"))


@add("period_date", f"SELECT id, CASE WHEN y IS NULL THEN 'Unknown' ELSE CAST(y - 1 AS VARCHAR) || '/' || right(CAST(y AS VARCHAR), 2) END AS period, CASE WHEN y IS NULL THEN 'Unknown' ELSE '31 March ' || CAST(y AS VARCHAR) END AS date FROM (SELECT id, {year_sql('text', 'name')} AS y FROM ({FX.REPORTS}) AS r) AS t")
def period_date(spark, sf_dir):
    when = X.period_date(F.col("text"), F.col("name"))
    return fixture(spark, sf_dir, FX.REPORTS).select("id", when["period"].alias("period"), when["date"].alias("date"))


@add("infer_year", f"SELECT id, {year_sql('text', 'name')} AS year FROM ({FX.REPORTS}) AS r")
def infer_year(spark, sf_dir):
    return fixture(spark, sf_dir, FX.REPORTS).select("id", X.infer_year(F.col("text"), F.col("name")).alias("year"))


QA = "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL"


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("text is not null")
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@add("scan_qa", QA)
def scan_qa(spark, sf_dir):
    return qa(spark, sf_dir)


def prompt(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: qa(spark, sf_dir).select("conv_id", "turn", fn().alias("text"))
    ORACLES[name] = f"SELECT conv_id, turn, {sql} AS text FROM ({QA}) AS qa"


_asked = f"{lit(X.ASKED)} || question || chr(10) || "
prompt("prompt_plain", lambda: X.prompt_plain(F.col("question"), F.col("answer")), f"{lit(X.INSTRUCTION + ' the financial question.')} || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || answer")
prompt("plain_dataset", lambda: X.prompt_plain(F.col("question"), F.col("answer")), ORACLES["prompt_plain"].split("turn, ")[1].split(" AS text")[0])
prompt("prompt_raft", lambda: X.prompt_raft(F.col("question"), F.lit("c"), F.col("answer")), f"{lit(X.GROUNDED)} || 'c' || {_asked} 'Answer: ' || answer")
prompt("prompt_rag", lambda: X.prompt_rag(F.col("question"), F.lit("c")), f"{lit(X.PREAMBLE)} || 'c' || {_asked} 'Answer:'")
prompt("prompt_ft", lambda: X.prompt_ft(F.col("question"), F.lit("c")), f"{lit(X.NUMBER_ONLY)} || 'c' || {_asked} 'Answer (number only):'")

# --- sections and chunks

_heading = "CASE " + " ".join(f"WHEN regexp_matches(line, {lit('(?i)' + p)}) THEN {lit(n)}" for n, p in V.SECTIONS) + " END"
_section_docs = f"SELECT id AS doc_id, '{'=' * 5} statement of financial activities {'=' * 5}' || chr(10) || text || chr(10) || 'Cash flow' || chr(10) || 'x' || CAST(id AS STRING) || chr(10) || 'Income Statement' || chr(10) || 'Cashflow again' AS text FROM ({FX.REPORTS}) AS r"
_section_sql = f"""SELECT doc_id, section, {strip_sql("string_agg(line, chr(10) ORDER BY pos)")} AS text FROM (
 SELECT doc_id, pos, line, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'general') AS section FROM (
  SELECT doc_id, pos, line, {_heading} AS h FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({_section_docs}) AS s) AS a) AS b) AS c) AS d GROUP BY doc_id, section"""


def section_docs(spark, sf_dir):
    return fixture(spark, sf_dir, _section_docs)


@add("sections", f"{_section_sql} UNION ALL SELECT id, 'general', '' FROM ({FX.REPORTS}) AS r")
def sections(spark, sf_dir):
    return S.sections(section_docs(spark, sf_dir))


@add("slice_section", f"SELECT id, substr(text, a, CASE WHEN b > 0 THEN 32 + b ELSE length(text) END) AS out FROM (SELECT id, text, a, strpos(substr(text, a + 33), chr(10) || 'BALANCE SHEET') AS b FROM (SELECT id, text, strpos(text, 'STATEMENT OF FINANCIAL ACTIVITIES') AS a FROM ({FX.REPORTS}) AS r) AS s) AS t")
def slice_section(spark, sf_dir):
    part = S.slice_section(F.col("text"), "statement of financial activities", [r"\nBALANCE SHEET", r"\nNOTES"])
    return fixture(spark, sf_dir, FX.REPORTS).select("id", part.alias("out"))


def windows_sql(source: str, size: int) -> str:
    step = size - S.OVERLAP
    return f"SELECT doc_id, section, {size} AS chunk_size, CAST(start AS INTEGER) AS start, array_to_string(w[start + 1:start + {size}], ' ') AS text FROM (SELECT doc_id, section, w, unnest(range(0, len(w), {step})) AS start FROM (SELECT doc_id, section, {words_sql('text')} AS w FROM {source}) AS a) AS b"


_whole = "(SELECT doc_id, 'general' AS section, text FROM documents) AS d"


def whole_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("general").alias("section"), "text")


def doc_chunks(spark, sf_dir, size=400):
    return S.chunks(whole_docs(spark, sf_dir), (size,))


@add("chunks", f"SELECT CAST(doc_id AS VARCHAR) || ':' || section || ':' || CAST(start AS VARCHAR) AS id, * FROM ({windows_sql(_whole, 100)}) AS c")
def chunks(spark, sf_dir):
    return doc_chunks(spark, sf_dir, 100)


@add("corpus", " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) || ':' || section || ':' || CAST(start AS VARCHAR) AS id, * FROM ({windows_sql(f'({_section_sql}) AS z', n)}) AS c{n}" for n in S.SIZES))
def corpus(spark, sf_dir):
    return S.corpus(section_docs(spark, sf_dir))


# --- indices

CHUNKS = f"c AS ({windows_sql(_whole, 400)}), w AS (SELECT doc_id, start, {ws_sql('text')} AS words FROM c)"
TF = "e AS (SELECT doc_id, start, len(words) AS dl, unnest(words) AS term FROM w), tf AS (SELECT doc_id, start, term, count(*) AS tf, max(dl) AS dl FROM e GROUP BY ALL)"
IDF = f"""n AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {I.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


@add("bm25_tf", f"WITH {CHUNKS}, {TF} SELECT doc_id, start, term, tf FROM tf")
def bm25_tf(spark, sf_dir):
    return I.term_frequency(doc_chunks(spark, sf_dir))


@add("bm25_df_idf", f"WITH {CHUNKS}, {TF}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_df_idf(spark, sf_dir):
    return I.idf(doc_chunks(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@add("bm25_stats", f"WITH {CHUNKS} SELECT count(*) AS n, round(avg(len(words)), 6) AS avgdl FROM w")
def bm25_stats(spark, sf_dir):
    return I.stats(doc_chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


_unit = "CAST(embedding AS DOUBLE[])"


@add("dense_build", f"SELECT vec_id, array_to_string(list_transform({_unit}, lambda x: CAST(CAST(round(x * 2000 / sqrt(list_dot_product({_unit}, {_unit}))) AS BIGINT) AS VARCHAR)), '|') AS vector FROM embeddings")
def dense_build(spark, sf_dir):
    v = F.transform(I.normalise(F.col("embedding")), lambda x: F.round(x * 2000).cast("long").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(v, "|").alias("vector"))


# --- retrieval

QUERIED = f"q AS (SELECT item_id AS query_id, text AS question, {pre_sql('text')} AS text FROM benchmark), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({ws_sql('text')}) AS term FROM q) AS u GROUP BY ALL)"
SCORES = f"""{CHUNKS}, {TF}, {IDF}, {QUERIED}, hits AS (SELECT query_id, doc_id, start, round(sum(times * idf * tf * {I.K1 + 1} / (tf + {I.K1} * ({1 - I.B} + {I.B} * dl / avgdl))), 6) AS score
FROM qt JOIN idf USING (term) JOIN tf USING (term), n GROUP BY ALL)"""
SPARSE = f"""{SCORES}, ranked AS (SELECT query_id, c.doc_id, c.start, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, c.doc_id DESC, c.start DESC) AS rank
FROM (SELECT query_id, doc_id, start FROM q, c) AS c LEFT JOIN hits USING (query_id, doc_id, start)), sparse AS (SELECT * FROM ranked WHERE rank <= {T.K})"""
DENSE = f"""v AS (SELECT vec_id AS doc_id, 0 AS start, {_unit} AS e FROM embeddings), dscore AS (SELECT a.doc_id AS query_id, b.doc_id, b.start, round(list_dot_product(a.e, b.e), 6) AS score FROM v a, v b WHERE a.doc_id < 20),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, start) AS rank FROM dscore) AS r WHERE rank <= {T.K})"""
_norm = "(score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-6)"
FUSED = f"""{SPARSE}, {DENSE}, dn AS (SELECT query_id, doc_id, start, rank AS dr, {_norm} AS dn FROM dense), sn AS (SELECT query_id, doc_id, start, rank AS sr, {_norm} AS sn FROM sparse),
both_ AS (SELECT query_id, doc_id, start, dr, sr, round({T.ALPHA} * coalesce(dn, 0) + {1 - T.ALPHA} * coalesce(sn, 0), 6) AS score FROM dn FULL OUTER JOIN sn USING (query_id, doc_id, start)),
fused AS (SELECT query_id, doc_id, start, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr) AS rank FROM both_)"""
_qw = f"list_distinct({words_sql('lower(question)')})"
RERANKED = f"""{FUSED}, cut_ AS (SELECT f.*, c.text AS ctx, q.question, least(1, CAST(floor((rank - 1) / {T.RERANK}) AS INTEGER)) AS tail FROM fused f JOIN c USING (doc_id, start) JOIN q USING (query_id)),
scored AS (SELECT query_id, doc_id, start, rank, tail, ctx, CASE WHEN tail = 1 THEN score ELSE round(CAST(len(list_intersect({_qw}, {words_sql('lower(ctx)')})) AS DOUBLE) / greatest(len({_qw}), 1), 6) END AS score FROM cut_),
reranked AS (SELECT query_id, doc_id, start, score, ctx, row_number() OVER (PARTITION BY query_id ORDER BY tail, CASE WHEN tail = 0 THEN -score END, rank) AS rank FROM scored)"""


def bench_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("start"), "embedding")


def dense_hits(spark, sf_dir, k=T.K):
    v = vectors(spark, sf_dir)
    return T.dense_topk(v, v.where("doc_id < 20").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), k)


def kept_chunks(spark, sf_dir):
    """The chunks of documents, cut once for all that is done with them."""
    return keep(doc_chunks(spark, sf_dir), "chunks")


def sparse_hits(spark, sf_dir, own=None):
    return T.sparse_topk(own or kept_chunks(spark, sf_dir), bench_queries(spark, sf_dir))


def fused_hits(spark, sf_dir, own=None):
    return T.fuse(dense_hits(spark, sf_dir), sparse_hits(spark, sf_dir, own))


def reranked_hits(spark, sf_dir, own=None):
    own = own or kept_chunks(spark, sf_dir)
    return T.rerank(fused_hits(spark, sf_dir, own), bench_queries(spark, sf_dir), own)


def picked_contexts(spark, sf_dir):
    own = kept_chunks(spark, sf_dir)
    return T.pick_contexts(reranked_hits(spark, sf_dir, own), own)


@add("sparse_scores", f"WITH {SCORES} SELECT * FROM hits")
def sparse_scores(spark, sf_dir):
    return T.sparse_scores(kept_chunks(spark, sf_dir), bench_queries(spark, sf_dir))


add("sparse_topk", f"WITH {SPARSE} SELECT * FROM sparse")(sparse_hits)
add("dense_topk", f"WITH {DENSE} SELECT * FROM dense")(dense_hits)
add("rank_fused", f"WITH {FUSED} SELECT * FROM fused")(fused_hits)
add("rerank", f"WITH {RERANKED} SELECT query_id, doc_id, start, score, rank FROM reranked")(reranked_hits)


@add("minmax_norm", f"WITH {DENSE} SELECT query_id, doc_id, start, rank, score, round({_norm}, 6) AS norm FROM dense")
def minmax_norm(spark, sf_dir):
    return T.minmax(dense_hits(spark, sf_dir)).withColumn("norm", F.round("norm", 6))


@add("fuse", f"WITH {FUSED} SELECT query_id, doc_id, start, score FROM fused")
def fuse(spark, sf_dir):
    return fused_hits(spark, sf_dir).drop("rank")


@add("pick_ctx", f"WITH {RERANKED} SELECT query_id, string_agg(ctx, chr(10) ORDER BY rank) AS contexts FROM reranked WHERE rank <= {T.PICK} GROUP BY query_id")
def pick_ctx(spark, sf_dir):
    return picked_contexts(spark, sf_dir).select("query_id", F.array_join("contexts", "\n").alias("contexts"))


@add("sources", f"WITH {RERANKED} SELECT query_id, string_agg(CAST(doc_id AS VARCHAR) || ':general:400', '|' ORDER BY rank) AS sources FROM reranked WHERE rank <= {T.PICK} GROUP BY query_id")
def sources(spark, sf_dir):
    picked = picked_contexts(spark, sf_dir)
    return picked.select("query_id", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["doc_id"], s["section"], s["chunk_size"].cast("string"))), "|").alias("sources"))


# --- guards, extraction, policies

ASKS = f"""asks AS (SELECT x.ask, x.q_id, q.question, x.contexts FROM (SELECT ask, q_id, list(ctx ORDER BY rank, ctx) AS contexts FROM ({FX.CONTEXTS}) AS x GROUP BY ask, q_id) AS x JOIN ({FX.QUESTIONS}) AS q ON q.q_id = x.q_id)"""
_said = "CASE (ask + q_id) % 4 WHEN 0 THEN 'It was £1,499.' WHEN 1 THEN 'no idea' WHEN 2 THEN NULL ELSE contexts[1] END"


def asks(spark, sf_dir):
    ctx = fixture(spark, sf_dir, FX.CONTEXTS)
    listed = ctx.groupBy("ask", "q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ctx"))), lambda x: x["ctx"]).alias("contexts"))
    k = (F.col("ask") + F.col("q_id")) % 4
    said = F.when(k == 0, "It was £1,499.").when(k == 1, "no idea").when(k == 2, F.lit(None).cast("string")).otherwise(F.get("contexts", F.lit(0)))
    return listed.join(spark.sql(FX.QUESTIONS), "q_id").withColumn("said", said)


GUARD = f"""g AS (SELECT *, {_said} AS said FROM asks), gm AS (SELECT *, list_filter({guard_sql("coalesce(said, '')")}, lambda n: NOT list_contains({guard_sql("array_to_string(contexts, ' ')")}, n)) AS missing FROM g),
guarded AS (SELECT *, len(missing) > 0 AS flag, CASE WHEN len(missing) > 0 THEN 'Numbers [''' || array_to_string(missing, ''', ''') || '''] not found in retrieved context. Low confidence.' ELSE '' END AS reason FROM gm)"""


@add("numeric_guard", f"WITH {ASKS}, {GUARD} SELECT ask, q_id, flag, reason FROM guarded")
def numeric_guard(spark, sf_dir):
    g = A.numeric_guard(F.coalesce("said", F.lit("")), F.col("contexts"))
    return asks(spark, sf_dir).select("ask", "q_id", g.alias("g")).select("ask", "q_id", "g.flag", "g.reason")


_labels = "CASE metric " + " ".join(f"WHEN {lit(k)} THEN [{', '.join(lit(s) for s in v)}]" for k, v in V.SYNONYMS.items()) + " END"
_all_labels = "[" + ", ".join(lit(s) for s in V.LABELS) + "]"
_first = lambda x: f"{excl_sql(x)}[1]"
METRIC = f"""m AS (SELECT ask, q_id, question, contexts, {metric_sql('question')} AS metric, {years_sql('question')} AS years FROM asks),
cx AS (SELECT ask, q_id, metric, years, {_labels} AS labels, unnest(range(1, len(contexts) + 1)) AS ci, unnest(contexts) AS ctx FROM m WHERE metric IS NOT NULL),
ln AS (SELECT *, unnest(range(1, len(l) + 1)) AS li, unnest(l) AS line FROM (SELECT *, string_split(ctx, chr(10)) AS l FROM cx) AS s),
lb AS (SELECT *, list_filter(labels, lambda s: contains(lower(line), s))[1] AS label, l[li + 1] AS below FROM ln),
sg AS (SELECT *, substr(line, strpos(lower(line), label) + length(label)) AS seg FROM lb WHERE label IS NOT NULL),
ct AS (SELECT *, list_min(list_filter(list_transform({_all_labels}, lambda t: strpos(lower(seg), t)), lambda p: p > 0)) AS cut FROM sg),
sc AS (SELECT *, CASE WHEN cut > 1 THEN substr(seg, 1, cut - 1) ELSE seg END AS s, len(years) = 0 OR len(list_filter(years, lambda y: contains(lower(line), replace(y, '/', ' ')))) > 0 AS dated FROM ct),
nums AS (SELECT *, CASE WHEN contains(lower(s), '{A.TAIL}') AND metric <> 'total_income_endowments' THEN {_first(f"substr(s, 1, strpos(lower(s), '{A.TAIL}') - 1)")} END AS n1,
 CASE WHEN contains(lower(s), 'total') THEN {_first("substr(s, strpos(lower(s), 'total'))")} END AS n2, {_first('s')} AS n3, {_first("coalesce(below, '')")} AS nb FROM sc),
same AS (SELECT ask, q_id, arg_min(coalesce(n1, n2, n3), ci * 1000 + li) AS v FROM nums WHERE dated AND coalesce(n1, n2, n3) IS NOT NULL GROUP BY ALL),
nxt AS (SELECT ask, q_id, arg_min(nb, ci * 1000 + li) AS v FROM nums WHERE nb IS NOT NULL GROUP BY ALL),
mv0 AS (SELECT asks.*, coalesce(same.v, nxt.v) AS v FROM asks LEFT JOIN same USING (ask, q_id) LEFT JOIN nxt USING (ask, q_id)),
mv AS (SELECT ask, q_id, {format_sql('v')} AS value FROM mv0)"""


@add("metric_value", f"WITH {ASKS}, {METRIC} SELECT ask, q_id, value FROM mv")
def metric_value(spark, sf_dir):
    return asks(spark, sf_dir).select("ask", "q_id", A.metric_value(F.col("question"), F.col("contexts")).alias("value"))


FALLBACK = f"""fk AS (SELECT ask, q_id, contexts, list_filter(regexp_extract_all(lower(question), '[a-zA-Z]+'), lambda w: length(w) >= 4) AS keys FROM asks),
fl AS (SELECT ask, q_id, keys, unnest(range(1, len(l) + 1)) AS li, unnest(l) AS line FROM (SELECT *, string_split(array_to_string(contexts, chr(10)), chr(10)) AS l FROM fk) AS s),
fs AS (SELECT *, len(list_filter(keys, lambda w: contains(lower(line), w))) AS score, nullif(regexp_extract(line, {lit(V.NUMBER)}), '') AS num FROM fl),
fb AS (SELECT ask, q_id, num FROM (SELECT *, row_number() OVER (PARTITION BY ask, q_id ORDER BY score DESC, li) AS r FROM fs WHERE score > 0 AND num IS NOT NULL) AS z WHERE r = 1),
nf AS (SELECT fk.ask, fk.q_id, coalesce(fb.num, nullif(regexp_extract(array_to_string(contexts, chr(10)), {lit(V.NUMBER)}), '')) AS number FROM fk LEFT JOIN fb USING (ask, q_id))"""


@add("number_fallback", f"WITH {ASKS}, {FALLBACK} SELECT ask, q_id, number FROM nf")
def number_fallback(spark, sf_dir):
    return asks(spark, sf_dir).select("ask", "q_id", A.number_fallback(F.col("question"), F.col("contexts")).alias("number"))


POLICY = f"""{ASKS}, {GUARD}, {METRIC}, {FALLBACK}, pa AS (SELECT g.ask, g.q_id, g.question, coalesce(g.said, '') AS said, g.flag, g.reason, mv.value AS p, nf.number AS nn, {metric_sql('g.question')} AS metric,
 {has_any_sql('g.question', V.NUMERIC)} AS numq, {has_any_sql('g.question', V.IN_SCOPE)} AS scope FROM guarded g JOIN mv USING (ask, q_id) JOIN nf USING (ask, q_id)),
pb AS (SELECT *, flag OR NOT regexp_matches(said, {lit(V.NUMBER)}) AS doubtful, coalesce(metric = 'total_expenditure', false) AND p IS NOT NULL AS forced FROM pa),
pc AS (SELECT *, CASE WHEN numq AND p IS NOT NULL THEN {currency_add_sql('p')} WHEN numq AND doubtful AND nn IS NOT NULL THEN {currency_add_sql('nn')} WHEN forced THEN {currency_add_sql('p')} ELSE said END AS answer,
 CASE WHEN numq AND doubtful AND p IS NOT NULL THEN 0.98 WHEN numq AND doubtful AND nn IS NOT NULL THEN 0.95 WHEN numq AND NOT doubtful AND p IS NOT NULL THEN CASE WHEN forced THEN 0.98 ELSE 0.95 END WHEN forced THEN 0.98 WHEN flag THEN 0.5 ELSE 0.9 END AS conf FROM pb)"""


@add("answer_policy", f"WITH {POLICY} SELECT ask, q_id, answer, CAST(CASE WHEN scope THEN conf ELSE least(conf, 0.35) END AS DOUBLE) AS confidence, CASE WHEN scope THEN flag ELSE true END AS flag, CASE WHEN scope THEN reason ELSE {lit(A.SOFT_REASON)} END AS reason FROM pc")
def answer_policy(spark, sf_dir):
    a = A.answer_policy(F.col("question"), F.col("said"), F.col("contexts"))
    return asks(spark, sf_dir).select("ask", "q_id", a.alias("a")).select("ask", "q_id", "a.answer", "a.confidence", "a.guardrail.flag", "a.guardrail.reason")


@add("ft_policy", f"WITH {POLICY}, ft AS (SELECT ask, q_id, p, nullif(regexp_extract(said, {lit(V.NUMBER)}), '') AS num, said FROM pa) SELECT ask, q_id, CASE WHEN p IS NOT NULL THEN {currency_add_sql('p')} WHEN num IS NOT NULL THEN {currency_add_sql('num')} ELSE {strip_sql('said')} END AS answer, CAST(CASE WHEN p IS NOT NULL THEN 0.98 ELSE 0.5 END AS DOUBLE) AS confidence FROM ft")
def ft_policy(spark, sf_dir):
    a = A.ft_policy(F.col("question"), F.coalesce("said", F.lit("")), F.col("contexts"), F.lit(None).cast("double"))
    return asks(spark, sf_dir).select("ask", "q_id", a.alias("a")).select("ask", "q_id", "a.answer", "a.confidence")


@add("ui_override", f"WITH {POLICY} SELECT ask, q_id, CASE WHEN p IS NOT NULL AND (length(said) > 16 OR NOT regexp_matches(said, '[£$€]')) THEN {currency_add_sql('p')} ELSE said END AS answer FROM pa")
def ui_override(spark, sf_dir):
    return asks(spark, sf_dir).select("ask", "q_id", A.ui_override(F.coalesce("said", F.lit("")), A.metric_value(F.col("question"), F.col("contexts"))).alias("answer"))


@add("first_context_number", f"WITH {ASKS} SELECT ask, q_id, TRY_CAST(replace(flatten(list_transform(contexts, lambda c: regexp_extract_all(c, '\\b[0-9][0-9,.]*\\b')))[1], ',', '') AS DOUBLE) AS number FROM asks")
def first_context_number(spark, sf_dir):
    return asks(spark, sf_dir).select("ask", "q_id", A.first_context_number(F.col("contexts")).alias("number"))


@add("seq_confidence", "WITH z AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT vec_id, list_transform([0, 1, 2, 3], lambda k: exp(e[k * 16 + 1 + (vec_id + k) % 16]) / list_sum(list_transform(e[k * 16 + 1:k * 16 + 16], lambda x: exp(x)))) AS p FROM z) SELECT vec_id, round(list_sum(p) / 4, 6) AS confidence FROM p")
def seq_confidence(spark, sf_dir):
    four = F.array(*[F.lit(k) for k in range(4)])
    logits = F.transform(four, lambda k: F.transform(F.slice("embedding", k * 16 + 1, 16), lambda x: x.cast("double")))
    chosen = F.transform(four, lambda k: ((F.col("vec_id") + k) % 16).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.sequence_confidence(logits, chosen), 6).alias("confidence"))


# --- reports

_lines = f"rl AS (SELECT id, pos, {strip_sql('line')} AS line FROM (SELECT id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM ({FX.REPORTS}) AS r) AS a) AS b)"
_specs = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(n)}, {lit(R.label_pattern(s))}, {'true' if d == 'drop' else 'false'})" for s, n, d in R.SOFA) + ") AS t(name, pattern, positive))"


@add("labels_extract", f"WITH {_lines}, {_specs}, hit AS (SELECT id, name, arg_min(CASE WHEN positive THEN {first_amount_sql('line', True)} ELSE {first_amount_sql('line')} END, pos) AS amount FROM rl JOIN spec ON regexp_matches(line, pattern) WHERE {first_amount_sql('line')} IS NOT NULL GROUP BY ALL) SELECT * FROM hit")
def labels_extract(spark, sf_dir):
    found = [F.struct(F.lit(n).alias("name"), a.alias("amount")) for n, a in R.extract_labels(F.col("lines"), R.SOFA).items()]
    return fixture(spark, sf_dir, FX.REPORTS).select("id", R.lines(F.col("text")).alias("lines")).select("id", F.explode(F.array(*found)).alias("f")).select("id", "f.name", "f.amount").where("amount is not null")


@add("grants", f"WITH {_lines} SELECT id, regexp_replace(line, {lit(V.AMOUNT)}, {first_amount_sql('line', True)}, 'g') AS line FROM rl WHERE regexp_matches(line, '(?i)\\bGrants?\\b')")
def grants(spark, sf_dir):
    return fixture(spark, sf_dir, FX.REPORTS).select("id", F.explode(R.grant_lines(R.lines(F.col("text")))).alias("line"))


@add("report_parse")
def report_parse(spark, sf_dir):
    return R.parse(fixture(spark, sf_dir, FX.REPORTS)).select("id", F.to_json("parsed").alias("parsed"))


@add("report_format")
def report_format(spark, sf_dir):
    return R.reports(fixture(spark, sf_dir, FX.REPORTS)).select("id", "year", "out_name", "rendered")


# --- prompts and datasets

_cum = "sum(cost) OVER (PARTITION BY query_id ORDER BY rank)"


@add("pack_budget", f"WITH {RERANKED}, pk AS (SELECT query_id, rank, ctx, len({ws_sql('ctx')}) AS cost FROM reranked WHERE rank <= {T.PICK}), cm AS (SELECT *, {_cum} AS total FROM pk) SELECT query_id, string_agg(ctx, chr(10) ORDER BY rank) AS packed FROM cm WHERE total + 20 <= 928 GROUP BY query_id")
def pack_budget(spark, sf_dir):
    picked = picked_contexts(spark, sf_dir)
    packed = P.pack(F.col("contexts"), F.lit(20), P.BUDGET - P.ROOM - P.MARGIN)
    return picked.select("query_id", packed.alias("p")).where(F.size("p") > 0).select("query_id", F.array_join("p", "\n").alias("packed"))


_fixed = f"len({ws_sql(f'{lit(X.GROUNDED)} || {_asked} {lit(chr(65) + chr(110) + chr(115) + chr(119) + chr(101) + chr(114) + chr(58) + chr(32))} || answer')})"


@add("raft_dataset", f"WITH {RERANKED}, pk AS (SELECT query_id, rank, ctx, len({ws_sql('ctx')}) AS cost FROM reranked WHERE rank <= {T.PICK}), cm AS (SELECT *, {_cum} AS total FROM pk), qa AS (SELECT conv_id AS query_id, min(question) AS question, min(answer) AS answer FROM ({QA}) AS z WHERE turn = 0 GROUP BY conv_id), fx AS (SELECT *, {_fixed} AS fixed FROM qa), pc AS (SELECT fx.query_id, question, answer, string_agg(ctx, chr(10) ORDER BY rank) FILTER (WHERE total + fixed <= 1024) AS packed FROM fx JOIN cm USING (query_id) GROUP BY ALL) SELECT query_id, {lit(X.GROUNDED)} || coalesce(packed, '') || {_asked} 'Answer: ' || answer AS text FROM pc")
def raft_dataset(spark, sf_dir):
    picked = picked_contexts(spark, sf_dir)
    asked = qa(spark, sf_dir).where("turn = 0").groupBy(F.col("conv_id").alias("query_id")).agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    return P.raft_dataset(asked.join(picked, "query_id")).select("query_id", "text")


@add("label_mask", "WITH t AS (SELECT doc_id, list_transform(string_split(substr(text, 1, 700), ' ')[1:64], lambda w: length(w)) AS ids FROM documents) SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda i: 50256)), ' ') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(0, 64 - len(ids)), lambda i: 0)), ' ') AS attention_mask, array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda i: -100)), ' ') AS labels FROM t")
def label_mask(spark, sf_dir):
    ids = F.transform(F.slice(F.split(F.substring("text", 1, 700), " "), 1, 100), lambda w: F.length(w))
    m = P.label_mask(ids, 64)
    out = table(spark, sf_dir, "documents").select("doc_id", m.alias("m"))
    return out.select("doc_id", *[F.array_join(F.transform(f"m.{c}", lambda x: x.cast("string")), " ").alias(c) for c in ("input_ids", "attention_mask", "labels")])


# --- evaluation

_close = "CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_filter(a, lambda u: len(list_filter(b, lambda v: (u = 0 AND v = 0) OR (v <> 0 AND abs(u - v) / greatest(1.0, abs(v)) <= 0.02))) > 0)) > 0 ELSE regexp_replace(said, '[^0-9]', '', 'g') = regexp_replace(truth, '[^0-9]', '', 'g') END"
_truth = f"SELECT x.id AS query_id, x.line AS said, y.line AS truth FROM ({FX.MONEY}) AS x JOIN ({FX.MONEY}) AS y ON y.id = x.id + x.id % 2 * 8"
EVAL = f"tr AS ({_truth}), nm AS (SELECT *, {norm_num_sql('said')} AS a, {norm_num_sql('truth')} AS b FROM tr), ev AS (SELECT query_id, said, truth, {_close} AS close FROM nm), er AS (SELECT query_id, 'System ' || CAST(query_id % 3 AS VARCHAR) AS method, said, truth, CASE WHEN close THEN 'Y' ELSE 'N' END AS correct FROM ev)"


def truths(spark, sf_dir):
    m = fixture(spark, sf_dir, FX.MONEY)
    x = m.select(F.col("id").alias("query_id"), F.col("line").alias("said"), (F.col("id") + F.col("id") % 2 * 8).alias("other"))
    return x.join(m.select(F.col("id").alias("other"), F.col("line").alias("truth")), "other").drop("other")


def results(spark, sf_dir):
    t = truths(spark, sf_dir)
    out = None
    for k in range(3):
        mine = t.where(F.col("query_id") % 3 == k)
        predicted = mine.select("query_id", F.col("said").alias("answer"), F.when(F.col("query_id") % 2 == 0, 0.9).alias("confidence"), (F.col("query_id") / 7).alias("seconds"))
        one = E.evaluate(predicted, mine.select("query_id", F.concat(F.lit("Q"), F.col("query_id").cast("string")).alias("question"), "truth"), f"System {k}")
        out = one if out is None else E.union(out, one)
    return out


@add("numeric_close", f"WITH {EVAL} SELECT query_id, close FROM ev")
def numeric_close(spark, sf_dir):
    return truths(spark, sf_dir).select("query_id", X.numeric_close(F.col("said"), F.col("truth")).alias("close"))


_rows = "SELECT query_id, 'Q' || CAST(query_id AS VARCHAR) AS \"Question\", method AS \"Method\", said AS \"Answer\", CASE WHEN query_id % 2 = 0 THEN CAST(0.9 AS DOUBLE) END AS \"Confidence\", round(query_id / 7, 3) AS \"Time (s)\", correct AS \"Correct (Y/N)\", truth AS \"GroundTruth\" FROM er"
add("eval_rows", f"WITH {EVAL} {_rows}")(results)
add("union_eval", f"WITH {EVAL} {_rows} UNION ALL {_rows}")(lambda spark, sf_dir: E.union(results(spark, sf_dir), results(spark, sf_dir)))


@add("accuracy", f"WITH {EVAL} SELECT method, count(*) AS total, count(*) FILTER (WHERE correct = 'Y') AS correct, round(100.0 * CAST(count(*) FILTER (WHERE correct = 'Y') AS DOUBLE) / count(*), 6) AS accuracy FROM er GROUP BY method")
def accuracy(spark, sf_dir):
    return E.accuracy(results(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@add("leaderboard", f"WITH {EVAL} SELECT method, round(avg(CASE WHEN correct = 'Y' THEN 1.0 ELSE 0.0 END) * 100, 6) AS score FROM er GROUP BY method")
def leaderboard(spark, sf_dir):
    return E.leaderboard(results(spark, sf_dir)).withColumn("score", F.round("score", 6))


@add("head_n", f"SELECT conv_id, turn, question, answer FROM ({QA}) AS z ORDER BY conv_id, turn LIMIT 20")
def head_n(spark, sf_dir):
    return E.head(qa(spark, sf_dir), 20, "conv_id", "turn")


@add("sanity")
def sanity(spark, sf_dir):
    q = F.col("question")
    few = spark.sql(FX.QUESTIONS).where("q_id in (0, 3, 16)")
    return few.select("question", A.in_scope(q).alias("in_scope"), A.rejected(q).alias("rejected"), A.detect_metric(q).alias("metric"))


@add("infer_adapters")
def infer_adapters(spark, sf_dir):
    a = A.answer_policy(F.col("question"), F.col("said"), F.col("contexts"))
    return asks(spark, sf_dir).select("question", a.alias("a")).select("question", "a.answer", "a.confidence", F.lit(0.0).alias("latency"))


# --- sources and sinks, each written to the shared folder and read again


@add("scan_txt")
def scan_txt(spark, sf_dir):
    path = shared_path(spark, "txt")
    table(spark, sf_dir, "benchmark").select("text").repartition(3).write.text(path)
    return readers.read_txt(spark, path)


@add("scan_table")
def scan_table(spark, sf_dir):
    path = shared_path(spark, "csv")
    table(spark, sf_dir, "nation").coalesce(1).write.csv(path, header=True)
    return readers.read_csv(spark, path)


@add("scan_dir")
def scan_dir(spark, sf_dir):
    path = shared_path(spark, "dir")
    table(spark, sf_dir, "benchmark").select("text").repartition(2).write.text(path)
    table(spark, sf_dir, "nation").coalesce(1).write.mode("append").csv(path, header=True)
    return readers.read_dir(spark, path)


def kept_index(spark, sf_dir):
    path = shared_path(spark, "index")
    readers.cached_index(spark, path, lambda: doc_chunks(spark, sf_dir))
    return readers.cached_index(spark, path, lambda: doc_chunks(spark, sf_dir))


@add("sink_index", ORACLES["bm25_tf"])
def sink_index(spark, sf_dir):
    return kept_index(spark, sf_dir)["postings"]


@add("scan_index", ORACLES["chunks"].replace(windows_sql(_whole, 100), windows_sql(_whole, 400)))
def scan_index(spark, sf_dir):
    return kept_index(spark, sf_dir)["chunks"]


@add("index_cache", ORACLES["bm25_df_idf"])
def index_cache(spark, sf_dir):
    return kept_index(spark, sf_dir)["idf"].select("term", "df", F.round("idf", 6).alias("idf"))


@add("get_state", ORACLES["bm25_stats"])
def get_state(spark, sf_dir):
    return kept_index(spark, sf_dir)["stats"].select("n", F.round("avgdl", 6).alias("avgdl"))


@add("sink_results", ORACLES["eval_rows"])
def sink_results(spark, sf_dir):
    path, df = shared_path(spark, "results"), results(spark, sf_dir)
    writers.write_results(df, path)
    return spark.read.csv(path, header=True, schema=df.schema, quote='"', escape='"')


@add("sink_report", f"SELECT DISTINCT name AS out_name FROM (SELECT 'report_' || coalesce(nullif(regexp_extract(name, '20[0-9]{{2}}'), ''), 'unknown') || '.txt' AS name, {year_sql('text', 'name')} AS y FROM ({FX.REPORTS}) AS r) AS t WHERE y IS NULL OR y NOT IN (2023, 2024)")
def sink_report(spark, sf_dir):
    path = shared_path(spark, "reports")
    writers.write_reports(R.reports(fixture(spark, sf_dir, FX.REPORTS)), path)
    return spark.read.text(path).select("out_name").distinct()


@add("ui_controls")
def ui_controls(spark, sf_dir):
    """The list sizes, weight and reranking that a user sets; sizes of 0 mean the default."""
    v, q = vectors(spark, sf_dir), bench_queries(spark, sf_dir).where("query_id < 20")
    asked = q.join(v.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return T.retrieve(kept_chunks(spark, sf_dir), v, asked, k_dense=3, k_sparse=0, alpha=0.0, reranked=False)

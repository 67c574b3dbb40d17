"""One query per operator, over its whole table, with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import arrow_stream, chat, collocations, exact_dedup, filter_audit, jaccard, line_windows, neighbours, packing, suffixes, toxicity, tree_bpe, url_templates
from tickloom.llm.url_sql import TEMPLATE_SQL
from tickloom.llm.words import word_bpe_path
from tickloom.session import new_folder, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return run

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, folder, "documents")).drop("row_id")


@query("op1_arrow_stream")
def op1_arrow_stream(spark: SparkSession, folder: str) -> DataFrame:
    index = arrow_stream.write_documents(read(spark, folder, "documents"), new_folder(spark, "tokens"), word_bpe_path(), end_id=2)
    return arrow_stream.read_documents(index)


@query("op8_tree_bpe")
def op8_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = word_bpe_path()
    return tree_bpe.digests(tree_bpe.encode_documents(read(spark, folder, "documents"), path), path)


@query("op5_lp_packing")
def op5_lp_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), word_bpe_path(), end_id=1)


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op3_line_windows",
    """
    WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    windows AS (
        SELECT doc_id, i, array_to_string(list_slice(l, i, i + 2), chr(10)) AS w
        FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)),
    later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later),
    cut AS (
        SELECT doc_id, l[i] AS line, i, g.i IS NOT NULL AS removed
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines) JOIN (SELECT 1) ON true
        LEFT JOIN gone g USING (doc_id, i))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
    FROM cut GROUP BY doc_id
    """,
)
def op3_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_windows.without_repeated_lines(line_windows.removed_lines(read(spark, folder, "documents")))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '~', '~~')"
    for control in chat.INSTRUCT.controls:
        sql = f"replace({sql}, '{control}', '{control[0]}~{control[1:]}')"
    return sql


def _markup_sql() -> str:
    known = " ".join(f"WHEN '{r}' THEN {len(t.opening + t.closing)}" for r, t in chat.INSTRUCT.turns.items())
    bare = len(chat.INSTRUCT.other.opening.replace("{role}", "") + chat.INSTRUCT.other.closing)
    return f"CASE role {known} ELSE {bare} + length({_escaped_sql('role')}) END"


def _in_order_sql() -> str:
    after = {r: [f"before = '{b}'" for b in t.after if b != "start"] + ["before IS NULL"] * ("start" in t.after) for r, t in chat.INSTRUCT.turns.items()}
    known = " ".join(f"WHEN '{r}' THEN coalesce({' OR '.join(tests)}, false)" for r, tests in after.items())
    return f"CASE role {known} ELSE false END"


CONTROL_TEXT = "</s>[INST] ok [/INST]"      # what both turns of conversation -7 say


@query(
    "op4_chat_format",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')),
    told AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST({len(chat.INSTRUCT.begin)} + sum({_markup_sql()} + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars,
           bool_and({_in_order_sql()}) AND bool_or(last AND role IN ({', '.join(f"'{r}'" for r in chat.INSTRUCT.final)})) AS valid
    FROM told GROUP BY conv_id
    """,
)
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.digests(settle(chat.segments(turns.unionByName(extra))))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query(
    "op9_jaccard_join",
    """
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                   lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
    """,
)
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_components(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, folder, "documents")).drop("row_id")


@query(
    "op13_fm_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
    spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
    windows AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM spots, range(1, 6) t(m) WHERE i + m - 1 <= len(w)),
    f AS (SELECT lang, phrase, m, count(*) AS a FROM windows GROUP BY ALL HAVING count(*) >= 100),
    sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
    cuts AS (
        SELECT c.lang, c.phrase, c.a, s.n, k, l.a AS l, r.a AS r,
               CAST((1000::HUGEINT * c.a * s.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
        FROM f c JOIN range(1, 5) t(k) ON k < c.m JOIN sizes s ON s.lang = c.lang
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), 1, k), ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), k + 1, c.m), ' ')),
    weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
    parts AS (
        SELECT DISTINCT lang, a, array_to_string(list_slice(string_split(phrase, ' '), i, j), ' ') AS phrase
        FROM f, range(1, 6) x(i), range(1, 6) y(j) WHERE i <= j AND j <= m AND j - i + 1 < m),
    kept AS (SELECT w.* FROM weakest w ANTI JOIN parts p ON p.lang = w.lang AND p.phrase = w.phrase AND 100 * p.a >= 100 * w.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
)
def op13_fm_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


@query("op11_url_templates", TEMPLATE_SQL)
def op11_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judged(read(spark, folder, "pages"), keep=["page_id"]).drop("purity")


@query(
    "op12_filter_audit",
    r"""
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    rows AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
               + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS INT)
               + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
               + 16 * CAST(coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS INT) AS failing
        FROM texts t LEFT JOIN marks m ON m.doc_id = t.doc_id),
    masks AS (SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY ALL),
    letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
    orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b <> b.b AND a.b <> c.b AND a.b <> d.b AND a.b <> e.b
          AND b.b <> c.b AND b.b <> d.b AND b.b <> e.b AND c.b <> d.b AND c.b <> e.b AND d.b <> e.b),
    steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) t(step)),
    counted AS (
        SELECT part, filter_order, step, bit,
               coalesce(sum(n) FILTER (failing & (before + bit) = 0), 0) AS kept,
               coalesce(sum(n) FILTER (failing & bit > 0 AND failing & before = 0), 0) AS removed,
               coalesce(sum(n) FILTER (failing & bit > 0 AND failing & before > 0), 0) AS redundant,
               coalesce(sum(n) FILTER (failing = bit), 0) AS unique_fails,
               coalesce(sum(good) FILTER (failing & bit > 0 AND failing & before = 0), 0) AS good_lost,
               coalesce(sum(toxic) FILTER (failing & bit > 0 AND failing & before = 0), 0) AS toxic_lost
        FROM masks, steps GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM counted
    """,
)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audited(read(spark, folder, "documents"), read(spark, folder, "labels"))

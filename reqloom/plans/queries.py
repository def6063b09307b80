"""One query for each operator, over the whole test tables, and the SQL it must agree with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom import contracts
from reqloom.functions import numeric as N
from reqloom.functions import text as T
from reqloom.operators import ingest, preprocess, reports, review, sentences, sentiment, terms, topics
from reqloom.plans import adapt
from reqloom.plans import sql as S
from reqloom.scratch import scratch_path, written
from reqloom.sources import files, schemas

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# --- documents ------------------------------------------------------------------------------------


@query(f"WITH src AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS l FROM documents) SELECT doc_id, {S.cleaned('l')} AS message FROM src")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.coalesce("text", F.lit(""))).alias("message"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents WHERE trim(text) <> '' GROUP BY text")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapt.documents(spark, sf_dir)
    return preprocess.keep_first(preprocess.not_empty(docs, "message"), "message", "doc_id").select("doc_id", F.sha2("message", 256).alias("text_sha256"))


@query(f"WITH {S.CORPUS} SELECT doc_id, length(message) AS n_chars, len({S.WORDS}) AS n_words FROM corpus")
def lang_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.corpus(spark, sf_dir).select("doc_id", F.length("message").cast("bigint").alias("n_chars"), T.word_count(F.col("message")).cast("bigint").alias("n_words"))


@query(f"WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '{S.SPACE}', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM documents) SELECT doc_id, {S.language('words')} AS lang FROM w")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("lang"))


@query(
    f"""WITH {S.CLEAN}, w AS (SELECT *, list_filter(string_split(lower(message), ' '), lambda w: w <> '') AS words FROM clean)
    SELECT doc_id, post_id, source, sha256(message) AS message_sha256, sha256(text) AS raw_sha256 FROM w
    WHERE {S.language("words")} = 'en' AND length(message) >= 500 AND len(words) >= 100"""
)
def preprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = preprocess.preprocess(adapt.documents(spark, sf_dir), "doc_id")
    return done.select("doc_id", "post_id", "source", F.sha2("message", 256).alias("message_sha256"), F.sha2("message_raw", 256).alias("raw_sha256"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.stratified_sample(adapt.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query(
    f"""WITH {S.CLEAN}, m AS (SELECT length(message) AS n_chars, len({S.WORDS}) AS n_words FROM clean),
    v AS (SELECT 'n_chars' AS measure, CAST(n_chars AS DOUBLE) AS x FROM m UNION ALL SELECT 'n_words', CAST(n_words AS DOUBLE) FROM m)
    SELECT measure, count(x) AS n, round(avg(x), 6) AS mean, quantile_cont(x, 0.5) AS median, round(quantile_cont(x, 0.95), 6) AS p95 FROM v GROUP BY measure"""
)
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = preprocess.preprocess(adapt.documents(spark, sf_dir), "doc_id", keep_language=None, chars=0, words=0)
    stats = reports.length_stats(docs.select(F.length("message").alias("n_chars"), T.word_count(F.col("message")).alias("n_words")), "n_chars", "n_words")
    return stats.select("measure", "n", F.round("mean", 6).alias("mean"), "median", F.round("p95", 6).alias("p95"))


@query(
    """WITH v AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
    SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INT) AS bin, count(*) AS n FROM v, e GROUP BY 1"""
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(adapt.table(spark, sf_dir, "documents").select(F.length("text").alias("n_chars")), "n_chars")


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_counts(adapt.table(spark, sf_dir, "documents"), "lang", shares=True).withColumn("pct", F.round("pct", 6))


@query("WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: list_contains(['não', 'você', 'muito', 'também'], w)) AS f FROM documents) SELECT doc_id, len(f) AS n_portuguese FROM c WHERE len(f) > 0")
def portuguese_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.table(spark, sf_dir, "documents").select("doc_id", T.portuguese_words(F.col("text")).cast("bigint").alias("n_portuguese")).where("n_portuguese > 0")


@query("SELECT doc_id, text, lang AS language, source, '2024' AS collected FROM documents")
def reshape_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapt.table(spark, sf_dir, "documents")
    out = preprocess.reshape(docs, {"lang": "language"}, ["n_chars", "never_there"], {"collected": "2024", "source": "not put over the column"})
    return preprocess.first_columns(out, "language", "doc_id")


@query("SELECT o_orderkey, printf('post_%04d', row_number() OVER (ORDER BY o_orderkey) - 1) AS post_id FROM orders")
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.with_ids(adapt.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"WITH {S.CORPUS}, n AS (SELECT (SELECT count(*) FROM documents) AS n_before, (SELECT count(*) FROM corpus) AS n_after) SELECT n_before, n_after, n_before - n_after AS n_removed, round((n_before - n_after) / n_before, 6) AS frac_removed FROM n")
def preprocess_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reduction(adapt.documents(spark, sf_dir), adapt.corpus(spark, sf_dir)).withColumn("frac_removed", F.round("frac_removed", 6))


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicates(adapt.table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query(
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1)
    SELECT coalesce(o.k, c.k) AS k, coalesce(c.n, 0) AS in_a, coalesce(o.n, 0) AS in_b FROM o FULL JOIN c ON o.k = c.k WHERE coalesce(c.n, 0) <> 1 OR coalesce(o.n, 0) <> 1"""
)
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = (adapt.table(spark, sf_dir, t) for t in ("customer", "orders"))
    return contracts.key_differences(customers.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "nation-csv")
    files.write_csv(adapt.table(spark, sf_dir, "nation").repartition(3), path)
    wanted = ["n_nationkey", "n_name", "n_regionkey", "never_there"]
    back = files.read_csv_folder(spark, path, columns=wanted)
    return back.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


#: (case, text, what is to come of it) for functions whose cases the tables lack.
ENTITIES = (("named", "&lt;b&gt; caf&eacute; &amp;amp;", "<b> café &amp;"), ("numbered", "it&#8217;s &#x41;", "it’s A"), ("no end", "a &amp b &notit;", "a & b ¬it;"), ("unknown", "&qqq; & so on", "&qqq; & so on"), ("none", "plain", "plain"))
ASPECT_LISTS = (("mixed", " Bateria, tela ,foo,OUTRO", "bateria|tela|outro"), ("empty", "", ""), ("repeated", "audio,audio", "audio|audio"))
PORTUGUESE_TEXTS = (("three", "Você não vai, MUITO obrigado", "3"), ("inside", "naonão muitos", "0"), ("one", "também", "1"))
DISTRIBUTIONS = (("even", "[0.25,0.75]", "[0.25,0.75]"), ("one", "[1.0]", "[1.0]"), ("none", "[]", "[]"))
CLOSE = (("equal", "1.0 1.0", "true"), ("within", "1.0 1.0000099", "true"), ("beyond", "1.0 1.0001", "false"), ("near zero", "0.0 0.0000009", "true"))
_CASES = tuple((kind, *row) for kind, rows in (("entity", ENTITIES), ("aspects", ASPECT_LISTS), ("portuguese", PORTUGUESE_TEXTS), ("json", DISTRIBUTIONS), ("close", CLOSE)) for row in rows)


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join((S.quoted(kind), S.quoted(case), S.quoted(out))) + ')' for kind, case, _, out in _CASES)}) v(kind, case_name, outcome)")
def function_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([row[:3] for row in _CASES], "kind string, case_name string, text string")
    text, pair = F.col("text"), F.transform(F.split("text", " "), lambda x: x.try_cast("double"))
    outcome = {
        "entity": T.unescape_html(text),
        "aspects": F.array_join(T.aspects(text), "|"),
        "portuguese": T.portuguese_words(text).cast("string"),
        "json": F.to_json(F.from_json(text, "array<double>")),
        "close": N.close_to(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))).cast("string"),
    }
    parts = [cases.where(F.col("kind") == kind).select("kind", "case_name", x.alias("outcome")) for kind, x in outcome.items()]
    return reduce(DataFrame.unionByName, parts)


# --- sentences ------------------------------------------------------------------------------------


@query(f"WITH {S.SENTENCES} SELECT sent_id, post_id, CAST(sent_idx AS INT) AS sent_idx, sentence, CAST(n_words AS INT) AS n_words, n_words < 5 AS is_fragment, is_dup_exact FROM sent")
def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.corpus_sentences(spark, sf_dir).select("sent_id", "post_id", "sent_idx", "sentence", "n_words", "is_fragment", "is_dup_exact")


@query(f"WITH {S.SENTENCES} SELECT sent_id, context FROM sent")
def sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.corpus_sentences(spark, sf_dir, contexts=True).select("sent_id", "context")


@query(f"WITH {S.SENTENCES} SELECT source, count(*) AS n, count_if(n_words < 5) AS n_fragments, count_if(is_dup_exact) AS n_dups FROM sent GROUP BY source")
def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.corpus_sentences(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_fragment").alias("n_fragments"), F.count_if("is_dup_exact").alias("n_dups"))


@query("SELECT conv_id, turn, string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.conversation_context(adapt.table(spark, sf_dir, "conversations"))


# --- raw records ----------------------------------------------------------------------------------

TITLES = ("Dell XPS 13 Review", "Samsung Galaxy Book4 Pro 14: Why Does This Exist?", "Samsung Galaxy Round Review", "iPhone 15 Pro Max Unboxing", "Ray-Ban Meta Gen 2 Review", "Mac Studio M2 Ultra Review", "Sony WH-1000XM5 hands-on", "Tesla Model 3 Review", "Steam Deck OLED: First Impressions", "Garmin rant", "")
URLS = (
    "https://www.youtube.com/watch?v=abcdefghijk&t=3", "https://youtu.be/abcdefghijk?si=1", "http://m.youtube.com:443/shorts/zyxwvutsrqp/", "https://youtube.com/embed/zyxwvutsrqp",
    "https://www.youtube.com/live/AAAAAAAAAAA?feature=share", "https://example.com/watch?v=abcdefghijk", "https://www.youtube.com/channel/x", "not a url",
)
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_TITLED = f"SELECT page_id AS id, {_TITLE} AS title FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i - 1}, {S.quoted(t)})' for i, t in enumerate(TITLES))})"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapt.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return pages.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TITLES)], "id bigint, title string"))


@query(f"WITH t(id, title) AS ({_TITLED}) SELECT id, {S.category('title')} AS product_category FROM t")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("id", T.product_category(F.col("title")).alias("product_category"))


@query(f"WITH t(id, title) AS ({_TITLED}) SELECT id, regexp_matches(title, {S.quoted(T.REVIEW_PATTERN)}, 'i') AS title_has_review FROM t")
def title_review_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("id", T.title_has_review(F.col("title")).alias("title_has_review"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS upload_date, CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%Y-%m') AS category FROM orders")
def iso_date_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    rows = adapt.table(spark, sf_dir, "orders").select("o_orderkey", T.iso_date(compact).alias("upload_date"))
    return preprocess.date_category(rows.withColumn("year", T.iso_year(F.col("upload_date"))), "upload_date")


@query(
    f"""WITH u(id, url) AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i - 1}, {S.quoted(u)})' for i, u in enumerate(URLS))})),
    p AS (SELECT id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':\\d*$', '') AS host,
                 regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM u)
    SELECT id, nullif(CASE WHEN host = 'youtu.be' THEN string_split(regexp_replace(path, '^/+', ''), '/')[1]
      WHEN ends_with(host, 'youtube.com') THEN CASE WHEN regexp_extract(q, '(?:^|&)v=([^&]+)', 1) <> '' THEN regexp_extract(q, '(?:^|&)v=([^&]+)', 1)
        ELSE regexp_extract(path, '^/(?:shorts|embed|live)/([^/]+)', 1) END END, '') AS video_id FROM p"""
)
def video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = adapt.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(spark.createDataFrame([(-i - 1, u) for i, u in enumerate(URLS)], "id bigint, url string"))
    return urls.select("id", T.video_id(F.col("url")).alias("video_id"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS post_id,
         CASE WHEN p_size % 5 = 0 AND p_brand <> '' THEN p_brand ELSE 'other' END AS product_category FROM part"""

)
def override_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = adapt.table(spark, sf_dir, "part")
    rows = parts.select(F.col("p_partkey").cast("string").alias("post_id"), F.lit("no product").alias("title"))
    own = parts.where("p_size % 5 = 0").select(F.col("p_partkey").cast("string").alias("post_id"), F.col("p_brand").alias("product_category"))
    return ingest.categorise(rows, own).select("post_id", "product_category")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = adapt.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("m"))
    return parsed.select("event_id", "m.k")


RECORDS = '﻿ junk [{"url": "https://youtu.be/a", "titulo": "Dell XPS 13 Review", "duracao": "10:00", "transcricao": " word word ", "fonte": "whisper", "youtube_metadata": {"id": "abcdefghijk", "title": "x", "channel": "C", "upload_date": "20240620", "view_count": 1000, "like_count": 50, "comment_count": 7, "language": "en"}}, {"titulo": "empty", "transcricao": " ", "youtube_metadata": {"id": "b"}}, {"titulo": "no metadata", "transcricao": "text"}]'


@query(
    """SELECT 'abcdefghijk' AS post_id, 'word word' AS message, 'Dell XPS 13 Review' AS title, 'C' AS channel, '2024-06-20' AS upload_date, CAST(2024 AS INT) AS year,
         CAST(1000 AS BIGINT) AS view_count, CAST(50 AS BIGINT) AS like_count, CAST(7 AS BIGINT) AS comment_count, '10:00' AS duration, 'whisper' AS source,
         'en' AS language_meta, 'laptop' AS product_category, true AS title_has_review"""
)
def build_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = files.parse_json_array(spark.createDataFrame([(RECORDS,)], "value string"), "value", schemas.RAW)
    return ingest.build_documents(ingest.drop_repeated_metadata(records), check=False)


@query(
    "SELECT unnest(['doc_id', 'quality', 'toxic']) AS field, unnest([count(doc_id), count(quality), count(toxic)]) AS n_present FROM labels"
)
def run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.profile(adapt.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


# --- terms and topics -----------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, sentence) of usable sentences, held: whole rows would hold each sentence's whole document."""
    return adapt.usable(spark, sf_dir).select("sent_id", "sentence").persist()


@query(f"WITH {S.VOCABULARY} SELECT term, CAST(term_id AS INT) AS term_id, df, tf FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    return terms.vocabulary(terms.term_rows(rows), rows.count()).select("term", "term_id", "df", "tf")


@query(
    f"""WITH {S.VOCABULARY}, r AS (
      SELECT sent_id, term, (1 + ln(tf.tf)) * (ln((1.0 + (SELECT count(*) FROM usable)) / (1 + df)) + 1) AS x FROM tf JOIN vocab USING (term))
    SELECT sent_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY sent_id)), 6) AS tfidf FROM r"""
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    held, n = terms.term_rows(rows), rows.count()
    return terms.tfidf(held, terms.vocabulary(held, n), n).select("sent_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {S.TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM usable)")
def bow_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    return terms.dictionary(terms.term_rows(rows), rows.count(), keep=None)


@query(f"WITH {S.TERMS}, d AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM usable)) SELECT sent_id, term, tf AS n FROM tf JOIN d USING (term)")
def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    held = terms.term_rows(rows)
    return terms.bags(held, terms.dictionary(held, rows.count(), keep=None), bounded=False)


TOPIC_WORDS = {0: ["the", "and", "that"], 1: ["was", "with", "the"], 2: ["for", "this", "which"], -1: ["an", "of"], 3: ["is"]}
_TOPIC_ROWS = ", ".join(f"({t}, {S.listed(w)})" for t, w in TOPIC_WORDS.items())


def _topic_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPIC_WORDS.items()), "topic_id int, words array<string>")


@query(
    f"""WITH t(topic_id, words) AS (VALUES {_TOPIC_ROWS}), w AS (SELECT topic_id, unnest(words[1:3]) AS word FROM t WHERE topic_id <> -1 AND len(words) >= 2)
    SELECT round(count(DISTINCT word) / (count(DISTINCT topic_id) * 3.0), 6) AS diversity FROM w"""
)
def topic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.diversity(_topic_words(spark), 3).select(F.round("diversity", 6).alias("diversity"))


@query(
    f"""WITH {S.SENTENCES}, t(topic_id, words) AS (VALUES {_TOPIC_ROWS}), texts AS (SELECT {S.tokens('sentence')} AS w FROM usable),
    win AS (SELECT list_distinct(w[s : s + 9]) AS w FROM (SELECT w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM texts WHERE len(w) > 0)),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM win),
    p AS (SELECT topic_id, words[i] AS x, words[j] AS y FROM t, range(1, 4) a(i), range(1, 4) b(j) WHERE i < j AND j <= len(words)),
    c AS (SELECT topic_id, x, y, count_if(list_contains(w, x) AND list_contains(w, y)) / any_value(total) AS pxy,
                 count_if(list_contains(w, x)) / any_value(total) AS px, count_if(list_contains(w, y)) / any_value(total) AS py FROM p, win, n GROUP BY ALL)
    SELECT topic_id, round(avg(CASE WHEN px * py > 0 THEN ln((pxy + 1e-12) / (px * py)) / -ln(pxy + 1e-12) ELSE 0.0 END), 6) AS npmi FROM c GROUP BY topic_id"""
)
def npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _topic_words(spark)
    texts = adapt.usable(spark, sf_dir).select(T.tokens(F.col("sentence")).alias("tokens"))
    counts, windows = topics.window_counts(texts, words.select(F.explode("words").alias("word")), 10)
    return topics.npmi(counts, windows, words, 10).select("topic_id", F.round("npmi", 6).alias("npmi"))


GRID = [(2, 0.10, 0.90), (3, 0.15, 0.80), (4, 0.15, 0.85), (5, 0.12, 0.95), (6, 0.05, 0.70)]


@query(
    f"""WITH g(k, npmi, diversity) AS (VALUES {', '.join(f'({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for k, a, b in GRID)}),
    f AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.npmi >= g.npmi AND o.diversity >= g.diversity AND (o.npmi > g.npmi OR o.diversity > g.diversity)))
    SELECT k, npmi, diversity, k = (SELECT k FROM f ORDER BY npmi DESC, diversity DESC, k LIMIT 1) AS chosen FROM f"""
)
def pareto_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame(GRID, "k int, npmi double, diversity double")
    chosen = topics.choose_k(grid).select(F.col("k").alias("best"))
    return topics.pareto(grid).join(F.broadcast(chosen), F.col("k") == F.col("best"), "left").select("k", "npmi", "diversity", F.col("best").isNotNull().alias("chosen"))


@query(f"WITH {S.WEIGHED} SELECT sent_id, CAST(topic_id AS INT) AS topic_id, round(topic_weight, 6) AS topic_weight, CAST(local_topic_id AS INT) AS local_topic_id FROM weighed")
def dominant_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.weighed(adapt.usable(spark, sf_dir)).select("sent_id", "topic_id", F.round("topic_weight", 6).alias("topic_weight"), "local_topic_id")


@query(
    f"""WITH {S.WEIGHED}, best AS (SELECT *, row_number() OVER (PARTITION BY topic_id, post_id ORDER BY topic_weight DESC, sent_id) AS k FROM weighed WHERE topic_id >= 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY topic_weight DESC, sent_id) AS place FROM best WHERE k = 1)
    SELECT CAST(topic_id AS INT) AS topic_id, CAST(place AS INT) AS place, post_id, sent_id FROM r WHERE place <= 5"""
)
def topic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.examples(adapt.weighed(adapt.usable(spark, sf_dir))).select("topic_id", "place", "post_id", "sent_id")


@query(
    f"""WITH {S.WEIGHED}, s AS (SELECT *, md5('42+' || topic_id || ':' || sent_id) AS h FROM weighed WHERE topic_id >= 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY topic_id, post_id ORDER BY h, sent_id) AS k FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY h, sent_id) AS place FROM best WHERE k = 1)
    SELECT CAST(topic_id AS INT) AS topic_id, CAST(place AS INT) AS place, post_id, sent_id FROM r WHERE place <= 5"""
)
def random_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.examples(adapt.weighed(adapt.usable(spark, sf_dir)), by="random").select("topic_id", "place", "post_id", "sent_id")


@query(
    f"""WITH {S.WEIGHED}, t AS (SELECT topic_id, count(*) AS n_sentences, count(DISTINCT post_id) AS n_videos FROM weighed WHERE topic_id >= 0 GROUP BY topic_id)
    SELECT CAST(topic_id AS INT) AS topic_id, n_sentences, n_videos, round(100.0 * n_sentences / (SELECT count(*) FROM weighed), 1) AS pct_frases FROM t"""
)
def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.sizes(adapt.weighed(adapt.usable(spark, sf_dir)).select("topic_id", "post_id").persist())


@query(
    f"""WITH {S.WEIGHED}, s AS (SELECT *, CAST(100 * topic_id + local_topic_id AS INT) AS subtopic FROM weighed WHERE topic_id IN (0, 2, 3) AND local_topic_id >= 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY subtopic, post_id ORDER BY local_topic_weight DESC, sent_id) AS k FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY subtopic ORDER BY local_topic_weight DESC, sent_id) AS place FROM best WHERE k = 1)
    SELECT subtopic, CAST(place AS INT) AS place, post_id, sent_id FROM r WHERE place <= 3"""
)
def subtopic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.weighed(adapt.usable(spark, sf_dir)).where("topic_id in (0, 2, 3) and local_topic_id >= 0")
    rows = rows.select("sent_id", "post_id", (100 * F.col("topic_id") + F.col("local_topic_id")).cast("int").alias("subtopic"), F.array_max("local_topic_distribution").alias("local_weight"))
    return topics.examples(rows, 3, topic="subtopic", weight="local_weight").select("subtopic", "place", "post_id", "sent_id")


@query(
    f"""WITH {S.TERMS}, w AS (SELECT CAST(length(term) % 3 AS INT) AS topic_id, term, sum(tf) AS weight FROM tf GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS place FROM w)
    SELECT topic_id, string_agg(term, ', ' ORDER BY place) AS top_terms FROM r WHERE place <= 20 GROUP BY topic_id"""
)
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = terms.term_rows(adapt.usable(spark, sf_dir))
    return topics.top_terms(held.groupBy((F.length("term") % 3).cast("int").alias("topic_id"), "term").agg(F.sum("tf").alias("weight")))


@query()
def global_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _, _ = topics.global_topics(_texts(spark, sf_dir))
    return assigned.select("sent_id", "topic_id", "topic_weight", "weights")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.weighed(adapt.usable(spark, sf_dir)).where("topic_id in (0, 2, 3)").select("sent_id", F.col("topic_id").alias("global_topic_id"), "sentence").persist()


@query()
def nmf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir)
    return topics.score_grid(rows, topics.local_grid(rows).persist())


@query()
def local_nmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir)
    fitted = topics.local_grid(rows).persist()
    scores = topics.score_grid(rows, fitted)
    best = scores.groupBy("global_topic_id").agg(F.max_by("k", F.struct("npmi", "diversity", -F.col("k"))).alias("k"))
    return topics.local_topics(rows, fitted, best)


# --- evidence and review --------------------------------------------------------------------------

CUES = ("I wish it had another USB port.", "The fan is annoying and noisy.", "I absolutely love it.", "This issue is disappointing.", "You should've told us, unfortunately.", "I don't like the keyboard and I would like more ports.")


@query(
    f"""WITH {S.EVIDENCE}, l(sent_id, lex_n, lex_hit, intent_hint) AS (VALUES ('c0', 1, true, 'pedido'), ('c1', 1, true, 'queixa'), ('c2', 0, false, 'outro'),
      ('c3', 2, true, 'queixa'), ('c4', 2, true, 'pedido'), ('c5', 2, true, 'pedido'))
    SELECT sent_id, CAST(lex_n AS INT) AS lex_n, lex_hit, intent_hint FROM evidence UNION ALL SELECT sent_id, CAST(lex_n AS INT), lex_hit, intent_hint FROM l"""
)
def lexicon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = review.score_lexicon(spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(CUES)], "sent_id string, sentence string"))
    return adapt.evidence(spark, sf_dir).select("sent_id", "lex_n", "lex_hit", "intent_hint").unionByName(frozen.select("sent_id", "lex_n", "lex_hit", "intent_hint"))


@query(f"WITH {S.EVIDENCE} SELECT sent_id, CAST(global_topic_id AS INT) AS global_topic_id, CAST(local_topic_id AS INT) AS local_topic_id, round(local_topic_weight, 6) AS local_topic_weight, CASE WHEN local_topic_id >= 0 THEN 'local ' || global_topic_id || ' ' || local_topic_id END AS local_top_terms, 'global ' || global_topic_id AS global_top_terms, round(topic_score, 6) AS topic_score FROM evidence")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.evidence(spark, sf_dir, check=True, contexts=True)
    return rows.select("sent_id", "global_topic_id", "local_topic_id", F.round("local_topic_weight", 6).alias("local_topic_weight"), "local_top_terms", "global_top_terms", F.round("topic_score", 6).alias("topic_score"))


@query(f"WITH {S.RANKED} SELECT ranking, CAST(rank AS INT) AS rank, sent_id FROM ranked")
def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rankings(written(adapt.evidence(spark, sf_dir), "evidence"), check=False)


def _sample(spark: SparkSession, sf_dir: str, contexts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blind, origin); contexts are in the blind sample only, and null unless asked for. Rankings are stored as they are sorted."""
    rows = written(adapt.evidence(spark, sf_dir, contexts=contexts), "evidence")
    blind, origin = review.blind_sample(rows, review.rankings(rows, check=False), check=False)
    return blind, written(origin, "origin")


@query(f"WITH {S.SAMPLED} SELECT CAST(review_id AS INT) AS review_id, sentence, context, product_category, CAST(NULL AS VARCHAR) AS requirement_candidate, CAST(NULL AS VARCHAR) AS aspect_ref, CAST(NULL AS VARCHAR) AS review_notes FROM origin")
def blind_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, contexts=True)[0]


@query(f"WITH {S.SAMPLED} SELECT CAST(review_id AS INT) AS review_id, sent_id, selection_source, CAST(rank_aleatoria AS INT) AS rank_aleatoria, CAST(rank_lexical AS INT) AS rank_lexical, CAST(rank_topico AS INT) AS rank_topico, CAST(rank_topico_lexical AS INT) AS rank_topico_lexical FROM origin")
def blind_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[1].select("review_id", "sent_id", "selection_source", *(f"rank_{r}" for r in sorted(review.RANKINGS)))


@query(
    f"""WITH {S.SAMPLED}, c AS (
      SELECT 'topico' AS ranking, requirement_candidate AS r FROM labelled WHERE rank_topico <= 50 UNION ALL SELECT 'lexical', requirement_candidate FROM labelled WHERE rank_lexical <= 50
      UNION ALL SELECT 'topico_lexical', requirement_candidate FROM labelled WHERE rank_topico_lexical <= 50
      UNION ALL SELECT 'aleatoria', requirement_candidate FROM labelled WHERE selection_source = 'aleatoria' AND k <= 100),
    a AS (SELECT ranking, count(*) AS n, count_if(r = 'sim') AS positives, {N.Z95} AS z FROM c GROUP BY ranking),
    b AS (SELECT *, positives / n AS p, 1 + z * z / n AS d FROM a),
    h AS (SELECT *, (p + z * z / (2 * n)) / d AS mid, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d AS half FROM b)
    SELECT ranking, n, positives, round(p, 6) AS precision, round(mid - half, 6) AS ci_low, round(mid + half, 6) AS ci_high FROM h"""
)
def precision_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = _sample(spark, sf_dir)[1]
    out = review.precision(adapt.annotations(spark, sf_dir, origin), origin, check=False)
    return out.select("ranking", "n", "positives", *(F.round(c, 6).alias(c) for c in ("precision", "ci_low", "ci_high")))


@query(f"WITH {S.SAMPLED} SELECT CAST(global_topic_id AS INT) AS global_topic_id, CAST(local_topic_id AS INT) AS local_topic_id, count(*) AS n_reviewed, count_if(requirement_candidate = 'sim') AS n_sim FROM labelled GROUP BY 1, 2")
def confirmed_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = _sample(spark, sf_dir)[1]
    return review.confirmed_by_topic(adapt.annotations(spark, sf_dir, origin), origin)


@query(f"WITH {S.EVIDENCE} SELECT CAST(global_topic_id AS INT) AS global_topic_id, CAST(local_topic_id AS INT) AS local_topic_id, count(*) AS n, count_if(lex_hit) AS n_lex_hit, round(avg(CAST(lex_hit AS INT)), 6) AS frac_lex_hit FROM evidence GROUP BY 1, 2")
def signals_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.signals(adapt.evidence(spark, sf_dir), "global_topic_id", "local_topic_id").withColumn("frac_lex_hit", F.round("frac_lex_hit", 6))


_KINDS = ("outro", "pedido", "queixa")


@query(
    f"""WITH {S.EVIDENCE}, r AS (SELECT CAST(global_topic_id AS VARCHAR) AS global_topic_id, intent_hint FROM evidence UNION ALL SELECT 'base', intent_hint FROM evidence)
    SELECT global_topic_id, count(*) AS n, {', '.join(f"round(count_if(intent_hint = '{k}') / count(*), 6) AS {k}" for k in _KINDS)} FROM r GROUP BY 1"""
)
def category_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.crosstab(adapt.evidence(spark, sf_dir), "global_topic_id", "intent_hint", _KINDS)
    return out.select("global_topic_id", "n", *(F.round(k, 6).alias(k) for k in _KINDS))


_SHARES = """c AS (SELECT {keys}, count(*) AS n, count_if(sentiment = 'Positiva') AS "Positiva", count_if(sentiment = 'Neutra') AS "Neutra", count_if(sentiment = 'Negativa') AS "Negativa" FROM {rows} GROUP BY 1),
    f AS (SELECT *, round_even("Positiva" / n, 4) AS frac_positiva, round_even("Neutra" / n, 4) AS frac_neutra, round_even("Negativa" / n, 4) AS frac_negativa FROM c)
    SELECT *, round_even(frac_positiva - frac_negativa, 4) AS saldo FROM f"""

# --- sentiment and export -------------------------------------------------------------------------


@query(f"WITH {S.SENTENCES}, {S.sentiment('sent')} SELECT sent_id, sentiment, round_even(p, 4) AS score_positiva, round_even(u, 4) AS score_neutra, round_even(n, 4) AS score_negativa FROM felt")
def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.classify(adapt.corpus_sentences(spark, sf_dir)).select("sent_id", "sentiment", "score_positiva", "score_neutra", "score_negativa")


@query(
    f"""WITH {S.WEIGHED}, {S.sentiment('weighed')}, {_SHARES.format(keys='CAST(topic_id AS INT) AS topic_id', rows='felt')}"""
)
def topic_sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sentiment.classify(adapt.weighed(adapt.usable(spark, sf_dir)))
    return sentiment.summarise(scored, "topic_id")


@query(f"""WITH {S.EVIDENCE}, {S.sentiment('evidence')}, {_SHARES.format(keys='lex_hit', rows='felt')}""")
def evidence_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its sentences' sentiment, by cue."""
    rows = adapt.corpus_sentences(spark, sf_dir)
    scored = sentiment.classify(rows).select("sent_id", "sentiment", "score")
    return sentiment.summarise(adapt.evidence(spark, sf_dir, of=rows).join(scored, "sent_id", "left"), "lex_hit")


@query(f"WITH {S.WEIGHED} SELECT sent_id, CAST(topic_id AS INT) AS topic_id, CASE topic_id WHEN 0 THEN 'the, and, that' WHEN 1 THEN 'was, with, the' WHEN 2 THEN 'for, this, which' WHEN 3 THEN 'is' END AS top_terms FROM weighed")
def results_with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with their topics' terms, as the export joins them; sentences without a topic stay."""
    names = spark.createDataFrame([(t, ", ".join(w)) for t, w in TOPIC_WORDS.items() if t >= 0], "topic_id int, top_terms string")
    return adapt.weighed(adapt.usable(spark, sf_dir)).select("sent_id", "topic_id").join(F.broadcast(names), "topic_id", "left").select("sent_id", "topic_id", "top_terms")


@query(f"WITH {S.SENTENCES}, k AS (SELECT DISTINCT sha256(sentence) AS key FROM sent) SELECT key FROM k WHERE substr(key, 1, 1) >= '8'")
def score_cache_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = adapt.corpus_sentences(spark, sf_dir).select(F.sha2("sentence", 256).alias("key")).distinct()
    kept = texts.where(F.substring("key", 1, 1) < "8")
    return texts.join(kept, "key", "left_anti")


@query(
    f"""WITH {S.WEIGHED}, {S.sentiment('sent')}
    SELECT felt.sent_id, felt.post_id, felt.sent_idx::INT AS sent_idx, CAST(weighed.topic_id AS INT) AS global_topic_id, coalesce(weighed.topic_id IN (0, 2, 3), false) AS tema_selecionado,
           CAST(CASE WHEN weighed.topic_id IN (0, 2, 3) THEN weighed.local_topic_id END AS INT) AS local_topic_id, sentiment AS sentimento
    FROM felt LEFT JOIN weighed USING (sent_id)"""
)
def final_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapt.corpus_sentences(spark, sf_dir).select("sent_id", "post_id", "sent_idx", "sentence", "n_words", "is_fragment", "is_dup_exact").persist()
    placed = adapt.weighed(sentences.usable(rows))
    local = placed.where("topic_id in (0, 2, 3)").select("sent_id", "local_topic_id")
    out = sentiment.export(rows, sentiment.classify(rows), placed.select("sent_id", F.col("topic_id").alias("global_topic_id")), local, check=False)
    return out.select("sent_id", "post_id", "sent_idx", "global_topic_id", "tema_selecionado", "local_topic_id", "sentimento")

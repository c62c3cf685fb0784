"""The query catalogue over the sample tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import hits as ht
from colloquy.functions import text as tx
from colloquy.operators import classify, lookups, passages, ranking, review, roles, scoring, shares, turns
from colloquy.plans import retrieval
from colloquy.plans.plan import Concept, Plan
from colloquy.sources import readers, sinks
from colloquy.sources.grams import GramIndex
from colloquy.staging import new_path, staged
from colloquy.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LATIN_ENDS, LATIN_PART, NO_SHIFT = "[.!?]", "[^.!?]+[.!?]?", r"^\s*Next,"
GROUPS = (Concept("of the", ("of", "the")), Concept("and in", ("and", "ing")), Concept("tion", ("tion",)))
PLAN = Plan("", GROUPS, ("the",))
#: Coverage of GROUPS in SQL, for a text t.
COVER_SQL = (
    "CASE WHEN contains(t, 'of the') THEN 1.0::DOUBLE ELSE (contains(t, 'of')::INT + contains(t, 'the')::INT) / 2.0::DOUBLE END",
    "CASE WHEN contains(t, 'and in') THEN 1.0::DOUBLE ELSE (contains(t, 'and')::INT + contains(t, 'ing')::INT) / 2.0::DOUBLE END",
    "CASE WHEN contains(t, 'tion') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# --- shares ----------------------------------------------------------------------------------------

_LINES = "lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return own.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey AS c, r_name AS m FROM {_LINES}),
w AS (SELECT m, 1.0::DOUBLE / count(*) OVER (PARTITION BY c) AS w FROM d),
p AS (SELECT m, floor(sum(w) / (SELECT count(DISTINCT c) FROM d) * 100 + 0.5)::BIGINT AS p, count(*)::BIGINT AS n FROM w GROUP BY m)
SELECT m AS ministry, p + CASE WHEN row_number() OVER (ORDER BY p DESC, m) = 1 THEN 100 - (sum(p) OVER ())::BIGINT ELSE 0 END AS percent, n FROM p""")
def fractional_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases, supplier regions as agencies."""
    return shares.fractional_shares(_lines(spark, sf), "l_orderkey", "r_name")


@query(f"""WITH d AS (SELECT l_orderkey AS c, r_name AS m, greatest(min(o_totalprice) / 500000, 0.05) AS w FROM {_LINES} JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL),
e AS (SELECT m, w / count(*) OVER (PARTITION BY c) AS w FROM d),
p AS (SELECT m, floor(sum(w) / sum(sum(w)) OVER () * 100 + 0.5)::BIGINT AS p FROM e GROUP BY m)
SELECT m AS ministry, p + CASE WHEN row_number() OVER (ORDER BY p DESC, m) = 1 THEN 100 - (sum(p) OVER ())::BIGINT ELSE 0 END AS percent FROM p""")
def weighted_shares(spark: SparkSession, sf: str) -> DataFrame:
    own = _lines(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("score", F.col("o_totalprice") / 500000)
    return shares.weighted_shares(own, ["l_orderkey"], "r_name", "score", "l_linenumber")


@query("""WITH s AS (SELECT source, sum(n_chars)::DOUBLE AS score FROM documents GROUP BY source),
p AS (SELECT source, score, round_even(score / sum(score) OVER () * 100, 1) AS p FROM s QUALIFY row_number() OVER (ORDER BY score DESC, source) <= 3)
SELECT source, score, round_even(p + CASE WHEN row_number() OVER (ORDER BY score DESC, source) = 1 THEN 100 - sum(p) OVER () ELSE 0 END, 1) AS percent FROM p""")
def topn_score_shares(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("score"))
    return shares.score_shares(own, "source", "score", 3)


# --- turns -----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations)
SELECT a.conv_id, a.turn AS ask_turn, b.turn AS reply_turn, b.text AS reply FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.x = b.x WHERE a.role = 'user' AND b.role = 'assistant'""")
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    own = turns.ask_reply_pairs(table(spark, sf, "conversations"), "conv_id", ["turn"], F.col("role") == "user", F.col("role") == "assistant", {"ask_turn": "turn"}, {"reply_turn": "turn", "reply": "text"})
    return own.drop("exchange")


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN turn = lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 THEN 0 ELSE 1 END AS b FROM conversations WHERE turn % 3 <> 1)
SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM b""")
def contiguous_runs(spark: SparkSession, sf: str) -> DataFrame:
    return turns.contiguous_runs(table(spark, sf, "conversations").where("turn % 3 <> 1"), "conv_id", None, "turn").select("conv_id", "turn", "run")


@query("""WITH p AS (SELECT conv_id, turn, turn + turn // 3 AS place FROM conversations),
b AS (SELECT *, CASE WHEN place = lag(place) OVER (PARTITION BY conv_id ORDER BY place) + 1 THEN 0 ELSE 1 END AS b FROM p)
SELECT conv_id, turn, sum(b) OVER (PARTITION BY conv_id ORDER BY place)::BIGINT AS run FROM b""")
def contiguous_runs_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All turns, in an order with a gap before every third."""
    own = table(spark, sf, "conversations").withColumn("place", F.expr("turn + turn div 3"))
    return turns.contiguous_runs(own, "conv_id", None, "place").select("conv_id", "turn", "run")


@query("""SELECT conv_id, turn, concat_ws(' ', lag(k, 2) OVER w, lag(k, 1) OVER w) AS previous_context
FROM (SELECT *, CASE WHEN role <> 'system' THEN right(text, 350) END AS k FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def previous_context(spark: SparkSession, sf: str) -> DataFrame:
    return turns.lag_context(table(spark, sf, "conversations"), "conv_id", ["turn"], "text", usable=F.col("role") != "system").select("conv_id", "turn", "previous_context")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.event_id, arg_max(b.value, b.i) AS previous FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.i BETWEEN a.i - 5 AND a.i - 1 GROUP BY a.event_id""")
def asof_same_speaker(spark: SparkSession, sf: str) -> DataFrame:
    return turns.asof_previous(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type"), F.col("value")).select("event_id", "previous")


@query("""SELECT conv_id, turn, role = 'user' AS lawmaker, role = 'system' OR regexp_matches(text, '^Th\\w+') AS chair FROM conversations""")
def role_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations")
    group = F.when(F.col("role") == "user", F.lit("party"))
    lawmaker = roles.is_lawmaker(group, F.lit(""), F.col("role"), chair="system", government="assistant")
    return own.select("conv_id", "turn", lawmaker.alias("lawmaker"), ((F.col("role") == "system") | F.col("text").rlike(r"^Th\w+")).alias("chair"))


# --- text ------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))::BIGINT AS n FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    own = tx.normalize(F.col("text"), nfkc=False)
    return table(spark, sf, "documents").select("doc_id", F.md5(own.cast("binary")).alias("digest"), F.length(own).cast("long").alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """The sample tables are in NFKC already."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize(F.col("text")).cast("binary")).alias("digest"))


_TOKENS = "regexp_extract_all(text, '[A-Za-z0-9]{2,}')"


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) SELECT token, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM t WHERE NOT regexp_full_match(token, '[0-9]+') GROUP BY token""")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("token"))
    return own.groupBy("token", "doc_id").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("""WITH c AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark),
g AS (SELECT item_id, substr(t, i, k) AS gram FROM (SELECT item_id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM c, (VALUES (2), (3)) v(k)))
SELECT item_id, gram, count(*)::BIGINT AS n FROM g WHERE NOT regexp_full_match(gram, '[0-9]+') GROUP BY ALL""")
def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "benchmark").select("item_id", F.explode(tx.char_ngrams(F.col("text"))).alias("gram"))
    return own.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS p FROM conversations)
SELECT conv_id, turn, 's' || unnest(range(1, len(p) + 1)) AS part_id, unnest(p) AS part FROM p""")
def sentence_parts(spark: SparkSession, sf: str) -> DataFrame:
    own = tx.sentence_parts(F.col("text"), "s", LATIN_PART, (), "^$")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(own).alias("part_id", "part"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return passages.passage_windows(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", LATIN_ENDS, NO_SHIFT)


_WINDOWS = """s AS (SELECT conv_id, turn, unnest(range(0, len(p))) AS i, unnest(p) AS s FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: x <> '') AS p FROM conversations)),
o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s),
win AS (SELECT a.conv_id, a.turn, a.i * 5 + k.k - 1 AS window_no, k.k AS n_sentences, any_value(a.start) AS start, string_agg(b.s, '' ORDER BY b.i) AS t
  FROM o a, (VALUES (1), (2), (3), (4), (5)) k(k), o b WHERE a.conv_id = b.conv_id AND a.turn = b.turn AND b.i BETWEEN a.i AND a.i + k.k - 1
  GROUP BY a.conv_id, a.turn, a.i, k.k HAVING count(*) = k.k AND length(string_agg(b.s, '' ORDER BY b.i)) <= 800)"""


@query(f"WITH {_WINDOWS} SELECT conv_id, turn, window_no::BIGINT AS window_no, n_sentences::INT AS n_sentences, start, start + length(t) AS \"end\", t AS passage FROM win")
def passage_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf).withColumn("window_no", F.col("window_no").cast("long"))


@query(f"""WITH {_WINDOWS}, c AS (SELECT *, [{", ".join(COVER_SQL)}] AS c FROM win),
b AS (SELECT *, list_sum(c) / 3 AS score FROM c WHERE list_max(c) >= 0.5)
SELECT conv_id, turn, start, t AS passage, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, length(t), window_no) = 1""")
def best_passage(spark: SparkSession, sf: str) -> DataFrame:
    own = passages.best_recall(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", PLAN, ends=LATIN_ENDS, shift=NO_SHIFT)
    return own.select("conv_id", "turn", "start", "passage", r6("score"))


@query(f"""WITH {_WINDOWS}, c AS (SELECT *, [{", ".join(COVER_SQL)}] AS c FROM win),
b AS (SELECT *, list_sum(c) / 3 AS coverage, list_sum(c) / 3 - length(t) / 5000.0::DOUBLE AS score FROM c WHERE list_min(c) >= 0.66)
SELECT conv_id, turn, start, t AS passage, round(coverage, 6) AS coverage, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, window_no) = 1""")
def question_window(spark: SparkSession, sf: str) -> DataFrame:
    own = passages.best_question(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", PLAN, ends=LATIN_ENDS, shift=NO_SHIFT)
    return own.select("conv_id", "turn", "start", "passage", r6("coverage"), r6("score"))


# --- scores ----------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT [{", ".join(COVER_SQL)}] AS c FROM (SELECT text AS t FROM documents))
SELECT unnest([1, 2, 3]) AS concept, round(unnest([1 + ln(1 + (count(*) + 1) / (count(*) FILTER (c[1] >= 0.5) + 1)), 1 + ln(1 + (count(*) + 1) / (count(*) FILTER (c[2] >= 0.5) + 1)), 1 + ln(1 + (count(*) + 1) / (count(*) FILTER (c[3] >= 0.5) + 1))]), 6) AS weight FROM c""")
def doc_frequency_weights(spark: SparkSession, sf: str) -> DataFrame:
    own = scoring.rarity_weights(table(spark, sf, "documents"), "text", PLAN)
    return spark.createDataFrame([(i + 1, round(w, 6)) for i, w in enumerate(own)], "concept int, weight double")


@query(f"""WITH c AS (SELECT doc_id, [{", ".join(COVER_SQL)}] AS c FROM (SELECT doc_id, text AS t FROM documents))
SELECT doc_id, round(list_sum(c) / 3, 6) AS coverage, list_min(c) >= 0.66 AS supported FROM c""")
def coverage_score(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", ht.coverages(F.col("text"), list(GROUPS)).alias("c"))
    return own.select("doc_id", F.round(ht.weighted_coverage(F.col("c")), 6).alias("coverage"), ht.supported(F.col("c")).alias("supported"))


@query("""WITH a AS (SELECT conv_id, turn, i FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations) WHERE substr(text, i, 3) = 'the'),
b AS (SELECT conv_id, turn, i FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations) WHERE substr(text, i, 4) = 'tion'),
a80 AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 80), b80 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 80),
p AS (SELECT conv_id, turn, least(a.i, b.i) - 1 AS start, greatest(a.i + 3, b.i + 4) - 1 AS e FROM a80 a JOIN b80 b USING (conv_id, turn) WHERE greatest(0, greatest(a.i, b.i) - least(a.i + 3, b.i + 4)) <= 180)
SELECT conv_id, turn, start::INT AS start, e::INT AS "end" FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY e - start, start, e) = 1""")
def proximity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").select("conv_id", "turn", scoring.spans(F.col("text"), ["the", "tion"]).alias("s"))
    return own.select("conv_id", "turn", "s.start", "s.end")


@query("""WITH t AS (SELECT conv_id, turn, text, list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{2,}')), lambda w: NOT regexp_full_match(w, '[0-9]+')) AS t FROM conversations)
SELECT conv_id, turn, round((contains(text, 'the')::INT + contains(text, 'tion')::INT + contains(text, 'zzz')::INT) / sqrt(3.0 * greatest(len(t), 1)), 6) AS similarity FROM t
WHERE (contains(text, 'the')::INT + contains(text, 'tion')::INT + contains(text, 'zzz')::INT) / sqrt(3.0 * greatest(len(t), 1)) >= 0.055""")
def set_similarity(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").select("conv_id", "turn", ht.set_similarity(["the", "tion", "zzz"], F.col("text"), tx.word_tokens(F.col("text"), ())).alias("s"))
    return own.where("s >= 0.055").select("conv_id", "turn", F.round("s", 6).alias("similarity"))


@query("""SELECT conv_id, turn, floor((0.75 * greatest(q, a) + 0.25 * least(q, a)) * 1000 + 0.5) / 1000 AS retrieval_score, floor((q + a) / 2 * 1000 + 0.5) / 1000 AS relevance
FROM (SELECT conv_id, turn, (contains(text, 'the')::INT + contains(text, 'zzz')::INT) / 2.0::DOUBLE AS q, (contains(text, 'tion')::INT + contains(text, 'er')::INT + contains(text, 'zzz')::INT) / 3.0::DOUBLE AS a FROM conversations)""")
def blended_scores(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").select("conv_id", "turn", ht.term_share(F.col("text"), ["the", "zzz"]).alias("q"), ht.term_share(F.col("text"), ["tion", "er", "zzz"]).alias("a"))
    q, a = F.col("q"), F.col("a")
    return own.select("conv_id", "turn", scoring.retrieval_score(q, a).alias("retrieval_score"), scoring.relevance(q, a).alias("relevance"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 8""")
def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The search below for one query."""
    own = table(spark, sf, "embeddings")
    return scoring.nearest_vectors(own, own.where("vec_id = 0"), "vec_id", "embedding").select("vec_id", r6("cosine"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.v, q.v), 9) AS cosine FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, vec_id, round(cosine, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) <= 8""")
def dense_cosine_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a query, against all rows."""
    own = table(spark, sf, "embeddings")
    return scoring.nearest_vectors(own, own.where("vec_id % 100 = 0"), "vec_id", "embedding").select("query", "vec_id", r6("cosine"))


# --- ranks and dedup -------------------------------------------------------------------------------


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, event_id LIMIT 100")
def keyword_scan_newest(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").where((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    return readers.newest(own.select("event_id", "ts", "user_id"), [F.desc("ts"), F.asc("event_id")], 100)


def _as_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("issue_id"), F.col("turn").cast("string").alias("speech_id"), F.lpad(F.col("conv_id").cast("string"), 9, "0").alias("date"), F.col("text").alias("speech"), F.col("turn").alias("ord"))


@query("SELECT conv_id::VARCHAR AS issue_id, turn::VARCHAR AS speech_id FROM conversations WHERE contains(text, 'tion') AND contains(text, 'the') AND conv_id >= 10 AND conv_id NOT IN (12) ORDER BY lpad(conv_id::VARCHAR, 9, '0') DESC, conv_id::VARCHAR, turn LIMIT 100")
def turn_scan(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan_turns(_as_turns(spark, sf), "tion the", "000000010", excluded=["12"]).rows.select("issue_id", "speech_id")


@query("""WITH h AS (SELECT DISTINCT conv_id FROM conversations WHERE contains(text, 'tion') AND contains(text, 'the') ORDER BY conv_id DESC LIMIT 10)
SELECT conv_id::VARCHAR AS issue_id, turn::VARCHAR AS speech_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM h)""")
def meeting_scan(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan_meetings(_as_turns(spark, sf), "tion the").rows.select("issue_id", "speech_id")


def _gram_index(spark: SparkSession, sf: str) -> GramIndex:
    index = GramIndex(spark, new_path(spark, "grams"), chunk=1 << 10, shelf=1 << 12)
    index.add(_as_turns(spark, sf))
    return index


@query(ORACLES["turn_scan"])
def turn_scan_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The scan over a written index of character pairs."""
    return readers.scan_turns(_gram_index(spark, sf), "tion the", "000000010", excluded=["12"]).rows.select("issue_id", "speech_id")


@query(ORACLES["meeting_scan"])
def meeting_scan_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan_meetings(_gram_index(spark, sf), "tion the").rows.select("issue_id", "speech_id")


@query("""WITH g AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM conversations)
SELECT gram, count(*)::BIGINT AS turns, min(conv_id || ':' || turn) AS least FROM g GROUP BY gram""")
def gram_postings(spark: SparkSession, sf: str) -> DataFrame:
    """How many turns hold each pair of characters, from the postings as written."""
    index = _gram_index(spark, sf)
    each = index._table("postings", "_year string, chunk long, gram string, turns array<int>").select("gram", F.explode(F.transform("turns", lambda t: t + F.col("chunk") * index.chunk)).alias("_place"))
    named = each.join(index.turns().select("_place", F.concat("issue_id", F.lit(":"), "speech_id").alias("id")), "_place")
    return named.groupBy("gram").agg(F.count("*").alias("turns"), F.min("id").alias("least"))


@query("""WITH h AS (SELECT conv_id, turn, role = 'user' AS asks, (contains(text, 'the')::INT + contains(text, 'tion')::INT) / 2.0::DOUBLE AS s FROM conversations WHERE contains(text, 'the') OR contains(text, 'tion'))
SELECT conv_id, max(s) AS score, bool_or(asks) AS has_question, count(DISTINCT CASE WHEN asks THEN turn END)::BIGINT AS question_matches, count(DISTINCT CASE WHEN NOT asks THEN turn END)::BIGINT AS answer_matches
FROM h GROUP BY conv_id ORDER BY has_question DESC, question_matches + least(answer_matches, 4) DESC, score DESC, conv_id LIMIT 20""")
def meeting_rank(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").withColumn("s", ht.term_share(F.col("text"), ["the", "tion"])).where("s > 0")
    return ranking.meeting_ranks(own, "conv_id", "turn", F.col("role") == "user", F.col("s"), 20)


@query("""WITH h AS (SELECT conv_id, turn, (contains(text, 'the')::INT + contains(text, 'tion')::INT) / 2.0::DOUBLE AS s FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS k FROM h QUALIFY k <= 4)
SELECT conv_id, max(s) AS s, string_agg(turn, ',' ORDER BY k) AS turns FROM b GROUP BY conv_id ORDER BY s DESC, conv_id LIMIT 4""")
def best_turns_per_meeting(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").withColumn("s", ht.term_share(F.col("text"), ["the", "tion"]))
    found = ranking.best_meetings(own, "conv_id", "turn", "s")
    return found.select("conv_id", F.col("score").alias("s"), F.array_join("turn_ids", ",").alias("turns"))


@query("""WITH y AS (SELECT o_orderkey, o_totalprice, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1 AS reserved FROM orders)
SELECT o_orderkey, o_totalprice, reserved FROM y ORDER BY reserved DESC, o_totalprice DESC, o_orderkey LIMIT 4""")
def reserve_per_year(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return ranking.reserve_per_group(own, "y", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice", "reserved")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("SELECT min(event_id) AS event_id, user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last row's value at the first row's place."""
    return ranking.keep_last(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id").select("event_id", "user_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def dedup_max(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.keep_max(table(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT o_custkey, o_orderkey, part FROM (SELECT o_custkey, o_orderkey, 0 AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY part, o_orderkey) = 1""")
def dedup_union(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    a, b = own.where("o_orderstatus = 'F'").withColumn("part", F.lit(0)), own.withColumn("part", F.lit(1))
    return ranking.union_with_precedence([a, b], ["o_custkey"], "o_orderkey").drop("o_orderstatus")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders QUALIFY k <= 4)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, string_agg(o_orderpriority, ',' ORDER BY k) AS variants FROM r GROUP BY o_custkey""")
def variant_lists(spark: SparkSession, sf: str) -> DataFrame:
    own = ranking.variants(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return own.select("o_custkey", "o_orderkey", F.array_join("variants", ",").alias("variants"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING')")
def semi_allowed(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return ranking.named_in(table(spark, sf, "orders"), allowed.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT count(DISTINCT l_orderkey)::BIGINT AS cases, count(DISTINCT l_suppkey)::BIGINT AS meetings, count(DISTINCT l_orderkey) >= 12 AND count(DISTINCT l_suppkey) >= 3 AS enough FROM lineitem WHERE l_discount >= 0.05")
def sufficiency_gate(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.evidence(table(spark, sf, "lineitem").where("l_discount >= 0.05"), F.col("l_orderkey"), F.col("l_suppkey"))


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) SELECT doc_id, place::BIGINT AS place, place % 10 < 8 AS is_train FROM n""")
def position_split(spark: SparkSession, sf: str) -> DataFrame:
    own = ranking.numbered(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "place")
    return classify.split(own, F.col("place")).select("doc_id", F.col("place").cast("long").alias("place"), "is_train")


@query("""WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT s_suppkey, (i // 8)::BIGINT AS batch, 'c' || (i + 1) AS id, 'c' || (i % 8 + 1) AS batch_id FROM n""")
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.batches(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"])


@query()
def diversified_topk(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select(F.concat_ws(":", "source", "doc_id").alias("case_id"), F.col("lang").alias("ministry"), F.col("doc_id").cast("string").alias("url"), F.col("source").alias("bucket"), (F.col("n_chars") / 100000).alias("score"), F.col("doc_id").alias("ord"))
    return ranking.diversified(own, 24)


@query("SELECT o_custkey, bool_and(o_orderdate < TIMESTAMP '1996-01-01') AS historical_only FROM orders GROUP BY o_custkey")
def historical_only(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(retrieval.only_old(F.date_format("o_orderdate", "yyyy-MM-dd"), "1996-01-01").alias("historical_only"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def notes_newest(spark: SparkSession, sf: str) -> DataFrame:
    return readers.newest(table(spark, sf, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], 20)


# --- lookups ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'red' WHEN regexp_matches(p_type, 'STEEL|TIN|NICKEL') THEN 'grey' END AS ministry FROM part")
def title_rule_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", roles.first_rule(F.col("p_type"), (("BRASS|COPPER", "red"), ("STEEL|TIN|NICKEL", "grey"))).alias("ministry"))


@query("SELECT n_name, count(*)::BIGINT AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""SELECT event_id, CASE WHEN code = 3036 OR contains(m, 'daily free allocation') THEN 'quota_exhausted' WHEN code = 3040 OR contains(m, 'overloaded') THEN 'model_busy' WHEN contains(m, 'timed out') THEN 'model_timeout' WHEN code = 5016 THEN 'model_access_denied' ELSE 'model_request_failed' END AS kind
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 3036 WHEN 1 THEN 3040 WHEN 2 THEN 5016 WHEN 3 THEN 1 END AS code, CASE event_type WHEN 'click' THEN 'request timed out' WHEN 'view' THEN 'server overloaded' WHEN 'purchase' THEN 'daily free allocation used' ELSE 'other' END AS m FROM events)""")
def error_classification(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_id") % 7 == 0, 3036).when(F.col("event_id") % 7 == 1, 3040).when(F.col("event_id") % 7 == 2, 5016).when(F.col("event_id") % 7 == 3, 1)
    said = F.when(F.col("event_type") == "click", "request timed out").when(F.col("event_type") == "view", "server overloaded").when(F.col("event_type") == "purchase", "daily free allocation used").otherwise("other")
    return table(spark, sf, "events").select("event_id", lookups.error_kind(code, said, F.lit(0)).alias("kind"))


@query("SELECT page_id, substr(trim(regexp_replace(html, '<[^>]*>', '', 'g')), 1, 260) AS snippet, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'))::BIGINT AS escaped FROM pages")
def html_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.html_snippet(F.col("html")).alias("snippet"), F.length(tx.html_escape(F.col("html"))).cast("long").alias("escaped"))


@query("""WITH p AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: trim(s))) AS s FROM documents),
q AS (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: trim(s))) AS s FROM benchmark)
SELECT p.doc_id, q.item_id, count(DISTINCT q.s)::BIGINT AS n FROM p JOIN q ON p.s = q.s WHERE length(q.s) BETWEEN 20 AND 180 GROUP BY ALL""")
def citation_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that are a document's own sentences: an equi-join on the sentence."""
    part = lambda c: F.transform(tx.occurrences(F.col(c), LATIN_PART), lambda s: F.trim(s))
    a = table(spark, sf, "documents").select("doc_id", F.explode(part("text")).alias("s"))
    b = table(spark, sf, "benchmark").select("item_id", F.explode(part("text")).alias("s")).where("length(s) between 20 and 180")
    return a.join(b, "s").groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) <= 200 THEN text ELSE substr(substr(text, 1, 180), 1, 200) END AS clip, substr(text, 1, 400) || CASE WHEN length(text) > 400 THEN '…' ELSE '' END AS excerpt,
conv_id || ':' || turn AS case_id, sha256('{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS key FROM conversations""")
def clips_and_keys(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations")
    clip = tx.context_clip(F.col("text"), F.lit(10), F.lit(80), 200, 100)
    key = tx.case_id(F.col("conv_id"), F.lit(""), F.col("turn").cast("string"), F.lit(""), F.lit(0))
    return own.select("conv_id", "turn", clip.alias("clip"), tx.excerpt(F.col("text"), F.lit(None).cast("int")).alias("excerpt"), key.alias("case_id"), tx.digest_key(F.col("conv_id"), F.col("turn")).alias("key"))


# --- classifier ------------------------------------------------------------------------------------

_BAG = f"tok AS (SELECT doc_id, lang, unnest({_TOKENS}) AS token FROM documents), bag AS (SELECT doc_id, any_value(lang) AS lang, token, count(*)::BIGINT AS n FROM tok WHERE NOT regexp_full_match(token, '[0-9]+') GROUP BY doc_id, token)"
_PREDICT = f"""{_BAG}, cen AS (SELECT lang, token, sum(n)::BIGINT AS n FROM bag WHERE doc_id % 10 < 8 GROUP BY lang, token),
dn AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS d FROM bag WHERE doc_id % 10 >= 8 GROUP BY doc_id), cn AS (SELECT lang, sqrt(sum(n * n)::DOUBLE) AS d FROM cen GROUP BY lang),
cs AS (SELECT b.doc_id, c.lang, (sum(b.n * c.n) / (any_value(dn.d) * any_value(cn.d)))::DOUBLE AS cosine FROM bag b JOIN cen c ON b.token = c.token JOIN dn ON dn.doc_id = b.doc_id JOIN cn ON cn.lang = c.lang WHERE b.doc_id % 10 >= 8 GROUP BY b.doc_id, c.lang),
pr AS (SELECT doc_id, lang AS predicted, cosine FROM cs WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 9) DESC, lang) = 1),
ev AS (SELECT d.doc_id, d.lang AS actual, pr.predicted FROM documents d LEFT JOIN pr ON d.doc_id = pr.doc_id WHERE d.doc_id % 10 >= 8)"""


def _folds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of the reference's 80/20 split, by the place of a document's id among all of them; without an id, on no side."""
    own = table(spark, sf, "documents")
    places = classify.split(ranking.numbered(own.select("doc_id").distinct(), ["doc_id"], "place"), F.col("place"))
    places = staged(places.select("doc_id", "is_train"))
    return own.join(places.where("is_train").select("doc_id"), "doc_id"), own.join(places.where("not is_train").select("doc_id"), "doc_id")


def _centroids(rows: DataFrame) -> DataFrame:
    return classify.train_centroids(rows, "lang", tokens=tx.word_tokens(F.col("text")))


def _predicted(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    found = classify.similarities(rows, "doc_id", centroids, "lang", tokens=tx.word_tokens(F.col("text")))
    return classify.predictions(found, "doc_id", "lang")


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _folds(spark, sf)
    return test.select("doc_id", F.col("lang").alias("actual")).join(_predicted(test, _centroids(train)), "doc_id", "left")


@query(f"WITH {_BAG} SELECT lang, token, sum(n)::BIGINT AS n FROM bag WHERE doc_id % 10 < 8 GROUP BY lang, token")
def centroid_train(spark: SparkSession, sf: str) -> DataFrame:
    """The training side of the reference's own 80/20 split by position."""
    return _centroids(_folds(spark, sf)[0])


@query(f"WITH {_PREDICT} SELECT doc_id, predicted, round(cosine, 6) AS cosine FROM pr")
def cosine_predict(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _folds(spark, sf)
    return _predicted(test, _centroids(train)).select("doc_id", "predicted", r6("cosine"))


@query(ORACLES["cosine_predict"].replace(" WHERE doc_id % 10 < 8", "").replace(" WHERE doc_id % 10 >= 8", "").replace(" WHERE b.doc_id % 10 >= 8", ""))
def cosine_predict_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by the centroids of all, as the reference predicts."""
    own = table(spark, sf, "documents")
    return _predicted(own, _centroids(own)).select("doc_id", "predicted", r6("cosine"))


@query(f"WITH {_PREDICT} SELECT count(*)::BIGINT AS total, count(predicted)::BIGINT AS covered, count(*) FILTER (actual = predicted)::BIGINT AS correct, round(count(predicted) / count(*)::DOUBLE, 4) AS coverage, round(count(*) FILTER (actual = predicted) / count(predicted)::DOUBLE, 4) AS accuracy FROM ev")
def evaluate_split(spark: SparkSession, sf: str) -> DataFrame:
    return classify.evaluation(_evaluated(spark, sf))


@query(f"WITH {_PREDICT}, c AS (SELECT actual, predicted, count(*)::BIGINT AS n FROM ev WHERE predicted IS NOT NULL GROUP BY ALL ORDER BY n DESC, actual, predicted LIMIT 12) SELECT actual, predicted, n FROM c WHERE actual <> predicted")
def confusion_top(spark: SparkSession, sf: str) -> DataFrame:
    return classify.confusion_top(_evaluated(spark, sf))


# --- reviews ---------------------------------------------------------------------------------------


def _reviews(spark: SparkSession, sf: str, labels: str = "doc_id % 5 <> 4") -> DataFrame:
    """A review row for each label taken; every eleventh id is there twice, some are malformed."""
    own = table(spark, sf, "labels").where(labels).withColumn("id", F.col("doc_id").cast("string"))
    own = own.select("id", F.lit("who").alias("beneficiary"), F.when(F.col("doc_id") % 13 != 0, "what").alias("activity"), F.expr("CASE WHEN toxic = 1 THEN 'different' WHEN quality = 0 THEN 'unclear' ELSE 'same' END").alias("relation"), F.expr("CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'why' END").alias("comparison"), F.expr("CASE WHEN quality = 1 THEN 'accept' ELSE 'uncertain' END").alias("decision"), F.lit("s1").alias("q"), F.lit("s2").alias("a"), F.lit(0).alias("ord"), "doc_id")
    return own.union(own.where("doc_id % 11 = 0").withColumn("ord", F.lit(1))).drop("doc_id")


_REVIEWS = """lab AS (SELECT doc_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 13 <> 0 THEN 'what' END AS activity, CASE WHEN toxic = 1 THEN 'different' WHEN quality = 0 THEN 'unclear' ELSE 'same' END AS relation, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'why' END AS comparison, CASE WHEN quality = 1 THEN 'accept' ELSE 'uncertain' END AS decision FROM labels WHERE doc_id % 5 <> 4),
rev AS (SELECT *, 1 AS nth FROM lab UNION ALL SELECT *, 2 FROM lab WHERE doc_id % 11 = 0),
chk AS (SELECT *, CASE WHEN activity IS NULL THEN 'missing_semantic_field' WHEN nth > 1 THEN 'duplicate_id' WHEN trim(comparison) = '' THEN 'blank_comparison' END AS reason FROM rev)"""


@query(f"""WITH {_REVIEWS}, parts AS (SELECT doc_id::VARCHAR AS id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS p FROM documents),
said AS (SELECT id, CASE WHEN relation = 'unclear' OR (decision = 'accept' AND relation <> 'same') THEN 'uncertain' WHEN relation <> 'same' THEN 'reject' ELSE decision END AS said FROM chk WHERE reason IS NULL),
twice AS (SELECT id FROM rev GROUP BY id HAVING count(*) > 1),
j AS (SELECT p.id, s.said, t.id IS NOT NULL AS twice, p.p[1] AS q, p.p[2] AS a FROM parts p LEFT JOIN said s ON p.id = s.id LEFT JOIN twice t ON t.id = p.id),
k AS (SELECT *, coalesce(said = 'accept' AND (q IS NULL OR a IS NULL), false) AS alien, said IS NOT NULL AND NOT twice AND NOT coalesce(said = 'accept' AND (q IS NULL OR a IS NULL), false) AS done FROM j)
SELECT id, CASE WHEN done THEN said ELSE 'uncertain' END AS decision, CASE WHEN said IS NULL AND NOT twice THEN 'missing' WHEN twice THEN 'duplicate_id' WHEN alien THEN 'foreign_reference' END AS reason, done AS completed, CASE WHEN done THEN q END AS question_evidence, CASE WHEN done THEN a END AS answer_evidence FROM k""")
def review_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf, _reviews(spark, sf))


def _reconciled(spark: SparkSession, sf: str, reviews: DataFrame) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    parts = docs.select("id", F.explode(tx.sentence_parts(F.col("text"), "s", LATIN_PART, (), "^$")).alias("part_id", "text"))
    return review.reconcile(docs.select("id"), reviews, parts)


@query(ORACLES["review_reconcile"].replace(" WHERE doc_id % 5 <> 4", ""))
def review_reconcile_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The reviews of all labels."""
    return _reconciled(spark, sf, _reviews(spark, sf, "true"))


@query(f"WITH {_REVIEWS} SELECT reason, count(*)::BIGINT AS n FROM chk WHERE reason IS NOT NULL GROUP BY reason")
def validation_counters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return review.failure_counts(review.checked(_reviews(spark, sf), docs))


@query(ORACLES["validation_counters"].replace(" WHERE doc_id % 5 <> 4", ""))
def validation_counters_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The reviews of all labels."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return review.failure_counts(review.checked(_reviews(spark, sf, "true"), docs))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0)::BIGINT AS accepted, count(*) FILTER (toxic = 1)::BIGINT AS rejected, count(*) FILTER (quality = 0 AND toxic = 0)::BIGINT AS uncertain, count(*) FILTER (doc_id % 2 = 0)::BIGINT AS completed FROM labels")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labels").withColumn("decision", F.expr("CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'uncertain' END")).withColumn("completed", F.col("doc_id") % 2 == 0)
    return review.outcome_counts(own)


@query("""WITH o AS (SELECT o_orderkey % 500 AS case_id, o_orderstatus AS ministry, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS r FROM orders)
SELECT case_id, ministry, CASE min(r) WHEN 1 THEN 'verified' WHEN 2 THEN 'pending' ELSE 'rejected' END AS outcome FROM o GROUP BY ALL""")
def scope_merge(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("case_id"), F.col("o_orderstatus").alias("ministry"), F.when(F.col("o_orderpriority") == "1-URGENT", "verified").when(F.col("o_orderpriority") == "2-HIGH", "pending").alias("outcome"))
    return review.merge_scope(own.select("case_id", "ministry").distinct(), own.where("outcome is not null"))


@query("""WITH a AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS x, sum((s_nationkey % 2 = 0)::INT) OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT s_suppkey, CASE WHEN NOT x THEN 'clear' WHEN k <= 8 THEN 'check' ELSE 'overflow' END AS scope FROM a""")
def scope_budget(spark: SparkSession, sf: str) -> DataFrame:
    return review.scope_budget(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_nationkey") % 2 == 0, ["s_suppkey"]).select("s_suppkey", "scope")


@query("SELECT sum(CASE WHEN value >= 0 AND value = floor(value) THEN value ELSE 0 END)::DOUBLE AS input_tokens, sum(event_id)::BIGINT AS output_tokens FROM events")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return review.usage_totals(table(spark, sf, "events").select(F.col("value").alias("input_tokens"), F.col("event_id").alias("output_tokens")))


@query("""SELECT conv_id, turn, sha256(role) AS question_id, CASE WHEN row_number() OVER (PARTITION BY role ORDER BY conv_id * 100 + turn) = 1 THEN role END AS role FROM conversations""")
def question_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))
    return review.question_dictionary(own, "role", "ord").drop("ord")


# --- time and state --------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT event_id, sum(1) OVER w AS used, sum(1) OVER w <= 100 AS allowed FROM events WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""".replace("sum(1) OVER w AS used", "(sum(1) OVER w)::BIGINT AS used"))
def daily_quota_window(spark: SparkSession, sf: str) -> DataFrame:
    return state.daily_quota(table(spark, sf, "events"), "ts", F.lit(1), 100, ["ts", "event_id"]).select("event_id", "used", "allowed")


@query("""WITH g AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) SELECT event_id, gap_us, coalesce(gap_us >= 3000000, true) AS spaced FROM g""")
def min_gap(spark: SparkSession, sf: str) -> DataFrame:
    return state.gap_ok(table(spark, sf, "events"), ["user_id"], "ts", ["ts", "event_id"]).select("event_id", "gap_us", "spaced")


@query("""SELECT p.event_id, CASE WHEN epoch_us(p.ts) - epoch_us(max(e.ts)) < 86400000000 THEN arg_max(e.value, (e.ts, e.event_id)) END AS hit
FROM events p LEFT JOIN events e ON p.user_id = e.user_id AND e.event_type = 'purchase' AND e.ts <= p.ts WHERE p.event_type = 'click' GROUP BY p.event_id, p.ts""")
def ttl_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The newest purchase of a click's user, if it is less than a day old."""
    own = table(spark, sf, "events")
    entries = own.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value")
    return state.ttl_lookup(own.where("event_type = 'click'").select("event_id", "user_id", "ts"), entries, "user_id", "ts", "at", 86400, "value").select("event_id", "hit")


# --- sources and sinks -----------------------------------------------------------------------------


_TEXTS = ["doc_id", "text", "lang", "source"]


def _reread_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """documents written as JSON lines, texts and all, and read again."""
    path = new_path(spark, "export")
    sinks.write_jsonl(table(spark, sf, "documents").select(*_TEXTS), path)
    return spark.read.schema("doc_id bigint, text string, lang string, source string").json(path)


def _reread_csv(spark: SparkSession, sf: str) -> DataFrame:
    """documents exported as CSV, texts and all, and read again; empty texts come back as null."""
    path = new_path(spark, "export")
    sinks.write_csv(table(spark, sf, "documents"), path, _TEXTS)
    return readers.read_csv(spark, path, "doc_id string, text string, lang string, source string")


@query("SELECT doc_id, lang, source FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _reread_jsonl(spark, sf).select("doc_id", "lang", "source")


@query("SELECT doc_id, md5(text) AS digest, lang, source FROM documents")
def jsonl_roundtrip_text(spark: SparkSession, sf: str) -> DataFrame:
    return _reread_jsonl(spark, sf).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "source")


@query("SELECT doc_id::VARCHAR AS doc_id, lang, source FROM documents")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    return _reread_csv(spark, sf).select("doc_id", "lang", "source")


@query("SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS digest, lang, source FROM documents")
def csv_export_text(spark: SparkSession, sf: str) -> DataFrame:
    return _reread_csv(spark, sf).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "lang", "source")


from colloquy import transcript_queries  # noqa: E402, F401  registers its own

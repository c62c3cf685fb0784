"""Catalogue entries of the transcript rules: debates made of the sample conversations, in the language that the rules are about.

The select list below makes the same table in Spark and in the SQL that queries are checked with.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import rules, schema
from colloquy.caches import ResultCache, ReviewCache, ReviewIdentity, SourceCache, canonical_input, key_of, reusable_batches
from colloquy.functions import hits as ht
from colloquy.functions import text as tx
from colloquy.functions.segment import icu_segmenter
from colloquy.operators import lookups, ranking, review, roles, turns, verdicts
from colloquy.plans import entries, retrieval
from colloquy.plans.plan import Concept, Plan
from colloquy.queries import LATIN_PART, query, table
from colloquy.sources import proxy, readers
from colloquy.staging import new_path, staged
from colloquy.streaming import keyed, state

PHRASES = (
    "水素ステーションの整備について、政府としてはどのような見解をお持ちなのか伺います。", "金融庁としては水素ステーションの整備に取り組みます。", "御指摘の水素ステーションの税制を進めます。", "環境省として対応します。水素ステーションの整備を進めます。次に、農業です。",
    "○山田委員長 開会します。", "独立行政法人水素機構が検討します。質問しません。", "連携する金融庁として対応します。水素の支援。", "「お答えします」と申し上げました。税制です。",
)
POSITIONS = ("経済産業大臣", "財務大臣・内閣府特命担当大臣(金融)", "内閣総理大臣", "環境省地球環境局長", "参考人", "内閣府副大臣")
_pick = lambda n, values: f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
TALK = (
    "cast(conv_id as string) AS issue_id", "cast(conv_id as string) || '-' || cast(turn as string) AS speech_id", "cast(turn as int) + 1 AS speech_order",
    "'202' || cast(conv_id % 5 as string) || '-0' || cast(1 + conv_id % 9 as string) || '-01' AS date", "CASE WHEN conv_id % 4 = 0 THEN '本会議' ELSE '経済産業委員会' END AS meeting",
    "CASE WHEN role = 'user' THEN '山田' ELSE '鈴木' END AS speaker", "CASE WHEN role = 'user' THEN '会派' END AS speaker_group",
    f"CASE WHEN role = 'assistant' THEN {_pick('(conv_id + turn) % 6', POSITIONS)} WHEN role = 'system' THEN '委員長' END AS speaker_position", "CASE WHEN turn % 7 = 3 THEN '証人' END AS speaker_role",
    f"{_pick('(conv_id * 3 + turn) % 8', PHRASES)} || text AS speech", "'https://a.jp/' || cast(conv_id as string) || '/' || cast(turn as string) AS speech_url", "turn AS ord", "(conv_id * 3 + turn) % 8 AS phrase",
)
TALK_SQL = f"talk AS (SELECT {', '.join(TALK)} FROM conversations)"
OFFICE = "concat_ws(' ', coalesce(speaker_role, ''), coalesce(speaker_position, ''))"
CHAIR_SQL = f"(regexp_matches({OFFICE}, '{rules.CHAIR}') OR regexp_matches(coalesce(speech, ''), '{rules.CHAIR_HEADER}'))"
ASKS_SQL = f"(coalesce(speaker_group, '') <> '' AND NOT {CHAIR_SQL} AND NOT regexp_matches({OFFICE}, '{rules.GOVERNMENT}'))"
HYDROGEN = Concept("水素税制", ("水素", "税制"))
PLAN = Plan("", (Concept("水素ステーション", ("水素ステーション",)), Concept("整備", ("整備",))), ("水素", "整備"))


def talk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(*TALK)


def as_turns(spark: SparkSession, sf: str) -> DataFrame:
    return talk(spark, sf).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.TURNS.split(", ")])


# --- roles and agencies ----------------------------------------------------------------------------


@query(f"""WITH {TALK_SQL} SELECT speech_id, {CHAIR_SQL} AS chair, {ASKS_SQL} AS asks,
coalesce(speaker_group, '') <> '' AND NOT regexp_matches({OFFICE}, '{rules.ROUTE_NOT_LEGISLATOR}') AS legislator, length(speech) >= 35 AND regexp_matches(speech, '{rules.QUESTION_LIKE}') AS question_like FROM talk""")
def speaker_roles(spark: SparkSession, sf: str) -> DataFrame:
    args = (F.col("speaker_role"), F.col("speaker_position"))
    group, text = F.col("speaker_group"), F.col("speech")
    own = {"chair": roles.is_chair(*args, text), "asks": roles.is_questioner(group, *args, text), "legislator": roles.is_route_legislator(group, *args), "question_like": roles.is_question_like(text)}
    return talk(spark, sf).select("speech_id", *[c.alias(n) for n, c in own.items()])


_CLAIM = "CASE phrase WHEN 1 THEN '金融庁' WHEN 3 THEN '環境省' END"


@query(f"""WITH {TALK_SQL} SELECT speech_id, CASE speaker_position WHEN '経済産業大臣' THEN '経済産業省' WHEN '環境省地球環境局長' THEN '環境省'
WHEN '財務大臣・内閣府特命担当大臣(金融)' THEN CASE phrase WHEN 1 THEN '金融庁' END WHEN '内閣総理大臣' THEN coalesce({_CLAIM}, '{rules.CABINET}') WHEN '内閣府副大臣' THEN coalesce({_CLAIM}, '{rules.CABINET}') END AS ministry FROM talk""")
def answering_agencies(spark: SparkSession, sf: str) -> DataFrame:
    return talk(spark, sf).select("speech_id", roles.answering_agency(F.col("speaker_position"), F.col("speech")).alias("ministry"))


_EARLY = f"CASE speaker_position WHEN '経済産業大臣' THEN '経済産業省' WHEN '環境省地球環境局長' THEN '環境省' WHEN '参考人' THEN NULL WHEN '委員長' THEN NULL ELSE CASE WHEN speaker_position IS NOT NULL THEN '{rules.CABINET}' END END"


@query(f"""WITH {TALK_SQL}, t AS (SELECT *, {_EARLY} AS ministry, speaker_group IS NOT NULL AND NOT regexp_matches({OFFICE}, '{rules.EARLY_CHAIR}') AND NOT regexp_matches({OFFICE}, '{rules.EARLY_GOVERNMENT}') AS lawmaker,
trim(regexp_replace(speech, '\\s+', ' ', 'g')) AS text FROM talk), e AS (SELECT *, sum(lawmaker::INT) OVER (PARTITION BY issue_id ORDER BY speech_order, ord) AS x FROM t)
SELECT a.text AS question, b.text AS answer, b.ministry, b.speech_url AS url FROM e a JOIN e b ON a.issue_id = b.issue_id AND a.x = b.x WHERE a.lawmaker AND NOT b.lawmaker AND b.ministry IS NOT NULL AND b.x > 0
AND length(a.text) >= 35 AND regexp_matches(a.text, '{rules.QUESTION_LIKE}')""")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return turns.labeled_pairs(as_turns(spark, sf)).select("question", "answer", "ministry", "url")


# --- concepts and quotes ---------------------------------------------------------------------------


@query(f"""WITH {TALK_SQL}, p AS (SELECT *, CASE WHEN phrase = 5 THEN 0 ELSE strpos(speech, '水素') END AS a, strpos(speech, '税制') AS b, strpos(speech, '水素税制') AS w FROM talk)
SELECT speech_id, CASE WHEN w > 0 THEN 1.0::DOUBLE ELSE ((a > 0)::INT + (b > 0)::INT) / 2.0::DOUBLE END AS coverage,
CASE WHEN w > 0 THEN w - 1 WHEN a > 0 AND b > 0 THEN least(a, b) - 1 WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 END::INT AS start,
CASE WHEN w > 0 THEN w + 3 WHEN a > 0 AND b > 0 THEN greatest(a, b) + 1 WHEN a > 0 THEN a + 1 WHEN b > 0 THEN b + 1 END::INT AS "end" FROM p""")
def concept_places(spark: SparkSession, sf: str) -> DataFrame:
    """A body's name holds a term of the concept, which is no hit; the places of the parts make the span."""
    return talk(spark, sf).select("speech_id", ht.concept_hit(F.col("speech"), HYDROGEN).alias("h")).select("speech_id", "h.coverage", "h.start", "h.end")


@query(f"""WITH {TALK_SQL}, p AS (SELECT speech_id, speech, substr(speech, 1, 12) AS q FROM talk)
SELECT speech_id, q || array_to_string(regexp_extract_all(substr(speech, strpos(speech, q) + length(q)), '{rules.PART_SENTENCE}')[1:2], '') AS longer FROM p""")
def quotes_in_context(spark: SparkSession, sf: str) -> DataFrame:
    return talk(spark, sf).select("speech_id", tx.quote_with_context(F.col("speech"), F.substring("speech", 1, 12)).alias("longer"))


@query(f"""WITH {TALK_SQL} SELECT speech_id, CASE phrase % 4 WHEN 0 THEN substr(speech, 2, 9) WHEN 1 THEN substr(speech, 3, 5) WHEN 2 THEN NULL ELSE CASE WHEN contains(speech, '「' || substr(speech, 1, 6) || '」') THEN '「' || substr(speech, 1, 6) || '」' ELSE substr(speech, 1, 6) END END AS quote FROM talk""")
def grounded_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes as they stand, without the marks put around them, and made up ones."""
    kind, text = F.col("phrase") % 4, F.col("speech")
    quote = F.when(kind == 0, F.substring(text, 2, 9)).when(kind == 1, F.substring(text, 3, 5)).when(kind == 2, F.lit("どこにもない")).otherwise(F.concat(F.lit("「"), F.substring(text, 1, 6), F.lit("」")))
    return talk(spark, sf).select("speech_id", tx.grounded(text, quote).alias("quote"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(text, '{rules.TOKEN}'), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in rules.TOOL_STOPWORDS)}], w))) AS t FROM documents)
SELECT doc_id, coalesce(len(t), 0)::INT AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM t""")
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", tx.token_set(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.sort_array("t"), " ").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, regexp_replace(replace(text, ' the ', ' AND '), '\\s+AND\\s+', ' ', 'g') AS rewritten FROM conversations")
def and_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.and_rewrite(F.replace("text", F.lit(" the "), F.lit(" AND "))).alias("rewritten"))


# --- scans -----------------------------------------------------------------------------------------


@query(f"WITH {TALK_SQL} SELECT count(*)::BIGINT AS hits, count(*) > 100 AS truncated FROM talk WHERE contains(speech, '水素') AND contains(speech, '整備') AND date >= '2021-01-01'")
def scan_hits(spark: SparkSession, sf: str) -> DataFrame:
    """How many turns a scan found, and whether there were more than it gives."""
    found = readers.scan_turns(as_turns(spark, sf), "水素 整備", "2021-01-01", excluded=["3"])
    return spark.createDataFrame([(found.hits, found.truncated)], "hits long, truncated boolean")


@query(f"WITH {TALK_SQL} SELECT issue_id, speech_id FROM talk WHERE issue_id IN ('1', '4', '9')")
def meetings_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return readers.meetings_by_id(as_turns(spark, sf), ["1", "4", "9"]).select("issue_id", "speech_id")


@query("""WITH h AS (SELECT conv_id, turn, role = 'user' AS asks, (contains(text, 'the')::INT + contains(text, 'tion')::INT) / 2.0::DOUBLE AS s FROM conversations WHERE contains(text, 'the') OR contains(text, 'tion'))
SELECT conv_id, max(s) AS score, bool_or(asks) AS has_question FROM h GROUP BY conv_id ORDER BY has_question DESC, score DESC, conv_id LIMIT 20""")
def meeting_rank_early(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "conversations").withColumn("s", ht.term_share(F.col("text"), ["the", "tion"])).where("s > 0")
    return ranking.meeting_ranks(own, "conv_id", "turn", F.col("role") == "user", F.col("s"), 20, counts=False).select("conv_id", "score", "has_question")


@query(f"""WITH {TALK_SQL} SELECT speech_id, meeting = '{rules.PLENARY}' AND contains(coalesce(speaker_position, ''), '{rules.PRIME_MINISTER}') AND length(speech) > 60 AS held FROM talk""")
def held_for_plenary_context(spark: SparkSession, sf: str) -> DataFrame:
    own = talk(spark, sf).withColumn("position", F.coalesce("speaker_position", F.lit(""))).withColumn("question_truncated", F.lit(False)).withColumn("answer_truncated", F.length("speech") > 60)
    return own.select("speech_id", turns.held_for_context(own).alias("held"))


@query()
def strict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return turns.strict_pairs(as_turns(spark, sf), PLAN, segment=icu_segmenter(spark))


@query()
def recall_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return turns.recall_pairs(as_turns(spark, sf), PLAN)


@query()
def retrieve_fast(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.retrieve_fast(readers.normalized_turns(as_turns(spark, sf)), PLAN, 2024).candidates


@query()
def retrieve_yearly(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.retrieve_yearly(readers.normalized_turns(as_turns(spark, sf)), PLAN, 2024, segment=icu_segmenter(spark)).candidates


# --- validated searches ----------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "corpus")
    as_turns(spark, sf).write.parquet(path)
    return path


@query(f"WITH {TALK_SQL} SELECT issue_id, speech_id, length(speech)::BIGINT AS n FROM talk WHERE contains(speech, '水素') AND contains(speech, 'tion') AND meeting = '経済産業委員会' AND date >= '2021-06-01' ORDER BY date DESC, issue_id, ord LIMIT 30")
def validated_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A search of the data source whose options are checked."""
    own = proxy.validated_turns(spark, _corpus(spark, sf), "水素 tion", "経済産業委員会", "2021-06-01", 30)
    return own.select("issue_id", "speech_id", F.length("speech").cast("long").alias("n"))


@query(f"""WITH {TALK_SQL}, h AS (SELECT issue_id FROM talk WHERE contains(speech, '税制') AND date >= '2020-01-01' GROUP BY issue_id ORDER BY max(date) DESC, issue_id LIMIT 10)
SELECT issue_id, speech_id FROM talk WHERE issue_id IN (SELECT issue_id FROM h)""")
def validated_meetings(spark: SparkSession, sf: str) -> DataFrame:
    return proxy.validated_meetings(spark, _corpus(spark, sf), "税制", most=10).select("issue_id", "speech_id")


#: Laws made of documents: every third has the word, every fifth is of a type that isn't asked for; a hundred make a page.
LAW = (
    "doc_id", "CASE doc_id % 4 WHEN 0 THEN '環境省設置法' WHEN 1 THEN '内閣府本府組織令' WHEN 2 THEN '廃棄物法' ELSE '財務省組織規則' END AS title",
    "CASE doc_id % 5 WHEN 0 THEN 'Rule' WHEN 1 THEN 'CabinetOrder' WHEN 2 THEN 'MinisterialOrdinance' ELSE 'Act' END AS kind", "CASE WHEN doc_id % 3 = 0 THEN '<b>廃棄物</b>の処理。' ELSE '水素の整備。' END AS first", "coalesce(text, '') || 'に関すること' AS second",
)


@query(f"""WITH law AS (SELECT {', '.join(LAW)} FROM documents), h AS (SELECT *, count(*) OVER () > 1000 AS truncated FROM law WHERE kind <> 'Rule' AND doc_id % 3 = 0 ORDER BY doc_id LIMIT 1000)
SELECT doc_id::VARCHAR AS law_id, title, CASE title WHEN '環境省設置法' THEN '環境省' WHEN '内閣府本府組織令' THEN '{rules.CABINET}' ELSE '財務省' END AS ministry, truncated, md5(left(trim(regexp_replace(second, '<[^>]*>', '', 'g')), 260)) AS snippet FROM h WHERE title <> '廃棄物法'""")
def law_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A law search over pages that say where the next begins; a page's laws are put in the order of their numbers."""
    laws = table(spark, sf, "documents").selectExpr(*LAW)
    item = F.struct(F.struct(F.col("doc_id").cast("string").alias("law_id"), F.col("kind").alias("law_type")).alias("law_info"), F.struct(F.col("title").alias("law_title")).alias("revision_info"), F.array(F.struct(F.col("first").alias("text")), F.struct(F.col("second").alias("text"))).alias("sentences"))
    pages = laws.groupBy(F.expr("doc_id div 100").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))), lambda s: s["i"]).alias("items"), F.count("*").alias("n"))
    pages = staged(pages)
    last = pages.agg(F.max("page")).first()[0]
    offset = F.when(F.col("page") < F.lit(last), (F.col("page") + 1) * 100)
    found = lookups.law_jurisdiction(pages.select("items", offset.alias("next_offset")), "廃棄物")
    return found.select(F.substring_index("url", "/", -1).alias("law_id"), "title", "ministry", "truncated", F.md5(F.col("snippet").cast("binary")).alias("snippet"))


# --- stored caches -----------------------------------------------------------------------------------

NOW = datetime(2024, 6, 1, 12, tzinfo=UTC)


@query(f"""WITH {TALK_SQL}, h AS (SELECT issue_id, speech_id, date FROM talk WHERE contains(speech, '水素') AND contains(speech, 'の') ORDER BY date DESC, issue_id, ord LIMIT 100)
SELECT issue_id, speech_id, n, 1 AS hits, 1 AS misses FROM h, (SELECT count(*)::BIGINT AS n FROM talk WHERE contains(speech, '水素') AND contains(speech, 'の'))""")
def cached_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan that is asked for twice: the second comes from what was kept of the first."""
    cache = SourceCache(spark, new_path(spark, "source-cache"), sf, lambda: NOW, most_entry=1 << 40, most_bytes=1 << 40)
    turns = as_turns(spark, sf)
    readers.scan_turns(turns, "水素 の", cache=cache)
    found = readers.scan_turns(turns.limit(0), "水素 の", cache=cache)
    return found.rows.select("issue_id", "speech_id", F.lit(found.hits).cast("long").alias("n"), F.lit(cache.hits).alias("hits"), F.lit(cache.misses).alias("misses"))


@query("""WITH r AS (SELECT lang, source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL)
SELECT 0 AS ask, false AS cached, * FROM r UNION ALL SELECT 1, true, * FROM r UNION ALL SELECT 2, false, * FROM r""")
def cached_result(spark: SparkSession, sf: str) -> DataFrame:
    """A result that is asked for now, within a day and after it: made, kept, made again."""
    cache, own = ResultCache(spark, new_path(spark, "result-cache")), table(spark, sf, "documents")
    per = own.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    rows = []
    for i, hours in enumerate((0, 23, 48)):
        found, cached = cache.through(key_of("sums", 1, sf), NOW + timedelta(hours=hours), lambda: (per, True))
        rows.append(found.select(F.lit(i).alias("ask"), F.lit(cached).alias("cached"), "lang", "source", "n", "chars"))
    return reduce(DataFrame.unionByName, rows)


# --- reviewers' answers as text ---------------------------------------------------------------------

#: A review of a label as JSON, in Spark and in the SQL: some lack a field, have one more, one that isn't text, or a value outside its set.
REVIEW = (
    "CASE WHEN doc_id % 37 = 5 THEN '[1]' ELSE '{\"id\":\"' || CASE WHEN doc_id % 23 = 7 THEN 'x' ELSE '' END || cast(doc_id as string) || '\"'"
    " || CASE WHEN doc_id % 13 = 0 THEN '' ELSE ',\"beneficiary\":\"' || CASE WHEN doc_id % 25 = 9 THEN ' ' ELSE 'who' END || '\"' END"
    " || ',\"activity\":' || CASE WHEN doc_id % 19 = 3 THEN '7' ELSE '\"what\"' END"
    " || ',\"relation\":\"' || CASE WHEN toxic = 1 THEN 'different' WHEN doc_id % 29 = 1 THEN ' same' WHEN doc_id % 29 = 2 THEN 'Same' WHEN doc_id % 29 = 4 THEN 'accept' WHEN doc_id % 29 = 6 THEN '' WHEN doc_id % 29 = 8 THEN 'x' WHEN quality = 0 THEN 'unclear' ELSE 'same' END"
    " || '\",\"comparison\":\"' || CASE WHEN doc_id % 17 = 0 THEN ' ' WHEN doc_id % 17 = 1 THEN repeat('y', 301) ELSE 'why' END"
    " || '\",\"decision\":\"' || CASE WHEN doc_id % 31 = 9 THEN 'yes' WHEN quality = 1 THEN 'accept' ELSE 'uncertain' END || '\"'"
    " || CASE WHEN doc_id % 27 = 2 THEN ',\"note\":\"n\"' ELSE '' END"
    " || CASE WHEN doc_id % 7 = 3 THEN '' WHEN doc_id % 7 = 4 THEN ',\"q\":\"\"' ELSE ',\"q\":\"q1\"' END"
    " || CASE WHEN doc_id % 11 = 2 THEN '' ELSE ',\"a\":\"v1a2\"' END || '}' END"
)
_REVIEW_TEXTS = f"""one AS (SELECT doc_id, doc_id // 8 AS batch, {REVIEW} AS o FROM labels), said2 AS (SELECT *, 1 AS nth FROM one UNION ALL SELECT *, 2 FROM one WHERE doc_id % 5 = 1),
rws AS (SELECT *, json_type(o) = 'OBJECT' AS obj, row_number() OVER (PARTITION BY batch ORDER BY doc_id, nth) AS place FROM said2 WHERE batch % 41 <> 3),
f AS (SELECT batch, place, o, obj, CASE WHEN obj THEN json_keys(o) ELSE [] END AS k, o->>'id' AS id, o->>'beneficiary' AS beneficiary, o->>'relation' AS relation, o->>'comparison' AS comparison, o->>'decision' AS decision, o->>'q' AS q, o->>'a' AS a FROM rws),
g AS (SELECT *, list_has_all(k, ['id', 'beneficiary', 'activity', 'relation', 'comparison', 'decision']) AND len(list_filter(k, lambda x: x NOT IN ('id', 'beneficiary', 'activity', 'relation', 'comparison', 'decision', 'q', 'a'))) = 0 AND json_type(o, '$.activity') = 'VARCHAR' AND NOT list_has_all(k, ['q', 'a']) AND decision IN ('reject', 'uncertain') AS omitted,
  CASE WHEN relation = 'unclear' OR (decision = 'accept' AND relation <> 'same') THEN 'uncertain' WHEN relation <> 'same' THEN 'reject' ELSE decision END AS said FROM f),
p AS (SELECT doc_id::VARCHAR AS did, doc_id // 8 AS batch, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
h AS (SELECT g.*, CASE WHEN NOT obj THEN 'invalid_row' WHEN NOT list_has_all(k, ['id', 'beneficiary', 'activity', 'relation', 'comparison', 'decision']) THEN 'missing_semantic_fields' WHEN list_contains(k, 'note') THEN 'unknown_fields' WHEN json_type(o, '$.activity') <> 'VARCHAR' THEN 'non_string_fields' WHEN NOT list_has_all(k, ['q', 'a']) AND decision = 'accept' THEN 'missing_accepted_refs' WHEN NOT list_has_all(k, ['q', 'a']) AND NOT omitted THEN 'invalid_row' END AS shape,
  did IS NOT NULL AS known, p.p[1] AS qtext, p.p[2] AS atext FROM g LEFT JOIN p ON g.id = p.did AND g.batch = p.batch),
i AS (SELECT *, CASE WHEN shape IS NOT NULL THEN shape WHEN NOT known THEN 'unknown_id' WHEN decision NOT IN ('accept', 'reject', 'uncertain') THEN 'invalid_decision' WHEN trim(comparison) = '' THEN 'blank_comparison' WHEN length(comparison) > 300 THEN 'long_comparison' WHEN relation NOT IN ('same', 'broader', 'provider_only', 'different', 'unclear') THEN 'invalid_relation' WHEN said = 'accept' AND (trim(beneficiary) = '' OR coalesce(q, '') = '' OR coalesce(a, '') = '') THEN 'blank_accepted_roles_or_refs' END AS r FROM h),
j AS (SELECT *, min(place) FILTER (r IS NULL) OVER (PARTITION BY batch, id) AS head FROM i),
chk AS (SELECT *, CASE WHEN shape IS NULL AND known AND place > head THEN 'duplicate_id' ELSE coalesce(r, CASE WHEN said = 'accept' AND (qtext IS NULL OR atext IS NULL) THEN 'unknown_accepted_refs' END) END AS reason FROM j)"""


def _responses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, responses, parts): a response for eight labels, some of it said twice, in a string, or no JSON at all."""
    labels = table(spark, sf, "labels")
    one = labels.select("doc_id", F.expr("doc_id div 8").alias("batch"), F.expr(REVIEW).alias("o"))
    both = one.withColumn("nth", F.lit(1)).union(one.where("doc_id % 5 = 1").withColumn("nth", F.lit(2)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "nth", "o"))), lambda s: s["o"]), ",")
    texts = both.groupBy("batch").agg(F.concat(F.lit('{"reviews":['), listed, F.lit("]}")).alias("t"))
    texts = texts.select("batch", F.expr("CASE WHEN batch % 41 = 3 THEN 'no json' WHEN batch % 43 = 2 THEN '\"' || replace(t, '\"', '\\\\\"') || '\"' ELSE t END").alias("response"))
    candidates = labels.select(F.expr("doc_id div 8").alias("batch"), F.col("doc_id").cast("string").alias("id")).distinct()
    docs = table(spark, sf, "documents").select(F.expr("doc_id div 8").alias("batch"), F.col("doc_id").cast("string").alias("id"), "doc_id", "text")
    parts = verdicts.answer_parts(docs.join(candidates, ["batch", "id"], "left_semi"), ["batch", "id"], "doc_id", "doc_id", question="text", answer="text", sentence=LATIN_PART, skip=(), header="^$")
    return candidates, texts, parts


def _review_texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, responses as read, rows as checked)."""
    candidates, texts, parts = _responses(spark, sf)
    read = verdicts.read_reviews(texts)
    return candidates, read, verdicts.checked_rows(verdicts.review_rows(read), candidates, parts)


@query(f"""WITH {_REVIEW_TEXTS} SELECT batch, 'returned' AS counter, count(*)::BIGINT AS n FROM rws GROUP BY batch UNION ALL SELECT batch, 'invalid_review', 1 FROM one WHERE batch % 41 = 3 GROUP BY batch UNION ALL SELECT batch, 'omitted_unused_refs', count(*) FROM chk WHERE omitted GROUP BY batch UNION ALL SELECT batch, reason, count(*) FROM chk WHERE reason IS NOT NULL GROUP BY batch, reason
UNION ALL SELECT batch, 'relation_' || CASE WHEN relation = '' THEN 'blank' WHEN relation = ' same' THEN 'surrounding_whitespace' WHEN relation = 'Same' THEN 'letter_case' WHEN relation = 'accept' THEN 'decision_code' ELSE 'other' END AS kind, count(*) FROM chk WHERE reason = 'invalid_relation' GROUP BY ALL""")
def review_text_counters(spark: SparkSession, sf: str) -> DataFrame:
    _, read, checked = _review_texts(spark, sf)
    return verdicts.batch_counters(read, checked)


@query(f"""WITH {_REVIEW_TEXTS}, good AS (SELECT batch, id, said, qtext, atext FROM chk WHERE reason IS NULL), late AS (SELECT DISTINCT batch, id FROM chk WHERE reason = 'duplicate_id'), c AS (SELECT DISTINCT doc_id // 8 AS batch, doc_id::VARCHAR AS id FROM labels),
s AS (SELECT c.*, CASE WHEN late.id IS NULL THEN good.said END AS said, qtext, atext FROM c LEFT JOIN good USING (batch, id) LEFT JOIN late USING (batch, id))
SELECT id, coalesce(said, 'uncertain') AS decision, said IS NOT NULL AS completed, CASE WHEN said = 'accept' THEN qtext END AS question_evidence, CASE WHEN said = 'accept' THEN atext END AS answer_evidence, CASE WHEN said = 'accept' THEN id::BIGINT END AS owner FROM s""")
def review_text_settled(spark: SparkSession, sf: str) -> DataFrame:
    candidates, _, checked = _review_texts(spark, sf)
    return verdicts.settled(candidates, checked).drop("batch", "comparison")


@query(f"""WITH {_REVIEW_TEXTS}, n AS (SELECT doc_id // 8 AS batch, count(DISTINCT doc_id) AS expected FROM labels GROUP BY ALL),
whole AS (SELECT batch FROM chk JOIN n USING (batch) GROUP BY batch, expected HAVING count(*) = expected AND count(*) FILTER (reason IS NOT NULL OR coalesce(said, 'uncertain') = 'uncertain') = 0)
SELECT k.nth, n.batch::BIGINT AS batch, k.nth = 1 AND n.batch IN (SELECT batch FROM whole) AS cache_hit, k.nth = 0 OR n.batch NOT IN (SELECT batch FROM whole) AS asked FROM n, (VALUES (0), (1)) k(nth)""")
def cached_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The same batches reviewed twice: the second round asks for those alone whose answers weren't complete and settled."""
    candidates, texts, parts = _responses(spark, sf)
    texts = staged(texts)
    inputs = staged(canonical_input(candidates, "batch", ["id"], "id"))
    cache, identity = ReviewCache(spark, new_path(spark, "review-cache")), ReviewIdentity("reviewer", "Compare.", "{}")
    asked: list[DataFrame] = []

    def ask(unseen: DataFrame) -> DataFrame:
        asked.append(staged(unseen.select("batch")))
        return unseen.select("batch").join(texts, "batch")

    def reusable(answers: DataFrame) -> DataFrame:
        read = verdicts.read_reviews(answers)
        return reusable_batches(candidates.join(answers.select("batch"), "batch"), read, verdicts.checked_rows(verdicts.review_rows(read), candidates, parts))

    rows = []
    for nth in range(2):
        found = cache.through(inputs, identity, ask, reusable, NOW + timedelta(days=nth))
        new = asked[nth].withColumn("asked", F.lit(True)) if len(asked) > nth else found.limit(0).select("batch", F.lit(True).alias("asked"))
        rows.append(found.join(new, "batch", "left").select(F.lit(nth).alias("nth"), "batch", "cache_hit", F.coalesce("asked", F.lit(False)).alias("asked")))
    return rows[0].unionByName(rows[1])


# --- reviews, addresses and caches -----------------------------------------------------------------


@query("SELECT conv_id, turn, NOT contains(text, 'the') OR NOT contains(substr(text, 1, 40), 'the') OR NOT contains(coalesce(role, ''), 'the') AS ambiguous FROM conversations")
def scope_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    own = review.needs_scope_check("the", F.col("text"), F.substring("text", 1, 40), F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", own.alias("ambiguous"))


@query("SELECT o_custkey AS case_id, o_orderstatus AS ministry, min(o_orderkey) AS ord, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL")
def accepted_unique(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("ministry"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("price"))
    return review.accepted_unique(own).select("case_id", "ministry", "ord", "price")


@query("SELECT substr(text, 1, 20) AS head, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def first_by_head(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(20)).alias("head"), "lang")
    return ranking.keep_first(own, ["head", "lang"], "doc_id").select("head", "lang", "doc_id")


@query("SELECT page_id, coalesce(regexp_extract(url, '^https://([^/?#:]+)', 1) = (SELECT regexp_extract(min(url), '^https?://([^/?#:]+)', 1) FROM pages), false) AS allowed FROM pages")
def allowed_urls(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "pages")
    host = own.agg(F.min("url").alias("u")).select(F.regexp_extract("u", "^https?://([^/?#:]+)", 1)).first()[0]
    return own.select("page_id", lookups.allowed_url(F.col("url"), host or "").alias("allowed"))


@query("""SELECT event_id, epoch_us(ts) + CASE WHEN value >= 50 THEN 86400 ELSE 30 END * 1000000::BIGINT AS expires_us, event_id % 5 = event_id % 3 AND event_id % 4 = 0 AS cacheable FROM events""")
def cache_rules(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events")
    expires = F.unix_micros(state.expires(F.col("ts"), F.coalesce(F.col("value") >= 50, F.lit(False))))
    return own.select("event_id", expires.alias("expires_us"), state.cacheable(F.col("event_id") % 5, F.col("event_id") % 3, F.col("event_id") % 4).alias("cacheable"))


@query("""WITH n AS (SELECT event_id, 100000 + event_id % 1000 * 700 AS size FROM events WHERE 100000 + event_id % 1000 * 700 <= 2000000 ORDER BY event_id DESC LIMIT 32)
SELECT event_id, size FROM (SELECT *, sum(size) OVER (ORDER BY event_id DESC) AS s FROM n) WHERE s <= 12000000""")
def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select("event_id", (F.lit(100000) + F.col("event_id") % 1000 * 700).alias("size"))
    return state.evict(own, ["event_id"], size="size").select("event_id", "size")


@query("""WITH b AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator on a table."""
    own = state.stream_sessions(table(spark, sf, "events"), "ts", "user_id")
    return own.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day_us, count(*)::BIGINT AS used, count(*) >= 100 AS exhausted FROM events GROUP BY date_trunc('day', ts)")
def daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator on a table."""
    own = state.stream_daily_usage(table(spark, sf, "events"), "ts", F.lit(1), 100)
    return own.select(F.unix_micros("day").alias("day_us"), "used", "exhausted")


# --- rules with a memory -----------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id::VARCHAR AS key, event_id::BIGINT AS id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)
SELECT key, id, gap_us::BIGINT AS gap_us, coalesce(gap_us >= 3000000, true) AS spaced FROM g""")
def gaps_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming rule on a table."""
    return keyed.gaps(table(spark, sf, "events"), F.col("user_id"), "ts", "event_id")


_MARK = "CASE event_id % 50 WHEN 7 THEN 'verified_quota' WHEN 8 THEN 'guess' END"


@query(f"""WITH e AS (SELECT *, {_MARK} AS mark, date_trunc('day', ts) AS day FROM events),
w AS (SELECT *, sum(CASE WHEN mark IS NULL THEN event_id % 7 ELSE 0 END) OVER r AS used, bool_or(coalesce(mark = 'verified_quota', false)) OVER r AS paused FROM e WINDOW r AS (PARTITION BY user_id % 20, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT (user_id % 20)::VARCHAR AS key, event_id::BIGINT AS id, used::DOUBLE AS used, used <= 30 AND NOT paused AS allowed, CASE WHEN paused THEN epoch_us(day::TIMESTAMP + INTERVAL 1 DAY) END::BIGINT AS paused_until_us FROM w WHERE mark IS NULL""")
def quota_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming rule on a table: marks of the right kind pause a key until midnight."""
    return keyed.quotas(table(spark, sf, "events"), F.col("user_id") % 20, "ts", "event_id", F.col("event_id") % 7, F.expr(_MARK), 30)


@query()
def requests_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming rule on a table; tests compare it with a simulation."""
    kind = F.when(F.col("event_id") % 3 == 0, "done").when(F.col("event_id") % 11 == 0, "failed").otherwise("ask")
    return keyed.flights(table(spark, sf, "events"), F.col("user_id") % 20, "ts", "event_id", F.col("event_type"), kind, seconds=6 * 3600)


# --- entries -----------------------------------------------------------------------------------------


@query()
def tool_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """The local tool's search; tests compare it with a plain retelling."""
    return entries.search_assignments(as_turns(spark, sf), "水素ステーションの税制について", ["水素", "税制"]).candidates


@query()
def route_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The starter route's shares; tests compare them with a plain retelling."""
    return entries.analyze(as_turns(spark, sf), "水素ステーションの整備について政府の見解を伺います。", icu_segmenter(spark)).shares

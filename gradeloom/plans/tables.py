"""Tables derived from the driver tables, and the same derivations as SQL.

No table is cut: pools are the first ``DEPTH`` candidates of a first stage, which is what a
first stage returns, and what has no first stage reads all candidates.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..functions.lineage import cut_lineage
from ..operators import retrieval, scale, slates, text as tx
from ..sources.tables import read_table
from . import sql as q
from .registry import cte

DEPTH = 100
RUBRIC = ["not relevant", "on the topic", "partly answers", "answers"]


class Tables:
    """Lazily derived DataFrames for one session and one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.root}/{name}.parquet")

    # ------------------------------------------------------------ documents
    @cached_property
    def corpus(self) -> DataFrame:
        first = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
        return self.raw("documents").select(
            "doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(first).alias("title"), "text"
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("qid"), "text")

    @cached_property
    def qrels_raw(self) -> DataFrame:
        """Grades from the overlap of distinct tokens; only judged pairs are listed.

        A judged pair shares at least half of the query's n tokens. The document is looked up by
        all but the query's most frequent quarter, and must hold n / 2 less that quarter of them;
        the whole overlap is counted for the pairs so found only.
        """
        asked = self.queries.select("qid", F.array_distinct(tx.raw_tokens("text")).alias("t"))
        qt = asked.select("qid", "t", F.size("t").alias("n"), F.explode("t").alias("term"))
        held = cut_lineage(
            self.corpus.select("doc_id", F.explode(F.array_distinct(tx.raw_tokens("text"))).alias("term"))
            .join(qt.select("term").distinct(), "term", "left_semi")
        )
        df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rarest = Window.partitionBy("qid").orderBy(F.coalesce("df", F.lit(0)), "term")  # a query's own tokens
        frequent = F.floor(F.col("n") / 4)
        placed = cut_lineage(qt.join(df, "term", "left").select(
            "qid", "term", "n", (F.row_number().over(rarest) > F.col("n") - frequent).alias("frequent"),
            F.greatest(F.ceil(F.col("n") / 2) - frequent, F.lit(1)).alias("needed")))
        rare, rest = placed.filter("NOT frequent"), placed.filter("frequent")
        found = (
            held.join(rare, "term").groupBy("qid", "doc_id", "n", "needed").agg(F.count(F.lit(1)).alias("c"))
            .filter(F.col("c") >= F.col("needed"))
        )
        more = found.select("qid", "doc_id").join(rest.select("qid", "term"), "qid").join(held, ["doc_id", "term"])
        more = more.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("m"))
        c = found.join(more, ["qid", "doc_id"], "left").select("qid", "doc_id", "n", (F.col("c") + F.coalesce("m", F.lit(0))).alias("c"))
        flip = (F.col("qid") + F.col("doc_id")) % 7 == 0
        grade = (
            F.when(100 * F.col("c") >= 99 * F.col("n"), 2)
            .when(10 * F.col("c") >= 6 * F.col("n"), 1)
            .otherwise(F.when(flip, -1).otherwise(0))
        )
        # the judged pairs are few, and most users read them more than once
        return cut_lineage(c.filter(10 * F.col("c") >= 5 * F.col("n")).select("qid", "doc_id", grade.alias("grade")))

    @cached_property
    def qrels(self) -> DataFrame:
        return self.qrels_raw.select("qid", "doc_id", F.greatest("grade", F.lit(0)).alias("grade"))

    @cached_property
    def stray_qrels(self) -> DataFrame:
        """Judgements of which some name a document that the collection does not have."""
        return self.qrels_raw.withColumn("doc_id", F.when(F.col("doc_id") % 11 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))

    @cached_property
    def ranked(self) -> DataFrame:
        return retrieval.bm25_search(self.corpus, self.queries, k=DEPTH)

    @cached_property
    def positions(self) -> DataFrame:
        """Where the queries' words stand in the documents: one pass for the search and for what cuts evidence."""
        return cut_lineage(tx.positional_hits(self.corpus, retrieval.query_terms(self.queries)))

    @cached_property
    def _search(self) -> tuple[DataFrame, DataFrame]:
        return retrieval.search_hits(self.positions, self.queries, k=DEPTH)

    @cached_property
    def query_idf(self) -> DataFrame:
        """(term, idf) of the queries' terms, from the search's own pass over the texts."""
        return self._search[1]

    @cached_property
    def ranked_once(self) -> DataFrame:
        """The ranking from the positions, written out for queries that read it several times."""
        return cut_lineage(self._search[0])

    # ----------------------------------------------------------- event pools
    @cached_property
    def candidates(self) -> DataFrame:
        """Every event as a candidate of its user's query, with its first-stage rank."""
        grade = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(
            F.col("event_type") == "view", 1
        ).otherwise(0)
        e = self.raw("events").select(
            F.col("user_id").alias("qid"), F.col("event_id").alias("doc_id"), "event_type", "props", "value",
            grade.alias("grade"),
        )
        latent = F.col("grade") * 0.8 - 1.2 + 0.15 * F.log1p("value") + 2.4 * (ex.uniform(1, "qid", "doc_id") - 0.5)
        e = e.withColumn("l", F.round(latent, 6))
        e = e.withColumn("first_score", F.round(F.col("l") + 2.0 * ex.uniform(2, "qid", "doc_id") - 1.0, 6))
        words = F.concat_ws(" ", "event_type", F.lit("by user"), F.col("qid").cast("string"), "props")
        e = e.withColumn("text", F.repeat(words, (F.col("doc_id") % 4 + 1).cast("int")))
        w = Window.partitionBy("qid").orderBy(F.col("first_score").desc(), "doc_id")
        return (
            e.withColumn("first_rank", F.row_number().over(w).cast("bigint"))
            .select("qid", "doc_id", "grade", "l", "first_score", "first_rank", "text")
        )

    @cached_property
    def pool(self) -> DataFrame:
        """What a first stage hands on: the first ``DEPTH`` candidates."""
        return self.candidates.filter(F.col("first_rank") <= DEPTH)

    @cached_property
    def pool_once(self) -> DataFrame:
        """The pool without its texts, written out for queries that read it several times."""
        return cut_lineage(self.pool.select("qid", "doc_id", "grade", "l", "first_rank"))

    @cached_property
    def pool_qrels(self) -> DataFrame:
        return self.candidates.select("qid", "doc_id", "grade")

    def dealt(self, stratify: bool = True, n_anchors: int = 4) -> DataFrame:
        return slates.deal(self.pool, 10, n_anchors, stratify)

    def items(self, stratify: bool = True, n_anchors: int = 4) -> DataFrame:
        """Candidates and anchors of every slate with their logits."""
        dealt = self.dealt(stratify, n_anchors)
        cand = dealt.select(
            "qid", "slate", F.col("doc_id").alias("item_id"), F.lit(False).alias("is_anchor"),
            F.lit(None).cast("int").alias("anchor_no"), "l", "grade", F.lit(None).cast("double").alias("utility"), "text",
        )
        slots = slates.anchor_slots(dealt, n_anchors, 4).withColumn("utility", F.col("anchor_no") * 2.0 - 3.0)
        noise = ex.uniform(3, "qid", "slate", "anchor_no")
        anch = slots.select(
            "qid", "slate", (-F.col("anchor_no") - 1).cast("bigint").alias("item_id"), F.lit(True).alias("is_anchor"),
            "anchor_no", F.round(F.col("utility") / 2.0 + noise - 0.5, 6).alias("l"),
            F.lit(None).cast("int").alias("grade"), "utility",
            F.concat(F.lit("anchor "), F.col("anchor_no").cast("string")).alias("text"),
        )
        return cand.unionByName(anch)

    def slate_logits(self, stratify: bool = True, n_anchors: int = 4) -> DataFrame:
        return ex.log_softmax_rows(self.items(stratify, n_anchors), "l", ["qid", "slate"], "lp")

    @cached_property
    def scored(self) -> DataFrame:
        """The calibrated pool, rounded so that ranks do not hang on the last bit."""
        return scale.calibrate(self.slate_logits()).select(
            "qid", "slate", "item_id", "grade", "lp",
            ex.r6("utility").alias("utility"), ex.r6("sigma").alias("sigma"),
        )

    @cached_property
    def late_scored(self) -> DataFrame:
        """The calibrated pool of a model that lost the scores of some slates."""
        return self.scored.withColumn("utility", F.when(F.col("slate") % 7 != 3, F.col("utility")))

    @cached_property
    def verdicts(self) -> DataFrame:
        """Level probabilities of a judge for every candidate."""
        raw = F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda i: F.exp(-F.pow((i - F.col("grade")).cast("double"), F.lit(2.0)) / 2.0)
            * (0.5 + ex.uniform(4, "qid", "doc_id", i)),
        )
        p = self.candidates.select("qid", F.col("doc_id").alias("item_id"), "grade", "first_rank", "l", ex.normalise(raw).alias("_p"))
        p = p.withColumn("level_probs", F.transform("_p", lambda x: F.round(x, 6)))
        cost = F.when(F.col("item_id") % 4 != 0, F.lit(250 * 0.042 / 1e6))
        return p.select(
            "qid", "item_id", "grade", "first_rank", "l", "level_probs",
            ex.r6(ex.expected_index("level_probs")).alias("expected_grade"),
            F.lit(250).cast("bigint").alias("tokens"), cost.alias("cost_usd"),
        )

    @cached_property
    def late_verdicts(self) -> DataFrame:
        """The verdicts of a judge that answers nine requests in ten; the others come back without a grade."""
        there = ex.uniform(93, "qid", "item_id") >= 0.1
        return self.verdicts.withColumns({c: F.when(there, F.col(c)) for c in ("expected_grade", "level_probs", "cost_usd")})

    @cached_property
    def system_scores(self) -> DataFrame:
        """Three systems on the same candidates, with a probability of relevance each."""
        s = ex.variants(
            ("system", "score"),
            ("first", F.col("first_score")),
            ("latent", F.col("l")),
            ("chance", F.round(4.0 * ex.uniform(5, "qid", "doc_id") - 2.0, 6)),
        )
        rows = self.candidates.select("qid", "doc_id", "grade", F.inline(s))
        return rows.withColumn("prob", F.round(ex.sigmoid(F.col("score") * 2.0), 9)).withColumn(
            "relevant", (F.col("grade") >= 2).cast("int")
        )

    # ---------------------------------------------------------- predictions
    @cached_property
    def predictions(self) -> DataFrame:
        e = self.raw("events").select(F.col("event_id").alias("ex_id"), F.col("event_type").alias("source"), "value")
        k = F.element_at(F.array(*[F.lit(x) for x in (2, 4, 8, 12)]), (F.col("ex_id") % 4 + 1).cast("int"))
        # settled: a later filter on what is made of the draws would make them again, element by element
        e = ex.settle(e.withColumn("k", k), {"truth": F.floor(ex.uniform(11, "ex_id") * F.col("k")).cast("int")})
        qtype = F.when(F.col("k") == 2, "noul").when((F.col("k") <= 10) & (F.col("ex_id") % 3 == 0), "score").otherwise("choice")
        sharp = 1.0 + 0.3 * F.log1p("value")
        logits = F.transform(
            F.sequence(F.lit(0), F.col("k") - 1),
            lambda i: F.round(
                sharp * (F.when(i == F.col("truth"), 1.2).otherwise(0.0) + 2.0 * ex.uniform(12, "ex_id", i)), 6
            ),
        )
        e = ex.settle(e.withColumn("qtype", qtype), {"logits": logits})
        e = ex.settle(e, {"probs": F.transform(ex.softmax("logits"), lambda x: F.round(x, 9))})
        label = F.when(F.col("ex_id") % 41 != 0, F.col("truth")).alias("label")
        return e.select("ex_id", "source", "qtype", "k", label, "logits", "probs")

    @cached_property
    def labelled(self) -> DataFrame:
        return self.predictions.filter(F.col("label").isNotNull())

    @cached_property
    def cumlogits(self) -> DataFrame:
        top = F.array_max("logits")
        return self.predictions.select(
            "ex_id", F.array(F.round(top - 2.0, 6), F.round(top - 3.0, 6), F.round(top - 4.0, 6)).alias("cum"),
            F.when(F.col("ex_id") % 5 != 0, (F.col("ex_id") % 4).cast("int")).alias("rel"),
        )

    # ------------------------------------------------------------- coverage
    @cached_property
    def intervals(self) -> DataFrame:
        return self._checked(self.raw("events"))

    @cached_property
    def intervals_stream(self) -> DataFrame:
        """The same rows as a stream over the table's files."""
        schema = self.spark.read.parquet(f"{self.root}/events.parquet").schema
        # as a pattern, the path may name a file as well as a folder
        return self._checked(self.spark.readStream.schema(schema).parquet(f"{self.root}/events.parque[t]"))

    @staticmethod
    def _checked(e: DataFrame) -> DataFrame:
        wide = F.when(F.col("event_type") == "error", 3.0).otherwise(1.0)
        return e.select(
            F.col("event_id").alias("id"), "ts", F.col("event_type").alias("grp"), F.col("value").alias("u_true"),
            F.round(F.col("value") + 60.0 * (ex.uniform(6, "event_id") - 0.5) * wide, 6).alias("u_hat"),
            F.lit(15.0).alias("sigma"),
        )

    # ------------------------------------------------------------ typed data
    @cached_property
    def typed_lines(self) -> DataFrame:
        c = self.raw("conversations")
        body = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""))
        bad = (F.col("conv_id") * 8 + F.col("turn")) % 17 == 0
        turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
        choice = F.concat(
            F.lit('{"state":"'), body, F.lit('","type":"choice","instructions":"who wrote this",'
            '"criteria":{"user":"asks","assistant":"answers","system":null},"label":"'),
            F.when(bad, "moderator").otherwise(F.col("role")), F.lit('"}'),
        )
        levels = F.when(bad, '["0","1","2","3","4","5","6","7","8","9","10"]').otherwise('["tiny","short","medium","long"]')
        n = F.length(body)
        level = F.when(n < 50, 0).when(n < 200, 1).when(n < 600, 2).otherwise(3).cast("string")
        score = F.concat(
            F.lit('{"state":{"text":"'), body, F.lit('","turn":'), turn,
            F.lit('},"type":"score","instructions":"how long is it","criteria":'), levels, F.lit(',"label":'), level,
            F.lit(',"weight":2.0,"meta":{"conv":"'), conv, F.lit('"}}'),
        )
        soft = F.when(F.col("turn") % 2 == 0, ',"soft_label":[0.2,0.6]').otherwise("")
        lab = F.when(bad, "").otherwise(
            F.concat(F.lit(',"label":'), F.when(F.col("role") == "assistant", "true").otherwise("false"), soft)
        )
        noul = F.concat(
            F.lit('{"state":"'), body, F.lit('","type":"noul","instructions":"did the assistant write this"'), lab, F.lit("}")
        )
        kind = F.col("conv_id") % 3
        return c.select(
            (F.col("conv_id") * 100 + F.col("turn")).cast("bigint").alias("ex_id"),
            F.when(kind == 0, choice).when(kind == 1, score).otherwise(noul).alias("line"),
        )

    # --------------------------------------------------------------- points
    @cached_property
    def points(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"),
            F.col("p_retailprice").cast("double").alias("cost_per_1k"),
            F.col("p_size").cast("double").alias("quality"),
            F.col("p_brand").alias("family"),
        )


# ------------------------------------------------------------- the SQL twins
cte("corpus", """SELECT doc_id, CASE WHEN doc_id%5=0 THEN '' ELSE substr(split_part(text, chr(10), 1), 1, 60) END AS title, text FROM documents""")
cte("bench_queries", "SELECT item_id AS qid, text FROM benchmark")
cte("doc_raw_tokens", "SELECT doc_id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) AS term FROM corpus")
cte("query_raw_tokens", "SELECT qid, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) AS term FROM bench_queries")
cte("doc_tokens", f"SELECT doc_id, term FROM doc_raw_tokens WHERE term NOT IN {q.STOP}")
cte("query_tf", f"SELECT qid, term, count(*) AS qtf FROM query_raw_tokens WHERE term NOT IN {q.STOP} GROUP BY 1,2")
cte("qrels_raw", """SELECT qid, doc_id, CASE WHEN 100*c>=99*n THEN 2 WHEN 10*c>=6*n THEN 1 WHEN (qid+doc_id)%7=0 THEN -1 ELSE 0 END AS grade
FROM (SELECT qid, doc_id, n, count(*) AS c FROM (SELECT DISTINCT doc_id, term FROM doc_raw_tokens) d
JOIN (SELECT DISTINCT qid, term FROM query_raw_tokens) x USING (term)
JOIN (SELECT qid, count(DISTINCT term) AS n FROM query_raw_tokens GROUP BY 1) s USING (qid) GROUP BY 1,2,3) WHERE 10*c>=5*n""")
cte("qrels", "SELECT qid, doc_id, greatest(grade,0) AS grade FROM qrels_raw")
cte("doc_len", "SELECT c.doc_id, coalesce(n,0) AS dl FROM corpus c LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc_tokens GROUP BY 1) USING (doc_id)")
cte("totals", "SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM doc_len")
cte("doc_tf", "SELECT doc_id, term, count(*) AS tf FROM doc_tokens GROUP BY 1,2")
cte("term_df", "SELECT term, count(*) AS df, ln(1+((SELECT n_docs FROM totals)-count(*)+0.5)/(count(*)+0.5)) AS idf FROM doc_tf GROUP BY 1")
cte("postings", "SELECT term, doc_id, tf, tf*1.9::DOUBLE/(tf+0.9::DOUBLE*(0.6::DOUBLE+0.4::DOUBLE*dl/(SELECT avgdl FROM totals))) AS w FROM doc_tf JOIN doc_len USING (doc_id)")
cte("bm25_ranked", f"""SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
FROM (SELECT qid, doc_id, round(sum(w*idf*qtf),6) AS score FROM postings JOIN query_tf USING (term) JOIN term_df USING (term) GROUP BY 1,2)) WHERE rank<={DEPTH}""")
cte("candidates", f"""SELECT qid, doc_id, grade, l, first_score, first_rank, repeat(words, (doc_id%4+1)::INT) AS text FROM (
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_score DESC, doc_id) AS first_rank FROM (
SELECT *, round(l+2.0*{q.u(2, 'qid', 'doc_id')}-1.0,6) AS first_score FROM (
SELECT *, round(grade*0.8::DOUBLE-1.2::DOUBLE+0.15::DOUBLE*ln(1+value)+2.4::DOUBLE*({q.u(1, 'qid', 'doc_id')}-0.5),6) AS l FROM (
SELECT user_id AS qid, event_id AS doc_id, value, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS grade,
concat_ws(' ', event_type, 'by user', user_id, props) AS words FROM events))))""")
cte("pool", f"SELECT * FROM candidates WHERE first_rank<={DEPTH}")


def anchored_items(name: str, slate: str, a: int) -> None:
    per = 10 - a
    cte(f"dealt{name}", f"""SELECT * EXCLUDE (ord, n_slates), {slate} AS slate FROM (
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_rank, doc_id)-1 AS ord, ceil(count(*) OVER (PARTITION BY qid)/{per}.0)::BIGINT AS n_slates FROM pool)""")
    cte(f"slots{name}", f"""SELECT qid, slate, slot, ((slate*{a}+slot)%4)::INT AS anchor_no FROM (SELECT DISTINCT qid, slate FROM dealt{name}), (SELECT unnest(range({a})) AS slot)""")
    cte(f"items{name}", f"""SELECT qid, slate, doc_id AS item_id, false AS is_anchor, NULL::INT AS anchor_no, l, grade, NULL::DOUBLE AS utility, text FROM dealt{name}
UNION ALL SELECT qid, slate, -anchor_no-1, true, anchor_no, round((anchor_no*2.0-3.0)/2.0+{q.u(3, 'qid', 'slate', 'anchor_no')}-0.5,6), NULL, (anchor_no*2.0-3.0)::DOUBLE, 'anchor '||anchor_no FROM slots{name}""")
    cte(f"slate_logits{name}", f"""SELECT *, l-max(l) OVER w-ln(sum(exp(l-m)) OVER w) AS lp FROM (SELECT *, max(l) OVER (PARTITION BY qid, slate) AS m FROM items{name}) WINDOW w AS (PARTITION BY qid, slate)""")
    cte(f"fits{name}", f"""SELECT qid, slate, n, slope, mu-slope*mx AS intercept, sqrt(greatest(vu-2.0*slope*cov+slope*slope*vx,0.0)) AS residual FROM (
SELECT *, CASE WHEN n=1 THEN 1.0::DOUBLE ELSE (n*cov+1.0)/(n*vx+1.0) END AS slope FROM (
SELECT qid, slate, count(*) AS n, avg(lp) AS mx, avg(utility) AS mu, covar_pop(lp,utility) AS cov, var_pop(lp) AS vx, var_pop(utility) AS vu
FROM slate_logits{name} WHERE is_anchor GROUP BY 1,2))""")
    cte(f"scored{name}", f"""SELECT qid, slate, item_id, grade, lp, {q.r6('slope*lp+intercept')} AS utility, {q.r6('0.35::DOUBLE*abs(slope)*(1.0+residual)')} AS sigma, slope, residual
FROM slate_logits{name} JOIN fits{name} USING (qid, slate) WHERE NOT is_anchor""")


anchored_items("", "ord%n_slates", 4)
anchored_items("_blocked", "(ord//6)", 4)
anchored_items("_two", "ord%n_slates", 2)
cte("verdicts", f"""SELECT *, {q.r6('list_sum(list_transform(level_probs, lambda x, i: x*(i-1)))')} AS expected_grade FROM (
SELECT qid, item_id, grade, first_rank, l, list_transform(p, lambda x: round(x/list_sum(p),6)) AS level_probs, 250::BIGINT AS tokens,
CASE WHEN item_id%4<>0 THEN 250*0.042::DOUBLE/1e6 END AS cost_usd FROM (
SELECT qid, doc_id AS item_id, grade, first_rank, l, [{', '.join(f"exp(-(({i}-grade)::DOUBLE*({i}-grade))/2.0)*(0.5+{q.u(4, 'qid', 'doc_id', str(i))})" for i in range(4))}] AS p FROM candidates))""")
cte("system_scores", f"""SELECT *, round(1.0/(1.0+exp(-score*2.0)),9) AS prob, (grade>=2)::INT AS relevant FROM (
SELECT qid, doc_id, grade, 'first' AS system, first_score AS score FROM candidates
UNION ALL SELECT qid, doc_id, grade, 'latent', l FROM candidates
UNION ALL SELECT qid, doc_id, grade, 'chance', round(4.0*{q.u(5, 'qid', 'doc_id')}-2.0,6) FROM candidates)""")
cte("predictions", f"""SELECT ex_id, source, qtype, k, CASE WHEN ex_id%41<>0 THEN truth END AS label, logits, list_transform({q.softmax('logits')}, lambda z: round(z,9)) AS probs FROM (
SELECT *, CASE WHEN k=2 THEN 'noul' WHEN k<=10 AND ex_id%3=0 THEN 'score' ELSE 'choice' END AS qtype,
list_transform(range(k), lambda i: round((1.0+0.3::DOUBLE*ln(1+value))*(CASE WHEN i=truth THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END+2.0*{q.u(12, 'ex_id', 'i')}),6)) AS logits FROM (
SELECT *, floor({q.u(11, 'ex_id')}*k)::INT AS truth FROM (
SELECT event_id AS ex_id, event_type AS source, value, [2,4,8,12][event_id%4+1] AS k FROM events)))""")
cte("labelled", "SELECT * FROM predictions WHERE label IS NOT NULL")
cte("cumlogits", """SELECT ex_id, [round(list_max(logits)-2.0,6), round(list_max(logits)-3.0,6), round(list_max(logits)-4.0,6)] AS cum,
CASE WHEN ex_id%5<>0 THEN (ex_id%4)::INT END AS rel FROM predictions""")
cte("intervals", f"""SELECT event_id AS id, ts, event_type AS grp, value AS u_true,
round(value+60.0*({q.u(6, 'event_id')}-0.5)*(CASE WHEN event_type='error' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END),6) AS u_hat, 15.0::DOUBLE AS sigma FROM events""")
cte("points", "SELECT 'part '||p_partkey AS name, p_retailprice::DOUBLE AS cost_per_1k, p_size::DOUBLE AS quality, p_brand AS family FROM part")
cte("typed_src", """SELECT conv_id*100+turn AS ex_id, conv_id, turn, role, conv_id%3 AS kind, (conv_id*8+turn)%17=0 AS bad,
trim(regexp_replace(lower(text),'[^a-z0-9 ]','','g')) AS body FROM conversations""")

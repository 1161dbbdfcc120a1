"""Queries on text vectors, mining and word rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.catalog import inputs as src
from stepscope.catalog.registry import query, with_
from stepscope.catalog.reshape import contains_sql, quoted
from stepscope.functions import text as tt
from stepscope.operators import evaluation, mining, ordered, similarity, vectors
from stepscope.plans import checks, parsing
from stepscope.session import arrow_limits, keep

_STOP = quoted(tx.STOPWORDS)
TOKENS_SQL = f"""tokens AS (
  SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'),
         lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS tokens FROM documents)"""
IDF_SQL = """idf AS (
  SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf
  FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tokens) GROUP BY term)"""
TFIDF_SQL = """raw AS (
  SELECT t.doc_id, t.term, t.n / t.doc_len * i.idf AS w FROM (
    SELECT doc_id, term, count(*) AS n, any_value(doc_len) AS doc_len FROM (
      SELECT doc_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM tokens) GROUP BY doc_id, term) t
  JOIN idf i ON i.term = t.term),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _rows(spark, sf, key=("doc_id",)):
    return vectors.document_vectors(src.texts(spark, sf), key)


def _vectors(spark, sf):
    return vectors.postings(_rows(spark, sf))


@query(
    "d1_tokenize",
    with_(TOKENS_SQL) + """SELECT doc_id, len(tokens) AS n_tokens,
       md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tokens""",
)
def d1(spark, sf):
    docs = vectors.doc_tokens(src.texts(spark, sf))
    return docs.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


@query(
    "d2_idf_table",
    with_(TOKENS_SQL, IDF_SQL) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
)
def d2(spark, sf):
    return vectors.idf_table(src.texts(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(
    "d3_tfidf",
    with_(TOKENS_SQL, IDF_SQL, TFIDF_SQL) + "SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf",
)
def d3(spark, sf):
    return _vectors(spark, sf).withColumn("weight", F.round("weight", 6))


@query(
    "d4_cosine_pairs",
    with_(TOKENS_SQL, IDF_SQL, TFIDF_SQL) + """, pairs AS (
      SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents)
    SELECT p.a, p.b, round(coalesce(sum(x.weight * y.weight), 0), 6) AS similarity
    FROM pairs p LEFT JOIN tfidf x ON x.doc_id = p.a
         LEFT JOIN tfidf y ON y.doc_id = p.b AND y.term = x.term
    WHERE p.b IS NOT NULL GROUP BY p.a, p.b""",
)
def d4(spark, sf):
    """Each document against the next one of its source."""
    docs = src.texts(spark, sf)
    placed = ordered.number_rows(docs.select("doc_id", "source"), "source", ["doc_id"], out="pos")
    pairs = ordered.neighbours(
        placed, "source", "pos", lambda w: {"b": F.lead("doc_id").over(w)}, ahead=1
    ).where("b IS NOT NULL").select(F.col("doc_id").alias("a"), "b")
    return vectors.cosine_pairs(_rows(spark, sf), pairs).withColumn(
        "similarity", F.round("similarity", 6)
    )


SIMILAR = 0.8
# Documents with equal shares of equal terms are one.
_PAIRS_SQL = f"""same AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY shares) AS rep FROM (
    SELECT doc_id, list((term, n / doc_len) ORDER BY term) AS shares FROM (
      SELECT doc_id, term, count(*) AS n, any_value(doc_len) AS doc_len FROM (
        SELECT doc_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM tokens) GROUP BY doc_id, term)
    GROUP BY doc_id)),
reps AS (SELECT t.* FROM tfidf t JOIN same s ON s.doc_id = t.doc_id AND s.rep = t.doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.weight * y.weight), 9) AS similarity
  FROM reps x JOIN reps y ON x.term = y.term AND x.doc_id < y.doc_id
  GROUP BY ALL HAVING round(sum(x.weight * y.weight), 9) >= {SIMILAR})"""


@query(
    "d4_similar_pairs",
    with_(TOKENS_SQL, IDF_SQL, TFIDF_SQL, _PAIRS_SQL)
    + "SELECT a, b, round(similarity, 6) AS similarity FROM pairs",
)
def d4_similar(spark, sf):
    """All pairs of different documents that are alike; copies are one document."""
    pairs, _ = similarity.similar_pairs(_rows(spark, sf), SIMILAR)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(
    "similarity_components",
    "WITH RECURSIVE " + ",\n".join((TOKENS_SQL, IDF_SQL, TFIDF_SQL, _PAIRS_SQL)) + """,
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT DISTINCT rep AS node, rep AS seen FROM same
      UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
    least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
    SELECT s.doc_id, l.component_id FROM same s JOIN least l ON l.node = s.rep""",
)
def similar_components(spark, sf):
    return similarity.similarity_components(_rows(spark, sf), SIMILAR)


@query(
    "d5_centroids",
    with_(TOKENS_SQL, IDF_SQL, TFIDF_SQL) + """, sums AS (
      SELECT d.lang, t.term, sum(t.weight) AS total FROM tfidf t JOIN documents d ON d.doc_id = t.doc_id GROUP BY ALL)
    SELECT lang, term, round(total / sqrt(sum(total * total) OVER (PARTITION BY lang)), 6) AS weight FROM sums""",
)
def d5(spark, sf):
    members = src.texts(spark, sf).select("doc_id", "lang")
    return vectors.centroids(_rows(spark, sf, ("doc_id", "lang")), members, ["lang"]).withColumn(
        "weight", F.round("weight", 6)
    )


def _patterns(spark, sf):
    tags = F.array(*[F.lit(t) for t in tx.TAGS])
    return src.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("int").alias("pattern_no"),
        F.format_string("pattern_%03d", F.col("item_id")).alias("pattern_id"),
        F.get(tags, (F.col("item_id") % 7).cast("int")).alias("category"),
        F.col("text").alias("trigger_description"),
        F.lit("").alias("safe_alternative"),
        F.lit(1.0).alias("confidence"),
    )


_BARS_SQL = "CASE category " + " ".join(
    f"WHEN '{t}' THEN {b}" for t, b in tx.CATEGORY_THRESHOLDS.items()
) + " END"


@query(
    "d6_nearest_pattern",
    with_(TOKENS_SQL, IDF_SQL, TFIDF_SQL) + f""", ptok AS (
      SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'),
             lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS tokens FROM benchmark),
    praw AS (SELECT t.item_id, t.term, t.n / t.doc_len * i.idf AS w FROM (
        SELECT item_id, term, count(*) AS n, any_value(doc_len) AS doc_len FROM (
          SELECT item_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM ptok) GROUP BY item_id, term) t
      JOIN idf i ON i.term = t.term),
    pvec AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM praw),
    sims AS (SELECT d.doc_id, p.item_id, round(sum(d.weight * p.weight), 12) AS sim
             FROM tfidf d JOIN pvec p ON p.term = d.term GROUP BY ALL),
    best AS (SELECT *, ([{quoted(tx.TAGS)}])[item_id % 7 + 1] AS category FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, item_id) AS rn FROM sims) WHERE rn = 1)
    SELECT doc_id, CAST(item_id AS INTEGER) AS pattern_no, round(sim, 6) AS similarity, category
    FROM best WHERE sim >= {_BARS_SQL}""",
)
def d6(spark, sf):
    counted = keep(vectors.counted_docs(src.texts(spark, sf)), "counted")
    idf = keep(vectors.idf_of(counted), "idf")
    found = vectors.nearest_of_counted(counted, _patterns(spark, sf), idf)
    return found.select(
        "doc_id", "pattern_no", F.round("similarity", 6).alias("similarity"),
        F.col("match.category").alias("category"),
    )


# Rules over words that are frequent in the tables.
WORD_RULES = [
    ("rule_one", "planning_error", "first rule", [("the", "ther"), ("ing", "tion"), ("ble",)]),
    ("rule_two", "memory_error", "second rule", [("eau", "que"), ("ère",)]),
    ("rule_three", "tool_use_error", "third rule", [("sch", "ung"), ("und", "der"), ("ein",), ("ich", "ver")]),
    ("rule_four", "other", "fourth rule", ["ción+los", "osa"]),
]


def rules_sql(low: str, rules) -> list[str]:
    """Hits per rule, in SQL."""
    out = []
    for _, _, _, sets in rules:
        terms = []
        for group in sets:
            test = " AND ".join(f"contains({low}, {tt.sql_text(w)})" for w in group)
            terms.append(f"CAST(({test}) AS INTEGER)")
        out.append(" + ".join(terms))
    return out


_HITS = rules_sql("low", WORD_RULES)


@query(
    "d7_keyword_rules",
    f"""WITH low AS (SELECT doc_id, lower(text) AS low FROM documents),
       hits AS (SELECT doc_id, [{', '.join(_HITS)}] AS h FROM low),
       top AS (SELECT doc_id, h, list_max(h) AS best, list_position(h, list_max(h)) AS n FROM hits)
       SELECT doc_id, ([{quoted(r[0] for r in WORD_RULES)}])[n] AS rule_id,
              ([{quoted(r[1] for r in WORD_RULES)}])[n] AS category,
              round(least(0.85, 0.40 + best / ([{', '.join(str(len(r[3])) for r in WORD_RULES)}])[n] * 0.45), 4) AS confidence
       FROM top WHERE best > 0""",
)
def d7(spark, sf):
    docs = tt.add_keyword_rule(src.texts(spark, sf), "m", "text", WORD_RULES)
    return docs.where("m IS NOT NULL").select("doc_id", "m.rule_id", "m.category", "m.confidence")


def _agreed(spark, sf):
    judged = src.judged(spark, sf)
    return judged.where(F.col("root_cause_error_type") == F.col("true_type")).select(
        F.col("root_cause_error_type").alias("category"), F.col("run_id").alias("doc_id"),
        F.col("justification").alias("text"),
    )


@query("d8_leader_cluster")
def d8(spark, sf):
    return mining.leader_cluster(_agreed(spark, sf))


@query(
    "d9_medoids",
    with_(TOKENS_SQL, IDF_SQL, TFIDF_SQL) + """, sums AS (
      SELECT d.lang, t.term, sum(t.weight) AS total, count(*) AS c FROM tfidf t JOIN documents d ON d.doc_id = t.doc_id GROUP BY ALL),
    sizes AS (SELECT lang, count(*) AS members FROM documents GROUP BY lang),
    dots AS (SELECT d.lang, d.doc_id, sum(t.weight * s.total) - sum(t.weight * t.weight) AS others
             FROM documents d LEFT JOIN tfidf t ON t.doc_id = d.doc_id
             LEFT JOIN sums s ON s.lang = d.lang AND s.term = t.term GROUP BY d.lang, d.doc_id),
    ranked AS (SELECT x.lang, x.doc_id, z.members, coalesce(x.others, 0) / (z.members - 1) AS a,
               row_number() OVER (PARTITION BY x.lang ORDER BY round(coalesce(x.others, 0) / (z.members - 1), 12) DESC, x.doc_id) AS rn
               FROM dots x JOIN sizes z ON z.lang = x.lang)
    SELECT lang, doc_id AS medoid, round(a, 6) AS avg_similarity, members FROM ranked WHERE rn = 1""",
)
def d9(spark, sf):
    members = src.texts(spark, sf).select("doc_id", "lang")
    return vectors.medoids(_rows(spark, sf, ("doc_id", "lang")), members, ["lang"]).withColumn(
        "avg_similarity", F.round("avg_similarity", 6)
    )


@query(
    "d10_snippets",
    with_(src.STEPS_SQL, src.RUNS_SQL) + """, roots AS (
      SELECT run_id, total_steps_taken // 2 AS root FROM runs)
    SELECT s.run_id, s.step_index, s.action_name, s.args_key AS action_args, s.tool_response
    FROM steps s JOIN roots r ON r.run_id = s.run_id
    WHERE s.step_index BETWEEN r.root - 2 AND r.root + 2""",
)
def d10(spark, sf):
    roots = src.runs(spark, sf).select(
        "run_id", F.floor(F.col("total_steps_taken") / 2).cast("int").alias("root_cause_step_index")
    )
    return mining.snippet_rows(src.steps(spark, sf), roots).drop("reasoning")


@query("d11_corrective_text")
def d11(spark, sf):
    docs = src.texts(spark, sf).select(
        F.col("lang").alias("category"), F.lit(0).alias("cluster"), "doc_id", "text"
    )
    chosen = docs.groupBy("category", "cluster").agg(F.min("doc_id").alias("medoid"))
    return mining.corrective_text(docs, chosen, ["ther", "tion", "que", "ung", "los"])


@query("d12_mine_patterns")
def d12(spark, sf):
    judged = src.judged(spark, sf)
    return mining.mine_patterns(
        judged.select("run_id", "root_cause_error_type", "root_cause_step_index", "justification"),
        judged.select("run_id", "true_type"),
        threshold=0.1,
        words=["ther", "tion", "que", "ung", "los"],
    )


# Terms as the plan rules take them; written without word boundaries, which the two
# engines see differently at accented letters.
PAIRS = [
    ("er", r"(?:^|\s)er(?:\s|$)", "re", r"(?:^|\s)re(?:\s|$)"),
    ("the", r"(?:^|\s)the(?:\s|$)", "with", r"(?:^|\s)with(?:\s|$)"),
]
TERMS = [("ing", r"ing"), ("eau", r"eau"), ("sch", r"sch"), ("en", r"(?:^|\s)en(?:\s|$)")]
VERBS = r"(?:^|\s)(?:of|de|and|la|der)(?:\s|$)"
_SPLIT = """halves AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS task,
  lower(CASE WHEN contains(text, chr(10)) THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END) AS plan
  FROM documents)"""


def _halves(spark, sf):
    return src.texts(spark, sf).select(
        F.col("doc_id").alias("run_id"),
        F.substring_index("text", "\n", 1).alias("task_description"),
        F.when(
            F.col("text").contains("\n"), F.regexp_replace("text", r"\A[^\n]*\n", "")
        ).otherwise("").alias("proposed_plan"),
    )


def _contradiction_sql() -> str:
    tests = []
    for left, lre, right, rre in PAIRS:
        for mine, mre, other, ore in ((left, lre, right, rre), (right, rre, left, lre)):
            tests.append(
                f"WHEN regexp_matches(task, '{mre}') AND NOT regexp_matches(task, '{ore}') "
                f"AND regexp_matches(plan, '{ore}') AND NOT regexp_matches(plan, '{mre}') THEN '{mine}/{other}'"
            )
    return "CASE " + " ".join(tests) + " END"


@query(
    "e3_plan_contradiction",
    with_(_SPLIT) + f"""SELECT doc_id AS run_id, 'Task explicitly requires ''' || split_part(c, '/', 1)
       || ''', but proposed plan targets ''' || split_part(c, '/', 2) || '''' AS description
    FROM (SELECT doc_id, {_contradiction_sql()} AS c FROM halves) WHERE c IS NOT NULL""",
)
def e3(spark, sf):
    found = _halves(spark, sf).select(
        "run_id",
        checks.plan_contradiction(F.col("task_description"), F.col("proposed_plan"), PAIRS).alias("m"),
    )
    return found.where("m IS NOT NULL").select("run_id", "m.description")


_OMITTED = "CASE " + " ".join(
    f"WHEN regexp_matches(task, '{p}') AND NOT regexp_matches(plan, '{p}') THEN '{n}'" for n, p in TERMS
) + " END"


@query(
    "e4_constraint_omission",
    with_(_SPLIT) + f"""SELECT doc_id AS run_id,
       'Include ''' || t || ''' in search parameters and filtering steps' AS safe_alternative
    FROM (SELECT doc_id, {_OMITTED} AS t FROM halves WHERE regexp_matches(plan, '{VERBS}')) WHERE t IS NOT NULL""",
)
def e4(spark, sf):
    found = _halves(spark, sf).select(
        "run_id",
        checks.constraint_omission(
            F.col("task_description"), F.col("proposed_plan"), TERMS, VERBS
        ).alias("m"),
    )
    return found.where("m IS NOT NULL").select("run_id", "m.safe_alternative")


@query("e5_check_plans")
def e5(spark, sf):
    checked = checks.check_plans(
        _halves(spark, sf), None, True, PAIRS, TERMS, VERBS, WORD_RULES
    )
    return checked.select(
        "run_id", "approved", "flagged", F.array_join("flags", " | ").alias("flags"),
        F.array_join("suggestions", " | ").alias("suggestions"),
    )


@query(
    "e10_response_failed",
    f"SELECT doc_id, {contains_sql('lower(text)', tx.RESPONSE_ERRORS)} AS failed FROM documents",
)
def e10(spark, sf):
    return src.texts(spark, sf).select("doc_id", tt.response_failed(F.col("text")).alias("failed"))


# Letters only, and no vowel that the transition words need: the line strategy is left.
_BARE = "[^a-df-hj-np-zA-DF-HJ-NP-Z\n ]"
_OTHERS = bytes(b for b in range(256) if b > 127 or re.match(_BARE, chr(b)))


def _bare(batches):
    """Texts without the characters of _BARE; what stays is ASCII, so bytes are dropped."""
    for batch in batches:
        kept = [v and v.translate(None, _OTHERS) for v in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string())], names=batch.schema.names
        )


@query(
    "f1_parse_plan",
    f"""WITH bare AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_BARE}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
       listed AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)),
                    lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10) AS items FROM bare),
       chosen AS (SELECT doc_id, len(items) < 2 AS is_fallback,
                  CASE WHEN len(items) >= 2 THEN items
                       WHEN t = '' THEN ['{tx.EMPTY_PLAN_ITEM}']
                       ELSE ['Execute task: ' || replace(substring(t, 1, 200), chr(10), ' ')] END AS items FROM listed),
       rows AS (SELECT doc_id, is_fallback, unnest(items) AS item, unnest(range(len(items))) AS no FROM chosen)
       SELECT doc_id AS run_id, CAST(no AS INTEGER) AS subgoal_no, format('subgoal_{{:03d}}', no + 1) AS subgoal_id,
              CASE WHEN is_fallback THEN item ELSE substring(item, 1, 200) END AS description, is_fallback,
              CASE WHEN is_fallback THEN 'single' ELSE 'lines' END AS strategy
       FROM rows""",
)
def f1(spark, sf):
    arrow_limits(spark)
    plans = src.texts(spark, sf).select(F.col("doc_id").alias("run_id"), F.col("text").alias("proposed_plan"))
    plans = plans.mapInArrow(_bare, plans.schema)
    return parsing.parse_plans(plans)


@query("f1_parse_plan_texts")
def f1_texts(spark, sf):
    """Whole texts by all strategies; `f1_parse_plan` reads letters only, as its SQL does."""
    plans = src.texts(spark, sf).select(
        F.col("doc_id").alias("run_id"), F.col("text").alias("proposed_plan")
    )
    return parsing.parse_plans(plans)


@query(
    "g12_order_by_payload_length",
    "SELECT doc_id AS run_id, length(text) AS payload_length FROM documents",
)
def g12(spark, sf):
    docs = src.texts(spark, sf).select(F.col("doc_id").alias("run_id"), F.col("text").alias("payload"))
    return evaluation.order_by_payload_length(docs).drop("payload")

"""Study queries: scheduling, mastery, grading, plans, sessions and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import study as U
from ..operators import study as O
from ..operators.joins import as_of_join, top_per_group
from ..sources.tables import cards, reviews, table

AS_OF = "2024-05-15"


def sm2_schedule(spark, d):
    """One step of the schedule for every review, from a state that follows from its ids."""
    r = reviews(spark, d)
    reps, ease, days, lapses = (r["event_id"] % 5).cast("int"), F.lit(1.3) + (r["event_id"] % 13) / 10, (r["event_id"] % 40).cast("int"), (r["event_id"] % 3).cast("int")
    return r.select("event_id", U.next_review(F.col("quality"), reps, ease, days, lapses).alias("s")).select("event_id", "s.*")


def review_card_by_book(spark, d):
    r = reviews(spark, d)
    return r.select("event_id", U.next_review_by_book(F.col("quality"), r["event_id"] % 5, F.lit(1.3) + (r["event_id"] % 13) / 10, (r["event_id"] % 40).cast("double")).alias("s")).select("event_id", "s.*")


def run_review_sessions(spark, d):
    """The review state of every learner's card after all events."""
    return O.fold_reviews(reviews(spark, d), ["user_id", "card_id"]).select("user_id", "card_id", "n_reviews", "interval_days", "ease", "reps", "lapses")


def _mastery():
    return U.card_mastery(F.col("interval_days"), F.col("ease"), F.col("lapses"), F.col("last_reviewed"), F.lit(AS_OF).cast("date"))


def card_mastery(spark, d):
    return cards(spark, d).select("card_id", F.round(_mastery(), 6).alias("mastery"))


def compute_mastery(spark, d):
    """Mastery over all, by book and by section."""
    return O.mastery_rollup(cards(spark, d).withColumn("section", F.col("tag")), _mastery())


def weakest_sections(spark, d):
    c = cards(spark, d).groupBy("book", "tag").agg(F.round(F.avg(_mastery()), 4).alias("mastery"), F.count("*").alias("n_cards"))
    return top_per_group(c, ["book"], [F.col("mastery"), F.col("tag")], 5)


def get_due_cards(spark, d):
    return cards(spark, d).where(F.col("due_date") <= F.lit(AS_OF).cast("date")).select("card_id", "due_date", F.row_number().over(Window.partitionBy("book").orderBy("due_date", "card_id")).alias("place")).withColumn("due_date", F.col("due_date").cast("string"))


def get_cards_by_book(spark, d):
    return cards(spark, d).where("book = 'Brand#2'").select("card_id", "prompt")


def get_cards_by_tag(spark, d):
    return cards(spark, d).where(F.array_contains(F.split(F.lower("tag"), " "), "economy")).select("card_id", "tag")


def get_study_stats(spark, d):
    due = F.col("due_date") <= F.lit(AS_OF).cast("date")
    return cards(spark, d).groupBy("book").agg(F.count("*").alias("n_cards"), F.count_if(due).alias("n_due"))


def make_quiz_adaptive(spark, d):
    """Ten cards of each book, two lapsed ones to one other; most lapses, longest due and least mastered first."""
    c = cards(spark, d).withColumn("mastery", F.round(_mastery(), 6))
    return O.interleaved(c, ["book"], F.col("reps") % 2 == 0, [F.desc("lapses"), F.col("due_date"), F.col("mastery"), F.col("card_id")], 10).select("book", "rank", "card_id", "slot")


def make_study_plan(spark, d):
    """A budget of 30 minutes for each book: cards due take 55 %, weak ones 20 %, at 35 seconds a card."""
    c = cards(spark, d).withColumn("mastery", F.round(_mastery(), 6)).withColumn("due", F.col("due_date") <= F.lit(AS_OF).cast("date"))
    due = top_per_group(c.where("due"), ["book"], [F.col("due_date"), F.col("card_id")], int(30 * 60 * 0.55 // 35)).select("book", F.lit("due").alias("block"), "rank", "card_id")
    weak = top_per_group(c.where("not due"), ["book"], [F.col("mastery"), F.col("card_id")], int(30 * 60 * 0.20 // 35)).select("book", F.lit("weak").alias("block"), "rank", "card_id")
    return due.union(weak)


def _answers(spark, d):
    c = table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user, reply


def match_questions_and_answers(spark, d):
    """User turns with the assistant's next turn, if there is one; of several the longest, then the last in order of text."""
    user, reply = _answers(spark, d)
    one = top_per_group(reply, ["conv_id", "turn"], [F.desc(F.length("answer")), F.desc("answer")], 1).drop("rank")
    return user.join(one, ["conv_id", "turn"], "left").groupBy("conv_id", "turn").agg(F.max(F.length("answer")).alias("answer_chars"), F.max(F.col("answer").isNotNull()).alias("matched"))


def unmatched_questions(spark, d):
    user, reply = _answers(spark, d)
    return user.join(reply, ["conv_id", "turn"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("n"))


def grade_answers(spark, d):
    user, reply = _answers(spark, d)
    pairs = user.join(reply, ["conv_id", "turn"])
    kind = F.when(F.col("turn") % 3 == 0, "cloze").otherwise("basic")
    return pairs.groupBy("conv_id", "turn").agg(F.max(U.grade(F.col("question"), F.col("answer"), kind)).alias("score"))


def grade_synonyms(spark, d):
    """Card prompts graded against a fixed answer that only synonyms reach."""
    c = cards(spark, d)
    return c.select("card_id", U.grade(F.concat("prompt", F.lit(" quick list")), F.concat(F.lit("fast vector "), F.col("prompt")), F.lit("basic")).alias("score"))


def terminality_scores(spark, d):
    r = reviews(spark, d)
    level = F.expr("CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'odd' END")
    return r.select("event_id", F.round(U.terminality(level, (F.col("event_id") % 11) / 10, F.col("event_id") % 3 == 0), 6).alias("terminality"))


def session_log(spark, d):
    """One row a learner and day: reviews, correct ones, mean quality, and a histogram of grades."""
    r = reviews(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return r.groupBy("user_id", "day").agg(
        F.count("*").alias("cards_reviewed"), F.count_if(F.col("quality") >= 3).alias("correct"), F.round(F.avg("quality"), 4).alias("avg_quality"),
        *(F.count_if(F.col("quality") == q).alias(f"q{q}") for q in range(6)),
    )


def weakest_tags(spark, d):
    """The five cards of lowest mean quality of each learner."""
    g = reviews(spark, d).groupBy("user_id", "card_id").agg(F.round(F.avg("quality"), 4).alias("avg_quality"))
    return top_per_group(g, ["user_id"], [F.col("avg_quality"), F.col("card_id")], 5)


def remediation_effectiveness(spark, d):
    """Mean quality of learner days with and without a repeated card, and the share above the overall mean."""
    r = reviews(spark, d).withColumn("day", F.to_date("ts"))
    s = r.groupBy("user_id", "day").agg(F.avg("quality").alias("q"), (F.count_if(F.col("quality") < 3) > 1).alias("helped"))
    mean = s.agg(F.avg("q").alias("overall"))
    return s.crossJoin(F.broadcast(mean)).groupBy("helped").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("avg_quality"), F.round(F.avg((F.col("q") > F.col("overall")).cast("double")), 6).alias("uplift"))


def upload_rate_limit(spark, d):
    """Whether a learner has had three or more sign-ups in the hour up to each one."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("recent")).withColumn("limited", F.col("recent") >= 3)


def session_windows(spark, d):
    """Review sessions: reviews of a learner no more than thirty minutes apart (an addition to the study tools)."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def review_state_as_of(spark, d):
    """Every purchase with the quality of the learner's last click before it."""
    r = reviews(spark, d)
    clicks, buys = r.where("quality = 3").select("user_id", "ts", F.col("event_id").alias("click_id")), r.where("quality = 5").select("event_id", "user_id", "ts")
    return as_of_join(buys, clicks, ["user_id"], "ts", "ts", "click_id").select("event_id", "user_id", "click_id")


def update_cards_latest(spark, d):
    """Cards merged by id: the last event wins."""
    return O.latest(reviews(spark, d), ["card_id"], [F.col("ts"), F.col("event_id")]).select("card_id", "event_id", "quality")


def concept_difficulty(spark, d):
    """By tag: cards, lapsed share, mean lapses and mean days to mastery."""
    c = cards(spark, d)
    days = F.when((F.col("interval_days") >= 7) & F.col("last_reviewed").isNotNull(), F.datediff("last_reviewed", F.lit("2024-01-01").cast("date")))
    return c.groupBy("tag").agg(F.count("*").alias("n_cards"), F.round(F.avg((F.col("lapses") > 0).cast("double")), 6).alias("failure_rate"), F.round(F.avg("lapses"), 6).alias("avg_lapses"), F.round(F.coalesce(F.avg(days), F.lit(-1.0)), 6).alias("days_to_mastery"))


def export_cards(spark, d):
    """Front, back and tags of a card as a tab-separated export has them."""
    c = cards(spark, d)
    back = F.concat_ws(" ", F.col("prompt"), F.concat(F.lit("[§"), F.col("tag"), F.lit(", "), F.col("book"), F.lit("]")))
    return c.select("card_id", F.col("prompt").alias("front"), back.alias("back"), F.array_join(F.array_distinct(F.array(F.regexp_replace("tag", " ", "_"), F.regexp_replace("book", " ", "_"))), " ").alias("tags"))


def evaluate_items(spark, d):
    """Coverage, citations and confidence of every part as an evaluated item."""
    p = table(spark, d, "part")
    name = F.split("p_name", " ")
    books = F.array(F.col("p_brand"))
    return p.select(
        "p_partkey", F.round(U.concept_coverage(F.array(F.element_at(name, 1), F.lit("widgets")), name), 6).alias("coverage"),
        U.cited(F.array(F.lit("Brand#2"), F.lit("Brand#17")), books).alias("cite_ok"),
        U.confident_enough(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"), F.lit("medium")).alias("confidence_ok"),
    )


def run_eval(spark, d):
    e = evaluate_items(spark, d)
    return e.agg(F.round(F.avg("coverage"), 6).alias("avg_coverage"), F.round(F.avg(F.col("cite_ok").cast("double")), 6).alias("cite_rate"), F.round(F.avg(F.col("confidence_ok").cast("double")), 6).alias("confidence_rate"), F.count("*").alias("n"))


REVIEWS = "WITH r AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS card_id, ts, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS quality FROM events)"
CARDS = """WITH c AS (SELECT p_partkey AS card_id, p_brand AS book, p_type AS tag, p_name AS prompt, (p_partkey % 45)::INT AS interval_days, 1.3::DOUBLE + (p_partkey % 18) / 10 AS ease, (p_partkey % 6)::INT AS reps, (p_partkey % 4)::INT AS lapses,
 CASE WHEN p_partkey % 5 <> 0 THEN DATE '2024-01-01' + (p_partkey % 120)::INT END AS last_reviewed, DATE '2024-03-01' + (p_partkey % 90)::INT AS due_date FROM part)"""
_days = f"date_diff('day', last_reviewed, DATE '{AS_OF}')"
MASTERY = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, (least(1.0::DOUBLE, interval_days / 30.0::DOUBLE) - lapses * 0.05::DOUBLE + greatest(0.0::DOUBLE, ease - 2.5::DOUBLE) * 0.5::DOUBLE) *
 CASE WHEN last_reviewed IS NULL THEN 0.5::DOUBLE WHEN {_days} > 60 THEN 0.7::DOUBLE WHEN {_days} > 30 THEN greatest(0.7::DOUBLE, 1.0::DOUBLE - 0.3::DOUBLE * (({_days} - 30) / 30.0::DOUBLE)) ELSE 1.0::DOUBLE END))"""
_step = lambda q, reps, ease, days, lapses: {
    "interval_days": f"CASE WHEN {q} < 3 OR {reps} = 0 THEN 1 WHEN {reps} = 1 THEN 6 ELSE round_even({days} * {ease}, 0)::INT END",
    "ease": f"round(greatest(1.3::DOUBLE, {ease} + CASE WHEN {q} < 3 THEN -0.20::DOUBLE ELSE 0.1::DOUBLE - (5 - {q}) * (0.08::DOUBLE + (5 - {q}) * 0.02::DOUBLE) END), 4)",
    "reps": f"CASE WHEN {q} < 3 THEN 0 ELSE {reps} + 1 END",
    "lapses": f"{lapses} + ({q} < 3)::INT",
}
_columns = lambda step: ", ".join(f"({v})::{'DOUBLE' if k == 'ease' else 'INT'} AS {k}" for k, v in step.items())
_ANSWERS = "WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')"
_tok = lambda s: f"list_distinct(regexp_extract_all(lower({s}), '[a-z0-9_]+'))"
_syn = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in U.SYNONYMS.items()) + "}"


def _grade(answer, expected, cloze):
    wide = f"list_distinct(list_concat({_tok(answer)}, flatten(list_transform({_tok(answer)}, lambda t: coalesce({_syn}[t], [])))))"
    share = f"(len(list_intersect({wide}, {_tok(expected)})) / len({_tok(expected)}))"
    return f"CASE WHEN trim({answer}) = '' THEN 0 WHEN {cloze} AND contains(lower(trim({answer})), lower(trim({expected}))) THEN 5 WHEN len({_tok(expected)}) = 0 THEN 3 WHEN {share} >= 0.70 THEN 5 WHEN {share} >= 0.50 THEN 4 WHEN {share} >= 0.30 THEN 3 WHEN {share} >= 0.15 THEN 2 WHEN {share} >= 0.05 THEN 1 ELSE 0 END"


_ITEMS = """SELECT p_partkey, round(len(list_filter([string_split(p_name, ' ')[1], 'widgets'], lambda e: len(list_filter(string_split(p_name, ' '), lambda f: contains(lower(f), lower(e)) OR contains(lower(e), lower(f)))) > 0)) / 2, 6) AS coverage,
  p_brand IN ('Brand#2', 'Brand#17') AS cite_ok, p_partkey % 3 < 2 AS confidence_ok FROM part"""
_rank = lambda by, order, n, src, cols: f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {src}) WHERE rank <= {n}"

QUERIES = {f.__name__: f for f in (
    sm2_schedule, review_card_by_book, run_review_sessions, card_mastery, compute_mastery, weakest_sections, get_due_cards, get_cards_by_book, get_cards_by_tag, get_study_stats,
    make_quiz_adaptive, make_study_plan, match_questions_and_answers, unmatched_questions, grade_answers, grade_synonyms, terminality_scores, session_log, weakest_tags, remediation_effectiveness,
    upload_rate_limit, session_windows, review_state_as_of, update_cards_latest, concept_difficulty, export_cards, evaluate_items, run_eval,
)}

_s1 = _step("quality", "(event_id % 5)", "(1.3::DOUBLE + (event_id % 13) / 10)", "(event_id % 40)", "(event_id % 3)")
_fold = _step("n.quality", "f.reps", "f.ease", "f.interval_days", "f.lapses")
ORACLE_SQL = {
    "sm2_schedule": f"{REVIEWS} SELECT event_id, {_columns(_s1)} FROM r",
    "review_card_by_book": f"{REVIEWS}, s AS (SELECT event_id, quality AS g, event_id % 5 AS n, 1.3::DOUBLE + (event_id % 13) / 10 AS e, (event_id % 40)::DOUBLE AS i FROM r) SELECT event_id, CASE WHEN g < 3 THEN 0.0 WHEN n = 0 THEN 1.0 WHEN n = 1 THEN 6.0 ELSE round(i * e, 1) END::DOUBLE AS interval_days, round(greatest(1.3::DOUBLE, e + (0.1::DOUBLE - (5 - g) * 0.02::DOUBLE)), 2) AS ease FROM s",
    "run_review_sessions": f"""{REVIEWS.replace('WITH', 'WITH RECURSIVE')}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, card_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id, card_id) AS n_reviews FROM r),
        f AS (SELECT DISTINCT user_id, card_id, 0::BIGINT AS k, n_reviews, 0 AS interval_days, 2.5::DOUBLE AS ease, 0 AS reps, 0 AS lapses FROM n
        UNION ALL SELECT n.user_id, n.card_id, n.k, n.n_reviews, {_columns(_fold)} FROM f JOIN n ON n.user_id = f.user_id AND n.card_id = f.card_id AND n.k = f.k + 1)
        SELECT user_id, card_id, n_reviews, interval_days, ease, reps, lapses FROM f WHERE k = n_reviews""",
    "card_mastery": f"{CARDS} SELECT card_id, round({MASTERY}, 6) AS mastery FROM c",
    "compute_mastery": f"{CARDS}, m AS (SELECT book, tag AS section, {MASTERY} AS m FROM c) SELECT book, section, grouping(book, section) AS level, count(*) AS n_cards, round(avg(m), 4) AS mastery FROM m GROUP BY GROUPING SETS ((book), (section), ())",
    "weakest_sections": f"{CARDS}, g AS (SELECT book, tag, round(avg({MASTERY}), 4) AS mastery, count(*) AS n_cards FROM c GROUP BY ALL) {_rank('book', 'mastery, tag', 5, 'g', '*')}",
    "get_due_cards": f"{CARDS} SELECT card_id, due_date::VARCHAR AS due_date, row_number() OVER (PARTITION BY book ORDER BY due_date, card_id) AS place FROM c WHERE due_date <= DATE '{AS_OF}'",
    "get_cards_by_book": f"{CARDS} SELECT card_id, prompt FROM c WHERE book = 'Brand#2'",
    "get_cards_by_tag": f"{CARDS} SELECT card_id, tag FROM c WHERE list_contains(string_split(lower(tag), ' '), 'economy')",
    "get_study_stats": f"{CARDS} SELECT book, count(*) AS n_cards, count(*) FILTER (due_date <= DATE '{AS_OF}') AS n_due FROM c GROUP BY book",
    "make_quiz_adaptive": f"""{CARDS}, k AS (SELECT book, card_id, reps % 2 AS kind, row_number() OVER (PARTITION BY book, reps % 2 ORDER BY lapses DESC, due_date, round({MASTERY}, 6), card_id) - 1 AS k FROM c),
        s AS (SELECT *, CASE WHEN kind = 0 THEN k // 2 * 3 + k % 2 ELSE k * 3 + 2 END AS slot FROM k) {_rank('book', 'slot, kind', 10, 's', 'book, rank, card_id, slot')}""",
    "make_study_plan": f"""{CARDS}, s AS (SELECT *, round({MASTERY}, 6) AS mastery, due_date <= DATE '{AS_OF}' AS due FROM c),
        x AS (SELECT * FROM s WHERE due), y AS (SELECT * FROM s WHERE NOT due)
        {_rank('book', 'due_date, card_id', 28, 'x', "book, 'due' AS block, rank, card_id")} UNION ALL {_rank('book', 'mastery, card_id', 10, 'y', "book, 'weak' AS block, rank, card_id")}""",
    "match_questions_and_answers": f"{_ANSWERS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(answer) DESC, answer DESC) AS k FROM a) WHERE k = 1) SELECT conv_id, turn, max(length(answer)) AS answer_chars, bool_or(answer IS NOT NULL) AS matched FROM u LEFT JOIN o USING (conv_id, turn) GROUP BY ALL",
    "unmatched_questions": f"{_ANSWERS} SELECT conv_id, count(*) AS n FROM u ANTI JOIN a USING (conv_id, turn) GROUP BY conv_id",
    "grade_answers": f"{_ANSWERS}, x AS (SELECT conv_id, turn, question, answer AS e FROM u JOIN a USING (conv_id, turn)) SELECT conv_id, turn, max({_grade('question', 'e', 'turn % 3 = 0')}) AS score FROM x GROUP BY ALL",
    "grade_synonyms": f"{CARDS}, x AS (SELECT card_id, prompt || ' quick list' AS g, 'fast vector ' || prompt AS e FROM c) SELECT card_id, {_grade('g', 'e', 'false')} AS score FROM x",
    "terminality_scores": "SELECT event_id, round(greatest(0, least(1, CASE event_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6 ELSE 0.3 END * (1 + (event_id % 11) / 10 * 0.3::DOUBLE) * CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END)), 6) AS terminality FROM events",
    "session_log": f"{REVIEWS} SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS cards_reviewed, count(*) FILTER (quality >= 3) AS correct, round(avg(quality), 4) AS avg_quality, {', '.join(f'count(*) FILTER (quality = {q}) AS q{q}' for q in range(6))} FROM r GROUP BY ALL",
    "weakest_tags": f"{REVIEWS}, g AS (SELECT user_id, card_id, round(avg(quality), 4) AS avg_quality FROM r GROUP BY ALL) {_rank('user_id', 'avg_quality, card_id', 5, 'g', '*')}",
    "remediation_effectiveness": f"{REVIEWS}, s AS (SELECT user_id, ts::DATE AS day, avg(quality) AS q, count(*) FILTER (quality < 3) > 1 AS helped FROM r GROUP BY ALL), o AS (SELECT avg(q) AS overall FROM s) SELECT helped, count(*) AS n, round(avg(q), 6) AS avg_quality, round(avg((q > overall)::INT), 6) AS uplift FROM s, o GROUP BY helped",
    "upload_rate_limit": "SELECT *, recent >= 3 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'signup')",
    "session_windows": "WITH g AS (SELECT user_id, ts, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE)::INT AS new FROM events), s AS (SELECT user_id, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id",
    "review_state_as_of": f"{REVIEWS}, c AS (SELECT user_id, ts, max(event_id) AS click_id FROM r WHERE quality = 3 GROUP BY ALL), b AS (SELECT * FROM r WHERE quality = 5) SELECT b.event_id, b.user_id, c.click_id FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.ts",
    "update_cards_latest": f"{REVIEWS} SELECT card_id, event_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY ts DESC, event_id DESC) AS k FROM r) WHERE k = 1",
    "concept_difficulty": f"{CARDS} SELECT tag, count(*) AS n_cards, round(avg((lapses > 0)::INT), 6) AS failure_rate, round(avg(lapses), 6) AS avg_lapses, round(coalesce(avg(CASE WHEN interval_days >= 7 AND last_reviewed IS NOT NULL THEN date_diff('day', DATE '2024-01-01', last_reviewed) END), -1.0), 6) AS days_to_mastery FROM c GROUP BY tag",
    "export_cards": f"{CARDS} SELECT card_id, prompt AS front, prompt || ' [§' || tag || ', ' || book || ']' AS back, CASE WHEN replace(tag, ' ', '_') = replace(book, ' ', '_') THEN replace(tag, ' ', '_') ELSE replace(tag, ' ', '_') || ' ' || replace(book, ' ', '_') END AS tags FROM c",
    "evaluate_items": _ITEMS,
    "run_eval": f"SELECT round(avg(coverage), 6) AS avg_coverage, round(avg(cite_ok::INT), 6) AS cite_rate, round(avg(confidence_ok::INT), 6) AS confidence_rate, count(*) AS n FROM ({_ITEMS})",
}

"""Word streams: turns, low-confidence segments, windows, chunks, batches and reassembly.

events stands for words: user_id is the transcript, (ts, event_id) the order, event_type the speaker and
value the confidence; a word lasts 20 seconds.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.walks import balanced_batches, turn_chunks
from ..registry import query, table



def order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def words(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts")
    return e.select(
        "user_id", "event_id", "ts", F.col("event_type").alias("speaker"), start.alias("start"), (start + 20).alias("end"), F.col("value").alias("confidence")
    )


WORDS_SQL = "(SELECT user_id, event_id, ts, event_type AS speaker, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 20 AS stop, value AS confidence FROM events)"


@query(
    f"""
    SELECT user_id, turn, min(speaker) AS speaker, count(*) AS n_words, min(start) AS start FROM
    (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM
     (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS f FROM {WORDS_SQL})) GROUP BY 1, 2
    """
)
def w3_speaker_turns(spark, sf_dir):
    flag = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order())), 0).otherwise(1)
    turns = words(spark, sf_dir).withColumn("f", flag).withColumn("turn", F.sum("f").over(order()))
    return turns.groupBy("user_id", "turn").agg(F.min("speaker").alias("speaker"), F.count("*").alias("n_words"), F.min("start").alias("start"))


SEGMENTS_SQL = f"""
    SELECT user_id, seg, count(*) AS n_words, min(start) AS start, max(stop) AS stop, min(event_id) AS first_id FROM
    (SELECT *, sum(CASE WHEN prev_low AND start - prev_stop <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM
     (SELECT *, lag(stop) OVER w AS prev_stop, coalesce(lag(confidence) OVER w < 60, false) AS prev_low FROM {WORDS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
    WHERE confidence < 60 GROUP BY 1, 2
"""


def low_segments(w, threshold: float = 60.0, gap: int = 3600):
    """Maximal runs of words under the threshold with gaps of at most ``gap`` and no other word between."""
    w = w.withColumn("prev_end", F.lag("end").over(order())).withColumn("prev_low", F.coalesce(F.lag(F.col("confidence") < threshold).over(order()), F.lit(False)))
    new = F.when(F.col("prev_low") & (F.col("start") - F.col("prev_end") <= gap), 0).otherwise(1)
    w = w.withColumn("seg", F.sum(new).over(order())).where(F.col("confidence") < threshold)
    return w.groupBy("user_id", "seg").agg(F.count("*").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("stop"), F.min("event_id").alias("first_id"))


@query(SEGMENTS_SQL)
def w4_low_confidence_segments(spark, sf_dir):
    return low_segments(words(spark, sf_dir))


@query(f"SELECT user_id, seg, greatest(0, start - 5) AS lo, least(1706659200, stop + 5) AS hi FROM ({SEGMENTS_SQL})")
def f36_padded_bundles(spark, sf_dir):
    s = low_segments(words(spark, sf_dir))
    return s.select("user_id", "seg", F.greatest(F.lit(0), F.col("start") - 5).alias("lo"), F.least(F.lit(1706659200), F.col("stop") + 5).alias("hi"))


@query()
def a23_balanced_batches(spark, sf_dir):
    s = low_segments(words(spark, sf_dir)).select("user_id", F.col("seg").alias("pos"), (F.col("stop") - F.col("start")).cast("double").alias("duration"))
    return balanced_batches(s, "user_id", most=4)


@query("SELECT event_id AS id, value < 60 AS is_low FROM events")
def p13_classify_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") < 60).alias("is_low"))


@query(f"SELECT event_id AS id, lag(speaker) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first FROM {WORDS_SQL}")
def w5_previous_word(spark, sf_dir):
    return words(spark, sf_dir).select(F.col("event_id").alias("id"), F.lag("speaker").over(order()).alias("previous"), (F.row_number().over(order()) == 1).alias("is_first"))


@query(
    f"""
    SELECT event_id AS id, CASE WHEN known THEN count(*) OVER t ELSE count(*) OVER w END AS n, CASE WHEN known THEN min(event_id) OVER t ELSE min(event_id) OVER w END AS lowest FROM
    (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM
     (SELECT *, speaker <> 'error' AS known, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS f FROM {WORDS_SQL}))
    WINDOW t AS (PARTITION BY user_id, turn), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING)
    """
)
def w7_context_frame(spark, sf_dir):
    """The run of words of one speaker around a word, or 40 words to either side where it has no speaker (here: error)."""
    w = words(spark, sf_dir)
    flag = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order())), 0).otherwise(1)
    w = w.withColumn("f", flag).withColumn("turn", F.sum("f").over(order())).withColumn("known", F.col("speaker") != "error")
    turn, near = Window.partitionBy("user_id", "turn"), order().rowsBetween(-40, 40)
    pick = lambda c: F.when(F.col("known"), c.over(turn)).otherwise(c.over(near))
    return w.select(F.col("event_id").alias("id"), pick(F.count("*")).alias("n"), pick(F.min("event_id")).alias("lowest"))


@query(f"SELECT event_id AS id, 'w' || (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS source_word_id FROM {WORDS_SQL}")
def w12_source_word_ids(spark, sf_dir):
    return words(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat(F.lit("w"), F.row_number().over(order()) - 1).alias("source_word_id"))


@query(
    f"""
    SELECT user_id, arg_max(pos, (pause, -pos)) AS pos, max(pause) AS pause FROM
    (SELECT user_id, row_number() OVER w - 1 AS pos, start - lag(stop) OVER w AS pause FROM {WORDS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE pos BETWEEN 10 AND 19 AND pause >= 2 GROUP BY 1
    """
)
def w11_longest_pause(spark, sf_dir):
    """The longest pause of at least two seconds in a range of places, the first of equals."""
    w = words(spark, sf_dir).select("user_id", (F.row_number().over(order()) - 1).cast("long").alias("pos"), (F.col("start") - F.lag("end").over(order())).alias("pause"))
    w = w.where("pos between 10 and 19 and pause >= 2")
    return w.groupBy("user_id").agg(F.max_by("pos", F.struct("pause", -F.col("pos"))).alias("pos"), F.max("pause").alias("pause"))


@query(
    f"""
    SELECT user_id, chunk, string_agg(speaker, ' ' ORDER BY ts, event_id) AS text, count(*) AS n FROM
    (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 30 AS chunk FROM {WORDS_SQL}) GROUP BY 1, 2
    """
)
def r13_fixed_chunks(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("chunk", F.floor((F.row_number().over(order()) - 1) / 30))
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "speaker")))
    return w.groupBy("user_id", "chunk").agg(F.array_join(F.transform(rows, lambda x: x["speaker"]), " ").alias("text"), F.count("*").alias("n"))


@query()
def r5_turn_chunks(spark, sf_dir):
    w = words(spark, sf_dir).select("user_id", "ts", "event_id", F.col("speaker").alias("word"), F.lit("s").alias("speaker"), "start", "end")
    return turn_chunks(w, "user_id", ["ts", "event_id"], least=10, most=20)


ASR = "'{\"results\":{\"channels\":[{\"alternatives\":[{\"transcript\":\"' || event_type || ' x\",\"words\":[{\"word\":\"' || event_type || '\",\"start\":' || (event_id % 7) || '.5,\"confidence\":0.5,\"extra\":1},{\"word\":\"x\",\"start\":9.0}]}]}]}}'"


@query("SELECT event_id AS id, i::BIGINT AS pos, CASE i WHEN 0 THEN event_type ELSE 'x' END AS word, CASE i WHEN 0 THEN event_id % 7 + 0.5::DOUBLE ELSE 9.0 END AS start, CASE i WHEN 0 THEN 0.5::DOUBLE END AS confidence FROM events, (VALUES (0), (1)) v(i)")
def s9_asr_response_words(spark, sf_dir):
    from ..sources.readers import asr_words

    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(ASR).alias("response"))
    return asr_words(raw, "id", "response").select("id", "pos", "word", "start", "confidence")


@query("SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT % 600 + 600 * (event_id % 4) AS start FROM events")
def s11_chunk_concat(spark, sf_dir):
    """Words of chunk k of a recording are shifted by the chunk's start."""
    local = F.unix_timestamp("ts") % 600
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (local + 600 * (F.col("event_id") % 4)).alias("start"))


@query(
    f"""
    SELECT user_id, start, event_id AS id, speaker AS word, false AS corrected FROM {WORDS_SQL} WHERE confidence >= 60
    UNION ALL SELECT user_id, start, first_id, 'fixed', true FROM ({SEGMENTS_SQL})
    """
)
def f38_reassemble(spark, sf_dir):
    w = words(spark, sf_dir)
    kept = w.where("confidence >= 60").select("user_id", "start", F.col("event_id").alias("id"), F.col("speaker").alias("word"), F.lit(False).alias("corrected"))
    fixed = low_segments(w).select("user_id", "start", F.col("first_id").alias("id"), F.lit("fixed").alias("word"), F.lit(True).alias("corrected"))
    return kept.unionByName(fixed)


@query(
    f"""
    SELECT a.user_id, a.event_id AS id, a.start FROM (SELECT *, row_number() OVER (PARTITION BY user_id, start, speaker ORDER BY event_id) AS k FROM {WORDS_SQL}) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, start, speaker ORDER BY event_id) AS k FROM {WORDS_SQL} WHERE event_id % 3 = 0) b
    ON a.user_id = b.user_id AND a.start = b.start AND a.speaker = b.speaker AND a.k = b.k
    """
)
def j14_merge_by_occurrence(spark, sf_dir):
    """Segments meet source words by (start, text), the k-th occurrence of one with the k-th of the other."""
    nth = Window.partitionBy("user_id", "start", "speaker").orderBy("event_id")
    w = words(spark, sf_dir).select("user_id", "event_id", "start", "speaker")
    a = w.withColumn("k", F.row_number().over(nth))
    b = w.where("event_id % 3 = 0").withColumn("k", F.row_number().over(nth)).drop("event_id")
    return a.join(b, ["user_id", "start", "speaker", "k"]).select("user_id", F.col("event_id").alias("id"), "start")


def _applied(rows):
    own, new = F.split("text", " "), F.split(F.when(F.col("turn") % 2 == 0, F.upper("text")).otherwise(F.concat("text", F.lit(" x"))), " ")
    made = F.when(F.size(own) == F.size(new), F.zip_with(own, new, lambda a, b: F.coalesce(b, a))).otherwise(own)
    return rows.select("conv_id", "turn", F.array_join(made, " ").alias("aligned"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(upper(text), 'ẞ', 'SS') ELSE text END AS aligned FROM conversations")  # DuckDB has a capital of ß
def r11_equal_length_apply(spark, sf_dir):
    return _applied(table(spark, sf_dir, "conversations"))


def _guarded(rows):
    return rows.select("conv_id", "turn", F.when(F.col("text").rlike("[0-9]{4}"), F.col("text")).otherwise(F.upper("text")).alias("guarded"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN text ELSE replace(upper(text), 'ẞ', 'SS') END AS guarded FROM conversations")
def r14_guards(spark, sf_dir):
    return _guarded(table(spark, sf_dir, "conversations"))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_DAYS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", *(f"{x}th" for x in _ONES[13:]), "twentieth"]
_DAYS += [*(f"twenty {x}" for x in _DAYS[:9]), "thirtieth", "thirty first"]
_YEARS = {1990 + k: f"nineteen ninety{' ' + _ONES[k] if k else ''}" for k in range(10)} | {2000: "two thousand"} | {2000 + k: f"two thousand and {_ONES[k]}" for k in range(1, 10)}
_MONTHS = "January February March April May June July August September October November December".split()


def spoken_day(day):
    """A date column in words: "the seventh of July nineteen ninety two"."""
    days, months = (F.array(*map(F.lit, x)) for x in (_DAYS, _MONTHS))
    years = F.create_map(*(F.lit(x) for kv in _YEARS.items() for x in kv))
    return F.concat(F.lit("the "), F.element_at(days, F.day(day)), F.lit(" of "), F.element_at(months, F.month(day)), F.lit(" "), years[F.year(day)])


DAY_SQL = "day(o_orderdate) || CASE WHEN day(o_orderdate) IN (11, 12, 13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate)"


@query(
    f"""
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY o_orderkey, i) - 1 AS pos, word, corrected FROM
    (SELECT o_custkey AS user_id, o_orderkey, unnest([0, 1, 2, 3]) AS i, unnest(['on', 'the', {DAY_SQL}, 'ordered']) AS word, unnest([false, false, true, false]) AS corrected FROM orders)
    """
)
def r16_spoken_dates(spark, sf_dir):
    """Every customer's order dates as one stream of spoken words."""
    from ..operators.dates import correct_stream

    said = F.split(F.concat(F.lit("on "), spoken_day(F.col("o_orderdate")), F.lit(" ordered")), " ")
    w = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.posexplode(said).alias("i", "word"))
    w = w.withColumns({"start": F.col("i").cast("double"), "end": F.col("i") + 0.5})
    return correct_stream(w, "user_id", ["o_orderkey", "i"]).select("user_id", "pos", "word", "corrected")


@query(f"SELECT o_orderkey AS id, 'It came on the ' || {DAY_SQL} || ' for ' || o_orderpriority AS text FROM orders")
def r17_spoken_dates_in_text(spark, sf_dir):
    from ..operators.dates import correct_texts

    said = F.concat(F.lit("It came  on "), spoken_day(F.col("o_orderdate")), F.lit(" for "), "o_orderpriority")
    return correct_texts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), said.alias("text")), "text")


#: What is said and what is written, a few for each form and for what is left alone.
SAID = (
    ("two thousand and sixteen", "2016"), ("two thousand", "2000"), ("two thousand and then", "2000 then"), ("nineteen ninety two", "1992"), ("nineteen five", "1905"),
    ("twenty six", "twenty six"), ("twenty sixteen", "2016"), ("nineteen hundred", "nineteen hundred"), ("the nineteen seventies", "the 1970s"), ("nineteen tens", "nineteen tens"),
    ("19 92", "1992"), ("1 992", "1992"), ("18 92", "18 92"), ("seventh July", "7th July"), ("seventh of July nineteen ninety two", "7th July 1992"), ("five of march", "five of march"),
    ("june nineteen ninety two", "June 1992"), ("March fifth twenty twenty four", "March 5th, 2024"), ("December twenty first", "December 21st"), ("may five", "May 5th"),
    ("march thirty two", "march thirty two"), ("3 March 2024", "3rd March, 2024"), ("3 March", "3 March"), ("March 2024", "March 2024"), ("I have three dogs", "I have three dogs"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{to}')" for k, (_, to) in enumerate(SAID)) + ") t(id, text)")
def r18_r25_date_forms(spark, sf_dir):
    from ..operators.dates import correct_texts

    return correct_texts(spark.createDataFrame([(k, said) for k, (said, _) in enumerate(SAID)], "id int, text string"), "text")


@query()
def r8_text_chunks(spark, sf_dir):
    from ..operators.alignment import text_chunks

    return text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def r9_retimed_edits(spark, sf_dir):
    from ..operators.alignment import retimed

    w = words(spark, sf_dir).groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", "event_id", F.col("speaker").alias("word"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))).alias("w")
    )
    kept = F.array_join(F.transform(F.filter("w", lambda x: x["event_id"] % 5 != 0), lambda x: F.when(x["event_id"] % 7 == 0, F.lit("edited")).otherwise(x["word"])), " ")
    return retimed(w.select("user_id", kept.alias("text"), F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("speaker"))).alias("words")), "user_id")

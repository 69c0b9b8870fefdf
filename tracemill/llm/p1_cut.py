"""Problem 1: texts cut off by a length limit or during transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import dealt, interim_table, table

#: An end that was seen so often is judged: it is a usual one if so large a part of its occurrences is followed by a stop.
#: A text of statements lacks its last stop only by exception; a final answer stands without one by rule.
SEEN_TEXT, SEEN_ANSWER = 3, 30
USUAL_TEXT, USUAL_ANSWER = 0.6, 0.002
#: An end without a stop counts as a form of its own if so large a part of all different texts, and so many, have it,
#: and if its words, wherever they occur, stand before a stop or an end so often. A cut that falls on one place of a template is rarer than that.
FORM, LEAST_FORM = 0.002, 5
FORM_ENDS = 0.1
STOP = "¶"

# What may stand in place of the rest of a cut text.
MARK = r"(?:…|\.\.\.|\[\.\.\.\]|\[(?:truncated|cut|cut off)\]|\x{FFFD}|<\|?|<\|[a-z_]{1,40}\|?|\\u?[0-9a-fA-F]{0,3}|\\u[0-9a-fA-F]{4})"
#: Words of a text: lower case, numbers as 0, what stands in \text{} as a, the end of a statement as STOP. @text@ must have single blanks.
WORDS = rf"""split(regexp_replace(regexp_replace(regexp_replace(lower(@text@), r'\d[\d.,]*\d|\d', '0'), r'\\text\{{[^}}]*\}}', r'\\text{{a}}'), r'[.!?。！？]["”’)\]]*(?:\s+|$)|\s*\n\s*', ' {STOP} '), ' ')"""

#: White space at the end of a text says nothing.
BARE = r"rtrim(' \t\n\u000B\u000C\r', @text@)"
#: The end of a text that holds its last statement whole, and the two before: the last 400 letters if a statement ends early in them, else all of it.
TAIL = r"IF(length(@text@) <= 400 OR left(right(@text@, 400), 200) rlike r'[.!?。！？]\s|\n', right(@text@, 400), @text@)"
#: The part of an end that holds its last words whole.
LAST = r"regexp_replace(IF(right(body, 160) rlike r'\s\S+\s+\S+\s+\S+\s+\S+$', right(body, 160), body), r'[^\S\n]+', ' ')"

#: How often three words stand before another one, and before a stop: a stop counts 2^32.
COUNTS = rf"""
    WITH bodies AS (SELECT left(bare, length(bare) - length(regexp_extract(right(bare, 80), r'{MARK}$', 0))) AS body FROM (SELECT {BARE.replace("@text@", "text")} AS bare FROM @texts@)),
    hashed AS (SELECT transform({WORDS.replace("@text@", "body")}, w -> xxhash64(w)) AS h FROM bodies),
    grams AS (SELECT inline(arrays_zip(h, slice(h, 2, size(h)), slice(h, 3, size(h)), slice(h, 4, size(h)))) AS (w1, w2, w3, w4) FROM (SELECT concat(array(xxhash64('')), h) AS h FROM hashed))
    SELECT w1, w2, w3, sum(CASE WHEN w4 = xxhash64('{STOP}') THEN 4294967296L ELSE 1L END) AS seen
    FROM grams WHERE w4 IS NOT NULL AND w3 <> xxhash64('{STOP}') GROUP BY w1, w2, w3
"""

#: A text's end is all that decides; what needs the whole text (open fences and dollars, other forms of its last word) is counted over it.
FIELDS = rf"""
    SELECT id, text_hash, f.* FROM (SELECT id, xxhash64(t) AS text_hash, {BARE.replace("@text@", "t")} AS t, {BARE.replace("@text@", "a")} AS a FROM @texts@) LATERAL VIEW inline(array(
        struct('reasoning' AS field, {TAIL.replace("@text@", "t")} AS tail, (length(t) - length(replace(t, '```', ''))) % 2 = 1 AS fence, (length(t) - length(replace(t, '$', ''))) % 2 = 1 AS dollar, '' AS other),
        struct('final_answer' AS field, a AS tail, false AS fence, false AS dollar, coalesce({TAIL.replace("@text@", "t")}, '') AS other))) f AS field, tail, fence, dollar, other
"""

ENDS = rf"""
    WITH trimmed AS (SELECT id, text_hash, field, fence, dollar, other, length(regexp_extract(tail, r'{MARK}$', 0)) AS mark, tail FROM @fields@ WHERE tail rlike r'\S'),
    bodies AS (SELECT id, text_hash, field, fence, dollar, other, mark > 0 AS marked, {BARE.replace("@text@", "left(tail, length(tail) - mark)")} AS body FROM trimmed),
    seen AS (SELECT id, text_hash, field, fence, dollar, other, marked, body, v.* FROM bodies LATERAL VIEW inline(array(struct(substring_index(body, char(10), -1) AS line))) v AS line WHERE body != ''),
    judged AS (
        SELECT id, text_hash, field, body, v.* FROM seen LATERAL VIEW inline(array(struct(
               marked OR fence
               OR body rlike r'<<[^>]*>?$'
               OR line rlike r'^\s*(?:\d+\.|[-*•])\s*$'
               OR (line rlike r'\d \W \d[\d.,]* = [\d.,]*$' AND NOT body rlike r'[.!?]$')
               OR (dollar AND body rlike r'=[^$=]*\d\.$')
               OR (dollar AND NOT body rlike r'[.!?]$') AS plain_cut,
               line rlike r'(?i)answer: [^\n]{{1,80}}####$' OR body rlike r'[.!?。！？]["”’)\]]*$' AS stopped,
               field = 'final_answer' AND body rlike r'^\W*(?:\\boxed\W*)?-?[\d.,/]*\d(?:\W*|\s+(?:\\text\W*)?\p{{L}}+\W*)$' AND NOT body rlike r'\{{[^}}]*$' AS value,
               CASE WHEN field = 'final_answer' AND instr(other, body) > 0 THEN regexp_extract(substring_index(other, body, -1), r'^[^.\n]*', 0) END AS rest
        ))) v AS plain_cut, stopped, value, rest)
    SELECT id, text_hash, field, body, plain_cut, stopped, value, rest, body rlike r'\p{{L}}$' AS by_letter FROM judged
"""

#: A value is cut only inside its word; a statement that the reasoning goes on with is cut; the rest is left to the trigrams.
SETTLED = r"""
    CASE WHEN plain_cut THEN true
         WHEN field = 'reasoning' AND stopped THEN false
         WHEN value THEN by_letter AND coalesce(rest rlike r'^\p{L}', false)
         WHEN rest IS NOT NULL THEN rest rlike r'[\p{L}\d]'
         WHEN stopped THEN false END
"""

#: The last words of what is left to the trigrams.
LASTS = rf"""
    WITH settled AS (SELECT id, text_hash, field, body, {SETTLED} AS settled FROM @ends@),
    seen AS (SELECT id, text_hash, field, body, settled, v.* FROM settled LATERAL VIEW inline(array(struct(IF(settled IS NULL, {WORDS.replace("@text@", LAST)}, NULL) AS w))) v AS w)
    SELECT id, text_hash, field, settled, IF(w IS NULL, NULL, regexp_extract(lower(body), r'\p{{L}}+$', 0)) AS part, xxhash64(w[size(w) - 1]) AS w3,
           xxhash64(CASE WHEN size(w) > 1 THEN w[size(w) - 2] ELSE '' END) AS w2, xxhash64(CASE WHEN size(w) > 2 THEN w[size(w) - 3] ELSE '' END) AS w1 FROM seen
"""

#: The beginnings of the words of all texts that some open value ends with.
BEGINNINGS = r"""
    WITH parts AS (SELECT DISTINCT part FROM @open@ WHERE part != ''),
    words AS (SELECT DISTINCT word FROM (SELECT explode(array_distinct(split(lower(text), r'[^\p{L}]+'))) AS word FROM @texts@))
    SELECT DISTINCT part FROM (SELECT explode(transform(sequence(1, length(word) - 1), k -> left(word, k))) AS part FROM words WHERE length(word) > 1) LEFT SEMI JOIN parts USING (part)
"""

DECIDE = f"""
    WITH total AS (SELECT count(DISTINCT text_hash) AS n FROM @texts@ WHERE field = 'reasoning'),
    forms AS (SELECT w1, w2, w3, ends FROM (SELECT w1, w2, w3, count(DISTINCT text_hash) AS ends FROM @open@ WHERE field = 'reasoning' GROUP BY w1, w2, w3) e JOIN total WHERE ends >= greatest({LEAST_FORM}, {FORM} * total.n)),
    tri AS (SELECT w1, w2, w3, shiftright(seen, 32) AS stops, (seen & 4294967295L) + shiftright(seen, 32) AS n FROM @counts@),
    bi AS (SELECT w2, w3, sum(stops) AS stops, sum(n) AS n FROM tri GROUP BY w2, w3),
    uni AS (SELECT w3, sum(stops) AS stops, sum(n) AS n FROM bi GROUP BY w3),
    context AS (SELECT w1, w2, sum(stops) AS stops, sum(n) AS n FROM tri GROUP BY w1, w2)
    SELECT o.id, o.field,
           CASE WHEN f.ends + coalesce(t.stops, 0) >= {FORM_ENDS} * (f.ends + coalesce(t.n, 0)) THEN false
                WHEN t.n >= least_seen THEN t.stops < usual * t.n
                WHEN b.n >= least_seen THEN b.stops < usual * b.n
                WHEN u.n >= least_seen THEN u.stops < usual * u.n
                WHEN l.part IS NOT NULL THEN true
                WHEN c.n >= least_seen THEN c.stops < usual * c.n
                ELSE true END AS cut
    FROM (SELECT *, IF(field = 'reasoning', {SEEN_TEXT}, {SEEN_ANSWER}) AS least_seen, IF(field = 'reasoning', {USUAL_TEXT}, {USUAL_ANSWER}) AS usual FROM @open@) o
    LEFT JOIN tri t ON o.w3 = t.w3 AND o.w2 = t.w2 AND o.w1 = t.w1
    LEFT JOIN bi b ON o.w3 = b.w3 AND o.w2 = b.w2
    LEFT JOIN uni u ON o.w3 = u.w3
    LEFT JOIN context c ON o.w1 = c.w1 AND o.w2 = c.w2
    LEFT JOIN @longer@ l ON o.part = l.part
    LEFT JOIN forms f ON o.w3 = f.w3 AND o.w2 = f.w2 AND o.w1 = f.w1
"""


def _sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """The query, whose @name@ stand for the frames; braces mean themselves."""
    query = query.replace("{", "{{").replace("}", "}}")
    for name in frames:
        query = query.replace(f"@{name}@", f"{{{name}}}")
    return spark.sql(query, **frames)


def cut_fields(paths: DataFrame, id_col: str = "path_id", text_col: str = "reasoning", answer_col: str = "final_answer") -> DataFrame:
    """(id, field_name) of the values that stop before their text did.

    Word trigrams of all texts are counted where a word follows and where a
    statement ends. A value without a stop is cut if its last trigram, or where
    that is rare its last two words or its last word, is hardly ever followed by
    a stop. A last word that is rare everywhere is cut if longer words of any
    text begin so, or if what follows the two words before it is hardly
    ever the end of a statement. Ends without a stop that many
    different texts have (an answer line, a closing fence) count as stops, unless
    more words follow them nearly always. Before that, values with a
    mark of the cut or an open delimiter are cut, and values with a stop are
    not; a final answer is held against the closing statement of its reasoning.

    Null and empty values, values of marks alone, and rows with a null id give
    nothing; equal rows count once; other columns are ignored. An empty table
    gives no rows.
    """
    spark = paths.sparkSession
    src = paths.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(answer_col).cast("string").alias("a"))
    fields = _sql(spark, FIELDS, texts=src)
    ends = interim_table(_sql(spark, LASTS, ends=_sql(spark, ENDS, fields=fields)), "ends")
    open_ = ends.where("settled IS NULL")
    texts = src.select(F.col("t").alias("text")).where("text is not null")
    counts = interim_table(_sql(spark, COUNTS, texts=texts), "trigrams")
    decided = _sql(spark, DECIDE, open=open_, texts=ends, counts=counts, longer=_sql(spark, BEGINNINGS, open=open_, texts=texts))
    cut = ends.where("settled").select("id", "field").unionAll(decided.where("cut").select("id", "field"))
    return cut.distinct().select(F.col("id").alias(id_col), F.col("field").alias("field_name"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_fields(dealt(table(spark, sf_dir, "reasoning_paths"), sf_dir, "reasoning_paths"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model (null for unknown): paths, paths with a cut field, and their share."""
    paths = dealt(table(spark, sf_dir, "reasoning_paths"), sf_dir, "reasoning_paths")
    models = paths.where("path_id is not null").groupBy("path_id").agg(F.min("generation_metadata.model").alias("model"))
    cut = cut_fields(paths).select("path_id").distinct().withColumn("cut", F.lit(1))
    joined = models.join(cut, "path_id", "left").groupBy("model").agg(F.count(F.lit(1)).alias("paths"), F.count("cut").alias("cut_paths"))
    return joined.withColumn("cut_share", F.col("cut_paths") / F.col("paths"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL: dict[str, str] = {}
